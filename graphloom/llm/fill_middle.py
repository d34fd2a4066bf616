"""Fill-in-middle training texts, cut between lines that content-defined chunks locate.

A text is cut into chunks where a rolling hash of its last bytes has a given form, so equal passages give equal chunks
wherever they stand. What a chunk knows of itself, where its lines end and how many code points it has, is worked out
once per worker and kept under its bytes: a chunk met again is compared with the kept bytes, never with a hash alone.
Sums over a text's chunks say how many lines it has, and which chunk holds the cut after the k-th line.

A line is ``[^\\n]*\\n`` or the rest behind the last line end. Both cuts, the kind of the text and the order of its parts
come from a keyed digest of doc_id, so every run and every partitioning gives the same.

Defined results. Null text is the empty one; it is plain, as are texts that contain a mark. A null doc_id counts as no
digits. A text without a line end is one line. Repeated rows each give their row. A chunk never exceeds ``LONGEST``
bytes, so a long text without line ends, or of one repeated character, has many. The kept chunks of a worker take
``KEPT_BYTES`` at most; beyond that they are let go and worked out anew. Columns other than doc_id and text are not
read. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SEED = 7
#: The marks before prefix, suffix and middle.
MARKS = ("<P>", "<S>", "<M>")
#: Of 100 texts, how many are rearranged, and how many of these have the suffix first.
RATE, SUFFIX_FIRST = 100, 50
#: A chunk ends where the low bits of the rolling hash are 0: 2 ** CHUNK_BITS bytes in the mean, LONGEST at most.
CHUNK_BITS, LONGEST = 11, 1 << 16
KEPT_BYTES = 64_000_000
SCHEMA = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"


@lru_cache(maxsize=1)
def _gear() -> np.ndarray:
    """A number of 32 bits for each byte."""
    return np.array([int.from_bytes(hashlib.sha256(bytes([b])).digest()[:4], "little") for b in range(256)], np.uint32)


def rolling(data: np.ndarray) -> np.ndarray:
    """For each byte the sum of the numbers of the last 32 bytes, each shifted by its distance: doubling spans instead of a loop over bytes."""
    h = _gear()[data]
    for span in (1, 2, 4, 8, 16):
        ahead = h[:-span] << np.uint32(span)
        h = h.copy()
        h[span:] += ahead
    return h


def chunk_ends(data: np.ndarray, bits: int = CHUNK_BITS, longest: int = LONGEST) -> np.ndarray:
    """Ends (exclusive) of the chunks of a text's bytes."""
    if not len(data):
        return np.zeros(0, np.int64)
    # The form is looked for in the high bits, which all 32 bytes reach.
    ends = np.flatnonzero(rolling(data) >> np.uint32(32 - bits) == 0) + 1
    ends = np.append(ends, len(data)) if not len(ends) or ends[-1] != len(data) else ends
    gaps = np.diff(ends, prepend=0)
    if gaps.max() <= longest:
        return ends
    return np.concatenate([np.append(np.arange(e - g + longest, e, longest), e) for e, g in zip(ends.tolist(), gaps.tolist(), strict=True)])


class Chunks:
    """Summaries of chunks by their bytes: places behind line ends, and the number of code points."""

    def __init__(self, limit: int = KEPT_BYTES):
        self.limit, self.used, self.kept = limit, 0, {}

    def summary(self, chunk: bytes) -> tuple[np.ndarray, int]:
        found = self.kept.get(chunk)  # a dictionary compares the bytes themselves
        if found is None:
            own = np.frombuffer(chunk, np.uint8)
            found = (np.flatnonzero(own == 10) + 1).astype(np.int32), len(own) - int(np.count_nonzero((own & 0xC0) == 0x80))
            size = len(chunk) + 4 * len(found[0]) + 300
            if self.used + size > self.limit:
                self.kept, self.used = {}, 0
            self.kept[chunk] = found
            self.used += size
        return found


class Layout:
    """Where the lines of a text end, from the summaries of its chunks."""

    def __init__(self, text: bytes, chunks: Chunks):
        self.text = text
        self.ends = chunk_ends(np.frombuffer(text, np.uint8))
        self.starts = np.concatenate([[0], self.ends[:-1]]) if len(self.ends) else self.ends
        self.parts = [chunks.summary(text[a:b]) for a, b in zip(self.starts.tolist(), self.ends.tolist(), strict=True)]
        self.lines = np.cumsum([len(x[0]) for x in self.parts], dtype=np.int64)
        self.points = np.cumsum([x[1] for x in self.parts], dtype=np.int64)

    def __len__(self) -> int:
        """The number of lines; a rest behind the last line end is one."""
        return (int(self.lines[-1]) if len(self.lines) else 0) + (len(self.text) > 0 and self.text[-1] != 10)

    def behind(self, k: int) -> tuple[int, int]:
        """(bytes, code points) before the cut behind line k."""
        if not k:
            return 0, 0
        if not len(self.lines) or k > self.lines[-1]:
            return len(self.text), int(self.points[-1]) if len(self.points) else 0
        c = int(np.searchsorted(self.lines, k))
        inside = int(self.parts[c][0][k - 1 - (int(self.lines[c - 1]) if c else 0)])
        own = np.frombuffer(self.text, np.uint8, inside, int(self.starts[c]))
        points = inside - int(np.count_nonzero((own & 0xC0) == 0x80))
        return int(self.starts[c]) + inside, points + (int(self.points[c - 1]) if c else 0)


def draws(doc_id: int | None, seed: int = SEED) -> list[int]:
    """Four numbers of 32 bits."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(digest[k : k + 8], 16) for k in range(0, 32, 8)]


def rearranged(doc_id: int | None, text: str | None, chunks: Chunks, seed: int = SEED, rate: int = RATE, suffix_first: int = SUFFIX_FIRST) -> tuple:
    """(n, form, prefix_chars, middle_chars, output) of one text."""
    raw = (text or "").encode()
    layout = Layout(raw, chunks)
    n, (h1, h2, h3, h4) = len(layout), draws(doc_id, seed)
    if not raw or h3 % 100 >= rate or any(m.encode() in raw for m in MARKS):
        return n, "plain", None, None, raw.decode()
    first, second = sorted((h1 % (n + 1), h2 % (n + 1)))
    (a, before), (b, until) = layout.behind(first), layout.behind(second)
    prefix, middle, suffix = (x.decode() for x in (raw[:a], raw[a:b], raw[b:]))
    p, s, m = MARKS
    form = "spm" if h4 % 100 < suffix_first else "psm"
    return n, form, before, until - before, f"{s}{suffix}{p}{prefix}{m}{middle}" if form == "spm" else f"{p}{prefix}{s}{suffix}{m}{middle}"


@lru_cache(maxsize=1)
def _chunks(limit: int) -> Chunks:
    """Kept by the Python worker from task to task."""
    return Chunks(limit)


def _transform(seed: int, rate: int, suffix_first: int, limit: int):
    def run(batches):
        chunks = _chunks(limit)
        for batch in batches:
            for lo in range(0, batch.num_rows, 200):
                ids, texts = (batch.slice(lo, 200).column(c).to_pylist() for c in ("doc_id", "text"))
                columns = zip(*(rearranged(i, t, chunks, seed, rate, suffix_first) for i, t in zip(ids, texts, strict=True)), strict=True)
                kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string())
                yield pa.record_batch([pa.array(ids, pa.int64()), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    return run


def transform(docs: DataFrame, seed: int = SEED, rate: int = RATE, suffix_first: int = SUFFIX_FIRST, kept_bytes: int = KEPT_BYTES) -> DataFrame:
    """doc_id, n (lines), form (plain, psm or spm), prefix_chars, middle_chars (null if plain) and output of every document."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return own.mapInArrow(_transform(seed, rate, suffix_first, kept_bytes), SCHEMA)


def restored(output: Column, form: Column) -> Column:
    """The text from what ``transform`` made of it. A rearranged text contains no mark, so the first one of each kind is the one that was put there."""
    p, s, m = MARKS
    psm = F.regexp_replace(output, f"(?s)^{p}(.*?){s}(.*?){m}(.*)$", "$1$3$2")
    spm = F.regexp_replace(output, f"(?s)^{s}(.*?){p}(.*?){m}(.*)$", "$2$3$1")
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def digests(docs: DataFrame) -> DataFrame:
    """What ``transform`` gives, with SHA-256 of the output and of the text restored from it."""
    made = transform(docs)
    digest = lambda c: F.sha2(F.encode(c, "UTF-8"), 256)
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest(F.col("output")).alias("output_sha256"), digest(restored(F.col("output"), F.col("form"))).alias("restored_sha256"))
