"""Token ids as ORC files for parallel and selective reading.

Documents are put in order of doc_id by a range exchange, each task encodes its range and writes one ORC file whose
integer columns are run-length encoded, with an index entry every ``row_index`` rows and a Bloom filter on doc_id.
Readers take stripes in parallel and skip those whose statistics or filters rule a doc_id out.

Words between ASCII blanks are encoded once per worker and remembered: the tokenizer neither joins nor looks
beyond white space, so the ids of a text are those of its words in order. Where the tokenizer splits words by
``SPLIT``, they are cut on between ASCII letters and other ASCII characters, where it always begins anew, and ASCII
letters count in lower case, so there is less to encode and to remember. Cutting and counting are array operations;
only the different pieces of two megabytes meet the memory. The memory is bounded.

Defined results. Null or empty text: the end id alone. Rows that share a doc_id stand in order of their texts;
a null doc_id stands first. Repeated rows are each written. An empty table gives no rows. Columns other than doc_id
and text are not read.
"""

from __future__ import annotations

import json
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.llm import textkit as tk
from graphloom.llm.common import new_path, written

END = 2
MEMORY_WORDS = 800_000
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

#: Kinds of bytes: beyond ASCII, ASCII letter, apostrophe, blank that parts words, other ASCII.
_FAR, _LETTER, _APOSTROPHE, _BLANK, _OTHER = range(5)
_KIND = np.array([_FAR if b >= 128 else _LETTER if chr(b).isalpha() else {"'": _APOSTROPHE, " ": _BLANK, "\n": _BLANK}.get(chr(b), _OTHER) for b in range(256)], np.uint8)


def _begins(pairs: list[tuple[int, int]]) -> np.ndarray:
    """For 8 * kind of a byte + kind of the next, whether a piece begins between them: behind blanks, and at the pairs."""
    begins = np.zeros(64, bool)
    begins[8 * _BLANK : 8 * _BLANK + 8] = True
    for a, b in pairs:
        begins[8 * a + b] = True
    return begins


WORDS = _begins([])
#: No piece begins behind an apostrophe, which takes some letters with it, or beside a character that may be a mark on a letter.
PIECES = _begins([(_LETTER, _OTHER), (_LETTER, _APOSTROPHE), (_OTHER, _LETTER)])


@lru_cache(maxsize=1)
def _tokenizer(path: str):
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


class WordMemory:
    """Ids of words in flat arrays. The first ``limit`` different words are kept, others are encoded when they come."""

    def __init__(self, encode, limit: int = MEMORY_WORDS):
        self.encode, self.limit = encode, limit
        self.index: dict[str, int] = {}
        self.ids, self.starts, self.lengths, self.used = np.zeros(1 << 20, np.int32), np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64), 0

    def _put(self, new: list[str]) -> dict[str, int]:
        """Writes the ids of new words behind all others; where they are, if they are not kept."""
        ids, lengths = self.encode(new)
        n = len(self.index)
        while n + len(new) > len(self.starts):
            self.starts, self.lengths = (np.concatenate([x, np.zeros_like(x)]) for x in (self.starts, self.lengths))
        while self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        self.ids[self.used : self.used + len(ids)] = ids
        self.lengths[n : n + len(new)] = lengths
        self.starts[n : n + len(new)] = self.used + np.cumsum(lengths) - lengths
        at = dict(zip(new, range(n, n + len(new)), strict=True))
        if n + len(new) > self.limit:
            return at
        self.index.update(at)
        self.used += len(ids)
        return {}

    def look_up(self, words: list[str], order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of words in order, given as indexes of different words: ids of all one after another, and the number of each one's ids."""
        at = list(map(self.index.get, words))
        if None in at:
            passing = self._put([w for w, k in zip(words, at, strict=True) if k is None])
            at = [passing[w] if k is None else k for w, k in zip(words, at, strict=True)] if passing else list(map(self.index.__getitem__, words))
        at = np.array(at, np.int64)[order]
        lengths = self.lengths[at]
        ends = np.cumsum(lengths)
        take = np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.starts[at] - (ends - lengths), lengths)
        return self.ids[take], lengths


def flat(ids: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    lengths = np.fromiter(map(len, ids), np.int64, len(ids))
    return np.fromiter((i for x in ids for i in x), np.int32, int(lengths.sum())), lengths


class WordEncoder:
    """Encodes many words in one text: words of letters with a blank between them, others with a special token."""

    def __init__(self, tokenizer):
        from tokenizers.pre_tokenizers import ByteLevel

        self.tokenizer = tokenizer
        added = sorted(tokenizer.get_added_tokens_decoder().items())
        self.name, self.mark = next(((t.content, i) for i, t in added if t.special and not t.normalized), (None, None))
        self.names = [t.content for _, t in added]
        form = json.loads(tokenizer.to_str())
        steps = [{"type": "Split", "pattern": {"Regex": SPLIT}, "behavior": "Removed", "invert": True}, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]
        normal = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
        #: Whether ``PIECES`` are encoded as they are within a text. The names of added tokens are looked for in texts as they came.
        self.cuts = form["pre_tokenizer"] == {"type": "Sequence", "pretokenizers": steps} and form["normalizer"] == {"type": "Sequence", "normalizers": normal} and not any(t.normalized for _, t in added)
        suffix, vocabulary = form["model"].get("end_of_word_suffix"), tokenizer.get_vocab(with_added_tokens=False)
        #: Of each id whether it ends what the tokenizer takes for a word, if every byte has such an id.
        self.ends = None
        if self.cuts and suffix and all(c + suffix in vocabulary for c in ByteLevel.alphabet()):
            self.ends = np.zeros(max(tokenizer.get_vocab().values()) + 1, bool)
            self.ends[[i for w, i in vocabulary.items() if w.endswith(suffix)]] = True

    def __call__(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words one after another, and the number of each word's ids."""
        if self.ends is None:
            return self._marked(words)
        plain = np.fromiter(map(str.isalpha, words), bool, len(words))
        plain_ids, plain_lengths = self._plain([w for w, p in zip(words, plain, strict=True) if p])
        other_ids, other_lengths = self._marked([w for w, p in zip(words, plain, strict=True) if not p])
        lengths = np.zeros(len(words), np.int64)
        lengths[plain], lengths[~plain] = plain_lengths, other_lengths
        is_plain, ids = np.repeat(plain, lengths), np.zeros(int(lengths.sum()), np.int32)
        ids[is_plain], ids[~is_plain] = plain_ids, other_ids
        return ids, lengths

    def _joined(self, texts: list[str]) -> np.ndarray:
        return np.concatenate([np.zeros(0, np.int32), *(np.array(e.ids, np.int32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False))])

    def _plain(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Each word of letters has an end at least; with as many ends as words, each has one."""
        ids = self._joined([" ".join(words[k : k + 1000]) for k in range(0, len(words), 1000)])
        ends = np.flatnonzero(self.ends[ids])
        return (ids, np.diff(ends, prepend=-1)) if len(ends) == len(words) else self._marked(words)

    def _marked(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        if self.mark is None or any(self.name in w for w in words):
            return flat([e.ids for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)])
        ids = self._joined([self.name + f" {self.name} ".join(words[k : k + 1000]) for k in range(0, len(words), 1000)])
        marks = np.flatnonzero(ids == self.mark)
        return ids[ids != self.mark], np.diff(np.append(marks, len(ids))) - 1


def pieces(data: np.ndarray, offsets: np.ndarray, begins: np.ndarray) -> tuple[pa.DictionaryArray, np.ndarray]:
    """The words of texts, or what ``begins`` cuts them into; for each text the index of its first one, with their number last."""
    kind = _KIND[data]
    inside = kind != _BLANK
    first = np.zeros(len(data), bool)
    first[1:] = begins[8 * kind[:-1] + kind[1:]]
    first[offsets[:-1][offsets[:-1] < len(data)]] = True
    if begins is PIECES:  # not where a mark may follow: NFC joins some letters with it in lower case only
        marked = np.zeros(len(data), bool)
        marked[:-1] = kind[1:] == _FAR
        data = np.where(marked, data, tk.LOWER[data])
    starts = np.flatnonzero(first & inside)
    own = np.append(np.flatnonzero(first[inside]), np.count_nonzero(inside)).astype(np.int32)
    found = pa.Array.from_buffers(pa.string(), len(starts), [None, pa.py_buffer(own), pa.py_buffer(data[inside])])
    return found.dictionary_encode(), np.searchsorted(starts, offsets)


@lru_cache(maxsize=1)
def _memory(path: str) -> WordMemory:
    """Kept by the Python worker from task to task."""
    return WordMemory(WordEncoder(_tokenizer(path)))


def _encode(path: str, end: int):
    def run(batches):
        memory = _memory(path)
        position = 0
        for batch in batches:
            for lo, hi, data, offsets in tk.chunks(batch.column("text")):
                part = batch.slice(lo, hi - lo)
                cuts = memory.encode.cuts and not any(pc.any(pc.match_substring(part.column("text"), name)).as_py() for name in memory.encode.names)
                found, firsts = pieces(data, offsets, PIECES if cuts else WORDS)
                ids, lengths = memory.look_up(found.dictionary.to_numpy(zero_copy_only=False).tolist(), found.indices.to_numpy())
                ends = np.append(0, np.cumsum(lengths))[firsts[1:]]
                whole = np.insert(ids, ends, end).astype(np.int32)
                yield pa.record_batch([part.column("doc_id"), pa.array(np.arange(position, position + hi - lo)), tk.list_array(whole, np.diff(ends, prepend=0) + 1, pa.int32())], ["doc_id", "position", "ids"])
                position += hi - lo

    return run


def write(docs: DataFrame, path: str, tokenizer_path: str, end: int = END, row_index: int = 1000) -> None:
    """Writes doc_id, position (in its file) and ids, in ascending order of doc_id within and across files."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    ordered = texts.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    encoded = ordered.mapInArrow(_encode(tokenizer_path, end), "doc_id long, position long, ids array<int>")
    options = {"orc.bloom.filter.columns": "doc_id", "orc.bloom.filter.fpp": "0.01", "orc.row.index.stride": str(row_index), "orc.create.index": "true", "compression": "zlib"}
    encoded.write.options(**options).orc(path)


def read(spark: SparkSession, path: str, doc_ids: list[int] | None = None) -> DataFrame:
    """doc_id, position, ids, file; with doc_ids, ORC's statistics and Bloom filters prune stripes and row groups."""
    rows = spark.read.schema("doc_id long, position long, ids array<int>").orc(path)
    rows = rows if doc_ids is None else rows.filter(F.col("doc_id").isin(doc_ids))
    return rows.withColumn("file", F.input_file_name())


def _sums(batches):
    for batch in batches:
        ids, offsets = tk.list_parts(batch.column("ids"))
        raw = memoryview(np.ascontiguousarray(ids, "<u4")).cast("B")
        sums = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
        yield pa.record_batch([batch.column("doc_id"), batch.column("position"), batch.column("file"), pa.array(np.diff(offsets)), pa.array(sums, pa.int64())], ["doc_id", "position", "file", "n_tokens", "ids_crc32"])


def file_number(file: Column) -> Column:
    return F.regexp_extract(file, "part-([0-9]+)-[^/]*$", 1).cast("long")


def index(spark: SparkSession, path: str) -> DataFrame:
    """From the files, for each document: doc_id, start (ids of all documents before it), n_tokens, ids_crc32."""
    # Written, as it is used twice: the ids are read once.
    own = written(read(spark, path).mapInArrow(_sums, "doc_id long, position long, file string, n_tokens long, ids_crc32 long"), "tokens-sums")
    # Spark numbers the files of a range exchange in order: part-00000 holds the lowest doc_ids. The numbers count, not the names, which grow beyond 99999.
    files = own.groupBy("file").agg(F.sum("n_tokens").alias("total"))
    files = files.select("file", (F.sum("total").over(Window.orderBy(file_number(F.col("file")))) - F.col("total")).alias("before"))
    inside = F.sum("n_tokens").over(Window.partitionBy("file").orderBy("position")) - F.col("n_tokens")
    return own.withColumn("inside", inside).join(files, "file").select("doc_id", (F.col("before") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32")


def encode_and_index(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    path = new_path(docs.sparkSession, "tokens-orc")
    write(docs, path, tokenizer_path)
    return index(docs.sparkSession, path)
