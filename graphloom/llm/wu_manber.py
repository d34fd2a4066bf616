"""Benchmark contamination by Wu-Manber multi-pattern search over words.

The patterns are windows of 13 consecutive words of benchmark items (an item of fewer words is one window). For
patterns of one length, a shift table over hashed blocks of two words tells how far a position can be skipped,
positions of shift 0 look up the bucket of their suffix block, the prefix block is compared, and the words
themselves are compared last. All segments of a batch of documents are scanned in step, each at its own pace.

The benchmark's pattern tables are broadcast in blocks of at most ``block_chars`` characters; a larger benchmark
takes more passes over the documents, each written to the shared folder, and nothing is left out.

Defined results. Null or empty text: no words, no hits, not contaminated. Null, empty or wordless items have no
window. Repeated rows, and rows that share a doc_id, are judged each by its own text; items that share a window
are all reported; rows that share an item_id are one item. An item without item_id is no item. An empty table
gives an empty result, an empty benchmark no hits. Columns other than those named are not read.
"""

from __future__ import annotations

import hashlib
import math
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm import textkit as tk
from graphloom.llm.common import written

WINDOW = 13
BLOCK = 2
TABLE_BITS = 18
SEGMENT = 256
_MASK = np.uint64((1 << TABLE_BITS) - 1)


def _blocks(h: np.ndarray, size: int) -> np.ndarray:
    return tk.pairs(h) if size == 2 else h


class Patterns:
    """Shift table and buckets of all patterns of one length."""

    def __init__(self, length: int, windows: dict[tuple[bytes, ...], set[int]]):
        self.length, self.block = length, min(BLOCK, length)
        self.shift = np.full(1 << TABLE_BITS, length - self.block + 1, np.int64)
        self.buckets: dict[int, list[tuple[int, tuple[bytes, ...], frozenset[int]]]] = defaultdict(list)
        for window, items in windows.items():
            h = _hash_words(window)
            b = _blocks(h, self.block)
            np.minimum.at(self.shift, (b & _MASK).astype(np.int64), len(b) - 1 - np.arange(len(b)))
            self.buckets[int(b[-1])].append((int(b[0]), window, frozenset(items)))

    def occurrences(self, h: np.ndarray, rows: np.ndarray, word_at) -> list[tuple[int, frozenset[int]]]:
        """(index of the first word, items) of every occurrence; rows: where each document's words begin."""
        n, back = self.length, self.length - self.block
        lo, hi = rows[:-1] + n - 1, rows[1:] - 1
        full = hi >= lo
        lo, hi = lo[full], hi[full]
        if not len(lo):
            return []
        pieces = (hi - lo) // SEGMENT + 1
        at = np.repeat(lo, pieces) + SEGMENT * (np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces))
        until = np.minimum(at + SEGMENT - 1, np.repeat(hi, pieces))
        b, found = _blocks(h, self.block), []
        while len(at):
            step = self.shift[(b[at - self.block + 1] & _MASK).astype(np.int64)]
            stop = step == 0
            for end in at[stop].tolist():
                for prefix, window, items in self.buckets.get(int(b[end - self.block + 1]), ()):
                    first = end - n + 1
                    if prefix == int(b[end - back - self.block + 1]) and all(word_at(first + k) == w for k, w in enumerate(window)):
                        found.append((first, items))
            at = at + np.where(stop, 1, step)
            live = at <= until
            at, until = at[live], until[live]
        return found


def _hash_words(words: tuple[bytes, ...]) -> np.ndarray:
    data = np.frombuffer(b" ".join(words), np.uint8)
    starts, ends, _ = tk.words(data, np.array([0, len(data)]), tk.ALNUM)
    return tk.word_hashes(data, starts, ends)


def item_windows(items: list[tuple[int, str]], width: int = WINDOW) -> dict[int, dict[tuple[bytes, ...], set[int]]]:
    """By length: each distinct window with the items that have it."""
    out: dict[int, dict[tuple[bytes, ...], set[int]]] = defaultdict(lambda: defaultdict(set))
    for item_id, text in items:
        data = tk.LOWER[np.frombuffer((text or "").encode(), np.uint8)]
        starts, ends, _ = tk.words(data, np.array([0, len(data)]), tk.ALNUM)
        raw = data.tobytes()
        words = [raw[s:e] for s, e in zip(starts, ends, strict=True)]
        for k in range(max(1, len(words) - width + 1) if words else 0):
            window = tuple(words[k : k + width])
            out[len(window)][window].add(item_id)
    return out


#: What a pass finds, under names that no table has.
WORDS, HIT, ITEMS = "__wm_words", "__wm_hit", "__wm_items"
STATE = f"{WORDS} long, {HIT} binary, {ITEMS} array<long>"


def _scan(tables, keep: list[str]):
    """Adds one block of patterns to what earlier passes found: a bit for each hit word, and the items."""

    def run(batches):
        patterns = tables.value
        for batch in batches:
            known = HIT in batch.schema.names
            for lo, hi, data, offsets in tk.chunks(batch.column("text")):
                data = tk.LOWER[data]
                starts, ends, rows = tk.words(data, offsets, tk.ALNUM)
                h, raw = tk.word_hashes(data, starts, ends), data.tobytes()
                change, items = np.zeros(len(h) + 1, np.int64), defaultdict(set)
                for p in patterns:
                    for first, those in p.occurrences(h, rows, lambda k: raw[starts[k] : ends[k]]):  # noqa: B023
                        change[first] += 1
                        change[first + p.length] -= 1
                        items[int(np.searchsorted(rows, first, side="right")) - 1] |= those
                hit = np.cumsum(change)[:-1] > 0
                part = batch.slice(lo, hi - lo)
                bits = [np.packbits(hit[a:b]).tobytes() if b > a and hit[a:b].any() else b"" for a, b in zip(rows[:-1], rows[1:], strict=True)]
                if known:
                    for k, (old, its) in enumerate(zip(part.column(HIT).to_pylist(), part.column(ITEMS).to_pylist(), strict=True)):
                        if old:
                            bits[k] = (np.frombuffer(old, np.uint8) | np.frombuffer(bits[k] or bytes(len(old)), np.uint8)).tobytes()
                            items[k] |= set(its)
                found = pa.array([sorted(items.get(k, ())) for k in range(hi - lo)], pa.list_(pa.int64()))
                yield pa.record_batch([*[part.column(c) for c in keep], pa.array(np.diff(rows)), pa.array(bits, pa.binary()), found], [*keep, WORDS, HIT, ITEMS])

    return run


def _scanned(docs: DataFrame, benchmark: DataFrame, window: int, block_chars: int, kept: list[str]) -> tuple[DataFrame, Column, Column]:
    """The columns of kept and what all passes find; the number of hit words, and whether that is contamination."""
    spark = docs.sparkSession
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).filter("item_id is not null and text is not null")
    blocks = max(1, math.ceil((items.agg(F.sum(F.length("text"))).first()[0] or 0) / block_chars))
    state = docs.select(*[F.col(c) for c in dict.fromkeys([*kept, "text"])]).withColumn("text", F.col("text").cast("string"))
    for k in range(blocks):
        some = items.filter(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == k) if blocks > 1 else items
        tables = spark.sparkContext.broadcast([Patterns(n, w) for n, w in item_windows([tuple(r) for r in some.collect()], window).items()])
        last = k == blocks - 1
        columns = kept if last else list(dict.fromkeys([*kept, "text"]))
        schema = ", ".join(f"`{c}` {state.schema[c].dataType.simpleString()}" for c in columns)
        state = state.mapInArrow(_scan(tables, columns), f"{schema}, {STATE}")
        if not last:
            state = written(state, "scanned")
            tables.destroy()
    n_hit = F.coalesce(F.aggregate(F.sequence(F.lit(1), F.length(HIT)), F.lit(0).cast("long"), lambda a, i: a + F.bit_count(F.conv(F.hex(F.substring(HIT, i, F.lit(1))), 16, 10).cast("int"))), F.lit(0).cast("long"))
    n_hit = F.when(F.length(HIT) > 0, n_hit).otherwise(F.lit(0).cast("long"))
    return state, n_hit, (n_hit > 0) & (20 * n_hit >= F.col(WORDS))


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_chars: int = 4_000_000) -> DataFrame:
    """For each row of docs: doc_id, n_words, n_hit, items (sorted), contaminated."""
    state, n_hit, contaminated = _scanned(docs, benchmark, window, block_chars, ["doc_id"])
    return state.select("doc_id", F.col(WORDS).alias("n_words"), n_hit.alias("n_hit"), F.col(ITEMS).alias("items"), contaminated.alias("contaminated"))


def clean(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_chars: int = 4_000_000) -> DataFrame:
    """The rows of docs that are not contaminated, with all their columns."""
    state, _, contaminated = _scanned(docs, benchmark, window, block_chars, docs.columns)
    return state.filter(~contaminated).select(*docs.columns)


def items_digest(items: list[int]) -> str:
    return hashlib.sha256(",".join(sorted(map(str, items))).encode()).hexdigest()
