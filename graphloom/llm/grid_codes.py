"""Vectors as short codes: each of several parts becomes the number of its nearest codebook entry, found by memoised grid cells.

A part lies in a cell of a coarse grid. For the cell's box the least and the largest squared distance to every entry
are known, and an entry whose least distance exceeds the smallest of the largest distances is nearest to no point of
the box. The entries that are left are remembered under the cell, and only they are compared with the parts in it.
Nothing is approximate: all is integer arithmetic, and the code is that of a comparison with every entry.

The codebooks are refined in rounds, each one pass over the vectors: tasks add up what they assign, the sums (one row
for each entry and position and task) meet in an exchange, and the new codebooks, whose size the parameters bound,
go to the tasks of the next round.

Defined results. Rows whose vector is null, or has a null, infinite or undefined component, are left out; so are those
whose length is not that of the first kept vector, in order of vec_id, or is 0 (where no vector is kept, nothing is
returned). Parts differ by one component at most if the length is no multiple of their number. Rows that share a vec_id
stand in order of their components; a null vec_id stands last. Fewer vectors than entries give as many entries. Repeated
rows each give their row. A component of 2 ** 17 or more raises ValueError: its squares would not add up exactly.
Columns other than vec_id, embedding and label are not read.
"""

from __future__ import annotations

import hashlib
from collections import OrderedDict
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm import textkit as tk
from graphloom.llm.common import written

SCALE, PARTS, ENTRIES, ROUNDS = 1024, 4, 256, 4
#: Width of a grid cell, in units of the scaled components.
CELL = 32
#: Cells that a worker remembers for a part and a codebook; the oldest go first, and are worked out anew when they come again.
KEPT_CELLS = 20_000
LARGEST = 1 << 17


def prepared(vectors: DataFrame) -> DataFrame:
    """vec_id, label and the scaled components of the vectors that are kept."""
    x = F.col("embedding")
    whole = x.isNotNull() & ~F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    own = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").alias("label"), F.col("embedding").cast("array<double>").alias("embedding")).filter(whole & (F.size("embedding") > 0))
    large = F.exists(x, lambda c: F.abs(c) >= LARGEST)
    scaled = F.transform(F.when(large, F.raise_error(F.lit(f"a component of a vector is {LARGEST} or more"))).otherwise(x), lambda c: F.floor(c * SCALE).cast("long"))
    return own.select("vec_id", "label", scaled.alias("scaled"))


def bounds(dims: int, parts: int = PARTS) -> list[int]:
    """Where the parts of a vector begin, and its end."""
    return [dims * k // parts for k in range(parts + 1)]


class Finder:
    """Nearest entries of one codebook, by cells that are remembered."""

    def __init__(self, book: np.ndarray, cell: int = CELL, limit: int = KEPT_CELLS):
        self.book, self.cell, self.limit = book, cell, limit
        self.kept: OrderedDict[bytes, np.ndarray] = OrderedDict()
        self.met = self.made = self.compared = 0

    def candidates(self, cells: np.ndarray) -> list[np.ndarray]:
        """For each cell the entries that may be nearest to some point of its box, in order."""
        # What a position adds to the bounds depends on its coordinate alone, and cells share coordinates.
        tables = []
        for position in range(cells.shape[1]):
            coordinates, of_cell = np.unique(cells[:, position], return_inverse=True)
            low, entry = coordinates[:, None] * self.cell, self.book[:, position][None]
            below, above = low - entry, entry - (low + self.cell - 1)  # positive: the box lies beyond the entry
            least, most = np.maximum(np.maximum(below, above), 0) ** 2, (np.maximum(below, above) + self.cell - 1) ** 2
            tables.append((least, most, of_cell))
        out = []
        for lo in range(0, len(cells), 128):
            rows = slice(lo, lo + 128)
            least = sum(t[of_cell[rows]] for t, _, of_cell in tables)
            most = sum(t[of_cell[rows]] for _, t, of_cell in tables)
            row, entry = np.nonzero(least <= most.min(1)[:, None])
            out += np.split(entry, np.flatnonzero(np.diff(row)) + 1)
        return out

    def __call__(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index, squared distance) of the nearest entry of each point; of equally near ones the first."""
        if not points.size:  # no points, or parts without a component, which are all equal
            return np.zeros(len(points), np.int64), np.zeros(len(points), np.int64)
        cells = np.floor_divide(points, self.cell)
        keys = [row.tobytes() for row in cells]
        new = dict(zip(keys, range(len(keys)), strict=True))
        found = {}
        for key in list(new):
            if (own := self.kept.get(key)) is not None:
                self.kept.move_to_end(key)
                found[key] = own
                del new[key]
        if new:
            at = list(new.values())
            found.update(zip(new, self.candidates(cells[at]), strict=True))
            self.kept.update((key, found[key]) for key in new)
            while len(self.kept) > self.limit:
                self.kept.popitem(last=False)
        lists = [found[key] for key in keys]
        counts = np.fromiter(map(len, lists), np.int64, len(lists))
        self.met, self.made, self.compared = self.met + len(keys), self.made + len(new), self.compared + int(counts.sum())
        index, best = np.empty(len(points), np.int64), np.empty(len(points), np.int64)
        ends = np.cumsum(counts)
        lo = 0
        while lo < len(points):
            # As many points as have some hundred thousand candidates.
            hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + 200_000)))
            entry, row = np.concatenate(lists[lo:hi]), np.repeat(np.arange(lo, hi), counts[lo:hi])
            distance = ((points[row] - self.book[entry]) ** 2).sum(1)
            begin = np.concatenate([[0], np.cumsum(counts[lo:hi])[:-1]])
            best[lo:hi] = np.minimum.reduceat(distance, begin)
            # Of the candidates at the least distance the first; entries stand in order.
            at = np.flatnonzero(distance == best[row])
            first = np.concatenate([[True], row[at][1:] != row[at][:-1]])
            index[lo:hi] = entry[at[first]]
            lo = hi
        return index, best


class Codebooks:
    """The entries of all parts; fixed size, whatever the number of vectors."""

    def __init__(self, entries: list[np.ndarray]):
        self.entries = entries

    def digest(self) -> str:
        """SHA-256 of all components by part, entry and position, as decimal numbers with commas between them."""
        return hashlib.sha256(",".join(str(x) for e in self.entries for x in e.ravel().tolist()).encode()).hexdigest()

    def after(self, sums: dict[tuple[int, int, int], tuple[int, int]]) -> Codebooks:
        """Each entry moved to the floor of the mean of what it was assigned, by (part, entry, position): (sum, count); others stay."""
        moved = [e.copy() for e in self.entries]
        for (part, entry, position), (total, count) in sums.items():
            moved[part][entry, position] = total // count
        return Codebooks(moved)


@lru_cache(maxsize=2)
def _finders(digest: str, cell: int, limit: int) -> list:
    """Of one codebook; kept by the Python worker from task to task, the last two."""
    return []


def _finders_of(books: Codebooks, cell: int, limit: int) -> list[Finder]:
    own = _finders(books.digest(), cell, limit)
    if not own:
        own += [Finder(e, cell, limit) for e in books.entries]
    return own


def _points(column: pa.Array, dims: int) -> np.ndarray:
    return tk.list_parts(column)[0].astype(np.int64).reshape(-1, dims)


def _added(shared, dims: int, cell: int, limit: int):
    """Sums and counts of what a task's parts are assigned to."""

    def run(batches):
        books = shared.value
        finders, edges = _finders_of(books, cell, limit), bounds(dims, len(books.entries))
        sums = [np.zeros(e.shape, np.int64) for e in books.entries]
        counts = [np.zeros(len(e), np.int64) for e in books.entries]
        for batch in batches:
            points = _points(batch.column("scaled"), dims)
            for p, find in enumerate(finders):
                own = points[:, edges[p] : edges[p + 1]]
                index, _ = find(np.ascontiguousarray(own))
                np.add.at(sums[p], index, own)
                counts[p] += np.bincount(index, minlength=len(counts[p]))
        for p in range(len(finders)):
            entry, position = np.nonzero(np.repeat(counts[p][:, None] > 0, sums[p].shape[1], axis=1))
            yield pa.record_batch([pa.array(np.full(len(entry), p, np.int32)), pa.array(entry.astype(np.int32)), pa.array(position.astype(np.int32)), pa.array(sums[p][entry, position]), pa.array(counts[p][entry])], ["part", "entry", "position", "total", "count"])

    return run


def _coded(shared, dims: int, cell: int, limit: int):
    def run(batches):
        books = shared.value
        finders, edges = _finders_of(books, cell, limit), bounds(dims, len(books.entries))
        for batch in batches:
            points = _points(batch.column("scaled"), dims)
            found = [find(np.ascontiguousarray(points[:, edges[p] : edges[p + 1]])) for p, find in enumerate(finders)]
            codes = np.stack([index for index, _ in found], 1).astype(np.uint8 if max(map(len, books.entries)) <= 256 else ">u2")
            yield pa.record_batch([batch.column("vec_id"), batch.column("label"), pa.array([row.tobytes().hex() for row in codes], pa.string()), pa.array(sum(d for _, d in found))], ["vec_id", "label", "code", "error"])

    return run


def compressed(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, cell: int = CELL, kept_cells: int = KEPT_CELLS) -> tuple[DataFrame, Codebooks | None]:
    """(vec_id, label, code, error of every kept vector; the codebooks). entries: 65,536 at most, the first of the kept vectors in order of vec_id."""
    spark = vectors.sparkSession
    kept = written(prepared(vectors), "scaled")
    first = kept.orderBy(F.asc_nulls_last("vec_id"), "scaled").limit(entries).collect()  # as many rows as entries
    dims = len(first[0]["scaled"]) if first else 0
    kept = kept.filter(F.size("scaled") == dims)
    label = kept.schema["label"].dataType.simpleString()
    if not first:
        return kept.select("vec_id", "label", F.lit("").alias("code"), F.lit(0).cast("long").alias("error")), None
    same = [r["scaled"] for r in first if len(r["scaled"]) == dims]
    if len(same) < len(first):  # some of the first are of another length
        same = [r["scaled"] for r in kept.orderBy(F.asc_nulls_last("vec_id"), "scaled").limit(entries).collect()]
    edges = bounds(dims, parts)
    books = Codebooks([np.array([r[a:b] for r in same], np.int64).reshape(len(same), b - a) for a, b in zip(edges[:-1], edges[1:], strict=True)])
    for _ in range(rounds):
        shared = spark.sparkContext.broadcast(books)  # parts x entries x components of a part
        added = kept.select("scaled").mapInArrow(_added(shared, dims, cell, kept_cells), "part int, entry int, position int, total long, count long")
        sums = added.groupBy("part", "entry", "position").agg(F.sum("total").alias("total"), F.sum("count").alias("count")).collect()  # entries x components at most
        books = books.after({(r["part"], r["entry"], r["position"]): (r["total"], r["count"]) for r in sums})
        shared.destroy()
    return kept.mapInArrow(_coded(spark.sparkContext.broadcast(books), dims, cell, kept_cells), f"vec_id long, label {label}, code string, error long"), books


def codes(vectors: DataFrame) -> DataFrame:
    """vec_id, code, error, label_error and codebooks_sha256. The errors are added by label before they meet the rows, so no label's rows are gathered."""
    coded, books = compressed(vectors)
    rows = written(coded, "codes")
    errors = rows.groupBy("label").agg(F.sum("error").alias("label_error"))
    # Labels may be many: their sums meet the rows in a join that Spark may broadcast, or split where a label has many rows.
    joined = rows.withColumnRenamed("label", "__label").join(errors, F.col("__label").eqNullSafe(F.col("label")), "left")
    return joined.select("vec_id", "code", "error", "label_error", F.lit(books.digest() if books else None).cast("string").alias("codebooks_sha256"))
