"""Exact nearest vectors without comparing all pairs.

Vectors lie in cells: each belongs to the pivot at the least angle, and keeps that angle. Pivots are a bounded sample,
chosen by hash. Angles obey the triangle inequality, so a query at angle a from a pivot is at least |a - b| away from a
vector that is at angle b from it: the cosine of that difference bounds the similarity from above. A search compares the
queries with the cells that promise most until these hold enough vectors, which gives each query a similarity to beat;
of all other cells, and in them of all other vectors, only those whose bound reaches it are compared.

The vectors are stored in order of cell and angle. A task compares the vectors of a cell with the queries that ask for it
as two matrices (``vector_grid``), of which it takes the rows between the angles that the bound leaves; large cells are cut
into slices. A query has a row for each cell; these rows are shuffled, so there may be as many queries as vectors.

Defined results. Rows whose vector is null, empty or zero, or is not as long as the pivots, are in no cell; nothing is
similar to them. Queries like that, and of another length, find nothing. The result equals that of comparing all pairs; ties break on id.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.operators import vector_grid as grid
from graphloom.operators.graph import ranked
from graphloom.sources.store import stored

#: Pivots at most, and vectors for each of them at least.
PIVOTS, PER_PIVOT = 256, 8
#: What rounding may do to a bound.
SLACK = 1e-7
#: One part in so many of all vectors is compared first: more gives a better similarity to beat, fewer leaves more to it.
FIRST_SHARE = 16


class VectorIndex(NamedTuple):
    pivots: np.ndarray  # unit vectors; PIVOTS at most
    items: DataFrame  # id, vector, cell, angle, in order of cell and angle
    cells: DataFrame  # cell, n, low, high, slices: the number of vectors, their least and largest angle, and into how many slices they are cut


def _units(column: pa.Array, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows with a vector of that length that is not zero, these as unit vectors)."""
    whole, m = grid.matrices(column).get(dims, (np.zeros(0, np.int64), np.zeros((0, dims))))
    with np.errstate(all="ignore"):
        norm = np.sqrt((m * m).sum(1))
    good = np.isfinite(norm) & (norm > 0)
    return whole[good], m[good] / norm[good, None]


def _angles(units: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(units @ pivots.T, -1.0, 1.0))


def _placed(pivots: np.ndarray):
    """Rows with the cell and the angle of their vectors; those in no cell are left out."""

    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 2000):
                part = batch.slice(lo, 2000)
                rows, units = _units(part.column("vector"), pivots.shape[1])
                angles = _angles(units, pivots)
                cell = angles.argmin(1) if len(rows) else np.zeros(0, np.int64)
                own = part.take(pa.array(rows))
                yield pa.RecordBatch.from_arrays([*own.columns, pa.array(cell.astype(np.int32)), pa.array(angles[np.arange(len(rows)), cell])], names=[*own.schema.names, "cell", "angle"])

    return run


def _seen(pivots: np.ndarray):
    """(qid, cell, angle) of each query and each cell."""

    def run(batches):
        for batch in batches:
            rows, units = _units(batch.column("query"), pivots.shape[1])
            angles = _angles(units, pivots)
            ids = batch.column("qid").take(pa.array(np.repeat(rows, len(pivots))))
            yield pa.RecordBatch.from_arrays([ids, pa.array(np.tile(np.arange(len(pivots), dtype=np.int32), len(rows))), pa.array(angles.ravel())], names=["qid", "cell", "q_angle"])

    return run


def build(items: DataFrame, pivots: int = PIVOTS) -> VectorIndex:
    """The index of items(id, vector)."""
    own = items.select("id", "vector").filter((F.size("vector") > 0) & ~F.exists("vector", lambda x: x.isNull() | F.isnan(x)))
    most = max(1, min(pivots, items.count() // PER_PIVOT))
    sample = own.orderBy(F.xxhash64("id", "vector"), "id").limit(most).collect()  # at most as many as pivots
    dims = len(sample[0]["vector"]) if sample else 1
    same = pa.array([r["vector"] for r in sample if len(r["vector"]) == dims], pa.list_(pa.float64()))
    chosen = _units(same, dims)[1]
    chosen = chosen if len(chosen) else np.eye(1, dims)
    kinds = dict(own.dtypes)
    placed = own.mapInArrow(_placed(chosen), f"id {kinds['id']}, vector {kinds['vector']}, cell int, angle double")
    parts = int(items.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = stored(placed.repartitionByRange(parts, "cell", "angle", "id").sortWithinPartitions("cell", "angle"), "vectors")
    cells = stored(rows.groupBy("cell").agg(F.count("*").alias("n"), F.min("angle").alias("low"), F.max("angle").alias("high"), F.ceil(F.count("*") / grid.ITEMS).cast("int").alias("slices")), "cells")
    return VectorIndex(chosen, rows, cells)


def _bound(apart: Column) -> Column:
    return F.cos(F.greatest(apart, F.lit(0.0)))


def promising(index: VectorIndex, queries: DataFrame, n: int) -> tuple[DataFrame, DataFrame]:
    """((qid, cell, slices, q_angle, bound) of cells that hold n vectors and a share of all or more together, the best first, for each query; the same of all others)."""
    kind = dict(queries.dtypes)["qid"]
    seen = queries.select("qid", "query").mapInArrow(_seen(index.pivots), f"qid {kind}, cell int, q_angle double").join(F.broadcast(index.cells), "cell")
    apart = F.greatest(F.col("low") - F.col("q_angle"), F.col("q_angle") - F.col("high"))
    by_promise = Window.partitionBy("qid").orderBy(F.desc("bound"), "cell").rowsBetween(Window.unboundedPreceding, -1)  # a row for each cell
    before = seen.withColumn("bound", _bound(apart)).withColumn("before", F.coalesce(F.sum("n").over(by_promise), F.lit(0))).drop("n", "low", "high")
    both = stored(before, "promise")
    enough = max(n, (index.cells.agg(F.sum("n")).first()[0] or 0) // FIRST_SHARE)
    return both.filter(F.col("before") < enough).drop("before"), both.filter(F.col("before") >= enough).drop("before")


def _pairs(index: VectorIndex, asked: DataFrame) -> DataFrame:
    """(qid, id) of the vectors in asked(qid, cell, q_angle, least) whose bound reaches least."""
    met = index.items.join(asked.select("qid", "cell", "q_angle", "least"), "cell")
    return met.filter(_bound(F.abs(F.col("q_angle") - F.col("angle"))) >= F.col("least") - SLACK).select("qid", "id")


def _nearest(n: int):
    """(qid, id, sim) of a slice of a cell and those who ask for it: the n best of each, of the vectors whose bound reaches least."""

    def run(items: pa.Table, asked: pa.Table) -> pa.Table:
        items = grid.in_order(items, "id")
        angle, q_angle, least = (t[c].to_numpy() for t, c in ((items, "angle"), (asked, "q_angle"), (asked, "least")))
        reach = np.arccos(np.clip(least - SLACK, -1.0, 1.0)) + SLACK
        found = []
        queries = grid.matrices(asked["query"])
        with np.errstate(all="ignore"):
            for length, own in grid.matrices(items["vector"]).items():
                if length in queries:
                    a, b = grid.Side(*own).fewest(n), grid.Side(*queries[length])
                    a = a.taken(np.argsort(angle[a.rows], kind="stable"))
                    q = b.rows
                    near = grid.nearest(a, b, n, least[q], (angle[a.rows], q_angle[q] - reach[q], q_angle[q] + reach[q]))
                    found += [(a.rows[i], q[j], sims) for i, j, sims in near]
        return grid.told(items, asked, found)

    return run


def compared(index: VectorIndex, asked: DataFrame, queries: DataFrame, n: int) -> DataFrame:
    """(qid, id, sim) of asked(qid, cell, slices, q_angle, least), a written table: in each slice the n best of what the bounds leave; 0 and less is dropped."""
    some = index.items.join(F.broadcast(asked.select("cell", "slices").distinct()), "cell")  # a row for each cell
    items = some.withColumn("slice", F.pmod(F.xxhash64("id"), F.col("slices")).cast("int")).select("cell", "slice", "id", "vector", "angle")
    given = asked.join(queries.select("qid", "query"), "qid").withColumn("slice", F.explode(F.sequence(F.lit(0), F.col("slices") - 1))).select("cell", "slice", "qid", "query", "q_angle", "least")
    schema = f"qid {dict(queries.dtypes)['qid']}, id {dict(items.dtypes)['id']}, sim double"
    return items.groupBy("cell", "slice").cogroup(given.groupBy("cell", "slice")).applyInArrow(_nearest(n), schema)


def _search(index: VectorIndex, queries: DataFrame, n: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(cells asked first, what was found there, what is asked of all others) for queries(qid, query)."""
    first, others = promising(index, queries, n)
    first = first.withColumn("least", F.lit(-1.0))
    found = stored(compared(index, first, queries, n), "found")
    # The n-th best so far is the similarity to beat; without as many, every similarity above 0 counts.
    best = ranked(found, ["qid"], F.desc("sim"), n=n).groupBy("qid").agg(F.count("*").alias("found"), F.min("sim").alias("worst"))
    least = best.select("qid", F.when(F.col("found") >= n, F.col("worst")).otherwise(0.0).alias("least"))
    asked = others.join(least, "qid", "left").withColumn("least", F.coalesce("least", F.lit(0.0))).filter(F.col("bound") >= F.col("least") - SLACK)
    return first, found, stored(asked, "asked")


def searched(index: VectorIndex, queries: DataFrame, n: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(pairs of the first cells, what was found there, pairs of all others that may be among the n best) for queries(qid, query)."""
    first, found, rest = _search(index, queries, n)
    return _pairs(index, first), found, _pairs(index, rest)


def top_similar(index: VectorIndex, queries: DataFrame, n: int = 50) -> DataFrame:
    """The n vectors closest to each of queries(qid, query): (qid, id, sim, rank), equal to comparing all pairs."""
    _, found, rest = _search(index, queries, n)
    both = found.unionByName(compared(index, rest, queries, n))
    return ranked(both, ["qid"], F.desc(F.round("sim", 9)), F.col("id"), n=n).select("qid", "id", "sim", "rank")
