"""Similarity of many vectors with many queries, cell by cell of a grid.

Items and queries are dealt into groups by hash; each group of items meets each group of queries in a cell, which a task
compares as two matrices. Groups have a bounded number of rows, so memory is bounded, and cells spread over the cluster.

Products of matrices choose the pairs; their similarities are then summed in the order of ``functions.vector.cosine``, so
they are equal to it to the last digit, and equal vectors have equal ones wherever they lie. Defined results are those of
``cosine``: pairs of different lengths and vectors with null components are similar by 0, and NaN is above all numbers.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Items and queries in a group, about, and items that are worth a group of their own.
ITEMS, QUERIES, FEWEST = 32_768, 8_192, 2_048
#: Numbers in a product of matrices, and pairs whose similarity is summed at once.
PRODUCT, PAIRS = 1 << 20, 1 << 16
#: What decides a rank is rounded to 9 places, so pairs this close to the last one chosen are chosen too.
TIE = 2e-9
#: More than what the order of a sum may change.
ROUNDING = 1e-11


def matrices(column: pa.ChunkedArray) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """(numbers of rows, their vectors) by length; without vectors that are null, empty or have null components."""
    out = {}
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    lengths = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    starts = lists.offsets.to_numpy()[:-1]
    values = lists.values.cast(pa.float64())
    missing = values.is_null().to_numpy(zero_copy_only=False) if values.null_count else None
    numbers = values.to_numpy(zero_copy_only=False)
    for n in np.unique(lengths[lengths > 0]):
        rows = np.flatnonzero(lengths == n)
        at = starts[rows][:, None] + np.arange(n)
        if missing is not None:
            whole = ~missing[at].any(1)
            rows, at = rows[whole], at[whole]
        if len(rows):
            out[int(n)] = rows, numbers[at]
    return out


def dots(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of each row of a and of b, summed as ``functions.vector.dot`` does."""
    total = np.zeros(len(a))
    for k in range(a.shape[1]):
        total += a[:, k] * b[:, k]
    return total


class Side:
    """Vectors of one length: with norms, and as unit vectors where these are regular."""

    def __init__(self, rows: np.ndarray, values: np.ndarray):
        self.rows, self.values, self.norms = rows, values, np.sqrt(dots(values, values))
        fine = np.isfinite(self.norms) & (self.norms > 1e-100)
        self.regular, self.odd = np.flatnonzero(fine), np.flatnonzero(~fine & (self.norms != 0))  # nothing is similar to zeros
        self.units = values[self.regular] / self.norms[self.regular, None]

    def __len__(self) -> int:
        return len(self.rows)

    def taken(self, keep: np.ndarray) -> Side:
        return Side(self.rows[keep], self.values[keep])

    def fewest(self, n: int) -> Side:
        """The first n of each group of equal vectors; of vectors with NaN the first n, too."""
        alike = np.where(np.isnan(self.norms)[:, None], np.nan, self.values)
        _, group = np.unique(np.ascontiguousarray(alike).view(np.dtype((np.void, alike.shape[1] * 8))).ravel(), return_inverse=True)
        order = np.argsort(group, kind="stable")
        first = np.searchsorted(group[order], group[order])
        keep = order[np.arange(len(order)) - first < n]
        return self if len(keep) == len(self) else self.taken(np.sort(keep))


def cosines(a: Side, i: np.ndarray, b: Side, j: np.ndarray) -> np.ndarray:
    """Of the i-th of a and the j-th of b, as ``functions.vector.cosine`` computes them."""
    out = np.zeros(len(i))
    for lo in range(0, len(i), PAIRS):
        p, q = i[lo : lo + PAIRS], j[lo : lo + PAIRS]
        norm = a.norms[p] * b.norms[q]
        out[lo : lo + PAIRS] = np.where((norm > 0) | np.isnan(norm), dots(a.values[p], b.values[q]) / norm, 0.0)
    return out


def _all_pairs(i: np.ndarray, j: np.ndarray):
    """All of i with all of j, a bounded number at a time."""
    step = max(1, PAIRS // max(1, len(j)))
    for lo in range(0, len(i), step):
        part = i[lo : lo + step]
        yield np.repeat(part, len(j)), np.tile(j, len(part))


def nearest(items: Side, queries: Side, n: int, least: np.ndarray | None = None, angles: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None):
    """(numbers of items, numbers of queries, similarities) that hold the n best items of each query; 0 and less is left out.

    With least, a similarity for each query, what is below it is left out. With angles (of items, in order; the lowest and
    the highest of items that a query has to meet), other items are not compared with the query.
    """
    own, asked = items.regular, queries.regular
    least = np.zeros(len(queries)) if least is None else least
    low, high = np.zeros(len(asked), np.int64), np.full(len(asked), len(own))
    if angles is not None:
        low, high = np.searchsorted(angles[0][own], angles[1][asked], "left"), np.searchsorted(angles[0][own], angles[2][asked], "right")
    order = np.argsort(low + high, kind="stable")
    order = order[low[order] < high[order]]
    step = max(8, PRODUCT // max(1, len(own)))
    for k in range(0, len(order), step):
        q = order[k : k + step]
        a, z = low[q].min(), high[q].max()
        close = queries.units[q] @ items.units[a:z].T
        if angles is not None:
            places = np.arange(a, z)
            close[(places < low[q][:, None]) | (places >= high[q][:, None])] = -np.inf
        bar = np.maximum(least[asked[q]], 0.0)
        if z - a > n:
            bar = np.maximum(bar, np.partition(close, z - a - n, axis=1)[:, z - a - n])
        x, y = np.nonzero(close >= bar[:, None] - TIE)
        i, j = own[y + a], asked[q[x]]
        sims = cosines(items, i, queries, j)
        keep = sims > 0
        yield i[keep], j[keep], sims[keep]
    plain = np.setdiff1d(np.arange(len(items)), items.odd)
    for some in (_all_pairs(items.odd, np.arange(len(queries))), _all_pairs(plain, queries.odd)):
        for i, j in some:
            sims = cosines(items, i, queries, j)
            keep = (sims > 0) | np.isnan(sims)
            yield i[keep], j[keep], sims[keep]


def best(items: Side, queries: Side) -> np.ndarray:
    """The highest similarity of each item over the queries, of which there is one at least."""
    out = np.full(len(items), -np.inf)
    queries = queries.fewest(1)
    own, asked = items.regular, queries.regular
    step = max(8, PRODUCT // max(1, len(asked)))
    for k in range(0, len(own) if len(asked) else 0, step):
        close = items.units[k : k + step] @ queries.units.T
        x, y = np.nonzero(close >= close.max(1)[:, None] - ROUNDING)
        np.maximum.at(out, own[x + k], cosines(items, own[x + k], queries, asked[y]))
    zero = np.flatnonzero(items.norms == 0)
    every = np.arange(len(queries))
    for some in (_all_pairs(np.concatenate([items.odd, zero]), every), _all_pairs(own, np.setdiff1d(every, asked))):
        for i, j in some:
            np.maximum.at(out, i, cosines(items, i, queries, j))
    return out


def in_order(table: pa.Table, key: str) -> pa.Table:
    return table.take(pc.sort_indices(table, sort_keys=[(key, "ascending")], null_placement="at_start"))


def told(items: pa.Table, queries: pa.Table, found: list[tuple]) -> pa.Table:
    """(qid, id, sim) of what was found: numbers of rows of items and queries, and similarities."""
    i, j, sims = (np.concatenate(x) for x in zip((np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)), *found, strict=True))
    return pa.table({"qid": queries["qid"].take(pa.array(j)), "id": items["id"].take(pa.array(i)), "sim": sims})


def _top(n: int):
    """(qid, id, sim) of the pairs of a cell among which are the n best of each query."""

    def run(items: pa.Table, queries: pa.Table) -> pa.Table:
        items = in_order(items, "id")
        found = []
        asked = matrices(queries["query"])
        with np.errstate(all="ignore"):
            for length, own in matrices(items["vector"]).items():
                if length in asked:
                    a, b = Side(*own).fewest(n), Side(*asked[length])
                    found += [(a.rows[i], b.rows[j], sims) for i, j, sims in nearest(a, b, n)]
        return told(items, queries, found)

    return run


def _most(by: list[str]):
    """(by, id, sim) of all items of a cell, by the most similar query."""

    def run(items: pa.Table, queries: pa.Table) -> pa.Table:
        given = queries.filter(pc.is_valid(queries["query"]))
        asked = matrices(given["query"])
        # Null components and another length: similar by 0 to whatever is asked.
        out = np.full(items.num_rows, 0.0 if given.num_rows else -np.inf)
        with np.errstate(all="ignore"):
            for length, own in matrices(items["vector"]).items():
                if length in asked:
                    sims = best(Side(*own), Side(*asked[length]))
                    out[own[0]] = sims if len(asked[length][0]) == given.num_rows else np.maximum(sims, 0.0)
        table = pa.table({**{c: items[c] for c in [*by, "id"]}, "sim": out})
        return table.filter(pa.array(out != -np.inf))

    return run


def grouped(rows: DataFrame, key: str, groups: int, own: str, others: int, other: str) -> DataFrame:
    """rows with the group that each is in, and once for each group that it meets."""
    return rows.withColumn(own, F.pmod(F.xxhash64(key), F.lit(groups)).cast("int")).withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(others - 1))))


def _compared(items: DataFrame, queries: DataFrame, by: list[str], most: int, run: Callable, schema: str) -> DataFrame:
    """What run makes of the cells of items(by, id, vector), most at most, and queries(by, qid, query)."""
    high = max(1, math.ceil(queries.count() / QUERIES))
    cores = items.sparkSession.sparkContext.defaultParallelism
    wide = max(1, math.ceil(most / ITEMS), min(math.ceil(3 * cores / high), math.ceil(most / FEWEST)))
    keys = [*by, "__item", "__query"]
    left = grouped(items.select(*by, "id", "vector"), "id", wide, "__item", high, "__query").repartition(wide * high, *keys)
    right = grouped(queries.select(*by, "qid", "query"), "qid", high, "__query", wide, "__item").repartition(wide * high, *keys)
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(run, schema)


def top(items: DataFrame, queries: DataFrame, n: int) -> DataFrame:
    """(qid, id, sim) of items(id, vector) and queries(qid, query): among them the n best of each query, with all that ties with them."""
    schema = f"qid {dict(queries.dtypes)['qid']}, id {dict(items.dtypes)['id']}, sim double"
    return _compared(items, queries, [], items.count(), _top(n), schema)


def most_similar(items: DataFrame, queries: DataFrame, by: list[str], most: int) -> DataFrame:
    """(by, id, sim): the highest similarity of items(by, id, vector), most at most, to the queries(by, qid, query) of the same key."""
    kinds = dict(items.dtypes)
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in [*by, "id"]) + ", sim double"
    return _compared(items, queries, by, most, _most(by), schema).groupBy(*by, "id").agg(F.max("sim").alias("sim"))
