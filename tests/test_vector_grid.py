"""Comparing by matrices equals comparing each pair by the column function; memory and work are those of groups."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom.functions import vector as V
from graphloom.operators import search as S
from graphloom.operators import vector_grid as grid

INF, NAN = float("inf"), float("nan")


def rows(df):
    return sorted(map(repr, df.collect()))


@pytest.fixture
def small(monkeypatch):
    """Groups so small that the data have many."""
    for name, n in {"ITEMS": 40, "QUERIES": 7, "FEWEST": 20, "PRODUCT": 64, "PAIRS": 16}.items():
        monkeypatch.setattr(grid, name, n)


@pytest.fixture(scope="module")
def given(spark):
    """Items and queries with copies, vectors of two lengths, and odd ones."""
    r = random.Random(17)
    vectors = [[r.gauss(0, 1) for _ in range(5)] for _ in range(60)]
    odd = [None, [], [0.0] * 5, [1.0] * 3, [-1.0, 2.0, 0.5], [None] + [1.0] * 4, [NAN] * 5, [INF, 1.0, 0.0, 0.0, 0.0], [1e200, 1.0, 0.0, 0.0, 0.0], [1e-160] * 5, [-x for x in vectors[0]]]
    items = [*vectors, *vectors[:20], *vectors[:5] * 6, *[[2 * x for x in v] for v in vectors[:9]], *odd, *odd]
    queries = [*vectors[:8], *vectors[3:6], [1.0, 0.0, 0.0], *odd]
    return spark.createDataFrame(list(enumerate(items)), "id long, vector array<double>").repartition(3), spark.createDataFrame(list(enumerate(queries)), "qid long, query array<double>")


def pairs(items, queries):
    """The similarity of each pair of vectors of one length, by the column function."""
    both = items.filter(F.size("vector") > 0).crossJoin(queries).filter(F.size("vector") == F.size("query"))
    return both.select("qid", "id", V.cosine(F.col("vector"), F.col("query")).alias("sim"))


@pytest.mark.parametrize("n", [1, 50])
def test_top_equals_each_pair(spark, small, given, n):
    items, queries = given
    want = S.ranked(pairs(items, queries).filter("sim > 0"), ["qid"], F.desc(F.round("sim", 9)), F.col("id"), n=n).select("qid", "id", "sim", "rank")
    got = rows(S.top_similar(items, queries, n))
    assert got == rows(want) and len(got) > n


def test_best_equals_each_pair(spark, small, given):
    items, queries = given
    want = pairs(items, queries).groupBy("id").agg(F.max("sim").alias("sim")).filter("sim > 0")
    assert rows(S.best_similarity(items, queries)) == rows(want)
    plain = [items.filter("id < 60"), queries.filter("qid < 11")]
    assert rows(S.best_similarity(*plain)) == rows(pairs(*plain).groupBy("id").agg(F.max("sim").alias("sim")).filter("sim > 0"))
    assert S.best_similarity(items, queries.limit(0)).collect() == S.top_similar(items.limit(0), queries).collect() == []


def test_best_by_key_has_what_is_unlike(spark, small, given):
    items, queries = given
    own = items.filter(F.size("vector") > 0).withColumn("k", F.explode(F.array(F.lit("a"), F.lit("b"), F.lit("c"))))
    asked = queries.withColumn("k", F.when(F.col("qid") < 5, "a").otherwise("b"))
    want = own.join(asked, "k").filter("query is not null").groupBy("k", "id").agg((F.max(V.cosine(F.col("vector"), F.col("query"))) + 0.0).alias("sim"))
    got = grid.most_similar(own, asked, ["k"], own.count())
    assert rows(got.select("k", "id", (F.col("sim") + 0.0).alias("sim"))) == rows(want.select("k", "id", "sim")) and got.filter("sim < 0").count() > 0


def test_copies_leave_a_cell_once_for_each_rank():
    r = np.random.default_rng(5)
    copies = np.repeat(r.normal(size=(2, 6)), 3000, axis=0)
    own = grid.Side(np.arange(6000), copies).fewest(4)
    assert own.rows.tolist() == [0, 1, 2, 3, 3000, 3001, 3002, 3003]


def test_many_pairs_take_no_row_each(spark):
    """A million pairs: what leaves the cells are the best, and no plan has a row for each pair."""
    r = random.Random(3)
    items = spark.createDataFrame([(k, [r.gauss(0, 1) for _ in range(8)]) for k in range(5000)], "id long, vector array<float>")
    found = grid.top(items, items.filter("id % 25 = 0").select(F.col("id").alias("qid"), F.col("vector").alias("query")), 10)
    assert 2000 <= found.count() <= 2000 * 12
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastNestedLoopJoin" not in plan and "Broadcast" not in plan
