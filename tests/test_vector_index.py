"""Indexed search equals search without an index, and compares less."""

import random

import pytest
from pyspark.sql import functions as F

from graphloom.operators import search as S
from graphloom.operators import vector_index as I

SCHEMA = "id long, vector array<double>"


def rows(df):
    return sorted(map(tuple, df.collect()))


def clusters(r, n, dims):
    centres = [[r.gauss(0, 1) for _ in range(dims)] for _ in range(8)]
    return [[x + r.gauss(0, 0.05) for x in r.choice(centres)] for _ in range(n)]


@pytest.mark.parametrize("kind", ["clusters", "random", "equal"])
def test_top_similar_equals_all_pairs(spark, kind):
    r = random.Random(kind)
    vectors = {"clusters": clusters(r, 1200, 6), "random": [[r.gauss(0, 1) for _ in range(6)] for _ in range(600)], "equal": [[1.0, 2.0, 3.0]] * 400 + [[3.0, 2.0, 1.0]] * 5}[kind]
    dims = len(vectors[0])
    odd = [None, [], [0.0] * dims, [1.0] * (dims + 1), [None] + [1.0] * (dims - 1), [float("nan")] * dims]
    items = spark.createDataFrame(list(enumerate(vectors)) + [(5000 + k, v) for k, v in enumerate(odd)], SCHEMA).repartition(5)
    queries = spark.createDataFrame(list(enumerate([*vectors[:12], [-x for x in vectors[0]], *odd[:4]])), "qid long, query array<double>")
    index = I.build(items, 40)
    whole = items.filter(F.size("vector") == dims).filter(~F.exists("vector", lambda x: x.isNull() | F.isnan(x)))
    for n in (1, 7, 450):
        assert rows(I.top_similar(index, queries, n)) == rows(S.top_similar(whole, queries, n))
    own = queries.filter(F.size("query") == dims)
    first, _, rest = I.searched(index, own, 7)
    compared = first.count() + rest.count()
    if kind == "clusters":
        assert compared < 0.4 * len(vectors) * own.count()
    pairs = rows(first.select("qid", "id").unionByName(rest.select("qid", "id")))
    assert len(set(pairs)) == len(pairs) <= len(vectors) * own.count()


def test_slices_of_cells_and_many_queries(spark, monkeypatch):
    """Cells cut into slices find the same; each slice hands on the best of a query, not a row for each pair."""
    monkeypatch.setattr(I.grid, "ITEMS", 30)
    r = random.Random(6)
    vectors = clusters(r, 500, 5)
    items = spark.createDataFrame(list(enumerate([*vectors, *vectors[:200]])), SCHEMA)
    queries = items.filter("id % 3 = 0").select(F.col("id").alias("qid"), F.col("vector").alias("query"))
    index = I.build(items, 10)
    assert index.cells.agg(F.max("slices")).first()[0] > 1
    assert rows(I.top_similar(index, queries, 4)) == rows(S.top_similar(items, queries, 4))
    first, found, _ = I.searched(index, queries, 4)
    assert found.count() < first.count() / 2


def test_index_edge_cases(spark):
    none = spark.createDataFrame([], SCHEMA)
    queries = spark.createDataFrame([(1, [1.0, 0.0])], "qid long, query array<double>")
    assert I.top_similar(I.build(none), queries).collect() == []
    assert I.top_similar(I.build(spark.createDataFrame([(1, [0.0, 0.0])], SCHEMA)), queries).collect() == []
    one = I.build(spark.createDataFrame([(1, [2.0, 0.0]), (2, [2.0, 0.0])], SCHEMA))
    assert rows(I.top_similar(one, queries, 5)) == [(1, 1, 1.0, 1), (1, 2, 1.0, 2)]
    assert I.top_similar(one, queries.filter("qid > 1"), 5).collect() == []


NODES = "node_id string, name string, signature string, grep_text string, call_centrality double, near boolean, node_ord int"


@pytest.fixture(scope="module")
def nodes(spark):
    r = random.Random(4)
    parts = ["load", "Save", "make", "Graph", "node", "é", "ß", "_x", "tree"]
    made = []
    for k in range(300):
        name = "".join(r.choice(parts) for _ in range(r.randint(1, 3)))
        made.append((f"f{k % 7}.py::{name}_{k}", name, "(n)" if k % 3 else None, f"{name}\n(n)\nf{k % 7}.py" if k % 11 else None, r.random(), bool(k % 2), k))
    return spark.createDataFrame(made, NODES)


@pytest.mark.parametrize("cased", [False, True])
def test_postings_change_nothing(spark, nodes, cased):
    terms = spark.createDataFrame([(t,) for t in ("Save", "save", "loadmake", "ß", "éß", "no such", "GRAPHnode", "Graphnode", "ee", " tree ", "eee", "f3.py", "")], "term string")
    plain = rows(S.grep(nodes, terms, cased=cased))
    assert rows(S.grep(nodes, terms, cased=cased, postings=S.posted(nodes))) == plain and {r[4] for r in plain} == {"literal", "fuzzy"}
    assert (("GRAPHnode", "literal") in {(r[0], r[4]) for r in plain}) != cased


def test_only_candidates_are_compared(spark, nodes):
    terms = spark.createDataFrame([("loadSave", "loadsave"), ("zzzz", "zzzz")], "term string, t string")
    found = S.candidates(S.posted(nodes), terms).collect()
    hits = {r.node_id for r in nodes.filter(F.contains(F.lower("grep_text"), F.lit("loadsave"))).collect()}
    assert hits and {r.node_id for r in found} >= hits and len(found) < 60 and {r.term for r in found} == {"loadSave"}


def test_names_lift_fuzzy_hits_as_comparing_all_does(spark, nodes):
    r = random.Random(9)
    names = sorted({x.name for x in nodes.collect()})
    vectors = {n: [r.gauss(0, 1) for _ in range(4)] for n in names if r.random() < 0.9}
    terms = {"zz load": [r.gauss(0, 1) for _ in range(4)], "qq": vectors[names[0]] if names[0] in vectors else [1.0] * 4, "no vector": None}
    asked = spark.createDataFrame([(t,) for t in terms], "term string")
    kept = S.named(nodes, spark.createDataFrame(list(vectors.items()), "name string, vector array<double>"), spark.createDataFrame([(t, v) for t, v in terms.items() if v], "term string, vector array<double>"))
    got = {}
    for x in S.grep(nodes, asked, names=kept).orderBy("rank").collect():
        got.setdefault(x.term, []).append((x.node_id, round(x.score, 6)))
    letters = {(x.term, x.node_id): x.score for x in S.grep(nodes, asked, fuzzy_n=1000).collect()}
    norm = lambda v: sum(x * x for x in v) ** 0.5
    for t, v in terms.items():
        scored = []
        for x in nodes.collect():
            own = vectors.get(x.name)
            sim = 60 * sum(a * b for a, b in zip(v, own, strict=True)) / (norm(v) * norm(own) + 1e-9) if v and own else 0
            score = max(letters.get((t, x.node_id), 0), sim)
            scored += [(-round(score, 9), x.node_ord, x.node_id, round(score, 6))] if score > 0 else []
        assert got.get(t, []) == [(i, s) for _, _, i, s in sorted(scored)[:3]]
