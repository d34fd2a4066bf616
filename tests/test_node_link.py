"""Node-link JSON, of our own and of other writers, older ones among them."""

import glob
import json

import pytest
from pyspark.sql import functions as F

from graphloom.operators import compile as C
from graphloom.sources import node_link

SOURCES = [("a.py", "from b import tool\ndef run():\n    return tool()\n"), ("b.py", 'X = "quote \\" and\\ttab"\nclass Tool:\n    """Says é and 😀."""\n    def tool(self):\n        return 1\ndef tool():\n    return 1\n'), ("d/c.py", "")]


def rows(df):
    return sorted(map(repr, df.collect()))


def test_round_trip(spark, tmp_path):
    nodes, edges = C.compile_graph(spark.createDataFrame(SOURCES, "rel_path string, source string"))
    nodes = nodes.withColumn("vector", F.when(F.col("type") == "FUNCTION", F.array(F.lit(0.5), F.lit(-1.25)).cast("array<float>")))
    path = f"{tmp_path}/graph"
    node_link.write(nodes, edges, f"file://{path}")
    # The files, one after another, are one document.
    whole = json.loads("\n".join(open(f).read() for f in sorted(glob.glob(f"{path}/part-*"))))
    assert whole["directed"] is True and whole["graph"] == {"schema": 2} and len(whole["nodes"]) == nodes.count() and len(whole["edges"]) == edges.count()
    assert {n["id"] for n in whole["nodes"]} == {r.node_id for r in nodes.collect()} and next(n for n in whole["nodes"] if n["id"] == "b.py::Tool")["docstring"] == "Says é and 😀."
    back, links = node_link.read(spark, f"file://{path}")
    same = [c for c in back.columns if c in nodes.columns]
    assert {"node_id", "doc", "chunk", "text", "vector", "start_line", "end_line"} <= set(same)
    assert rows(back.select(*same)) == rows(nodes.select(*same)) and rows(links) == rows(edges.select("src", "dst", "relationship"))
    # The same from one file, as others write it.
    (tmp_path / "one.json").write_text(json.dumps(whole, indent=2))
    again, links = node_link.read(spark, f"file://{tmp_path}/one.json")
    assert rows(again.select(*same)) == rows(nodes.select(*same)) and rows(links) == rows(edges.select("src", "dst", "relationship"))


def test_empty_graph_and_no_graph(spark, tmp_path):
    nodes, edges = C.compile_graph(spark.createDataFrame([], "rel_path string, source string"))
    node_link.write(nodes, edges, f"file://{tmp_path}/none")
    assert json.loads("".join(open(f).read() for f in sorted(glob.glob(f"{tmp_path}/none/part-*"))))["nodes"] == []
    assert [df.collect() for df in node_link.read(spark, f"file://{tmp_path}/none")] == [[], []]
    (tmp_path / "bad.json").write_text("[1, 2")
    with pytest.raises(ValueError, match="no node-link"):
        node_link.read(spark, f"file://{tmp_path}/bad.json")


def test_older_schema_and_hydration(spark, tmp_path):
    old = {"directed": True, "graph": {}, "nodes": [{"id": "a.py::run", "type": "FUNCTION", "name": "run", "line_span": "2-3", "chunk_text": "def run(): ...", "other": [1]}, {"name": "no id"}, {"id": "a.py", "type": "FILE", "line_span": None}], "links": [{"source": "a.py", "target": "a.py::run", "relationship": "CONTAINS"}, {"source": "a.py"}]}
    (tmp_path / "old.json").write_text(json.dumps(old))
    nodes, edges = node_link.read(spark, f"file://{tmp_path}/old.json")
    assert {(r.node_id, r.start_line, r.end_line, r.chunk) for r in nodes.collect()} == {("a.py::run", 2, 3, "def run(): ..."), ("a.py", None, None, None)}
    assert [tuple(r) for r in edges.collect()] == [("a.py", "a.py::run", "CONTAINS")]
    own = spark.createDataFrame([("a.py::run", "own", 9), ("new", "own", None)], "node_id string, chunk string, start_line int")
    got = {r.node_id: (r.chunk, r.start_line, r.end_line) for r in node_link.hydrated(own, nodes).collect()}
    assert got == {"a.py::run": ("def run(): ...", 2, 3), "new": ("own", None, None)}
