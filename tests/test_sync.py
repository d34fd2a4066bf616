"""Graphs after changes equal graphs built anew; vectors and docstrings of what did not change stay."""

import random

from pyspark.sql import functions as F

from graphloom.operators import compile as C
from graphloom.operators import delta as D
from graphloom.operators import resolve as R
from graphloom.operators import sync as Y

OLD = {"a.py": "from b import tool\ndef run():\n    return tool()\n", "b.py": "def tool():\n    return 1\n", "c.py": "def spare():\n    return 2\n", "d.py": "import c\nfrom c import spare\ndef go():\n    return spare()\n"}
NEW = {**OLD, "b.py": "def other():\n    return 1\n", "e/f.py": "def tool():\n    return 3\n", "a.py": "from b import tool\nfrom e.f import tool\ndef run():\n    return tool()\n"}
del NEW["c.py"]


def table(spark, files, times):
    return spark.createDataFrame([(p, s, times.get(p, 1.0)) for p, s in files.items()], "rel_path string, source string, mtime double")


def rows(df):
    return sorted(map(repr, df.collect()))


def equal_full_build(graph, files):
    nodes, edges = C.compile_graph(files)
    assert rows(graph.nodes.select(*nodes.columns)) == rows(nodes)
    assert rows(graph.edges.select(*edges.columns)) == rows(edges)
    assert rows(graph.uses) == rows(D.uses(graph.facts))


def tracked(files):
    return files.select(F.col("rel_path").alias("path"), "mtime")


def calls(graph):
    return {(r.src, r.dst) for r in graph.edges.filter("relationship = 'CALLS'").collect()}


def test_incremental_equals_full(spark):
    old, new = table(spark, OLD, {}), table(spark, NEW, {"a.py": 2.0, "b.py": 2.0})
    before = D.built(old)
    assert calls(before) == {("a.py::run", "b.py::tool"), ("d.py::go", "c.py::spare")}
    after = D.synced(new, tracked(old), before)
    equal_full_build(after, new)
    assert calls(after) == {("a.py::run", "e/f.py::tool")}
    # Nothing changed: nothing is parsed, and the graph is the same.
    again = D.synced(new, tracked(new), after)
    assert rows(again.edges) == rows(after.edges)


def test_random_edits_equal_full_builds(spark):
    r = random.Random(11)
    paths = ["a.py", "b.py", "pkg/__init__.py", "pkg/c.py", "pkg/deep/d.py", "pkg/deep/__init__.py", "pkg.py", "x/y/z.py", "broken.py"]
    names = ["tool", "make", "Base", "Kind", "run"]

    def source(path):
        if path == "broken.py" and r.random() < 0.5:
            return "def (:\n"
        lines = []
        for _ in range(r.randint(0, 3)):
            lines.append(r.choice(["import a", "import pkg.c", "from pkg import c", "from pkg.deep import d", "from . import c", "from .c import tool", "from .. import b", "from y import z", "import pkg", "from b import make"]))
        for n in r.sample(names, r.randint(0, 3)):
            other = r.choice(names)
            if n[0].isupper():
                lines.append(f"class {n}({other}):\n    def run(self):\n        return self.{r.choice(names)}({other}())")
            else:
                lines.append(f"def {n}(x):\n    return {other}(x)")
        if r.random() < 0.3:
            lines.append(f"{r.choice(names)}()")
        return "\n".join(lines) + "\n"

    files = {p: source(p) for p in paths[:6]}
    times = dict.fromkeys(files, 1.0)
    was = table(spark, files, times)
    graph = D.built(was)
    for step in range(2):
        for p in r.sample(paths, 5):
            if p in files and r.random() < 0.4:
                del files[p]
            else:
                files[p], times[p] = source(p), 2.0 + step
        now = table(spark, files, times)
        graph = D.kept(D.synced(now, tracked(was), graph))
        equal_full_build(graph, now)
        was = now


def test_only_what_a_change_reaches_is_resolved(spark, monkeypatch):
    files = {f"f{k}.py": f"from g{k} import tool_{k}\ndef use_{k}(x):\n    return tool_{k}(x)\n" for k in range(40)} | {f"g{k}.py": f"def tool_{k}(x):\n    return x\n" for k in range(40)}
    old = table(spark, files, {})
    before = D.built(old)
    met = {}
    callees = R.callees
    monkeypatch.setattr(R, "callees", lambda c, n, i: met.update(calls={x.caller_id for x in c.collect()}, nodes={x.node_id for x in n.collect()}) or callees(c, n, i))
    # A body changes: no name has another definer, so only the file itself is resolved.
    body = table(spark, files | {"g7.py": "def tool_7(x):\n    return x + 1\n"}, {"g7.py": 2.0})
    D.synced(body, tracked(old), before)
    assert met == {"calls": set(), "nodes": {"g7.py::tool_7"}}
    # A function goes: its caller is resolved again, and meets nothing else.
    gone = table(spark, files | {"g7.py": "def other(x):\n    return x\n"}, {"g7.py": 2.0})
    after = D.synced(gone, tracked(old), before)
    assert met == {"calls": {"f7.py::use_7"}, "nodes": {"f7.py::use_7", "g7.py::other"}}
    assert ("f7.py::use_7", "g7.py::tool_7") not in calls(after) and len(calls(after)) == 39


def test_vectors_stay_with_their_texts(spark):
    before = spark.createDataFrame([("a", "x", [1.0]), ("b", "y", [2.0]), ("c", None, None)], "node_id string, text string, vector array<float>")
    now = spark.createDataFrame([("a", "x"), ("b", "new text"), ("c", None), ("d", "z")], "node_id string, text string")
    embedder = lambda t: F.array(F.length(t).cast("float"))
    assert {r.node_id: r.vector for r in Y.embedded(now, before, embedder).collect()} == {"a": [1.0], "b": [8.0], "c": None, "d": [1.0]}
    assert {r.node_id: r.vector for r in Y.embedded(now, None, embedder).collect()} == {"a": [1.0], "b": [8.0], "c": None, "d": [1.0]}


def test_generated_docstrings(spark):
    given = [("a", "f", "def f(): ...", "Own words.", "h1"), ("b", "g", "def g(): ...", None, "h2"), ("c", "g", "def g(): ...", "", "h2"), ("d", "k", "def k(): ...", None, "h3"), ("e", "", "def k(): ...", None, "h4"), ("f", "s", "def s(): ...", None, "h5")]
    functions = spark.createDataFrame(given, "node_id string, name string, chunk string, docstring string, body_hash string")
    cache = spark.createDataFrame([("h3", "Cached.")], "body_hash string, doc string")
    provider = lambda name, chunk: F.when(name == "s", "Too short.").otherwise(F.concat(F.lit("Tells what the function "), name, F.lit(" does. And more.")))
    known, grown = Y.with_generated_docs(functions, cache, provider)
    told = "Tells what the function g does."
    assert {r.node_id: (r.docstring, r.docstring_source) for r in known.collect()} == {"a": ("Own words.", "native"), "b": (told, "auto"), "c": (told, "auto"), "d": ("Cached.", "auto"), "e": ("", "none"), "f": ("", "none")}
    assert sorted(map(tuple, grown.collect())) == [("h2", told), ("h3", "Cached.")]
    assert {r.docstring_source for r in Y.with_generated_docs(functions, cache)[0].collect()} == {"native", "auto", "none"}
