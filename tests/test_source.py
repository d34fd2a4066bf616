"""A small workspace with what is easy to get wrong, from files to resolved calls."""

import pytest

from pyspark.sql import functions as F

from graphloom.operators import compile as C
from graphloom.operators import graph as G
from graphloom.operators import resolve as R
from graphloom.sources import python_source as P
from graphloom.sources import skeleton as K
from graphloom.sources import store
from graphloom.sources.workspace import scan

FILES = {
    ".gitignore": "build_out/\n*.log\n",
    "main.py": 'import os\nfrom pkg.core import Session, send_all\nfrom pkg import util\n\nTIMEOUT = 5\nLIMIT: int = 10\n\n\ndef run(url):\n    """Run one request."""\n    s = Session()\n    return s.send(url)\n\n\nrun("x")\n',
    "pkg/__init__.py": "",
    "pkg/base.py": "class Base:\n    pass\n\n\ndef helper():\n    return 0\n",
    "pkg/core.py": 'from .base import Base\nfrom .util import helper\n\n\nclass Session(Base):\n    """HTTP session."""\n\n    @property\n    def name(self):\n        return helper()\n\n    def send(self, url, *, retries=3):\n        def retry(n):\n            return self.send(url)\n        return retry(retries)\n\n\ndef send_all(urls):\n    return [send(u) for u in urls]\n',
    "pkg/util.py": "def helper():\n    return helper_impl()\n\n\nif True:\n    def helper_impl():\n        return 1\n",
    "script.py": 'from main import run\n\nrun("y")\n',
    "broken.py": "def (:\n",
    "build_out/gone.py": "X = 1\n",
    "notes.txt": "X = 1\n",
}


@pytest.fixture
def parsed(spark, tmp_path):
    for name, text in FILES.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    (tmp_path / "pkg/again").symlink_to(tmp_path, target_is_directory=True)
    (tmp_path / "binary.py").write_bytes(b"\xff\xfe\xff")
    return P.parse(scan(spark, str(tmp_path)))


def rows(df):
    return {tuple(r) for r in df.collect()}


def test_workspace(parsed):
    assert rows(parsed.filter("kind in ('FILE', 'ERROR')").select("rel_path", "kind")) == {("main.py", "FILE"), ("pkg/__init__.py", "FILE"), ("pkg/base.py", "FILE"), ("pkg/core.py", "FILE"), ("pkg/util.py", "FILE"), ("script.py", "FILE"), ("broken.py", "ERROR"), ("binary.py", "ERROR")}
    assert rows(P.entities(parsed).select("node_id", "type", "is_method", "signature")) == {
        ("main.py::TIMEOUT", "CONSTANT", False, None), ("main.py::LIMIT", "CONSTANT", False, None), ("main.py::run", "FUNCTION", False, "(url)"), ("pkg/base.py::Base", "CLASS", False, None), ("pkg/base.py::helper", "FUNCTION", False, "()"),
        ("pkg/core.py::Session", "CLASS", False, None), ("pkg/core.py::Session.name", "FUNCTION", True, "(self)"), ("pkg/core.py::Session.send", "FUNCTION", True, "(self, url)"),
        ("pkg/core.py::Session.retry", "FUNCTION", True, "(n)"), ("pkg/core.py::send_all", "FUNCTION", False, "(urls)"), ("pkg/util.py::helper", "FUNCTION", False, "()"), ("pkg/util.py::helper_impl", "FUNCTION", False, "()"),
    }
    assert rows(P.class_bases(parsed)) == {("pkg/core.py::Session", "pkg/core.py", "Base")}


def test_imports_and_calls(parsed):
    relative = P.relative_imports(parsed)
    assert rows(relative) == {("pkg/core.py", "pkg/base.py"), ("pkg/core.py", "pkg/util.py")}
    absolute = R.absolute_imports(P.imported_names(parsed), P.modules(parsed)).filter("file_path is not null").selectExpr("import_id AS src", "file_path AS dst")
    assert {("main.py", "pkg/core.py"), ("main.py", "pkg/util.py"), ("main.py", "pkg/__init__.py")} <= rows(absolute)


def test_compiled_graph(spark):
    files = spark.createDataFrame([(k, v) for k, v in FILES.items() if k.endswith(".py") and not k.startswith("build_out")], "rel_path string, source string")
    nodes, edges = C.compile_graph(files)
    assert rows(nodes.filter("type in ('FILE', 'MODULE')").select("node_id", "type", "name")) == {("pkg", "MODULE", "pkg"), *((f, "FILE", f.split("/")[-1]) for f in FILES if f.endswith(".py") and not f.startswith("build_out"))}
    assert {r[0]: (r[1], r[2]) for r in nodes.filter("type not in ('FILE', 'MODULE')").select("node_id", "start_line", "end_line").collect()} == {
        "main.py::run": (9, 12), "main.py::TIMEOUT": (5, 5), "main.py::LIMIT": (6, 6), "pkg/base.py::helper": (5, 6), "pkg/base.py::Base": (1, 2), "pkg/core.py::send_all": (18, 19), "pkg/core.py::Session": (5, 15),
        "pkg/core.py::Session.name": (9, 10), "pkg/core.py::Session.send": (12, 15), "pkg/util.py::helper": (1, 2), "pkg/core.py::Session.retry": (13, 14), "pkg/util.py::helper_impl": (6, 7),
    }
    assert rows(nodes.filter("text is null and type not in ('FILE', 'MODULE')").select("node_id")) == {("main.py::LIMIT",)}
    of = lambda kind: rows(edges.filter(F.col("relationship") == kind).select("src", "dst"))
    assert of("MEMBER_OF") == {("pkg", f"pkg/{f}.py") for f in ("__init__", "base", "core", "util")} and of("SUBMODULE_OF") == set()
    assert of("CONTAINS") == {(r[0].split("::")[0], r[0]) for r in nodes.filter("file_path is not null").select("node_id").collect()} and len(of("CONTAINS")) == 12
    assert of("IMPORTS") == {("main.py", "pkg/__init__.py"), ("main.py", "pkg/core.py"), ("main.py", "pkg/util.py"), ("pkg/core.py", "pkg/base.py"), ("pkg/core.py", "pkg/util.py"), ("script.py", "main.py")}
    assert of("INHERITS_FROM") == {("pkg/core.py::Session", "pkg/base.py::Base")}
    core = "pkg/core.py::"
    assert of("CALLS") == {
        ("main.py", "main.py::run"), ("main.py::run", core + "Session"), (core + "Session.name", "pkg/util.py::helper"), (core + "Session.send", core + "Session.retry"), (core + "Session.send", core + "Session.send"),
        (core + "send_all", core + "Session.send"), ("pkg/util.py::helper", "pkg/util.py::helper_impl"),
    }
    shares = {r[0]: r[1] for r in G.call_centrality(nodes, edges).select("node_id", "call_centrality").collect()}
    assert shares[core + "Session.send"] == 1.0 and shares["main.py::run"] == shares["pkg/util.py::helper"] == 0.5 and shares["pkg/base.py::Base"] == 0.0 and "main.py::LIMIT" not in shares


def test_saved_graphs(spark, tmp_path):
    folder = f"file://{tmp_path}/{store.graph_key('/work')}"
    assert store.load_graph(spark, folder) is None
    nodes = spark.createDataFrame([("a",)], "node_id string")
    edges = spark.createDataFrame([("a", "a", "CALLS")], "src string, dst string, relationship string")
    store.save_graph(nodes, edges, folder)
    # A graph that was read can be saved under the same folder.
    old = store.load_graph(spark, folder)
    store.save_graph(old[0].unionByName(spark.createDataFrame([("b",)], "node_id string")), old[1], folder)
    assert rows(store.load_graph(spark, folder)[0]) == {("a",), ("b",)}
    assert store.load_docs(spark, f"file://{tmp_path}/docs").collect() == []
    store.save_docs(spark.createDataFrame([("h", "doc"), ("", "x"), ("k", None)], "body_hash string, doc string"), f"file://{tmp_path}/docs")
    assert rows(store.load_docs(spark, f"file://{tmp_path}/docs")) == {("h", "doc")}


def test_facts_of_odd_sources():
    assert P.facts(None)[0]["kind"] == "ERROR" and P.facts("\0")[0]["kind"] == "ERROR"
    assert P.facts("") == [{"kind": "FILE", "doc": None, "calls": []}]
    one, two = (P.facts(f'def f(a):\n    """{doc}"""\n    return a\n')[1] for doc in "xy")
    assert one["body_hash"] == two["body_hash"] and one["doc"] != two["doc"]
    assert P.facts("def f(b):\n    return b\n")[1]["body_hash"] != one["body_hash"]
    assert P.facts("class A(B[int], c.D, e(), *f): pass")[1]["bases"] == ["B", "D", "e"]


def test_chunks():
    odd = P.facts('class A:\r\n    @f\r\n    def é(self): return "é"; x = 1\n')
    assert [x["chunk"] for x in odd[1:]] == ['class A:\n    @f\n    def é(self): return "é"; x = 1', 'def é(self): return "é"; x = 1']


FUNCTION = '''
@timed
def bake(dough, oven, *trays, hot=False) -> Loaf:
    """Bake all trays."""
    while oven.temperature() < 230:
        oven.wait(1)
    (first, rest), count = split(trays), len(trays)
    for tray in rest:
        yield tray
    if hot and count:
        return first
    return oven.empty(dough)
'''
CLASS = '''class Recipe(Card, Mapping[str, Gram]):
    """What goes into a loaf."""
    UNIT: str = "g"
    servings = 4

    def scale(self, factor):
        """Multiply.
        All of it."""
        return weigh(self, factor)

    async def order(self): pass
'''


def test_outlines():
    function, recipe = K.outline(FUNCTION), K.outline(CLASS)
    assert function[0] == "Signature: @timed" and {"Decorators: timed", "Docstring: Bake all trays.", "Return type: Loaf", "Calls: empty, len, split, temperature, wait", "Yields: tray", "Return expressions: oven.empty(dough), first"} <= set(function)
    assert not any("while" in x or "for tray" in x for x in function)
    assert recipe[:4] == ["Type: CLASS", "Name: Recipe", "Inherits: Card, Mapping[str, Gram]", "Docstring: What goes into a loaf."]
    assert "  - def scale(self, factor)  # Multiply." in recipe and any(x.startswith("Attributes: ") and "UNIT" in x and "servings" in x for x in recipe) and not any("weigh(self" in x for x in recipe)
    assert K.outline("def f():\n    return " + "a" * 90)[1] == "Return expressions: " + "a" * 77 + "..."
    assert K.outline(None) == K.outline(" ") == K.outline("X = 1") == [] and K.outline("def (:") is None


def test_skeletons_and_passages(spark):
    given = [("def f(): return g()", "Type: FUNCTION", "C", "a.py"), ("def (:", " t ", None, "a.py"), (" def (: ", None, None, None), (None, "t", "C", "a.py"), ("X = 1", "", "C", ""), ("", None, None, None)]
    df = spark.createDataFrame(given, "chunk string, text string, owner string, path string")
    parts = [F.col(c) for c in df.columns]
    whole = "Signature: def f()\nClass: C\nCalls: g\nReturn expressions: g()\nFile: a.py"
    assert [tuple(r) for r in df.select(K.skeleton(*parts), K.rerank_passage(*parts)).collect()] == [(whole, f"Type: FUNCTION\n\n{whole}"), ("t", "t"), ("def (:", "def (:"), ("t", "t"), ("", ""), ("", "")]
