"""From a folder to an answer, and again after changes; two writers of one graph."""

import os
import threading

import pytest
from pyspark.sql import functions as F

from graphloom.operators import delta as D
from graphloom.operators import workspace_search as W
from graphloom.sources import store
from graphloom.sources.workspace import scan

FILES = {
    "bakery/dough.py": "from bakery import oven\n\n\nclass Dough:\n    \"\"\"Flour and water that rise.\"\"\"\n\n    def knead(self, minutes):\n        return self.rest(minutes)\n\n    def rest(self, minutes):\n        return heat_oven(minutes)\n\n\ndef heat_oven(n):\n    \"\"\"Heat the oven before baking bread.\"\"\"\n    return oven.warm(n)\n",
    "bakery/oven.py": "def warm(n):\n    return n + 1\n\n\ndef cool(n):\n    return n - 1\n",
    "bakery/__init__.py": "",
}


def write(root, files, at):
    for path, text in files.items():
        (root / path).parent.mkdir(parents=True, exist_ok=True)
        (root / path).write_text(text)
        os.utime(root / path, (at, at))


def spoken(name, chunk):
    return F.concat(F.lit("It says what the function "), name, F.lit(" is good for. More."))


def test_search_and_search_again(spark, tmp_path):
    root, folder = tmp_path / "work", f"file://{tmp_path}/graphs"
    root.mkdir()
    write(root, FILES, 1000)
    first = W.search(spark, str(root), ["heat the oven before baking"], ["knead", "Dough.rest", "no such thing"], folder, provider=spoken)
    parts = first.split("\n\n")
    assert first.startswith("## Search\n\ngrep#1:\nknead: 7:8:bakery/dough.py\nknead (anchor) -> rest\n") and "grep#2:\nknead -> rest (anchor) -> heat_oven\nheat_oven: 14:16:bakery/dough.py" in first
    assert parts[0] == "## Search" and "searchQuery#1:" in first
    at = f"{folder}/{store.graph_key(str(root))}"
    number, tables = store.load_tables(spark, at)
    docs = {r.name: (r.doc, r.docstring_source) for r in tables["searchable"].collect()}
    assert number == 1 and docs["warm"] == ("It says what the function warm is good for.", "auto") and docs["heat_oven"][1] == "native"
    assert "Doc: It says what the function warm" in {r.name: r.text for r in tables["searchable"].collect()}["warm"]
    # Nothing changed: the same answer from the same version.
    assert W.search(spark, str(root), ["heat the oven before baking"], ["knead", "Dough.rest", "no such thing"], folder, provider=spoken) == first and store.load_tables(spark, at)[0] == 1
    # A file changes: only its new texts are embedded and documented, and the next version equals a graph built anew.
    write(root, {"bakery/oven.py": "def warm(n):\n    return n + 1\n\n\ndef chill(n):\n    return n - 2\n"}, 2000)
    refused = lambda name, chunk: F.when(name == "chill", spoken(name, chunk)).otherwise(F.raise_error(F.lit("asked again")))
    second = W.search(spark, str(root), [], ["chill", "warm"], folder, provider=refused)
    assert "chill: 5:6:bakery/oven.py" in second and "cool" not in second
    number, tables = store.load_tables(spark, at)
    new = D.built(scan(spark, str(root)))
    assert number == 2
    for name in ("nodes", "edges", "uses"):
        assert sorted(map(repr, tables[name].select(*getattr(new, name).columns).collect())) == sorted(map(repr, getattr(new, name).collect()))


def test_nothing_to_ask_and_nothing_to_find(spark, tmp_path):
    (tmp_path / "none").mkdir()
    assert W.search(spark, str(tmp_path / "none"), [], [], f"file://{tmp_path}/g") == "## Search"
    assert W.search(spark, str(tmp_path / "none"), ["anything", " "], ["x"], f"file://{tmp_path}/g") == "## Search\n\ngrep#1:\n(no matches)\n\nsearchQuery#1:\n(no matches)\n\nsearchQuery#2:\n(no matches)"


def numbers(tables):
    return {r.n for r in tables["rows"].collect()}


@pytest.mark.parametrize("kind", ["file", "viewfs"])
def test_two_writers_lose_nothing(spark, tmp_path, kind):
    spark._jsc.hadoopConfiguration().set("fs.viewfs.mounttable.shelf.link./in", f"file://{tmp_path}")
    folder = f"file://{tmp_path}/graph" if kind == "file" else "viewfs://shelf/in/graph"
    store.commit(spark, folder, {"rows": spark.range(0).withColumnRenamed("id", "n")}, 0)
    both, runs, failed = threading.Barrier(2, timeout=60), [], []

    def add(n):
        def change(tables):
            runs.append(n)
            if runs.count(n) == 1:
                both.wait()  # both have read the same version
            return {"rows": tables["rows"].unionByName(spark.createDataFrame([(n,)], "n long"))}

        try:
            store.update(spark, folder, change)
        except Exception as error:  # noqa: BLE001
            failed.append(error)

    threads = [threading.Thread(target=add, args=(n,)) for n in (1, 2)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    number, tables = store.load_tables(spark, folder)
    # One of them had to start again, from what the other had written.
    assert not failed and numbers(tables) == {1, 2} and number == 3 and len(runs) == 3
    with pytest.raises(store.Conflict):
        store.commit(spark, folder, {"rows": tables["rows"]}, 1)
    assert numbers(store.load_tables(spark, folder)[1]) == {1, 2}


def test_versions_of_another_schema_are_not_read(spark, tmp_path, monkeypatch):
    folder = f"file://{tmp_path}/graph"
    monkeypatch.setattr(store, "SCHEMA_VERSION", 1)
    store.commit(spark, folder, {"rows": spark.range(3)}, 0)
    monkeypatch.undo()
    assert store.load_tables(spark, folder) == (1, None)
    assert store.update(spark, folder, lambda was: {"rows": spark.range(4)} if was is None else was)["rows"].count() == 4
    # What a job that failed left behind is not read.
    spark.range(9).write.parquet(f"{folder}/left-behind/rows")
    assert store.load_tables(spark, folder)[1]["rows"].count() == 4
