"""The data source gives what ``scan`` gives, opens only what is asked for, and reads other file systems."""

import os

import pytest
from pyspark.sql import functions as F

from graphloom.sources import workspace_source as W
from graphloom.sources.workspace import scan

FILES = {"__init__.py": "", "app.py": "import pkg\r\nx = 1\r", "pkg/__init__.py": "from . import a\n", "pkg/a.py": "def f():\n    return 1\n", "pkg/_own.py": "y = 2\n", "pkg/deep/er/b.py": "z = 3\n", "pkg/deep/notes.txt": "no", "build/gone.py": "", "skip_me/gone.py": "", "pkg/.hidden.py": "h = 1\n", "pkg/venv/gone.py": "", "other/c.py": "é = 1\n", "other/left_out.py": ""}


@pytest.fixture(scope="module")
def tree(tmp_path_factory):
    root = tmp_path_factory.mktemp("tree")
    for k, (path, text) in enumerate(FILES.items()):
        (root / path).parent.mkdir(parents=True, exist_ok=True)
        (root / path).write_bytes(text.encode())
        os.utime(root / path, (1000 + k, 1000 + k))
    (root / "pkg/latin.py").write_bytes(b"x = '\xe9'\n")
    (root / ".gitignore").write_text("# own\nskip_me/\nleft_out.py\n")
    (root / "pkg/deep/back").symlink_to(root / "pkg")
    (root / "pkg/deep/side").symlink_to(root / "other")
    (root / "pkg/nowhere.py").symlink_to(root / "not/there.py")
    (root / "empty").mkdir()
    return root


def rows(df):
    return sorted(map(tuple, df.select("rel_path", F.round("mtime", 3), "source").collect()), key=repr)


@pytest.mark.parametrize("partitions", ["1", "2", "200"])
def test_source_equals_scan(spark, tree, partitions):
    W.register(spark)
    want = rows(scan(spark, str(tree)))
    assert {r[0] for r in want} >= {"__init__.py", "pkg/_own.py", "pkg/deep/er/b.py", "pkg/latin.py", "pkg/deep/side/c.py"} and len(want) == 10
    read = spark.read.format("workspace").option("partitions", partitions)
    assert rows(read.load(str(tree))) == want == rows(read.load(f"file://{tree}"))


def test_filters_reach_the_files(spark, tree):
    W.register(spark)
    want = [r for r in rows(scan(spark, str(tree)))]
    read = spark.read.format("workspace").option("store", "tests.shelf_store:opened").load(f"shelf://{tree}")
    # A file system that knows no links enters linked folders by their names; a loop would not end, so ask for a part.
    log = f"{tree}.opened"

    def asked(df):
        open(log, "w").close()
        got = rows(df)
        with open(log) as f:
            return got, sorted(x.lstrip("/") for x in f.read().split() if x.endswith(".py"))

    got, files = asked(read.filter(F.col("rel_path").startswith("pkg/deep/er/")))
    assert got == [r for r in want if r[0].startswith("pkg/deep/er/")] and files == ["pkg/deep/er/b.py"]
    got, files = asked(read.filter(F.col("rel_path").isin("app.py", "other/c.py", "build/gone.py")))
    assert [r[0] for r in got] == ["app.py", "other/c.py"] == files
    local = spark.read.format("workspace").load(str(tree))
    assert rows(local.filter((F.col("mtime") > 1001) & (F.col("mtime") <= 1004) & (F.length("source") > 0))) == [r for r in want if 1001 < r[1] <= 1004 and r[2]]


def test_list_without_sources_and_errors(spark, tree):
    W.register(spark)
    listed = spark.read.format("workspace").option("content", "false").option("patterns", "other deep").load(str(tree))
    assert listed.columns == ["rel_path", "mtime"] and {r.rel_path for r in listed.collect()} == {"__init__.py", "app.py", "pkg/__init__.py", "pkg/a.py", "pkg/_own.py", "pkg/.hidden.py", "pkg/latin.py"}
    assert spark.read.format("workspace").load(f"{tree}/empty").collect() == []
    with pytest.raises(Exception, match="FileNotFoundError"):
        spark.read.format("workspace").load(f"{tree}/no_such").collect()
