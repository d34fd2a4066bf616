"""Python files of a folder tree as rows. Files whose names begin with an underscore count too, which Spark's file readers skip."""

from __future__ import annotations

import os

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Folders that are ignored without being asked for.
IGNORED = [".git", ".cursor", ".venv", "venv", "env", "__pycache__", "node_modules", ".pytest_cache", ".mypy_cache", "build", "dist", ".*"]


def ignore_patterns(root: str) -> list[str]:
    """The default patterns and those of the root's ignore file, each to be equal to a segment of a path."""
    try:
        with open(os.path.join(root, ".gitignore"), encoding="utf-8") as f:
            own = [line.strip() for line in f]
    except (OSError, UnicodeDecodeError):
        own = []
    return sorted({*IGNORED, *(x.rstrip("/") for x in own if x and not x.startswith("#"))})


def ignored(path: Column, patterns: list[str]) -> Column:
    return F.arrays_overlap(F.split(path, "/"), F.lit(patterns))


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(schema)], schema=schema)


def _list(root: str, patterns: frozenset[str]):
    """Paths below entries of the root. Links are followed, and a folder that a link leads back to is not entered again."""
    schema = pa.schema([("rel_path", pa.string()), ("mtime", pa.float64())])

    def run(batches):
        for batch in batches:
            rows: list[tuple] = []
            for entry in batch.column("entry").to_pylist():
                top = os.path.join(root, entry)
                around = {top: {os.path.realpath(root)}}
                for folder, folders, names in os.walk(top, followlinks=True) if os.path.isdir(top) else [(root, [], [entry])]:
                    above = around.pop(folder, set()) | {os.path.realpath(folder)}
                    folders[:] = [x for x in sorted(folders) if x not in patterns and os.path.realpath(os.path.join(folder, x)) not in above]
                    around.update((os.path.join(folder, x), above) for x in folders)
                    for name in sorted(names):
                        full = os.path.join(folder, name)
                        if name.endswith(".py") and name not in patterns and os.path.exists(full):
                            rows.append((os.path.relpath(full, root), os.path.getmtime(full)))
                    if len(rows) >= 1000:
                        yield _batch(rows, schema)
                        rows = []
            yield _batch(rows, schema)

    return run


def _read(root: str):
    schema = pa.schema([("rel_path", pa.string()), ("mtime", pa.float64()), ("source", pa.string())])

    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 100):
                rows = []
                for path, mtime in zip(*(batch.slice(lo, 100).column(c).to_pylist() for c in ("rel_path", "mtime")), strict=True):
                    try:
                        with open(os.path.join(root, path), encoding="utf-8") as f:
                            rows.append((path, mtime, f.read()))
                    except (OSError, UnicodeDecodeError):
                        rows.append((path, mtime, None))
                yield _batch(rows, schema)

    return run


def dealt(df: DataFrame, key: str) -> DataFrame:
    """df in as many parts as a shuffle has, however few bytes it is: files are small, and cost time all the same."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)


def scan(spark: SparkSession, root: str) -> DataFrame:
    """rel_path, mtime and source (null if it can't be read) of the Python files below root, a folder that all workers see.
    The driver lists the topmost level only; tasks list what lies below, and others read it, a like number of files each."""
    patterns = ignore_patterns(root)
    entries = [(x,) for x in sorted(os.listdir(root)) if x not in patterns]
    found = spark.createDataFrame(entries, "entry string").repartition(max(1, min(len(entries), 200)), "entry")
    paths = found.mapInArrow(_list(root, frozenset(patterns)), "rel_path string, mtime double")
    return dealt(paths, "rel_path").mapInArrow(_read(root), "rel_path string, mtime double, source string")
