"""Tables of a code graph in the folder that driver and executors share: scratch tables, and versions of a saved graph.

A version's tables are written to a folder of their own. What makes them the graph is the file of the next number in
``log``, which is created only if nobody has: of several writers that started from the same version one succeeds, and
the others start again from what it wrote. No clock is asked, readers see a whole version or the one before, and what
a job that failed left behind is never read. Missing or unreadable graphs, and those of another schema, load as None.

Creation that fails if the file exists is the file system's: of the machine for ``file:``, of Hadoop's for others.
"""

from __future__ import annotations

import errno
import hashlib
import json
import os
import re
import tempfile
import uuid
from collections.abc import Callable
from urllib.parse import unquote, urlparse

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: What the columns of saved tables mean; graphs of another schema are built anew.
SCHEMA_VERSION = 2


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a temporary folder where that is unset and all runs on this machine."""
    if folder := spark.conf.get("spark.checkpoint.dir", None):
        return folder
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return "file://" + tempfile.gettempdir()


def stored(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder: it is computed once, and a lost executor costs a read."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def graph_key(root: str) -> str:
    """The name of a workspace's graph: a digest of its root's path."""
    return "graph_" + hashlib.md5(root.encode()).hexdigest()


class Conflict(Exception):
    """Somebody else committed the version."""


def _local(folder: str) -> str | None:
    """The path of a folder of this machine's file system; None for other file systems."""
    parts = urlparse(folder)
    return unquote(parts.path) if parts.scheme == "file" else folder if not parts.scheme else None


def _hadoop(spark: SparkSession, path: str):
    """(file system, path) of Hadoop's API."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def create_once(spark: SparkSession, path: str, text: str) -> None:
    """Writes a small file that does not exist yet; Conflict if it does."""
    if (own := _local(path)) is not None:
        os.makedirs(os.path.dirname(own), exist_ok=True)
        part = f"{own}.{uuid.uuid4().hex}.part"
        with open(part, "w", encoding="utf-8") as f:
            f.write(text)
        try:
            os.link(part, own)  # whole from the start, and only if there is none
        except OSError as error:
            if error.errno == errno.EEXIST:
                raise Conflict(path) from None
            raise
        finally:
            os.unlink(part)
        return
    files, at = _hadoop(spark, path)
    try:
        out = files.create(at, False)
        out.write(text.encode())
        out.close()
    except Py4JJavaError as error:
        if "AlreadyExists" in error.java_exception.getClass().getName() or files.exists(at):
            raise Conflict(path) from None
        raise


def last_commit(spark: SparkSession, folder: str) -> tuple[int, dict | None]:
    """(number, what was committed) of the last version; (0, None) where there is none."""
    try:
        files, at = _hadoop(spark, f"{folder}/log")
        names = [x.getPath().getName() for x in files.listStatus(at)] if files.exists(at) else []
    except Py4JJavaError:
        return 0, None
    numbers = [int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit()]
    if not numbers:
        return 0, None
    last = max(numbers)
    try:
        return last, json.loads(spark.read.text(f"{folder}/log/{last:010d}.json", wholetext=True).first()[0])
    except (AnalysisException, ValueError, TypeError):
        return last, None


def commit(spark: SparkSession, folder: str, tables: dict[str, DataFrame], after: int) -> int:
    """Writes tables as the version after the given one, and returns its number; Conflict if there is one already."""
    version = uuid.uuid4().hex
    for name, df in tables.items():
        df.write.parquet(f"{folder}/{version}/{name}")
    create_once(spark, f"{folder}/log/{after + 1:010d}.json", json.dumps({"version": version, "schema": SCHEMA_VERSION, "tables": sorted(tables)}))
    return after + 1


def load_tables(spark: SparkSession, folder: str) -> tuple[int, dict[str, DataFrame] | None]:
    """(number, tables by name) of the last version; None for the tables if there is none, or it is of another schema."""
    number, last = last_commit(spark, folder)
    if last is None or last.get("schema") != SCHEMA_VERSION:
        return number, None
    try:
        return number, {name: spark.read.parquet(f"{folder}/{last['version']}/{name}") for name in last["tables"]}
    except AnalysisException:
        return number, None


def update(spark: SparkSession, folder: str, change: Callable[[dict[str, DataFrame] | None], dict[str, DataFrame]], tries: int = 5) -> dict[str, DataFrame]:
    """Commits what change makes of the current tables (None at first). If another writer was faster, change runs again on what that one wrote."""
    for k in range(tries):
        number, tables = load_tables(spark, folder)
        made = change(tables)
        try:
            commit(spark, folder, made, number)
        except Conflict:
            if k + 1 == tries:
                raise
            continue
        return load_tables(spark, folder)[1] or made
    raise ValueError("tries must be 1 or more")


def save_graph(nodes: DataFrame, edges: DataFrame, folder: str) -> int:
    """Commits a graph as the next version, whatever the current one is; returns its number."""
    update(nodes.sparkSession, folder, lambda _: {"nodes": nodes, "edges": edges})
    return last_commit(nodes.sparkSession, folder)[0]


def load_graph(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame] | None:
    """(nodes, edges) of the last version, or None if there is none of this schema."""
    tables = load_tables(spark, folder)[1]
    return (tables["nodes"], tables["edges"]) if tables and {"nodes", "edges"} <= set(tables) else None


def save_docs(cache: DataFrame, path: str) -> None:
    """Writes a cache (body_hash, doc) of generated docstrings, as lines of JSON."""
    cache.select("body_hash", "doc").write.mode("overwrite").json(path)


def load_docs(spark: SparkSession, path: str) -> DataFrame:
    """The cache without empty keys and texts; nothing where there is none."""
    try:
        cache = spark.read.schema("body_hash string, doc string").json(path)
        cache.limit(1).collect()
    except AnalysisException:
        cache = spark.createDataFrame([], "body_hash string, doc string")
    return cache.filter("coalesce(body_hash, '') != '' and coalesce(doc, '') != ''")
