"""Graphs as node-link JSON: {"directed", "multigraph", "graph": {...}, "nodes": [{"id", ...}], "edges": [{"source", "target", ...}]}.

``write`` makes a folder of text files that are one JSON document when they are read one after another; each node and
each edge has a line of its own, so tasks write them, and ``read`` takes them apart line by line, without a task that
sees the whole. Documents of other writers, one object on any number of lines, are read as a whole, as JSON demands, and
may call the edges "links", as older writers did. "graph" has a schema number; documents without one are of schema 1,
whose nodes have a line_span "start-end" and no lines.

Defined results. Unknown attributes are left out, missing ones are null. A node without an id, and an edge without both
ends, is left out. An empty graph has an empty list of each. A file that is no such JSON raises ValueError.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SCHEMA = 2
NODE = "id string, type string, name string, file_path string, class_name string, is_method boolean, start_line int, end_line int, line_span string, signature string, docstring string, docstring_source string, body_hash string, chunk_text string, embedding_text string, embedding array<float>, call_centrality double"
EDGE = "source string, target string, relationship string"
_HEAD = f'{{"directed": true, "multigraph": false, "graph": {{"schema": {SCHEMA}}}, "nodes": ['
#: What the attributes are called in tables of nodes, where the names differ.
_TABLE = {"id": "node_id", "docstring": "doc", "chunk_text": "chunk", "embedding_text": "text", "embedding": "vector"}


def _lines(df: DataFrame, section: int, by: list[str]) -> DataFrame:
    """(section, key, line): a row's JSON; the first one in order has no comma before it."""
    rows = df.select(F.to_json(F.struct(*by)).alias("key"), F.to_json(F.struct(*df.columns)).alias("json"))
    first = rows.agg(F.min(F.struct("key", "json")).alias("first"))
    comma = F.when(F.struct("key", "json") == F.col("first"), "").otherwise(",")
    return rows.join(F.broadcast(first), how="left").select(F.lit(section).alias("section"), "key", "json", F.concat(comma, "json").alias("line"))


def write(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """nodes(node_id, ...) and edges(src, dst, relationship), different rows each, to a folder that does not exist yet."""
    spark = nodes.sparkSession
    named = {v: k for k, v in _TABLE.items()}
    known = {f.name for f in T.StructType.fromDDL(NODE)}
    own = nodes.dropDuplicates(["node_id"]).select(*[F.col(c).alias(named.get(c, c)) for c in nodes.columns if named.get(c, c) in known])
    links = edges.select(F.col("src").alias("source"), F.col("dst").alias("target"), "relationship").distinct()
    marks = spark.createDataFrame([(0, "", "", _HEAD), (2, "", "", '], "edges": ['), (4, "", "", "]}")], "section int, key string, json string, line string")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    whole = marks.unionByName(_lines(own, 1, ["id"])).unionByName(_lines(links, 3, ["source", "target", "relationship"]))
    whole.repartitionByRange(parts, "section", "key", "json").sortWithinPartitions("section", "key", "json").select("line").write.text(path)


def _tables(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    span = F.regexp_extract("line_span", r"^\s*(\d+)\s*-\s*(\d+)\s*$", 1), F.regexp_extract("line_span", r"^\s*(\d+)\s*-\s*(\d+)\s*$", 2)
    line = lambda c, s: F.coalesce(F.col(c), F.when(s != "", s.cast("int"))).alias(c)
    columns = [line("start_line", span[0]) if f.name == "start_line" else line("end_line", span[1]) if f.name == "end_line" else F.col(f.name).alias(_TABLE.get(f.name, f.name)) for f in T.StructType.fromDDL(NODE) if f.name != "line_span"]
    return nodes.filter("id is not null").select(*columns), edges.filter("source is not null and target is not null").select(F.col("source").alias("src"), F.col("target").alias("dst"), "relationship")


def _object(line: Column) -> Column:
    return F.regexp_replace(F.trim(line), "^,", "")


def read(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges): node_id, type, name, file_path, ... and src, dst, relationship."""
    lines = spark.read.text(path)
    if not lines.filter(F.col("value") == _HEAD).isEmpty():
        objects = lines.select(_object(F.col("value")).alias("json")).filter(F.col("json").startswith("{") & (F.col("json") != _HEAD))
        own = objects.select(F.from_json("json", NODE).alias("n"), F.from_json("json", EDGE).alias("e"))
        return _tables(own.select("n.*"), own.select("e.*"))
    schema = f"nodes array<struct<{_colons(NODE)}>>, edges array<struct<{_colons(EDGE)}>>, links array<struct<{_colons(EDGE)}>>, _corrupt_record string"
    whole = spark.read.schema(schema).option("multiLine", True).option("mode", "PERMISSIVE").json(path)
    if whole.isEmpty() or not whole.filter("nodes is null or _corrupt_record is not null").isEmpty():
        raise ValueError(f"{path} is no node-link JSON")
    return _tables(whole.select(F.inline("nodes")), whole.select(F.inline(F.coalesce("edges", "links", F.array().cast(f"array<struct<{_colons(EDGE)}>>")))))


def _colons(ddl: str) -> str:
    return ", ".join(f"{f.name}: {f.dataType.simpleString()}" for f in T.StructType.fromDDL(ddl))


def hydrated(nodes: DataFrame, known: DataFrame, columns: tuple[str, ...] = ("start_line", "end_line", "body_hash", "chunk", "text", "vector")) -> DataFrame:
    """nodes with what known(node_id, ...) says of them in columns, where it says something; nodes that are known alone are not added."""
    given = [c for c in columns if c in known.columns]
    told = known.groupBy("node_id").agg(*[F.first(c, ignorenulls=True).alias(f"__{c}") for c in given])
    both = nodes.join(told, "node_id", "left")
    kept = [F.coalesce(f"__{c}", c).alias(c) if c in given else F.col(c) for c in nodes.columns]
    return both.select(*kept, *[F.col(f"__{c}").alias(c) for c in given if c not in nodes.columns])
