"""Edges and degrees of the code graph. Tables: nodes(node_id, type, name, file_path, node_ord, ...), edges(src, dst, relationship)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CALLABLE = ("CLASS", "FUNCTION")


def call_centrality(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """nodes of classes and functions with calls_in_degree and call_centrality, its share of the largest degree."""
    degree = edges.filter("relationship = 'CALLS'").groupBy(F.col("dst").alias("node_id")).agg(F.count("*").alias("d"))
    counted = nodes.filter(F.col("type").isin(*CALLABLE)).join(degree, "node_id", "left").withColumn("calls_in_degree", F.coalesce("d", F.lit(0))).drop("d")
    # The largest degree is one row, joined back, rather than a window over all nodes in one task.
    top = counted.agg(F.max("calls_in_degree").alias("top"))
    share = F.when(F.col("top") > 0, F.col("calls_in_degree") / F.col("top")).otherwise(0.0)
    return counted.join(F.broadcast(top), how="left").withColumn("call_centrality", share).drop("top")


def summary(nodes: DataFrame, edges: DataFrame, node_types: list[str], edge_types: list[str]) -> DataFrame:
    """(kind, label, n) for given types, zeros included, and the totals."""
    spark = nodes.sparkSession
    domain = spark.createDataFrame([("node", t) for t in node_types] + [("edge", t) for t in edge_types], "kind string, label string")
    found = nodes.groupBy(F.lit("node").alias("kind"), F.col("type").alias("label")).count().unionByName(edges.groupBy(F.lit("edge").alias("kind"), F.col("relationship").alias("label")).count())
    totals = nodes.agg(F.count("*").alias("n")).select(F.lit("node").alias("kind"), F.lit("total").alias("label"), "n").unionByName(edges.agg(F.count("*").alias("n")).select(F.lit("edge").alias("kind"), F.lit("total").alias("label"), "n"))
    return F.broadcast(domain).join(found, ["kind", "label"], "left").select("kind", "label", F.coalesce("count", F.lit(0)).alias("n")).unionByName(totals)


def folders(path: Column) -> Column:
    """All folders that a path lies in, the topmost first."""
    parts = F.split(path, "/")
    within = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    return F.when(F.size(parts) > 1, within).otherwise(F.array().cast("array<string>"))


def folder_tree(files: DataFrame) -> DataFrame:
    """(src, dst, relationship) of folders and files of distinct paths."""
    parts = files.select("path").distinct().withColumn("p", F.split("path", "/"))
    level = parts.filter(F.size("p") > 1).select("path", "p", F.explode(F.sequence(F.lit(1), F.size("p") - 1)).alias("i"))
    prefix = lambda n: F.array_join(F.slice("p", 1, n), "/")
    folders = level.filter("i > 1").select(prefix(F.col("i") - 1).alias("src"), prefix(F.col("i")).alias("dst"), F.lit("SUBMODULE_OF").alias("relationship")).distinct()
    members = parts.filter(F.size("p") > 1).select(prefix(F.size("p") - 1).alias("src"), F.col("path").alias("dst"), F.lit("MEMBER_OF").alias("relationship"))
    return folders.unionByName(members)


def tracked_files(nodes: DataFrame) -> DataFrame:
    """(file_path) of files that define something."""
    return nodes.filter("coalesce(file_path, '') != ''").select("file_path").distinct()


def met_neighbours(edges: DataFrame, anchors: DataFrame) -> DataFrame:
    """(side, node_id) of callers and callees one step from anchors(anchor, ...), with the columns of anchors. A function that
    calls itself is both. Rows recur where edges do."""
    calls = edges.filter("relationship = 'CALLS'").select("src", "dst")
    callers = calls.join(anchors, calls.dst == anchors.anchor).select(*anchors.columns, F.lit("caller").alias("side"), F.col("src").alias("node_id"))
    callees = calls.join(anchors, calls.src == anchors.anchor).select(*anchors.columns, F.lit("callee").alias("side"), F.col("dst").alias("node_id"))
    return callers.unionByName(callees)


def call_neighbours(edges: DataFrame, anchors: DataFrame) -> DataFrame:
    """(anchor, side, node_id): callers and callees one step from anchors(anchor). A function that calls itself is both."""
    return met_neighbours(edges, anchors).select("anchor", "side", "node_id").distinct()


def ranked(rows: DataFrame, by: list[str], *order: Column, n: int) -> DataFrame:
    """The first n rows of each group with their rank."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col("rank") <= n)


def strip_calls(edges: DataFrame, nodes: DataFrame, files: DataFrame) -> DataFrame:
    """edges without the CALLS into and out of nodes of files(file_path), and of the files themselves."""
    gone = nodes.join(files, "file_path", "left_semi").select("node_id").unionByName(files.select(F.col("file_path").alias("node_id"))).distinct()
    calls, rest = edges.filter("relationship = 'CALLS'"), edges.filter("relationship != 'CALLS'")
    for end in ("src", "dst"):
        calls = calls.join(gone.withColumnRenamed("node_id", end), end, "left_anti")
    return calls.select(*edges.columns).unionByName(rest)
