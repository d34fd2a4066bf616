"""Resolution of imports, base classes and calls, as joins whose right sides are unique on their keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.sources import python_source as P


def registry(nodes: DataFrame) -> DataFrame:
    """(name, file_path): the file that defines a class or plain function of that name last."""
    own = nodes.filter("type = 'CLASS' or type = 'FUNCTION' and not coalesce(is_method, false)")
    return own.groupBy("name").agg(F.max_by("file_path", "node_ord").alias("file_path"))


def callees(calls: DataFrame, nodes: DataFrame, imports: DataFrame) -> DataFrame:
    """(src, dst) of calls(caller_id, file_path, class_name, symbol): a member of the caller's class, anything of that name in its file,
    the first function of that name there, or the registered definer if the file imports it; in this order."""
    ids = nodes.select("node_id").distinct()
    first = nodes.filter("type = 'FUNCTION'").groupBy("file_path", F.col("name").alias("symbol")).agg(F.min_by("node_id", "node_ord").alias("c3"))
    known = registry(nodes).select(F.col("name").alias("symbol"), F.col("file_path").alias("there"))
    reachable = imports.select(F.col("src").alias("file_path"), F.col("dst").alias("there")).distinct().withColumn("imported", F.lit(True))
    c = calls.withColumn("k1", F.when(F.coalesce("class_name", F.lit("")) != "", F.concat("file_path", F.lit("::"), "class_name", F.lit("."), "symbol"))).withColumn("k2", F.concat("file_path", F.lit("::"), "symbol"))
    c = c.join(ids.select(F.col("node_id").alias("k1"), F.col("node_id").alias("c1")), "k1", "left").join(ids.select(F.col("node_id").alias("k2"), F.col("node_id").alias("c2")), "k2", "left").join(first, ["file_path", "symbol"], "left")
    c = c.join(known, "symbol", "left").join(reachable, ["file_path", "there"], "left").withColumn("k4", F.when(F.col("imported"), F.concat("there", F.lit("::"), "symbol")))
    c = c.join(ids.select(F.col("node_id").alias("k4"), F.col("node_id").alias("c4")), "k4", "left")
    return c.select(F.col("caller_id").alias("src"), F.coalesce("c1", "c2", "c3", "c4").alias("dst")).filter("dst is not null").distinct()


def bases(classes: DataFrame, nodes: DataFrame, imports: DataFrame) -> DataFrame:
    """(src, dst) of classes(node_id, file_path, base): a node of that name in the file, or the registered class if its file is imported."""
    ids = nodes.select("node_id").distinct()
    known = nodes.filter("type = 'CLASS'").groupBy("name").agg(F.max_by("file_path", "node_ord").alias("there"))
    reachable = imports.select(F.col("src").alias("file_path"), F.col("dst").alias("there")).distinct().withColumn("imported", F.lit(True))
    c = classes.select(F.col("node_id").alias("src"), "file_path", "base").withColumn("k1", F.concat("file_path", F.lit("::"), "base"))
    c = c.join(ids.select(F.col("node_id").alias("k1"), F.col("node_id").alias("c1")), "k1", "left").join(known.select(F.col("name").alias("base"), "there"), "base", "left").join(reachable, ["file_path", "there"], "left")
    return c.select("src", F.coalesce("c1", F.when(F.col("imported"), F.concat("there", F.lit("::"), "base"))).alias("dst")).filter("dst is not null").distinct()


def absolute_imports(imports: DataFrame, modules: DataFrame, asked: DataFrame | None = None) -> DataFrame:
    """imports(import_id, name) with file_path: the first of modules(module, file_path, file_ord) whose dotted name is the name or ends with it.
    With asked (name), the only names that are imported, other endings of modules are not grouped."""
    suffixes = P.suffixes(modules)
    if asked is not None:
        suffixes = suffixes.join(asked, "name", "left_semi")
    first = suffixes.groupBy("name").agg(F.min_by("file_path", "file_ord").alias("file_path"))
    return imports.join(first, "name", "left").select("import_id", "name", "file_path")
