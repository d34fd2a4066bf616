"""Code-graph tables derived from the star schema, for the registered queries: parts are functions, order lines their calls."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.functions import text as T
from graphloom.operators.graph import call_centrality


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = read(spark, sf_dir, "part")
    name = F.concat(F.replace("p_name", F.lit(" "), F.lit("_")), F.lit("_"), F.col("p_partkey").cast("string"))
    path = F.concat(F.lower(F.replace("p_brand", F.lit("#"), F.lit("_"))), F.lit(".py"))
    own = part.select(F.lit("FUNCTION").alias("type"), name.alias("name"), path.alias("file_path"), F.concat(F.lit("("), F.lower("p_type"), F.lit(")")).alias("signature"), F.col("p_partkey").alias("node_ord"), F.lit(False).alias("is_method"))
    own = own.withColumn("node_id", F.concat_ws("::", "file_path", "name"))
    text = T.embedding_text(F.col("type"), F.col("name"), F.lit(None).cast("string"), F.array().cast("array<string>"), F.lit(None).cast("string"))
    return own.withColumn("grep_text", T.grep_text(F.col("name"), F.col("signature"), F.col("file_path"), text))


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CALLS from each line's part to the part of the next line of its order."""
    lines = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    following = F.lead("l_partkey").over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey"))
    return lines.select(F.col("l_partkey").alias("s"), following.alias("d")).filter("d is not null").distinct()


def graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    n = nodes(spark, sf_dir)
    ids = n.select(F.col("node_ord"), "node_id")
    e = edges(spark, sf_dir).join(ids.select(F.col("node_ord").alias("s"), F.col("node_id").alias("src")), "s").join(ids.select(F.col("node_ord").alias("d"), F.col("node_id").alias("dst")), "d")
    return n, e.select("src", "dst", F.lit("CALLS").alias("relationship"))


def ranked_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes as search reads them."""
    n, e = graph(spark, sf_dir)
    return call_centrality(n, e).withColumn("near", F.lit(False))


NODES_SQL = """n AS (SELECT 'FUNCTION' AS type, replace(p_name, ' ', '_') || '_' || p_partkey AS name, lower(replace(p_brand, '#', '_')) || '.py' AS file_path, '(' || lower(p_type) || ')' AS signature, p_partkey AS node_ord FROM part),
nodes AS (SELECT *, file_path || '::' || name AS node_id, name || chr(10) || signature || chr(10) || file_path || chr(10) || 'Type: FUNCTION' || chr(10) || 'Name: ' || name AS grep_text FROM n),
e AS (SELECT DISTINCT l_partkey AS s, d FROM (SELECT l_partkey, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS d FROM lineitem) WHERE d IS NOT NULL),
edges AS (SELECT a.node_id AS src, b.node_id AS dst, 'CALLS' AS relationship FROM e JOIN nodes a ON a.node_ord = s JOIN nodes b ON b.node_ord = d)"""
CENTRAL_SQL = NODES_SQL + """,
deg AS (SELECT nodes.*, coalesce(k, 0) AS calls_in_degree FROM nodes LEFT JOIN (SELECT dst, count(*) AS k FROM edges GROUP BY dst) g ON g.dst = node_id),
central AS (SELECT *, CASE WHEN (SELECT max(calls_in_degree) FROM deg) > 0 THEN calls_in_degree / (SELECT max(calls_in_degree) FROM deg) ELSE 0.0 END AS call_centrality, false AS near FROM deg)"""
