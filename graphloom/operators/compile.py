"""From source files to the tables of a code graph.

nodes: node_id, type, name, file_path, class_name, is_method, start_line, end_line, signature, doc, body_hash, chunk, text
(what is embedded), node_ord; edges: src, dst, relationship. FILE and MODULE nodes have no file_path.

Defined results. A file that does not parse, or has no source, is a FILE node with its folders and nothing else. A path
that occurs twice counts once, with the last of its sources in order. Files without a definition call nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.functions import text as T
from graphloom.operators import graph as G
from graphloom.operators import resolve as R
from graphloom.sources import python_source as P
from graphloom.sources.store import stored
from graphloom.sources.workspace import dealt

NODE = ["node_id", "type", "name", "file_path", "class_name", "is_method", "start_line", "end_line", "signature", "doc", "body_hash", "chunk", "text", "node_ord"]


def parsed_once(files: DataFrame) -> DataFrame:
    """Facts of files (rel_path, source), parsed once and kept: nodes and all kinds of edges are made from them."""
    once = files.filter("rel_path is not null").groupBy("rel_path").agg(F.max("source").alias("source"))
    # A file is parsed by one task, and tasks get like numbers of files, however few their bytes are.
    return stored(P.parse(dealt(once, "rel_path")), "facts")


def entity_nodes(facts: DataFrame) -> DataFrame:
    own = P.entities(facts)
    bases = facts.filter("kind = 'CLASS'").groupBy(F.col("rel_path").alias("file_path"), "name").agg(F.max_by("bases", "ord").alias("base_names"))
    own = own.join(bases.withColumn("type", F.lit("CLASS")), ["file_path", "name", "type"], "left")
    text = T.embedding_text(F.col("type"), F.col("name"), F.col("class_name"), F.coalesce("base_names", F.array().cast("array<string>")), F.col("doc"))
    # An annotated constant has no source text, and is not embedded.
    return own.withColumn("text", F.when(F.col("chunk").isNotNull(), text)).withColumn("node_ord", F.struct("file_path", "ord")).select(*NODE)


def place_nodes(facts: DataFrame) -> DataFrame:
    """FILE and MODULE nodes."""
    paths = facts.filter("kind in ('FILE', 'ERROR')").select("rel_path")
    folders = paths.withColumn("p", F.split("rel_path", "/")).filter(F.size("p") > 1).select(F.explode(F.transform(F.sequence(F.lit(1), F.size("p") - 1), lambda n: F.array_join(F.slice("p", 1, n), "/"))).alias("node_id")).distinct()
    places = paths.select(F.col("rel_path").alias("node_id"), F.lit("FILE").alias("type")).unionByName(folders.select("node_id", F.lit("MODULE").alias("type")))
    return places.withColumn("name", F.element_at(F.split("node_id", "/"), -1)).withColumn("node_ord", F.struct(F.col("node_id").alias("file_path"), F.lit(-1).alias("ord")))


def nodes(facts: DataFrame) -> DataFrame:
    return entity_nodes(facts).unionByName(place_nodes(facts), allowMissingColumns=True)


def imports(facts: DataFrame) -> DataFrame:
    """(src, dst) of files that import files."""
    absolute = R.absolute_imports(P.imported_names(facts), P.modules(facts)).filter("file_path is not null and file_path != import_id")
    return absolute.select(F.col("import_id").alias("src"), F.col("file_path").alias("dst")).unionByName(P.relative_imports(facts)).distinct()


def call_edges(facts: DataFrame, own: DataFrame, imported: DataFrame) -> DataFrame:
    """(src, dst) of calls; own: entity nodes. Only files with a definition take part."""
    calls = P.calls(facts).join(own.select("file_path").distinct(), "file_path", "left_semi")
    return R.callees(calls, own, imported)


def edges(facts: DataFrame, own: DataFrame) -> DataFrame:
    """All kinds of edges; own: entity nodes."""
    imported = stored(imports(facts), "imports")
    kind = lambda df, name: df.select("src", "dst", F.lit(name).alias("relationship"))
    tree = G.folder_tree(facts.filter("kind in ('FILE', 'ERROR')").select(F.col("rel_path").alias("path")))
    contains = own.select(F.col("file_path").alias("src"), F.col("node_id").alias("dst"))
    parts = [tree.select("src", "dst", "relationship"), kind(contains, "CONTAINS"), kind(imported, "IMPORTS"), kind(R.bases(P.class_bases(facts), own, imported), "INHERITS_FROM"), kind(call_edges(facts, own, imported), "CALLS")]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def graph_of(facts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of the facts of all files."""
    own = stored(entity_nodes(facts), "entities")
    return own.unionByName(place_nodes(facts), allowMissingColumns=True), edges(facts, own)


def compile_graph(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of files (rel_path, source)."""
    return graph_of(parsed_once(files))
