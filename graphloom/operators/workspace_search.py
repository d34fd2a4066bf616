"""One call from a folder of Python files to an answer: what changed is parsed, documented and embedded, the graph is committed as
a version, and the queries and terms are looked up in it.

A version has the tables of ``delta.Graph`` and: tracked (path, mtime), docs (body_hash, doc), searchable (nodes with text,
vector, passage and centrality), names (name, vector), postings and grams. Of several callers that refresh a graph at a
time each gets a whole version (``store.update``). With nothing changed the stored version answers, and is not written again.

Defined results. Without queries and terms the answer is the headline. A workspace without Python files has an empty graph.
Blank queries and terms are left out, and keep their numbers.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions import models
from graphloom.functions import text as T
from graphloom.operators import answer as A
from graphloom.operators import delta as D
from graphloom.operators import graph as G
from graphloom.operators import search as S
from graphloom.operators import sync as Y
from graphloom.sources import skeleton as K
from graphloom.sources import store
from graphloom.sources.workspace import scan

Embedder = Callable[[Column], Column]
Provider = Callable[[Column, Column], Column]


def refreshed(files: DataFrame, tables: dict[str, DataFrame] | None, embedder: Embedder, provider: Provider | None = None) -> dict[str, DataFrame]:
    """The tables of the next version from files(rel_path, mtime, source) and those of the one before."""
    spark, now = files.sparkSession, store.stored(files.select("rel_path", "mtime", "source"), "files")
    if tables is None:
        graph = D.built(now)
        docs = spark.createDataFrame([], "body_hash string, doc string")
    else:
        graph = D.kept(D.synced(now, tables["tracked"], D.Graph(*(tables[name] for name in D.Graph._fields))))
        docs = tables["docs"]
    nodes, docs = Y.documented(graph.nodes, docs, provider)
    nodes = nodes.withColumn("text", F.when(F.col("file_path").isNotNull(), T.text_to_embed(F.col("text"), F.col("chunk"))))
    with_vectors = Y.embedded(nodes, tables and tables["searchable"], embedder)
    searchable = G.call_centrality(with_vectors, graph.edges).withColumn("grep_text", T.grep_text(F.col("name"), F.col("signature"), F.col("file_path"), F.col("text")))
    passage = K.rerank_passage(F.col("chunk"), F.col("text"), F.col("class_name"), F.col("file_path"))
    searchable = store.stored(searchable.withColumn("passage", passage), "searchable")
    postings = S.posted(searchable)
    tracked = now.filter("rel_path is not null").groupBy(F.col("rel_path").alias("path")).agg(F.max("mtime").alias("mtime"))
    names = Y.name_vectors(searchable, tables and tables["names"], embedder)
    return {**graph._asdict(), "tracked": tracked, "docs": docs, "searchable": searchable, "names": names, "postings": postings.rows, "grams": postings.grams}


def refresh(files: DataFrame, folder: str, embedder: Embedder, provider: Provider | None = None) -> dict[str, DataFrame]:
    """The tables of the version that says what files(rel_path, mtime, source) are now; committed, unless it is the last one."""
    spark = files.sparkSession
    now = files.filter("rel_path is not null").select(F.col("rel_path").alias("path"), "mtime")
    tables = store.load_tables(spark, folder)[1]
    if tables is not None and Y.changes(tables["tracked"], now).isEmpty():
        return tables
    return store.update(spark, folder, lambda was: refreshed(files, was, embedder, provider))


def found(tables: dict[str, DataFrame], queries: list[str], terms: list[str], embedder: Embedder, scorer: A.Scorer | None = A.lexical) -> DataFrame:
    """``answer.matches`` of what is asked of a version."""
    spark = tables["searchable"].sparkSession
    numbered = lambda asked, name: spark.createDataFrame([(k, x.strip()) for k, x in enumerate(asked, 1) if x and x.strip()], f"no int, {name} string")
    own = store.stored(numbered(queries, "query").withColumn("vector", embedder(F.col("query"))), "queries")
    return A.matches(tables["searchable"], tables["edges"], own, numbered(terms, "term"), scorer, embedder=embedder, names=tables["names"], postings=S.Postings(tables["postings"], tables["grams"]))


def search(spark: SparkSession, root: str, queries: list[str], terms: list[str] | None = None, folder: str | None = None, embedder: Embedder | None = None, scorer: A.Scorer | None = A.lexical, provider: Provider | None = None, files: DataFrame | None = None) -> str:
    """The answer as Markdown. root: the workspace, which names its graph under folder (the shared one if none is given); files: its files, where ``scan`` can't read it."""
    embed = embedder or models.embedder()
    at = f"{folder or store.shared_folder(spark)}/{store.graph_key(root)}"
    tables = refresh(files if files is not None else scan(spark, root), at, embed, provider)
    terms = terms or []
    return A.told_markdown(store.stored(found(tables, queries, terms, embed, scorer), "found"), len(terms), len(queries))
