"""Differences between two states of the files, and what they change."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions import text as T
from graphloom.sources.store import stored
from graphloom.sources.workspace import dealt


def changes(tracked: DataFrame, current: DataFrame) -> DataFrame:
    """(path, change) of tracked(path, mtime) and current(path, mtime): new, deleted or dirty; unchanged files are left out."""
    both = tracked.select("path", F.col("mtime").alias("was")).join(current.select("path", F.col("mtime").alias("now")), "path", "full")
    change = F.when(F.col("was").isNull(), "new").when(F.col("now").isNull(), "deleted").when(F.col("now") > F.col("was"), "dirty")
    return both.select("path", change.alias("change")).filter("change is not null")


def upsert(old: DataFrame, new: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Rows of both; where both have a key, values of new that are not null win."""
    renamed = new.select(key, *[F.col(c).alias(f"__{c}") for c in columns])
    return old.select(key, *columns).join(renamed, key, "full").select(key, *[F.coalesce(f"__{c}", c).alias(c) for c in columns])


def with_cached_docs(functions: DataFrame, cache: DataFrame) -> DataFrame:
    """functions(node_id, docstring, body_hash) with docstring and docstring_source: their own, else the cached one of the body, else none."""
    known = cache.filter("coalesce(body_hash, '') != '' and coalesce(doc, '') != ''").groupBy("body_hash").agg(F.max("doc").alias("doc"))
    own = F.coalesce("docstring", F.lit("")) != ""
    source = F.when(own, "native").when(F.col("doc").isNotNull(), "auto").otherwise("none")
    return functions.join(known, "body_hash", "left").select("node_id", "body_hash", F.when(own, F.col("docstring")).otherwise(F.coalesce("doc", F.lit(""))).alias("docstring"), source.alias("docstring_source"))


def embedded(nodes: DataFrame, before: DataFrame | None, embedder: Callable[[Column], Column]) -> DataFrame:
    """nodes with vector: the one of before(node_id, text, vector) where the text is the same, else the embedder's; none without text."""
    if before is None:
        return nodes.withColumn("vector", F.when(F.col("text").isNotNull(), embedder(F.col("text"))))
    old = before.filter("vector is not null").groupBy("node_id", "text").agg(F.first("vector").alias("vector"))
    kept = nodes.join(old, ["node_id", "text"], "left")
    same, rest = kept.filter("vector is not null or text is null"), kept.filter("vector is null and text is not null")
    columns = [*nodes.columns, "vector"]
    return same.select(*columns).unionByName(rest.withColumn("vector", embedder(F.col("text"))).select(*columns))


def with_generated_docs(functions: DataFrame, cache: DataFrame, provider: Callable[[Column, Column], Column] | None = None, least_words: int = 6) -> tuple[DataFrame, DataFrame]:
    """functions(node_id, name, chunk, docstring, body_hash) with docstring and its source, and the cache with what was generated.

    Own docstrings stand, then cached ones of the same body, then the first sentence of what the provider says of name and
    source, if that has enough words. A body is asked for once. Without a provider nothing is generated.
    """
    known = with_cached_docs(functions, cache)
    if provider is None:
        return known, cache
    asked = functions.join(known.filter("docstring_source = 'none' and coalesce(body_hash, '') != ''").select("node_id"), "node_id", "left_semi")
    asked = asked.filter("coalesce(name, '') != '' and coalesce(chunk, '') != ''").groupBy("body_hash").agg(F.min(F.struct("name", "chunk")).alias("x"))
    # Few bytes, but each takes its time: as many tasks as a shuffle has parts share them.
    asked = dealt(asked, "body_hash")
    # Stored as it was said: a condition on it would have Spark ask once for the condition and once for the row.
    said = stored(asked.select("body_hash", provider(F.col("x.name"), F.col("x.chunk")).alias("said")), "said")
    sentence = said.select("body_hash", T.one_sentence(F.col("said")).alias("doc"))
    grown = cache.select("body_hash", "doc").unionByName(sentence.filter(F.size(F.filter(F.split("doc", "\\s+"), lambda w: w != "")) >= least_words))
    return with_cached_docs(functions, grown), grown


def documented(nodes: DataFrame, cache: DataFrame, provider: Callable[[Column, Column], Column] | None = None, least_words: int = 6) -> tuple[DataFrame, DataFrame]:
    """(nodes with docstring_source, the cache with what was generated). Functions without a docstring get a generated one, in doc and in the text that is embedded."""
    functions = nodes.filter("type = 'FUNCTION'").select("node_id", "name", "chunk", F.col("doc").alias("docstring"), "body_hash")
    known, grown = with_generated_docs(functions, cache, provider, least_words)
    told = known.filter("docstring_source = 'auto'").select("node_id", F.col("docstring").alias("__doc"))
    own = nodes.join(told, "node_id", "left")
    own_doc = F.coalesce("doc", F.lit("")) != ""
    source = F.when(F.col("__doc").isNotNull(), "auto").when(own_doc, "native").otherwise("none")
    text = T.embedding_text(F.col("type"), F.col("name"), F.col("class_name"), F.array().cast("array<string>"), F.col("__doc"))
    told_text = F.when(F.col("__doc").isNotNull() & F.col("text").isNotNull(), text).otherwise(F.col("text"))
    rest = [c for c in nodes.columns if c not in ("doc", "text")]
    return own.select(*rest, F.coalesce("__doc", "doc").alias("doc"), told_text.alias("text"), source.alias("docstring_source")), grown


def name_vectors(nodes: DataFrame, before: DataFrame | None, embedder: Callable[[Column], Column]) -> DataFrame:
    """(name, vector) of the names of nodes, a row each: those of before(name, vector) where there is one, else the embedder's."""
    names = nodes.select(F.trim("name").alias("name")).filter("name != ''").distinct()
    if before is None:
        return names.withColumn("vector", embedder(F.col("name")))
    old = before.filter("vector is not null").groupBy("name").agg(F.first("vector").alias("vector"))
    kept = names.join(old, "name", "left")
    return kept.filter("vector is not null").unionByName(kept.filter("vector is null").select("name").withColumn("vector", embedder(F.col("name"))))
