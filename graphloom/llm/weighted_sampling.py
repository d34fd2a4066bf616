"""Document fingerprints by consistent weighted sampling, in DataFrame functions alone.

A document is a weighted set: its words with their counts. For each of ``SAMPLES`` samples and each word, hashes of
the word give r and c from Gamma(2, 1) and b from the unit interval; with the word's weight S,

    t = floor(ln S / r + b),    ln a = ln c - r * (t - b + 1),

and the sample is the least a. Two documents have the same least a with a probability equal to their generalised
Jaccard similarity, the sum of the smaller weights over the sum of the larger, so the share of equal samples
estimates it, with a standard error of at most 0.5 / sqrt(SAMPLES). A fingerprint is the samples' 32-bit hashes in
hexadecimal.

Texts are dealt out by their keys once; counting and sampling follow within those partitions without a further
shuffle. The document that follows is found in ranges of keys of like numbers of documents, whatever the ids are; only
the ranges' ends are joined across.

Defined results. Null text: the empty text. A text without words is one empty word of weight 1, so such texts are
alike. A null doc_id comes after all others in descending order. Rows that share a doc_id, or have none, are each a
document, in an order of their texts; exact repetitions of a row are one document in that order, and each has its row.
An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.llm.common import written

SAMPLES = 48
#: Samples that are drawn in one row: with more, the generated code outgrows what the JVM compiles, and takes three to five times as long.
TOGETHER = 6
_PART = (1 << 21) - 1


def terms(text: Column) -> Column:
    """Words between white space, in lower case."""
    return F.array_remove(F.split(F.lower(text), "[\\x20\\x09-\\x0D]+"), "")


def _uniform(h: Column, part: int) -> Column:
    """One of three uniform numbers in (0, 1) from a 64-bit hash."""
    return (F.shiftrightunsigned(h, 21 * part).bitwiseAND(F.lit(_PART)) + F.lit(0.5)) / F.lit(float(_PART + 1))


def draws(term: Column, first: Column) -> tuple[Column, Column, Column]:
    """r, ln c and b of a sample for a term (64-bit hash); first: twice the sample's number."""
    one, two = F.xxhash64(term, first), F.xxhash64(term, first + 1)
    return -F.ln(_uniform(one, 0) * _uniform(one, 1)), F.ln(-F.ln(_uniform(two, 0) * _uniform(two, 1))), _uniform(one, 2)


def signatures(counted: DataFrame, keys: list[str], weights: dict[str, str], samples: int = SAMPLES) -> DataFrame:
    """keys and, for each (name, weight column) of weights, an array of hashed samples; counted: keys, term, weights."""
    logs = [F.when(F.col(w) > 0, F.ln(w)).alias(w) for w in weights.values()]
    starts = F.array(*[F.lit(2 * j) for j in range(0, samples, TOGETHER)])
    rows = counted.select(*keys, "term", *logs, F.explode(starts).alias("first"))
    # The draws of a term serve all weights it has.
    drawn = [x.alias(f"{name}{j}") for j in range(TOGETHER) for name, x in zip("rcb", draws(F.col("term"), F.col("first") + 2 * j), strict=True)]
    value = lambda w, j: F.col(f"c{j}") - F.col(f"r{j}") * (F.floor(F.col(w) / F.col(f"r{j}") + F.col(f"b{j}")) - F.col(f"b{j}") + 1)
    least = [F.min(value(w, j)).alias(f"{name}_{j}") for j in range(TOGETHER) for name, w in weights.items()]
    some = rows.select(*keys, "first", *weights.values(), *drawn).groupBy(*keys, "first").agg(*least)
    low = F.lit(0xFFFFFFFF)
    hashed = some.select(*keys, F.struct("first", *[F.array(*[F.xxhash64(f"{name}_{j}").bitwiseAND(low) for j in range(TOGETHER)]).alias(name) for name in weights]).alias("some"))
    # A key has as many rows here as there are groups of samples.
    whole = hashed.groupBy(*keys).agg(F.array_sort(F.collect_list("some")).alias("all"))
    return whole.select(*keys, *[F.slice(F.flatten(F.col(f"all.{name}")), 1, samples).alias(name) for name in weights])


def likeness(a: Column, b: Column) -> Column:
    return F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda s: s)) / F.size(a)


def as_text(signature: Column) -> Column:
    return F.array_join(F.transform(signature, lambda x: F.lpad(F.lower(F.hex(x)), 8, "0")), "")


def ordered(ids: DataFrame, by: list[str]) -> DataFrame:
    """ids, which are distinct in the columns by, with place (0, 1, ... in ascending order) and before (the row before's by, the last one's for the first)."""
    own = F.struct(*by)
    placed = written(ids.repartitionByRange(*by).withColumn("part", F.spark_partition_id()), "placed")
    parts = written(placed.groupBy("part").agg(F.count("*").alias("n"), F.max(own).alias("top")), "parts")
    along = Window.orderBy("part")
    # As many rows as there are ranges.
    edges = parts.select("part", F.lag("top").over(along).alias("below"), (F.sum("n").over(along) - F.col("n")).alias("first"))
    edges = edges.join(parts.agg(F.max("top").alias("high")), how="left").select("part", F.coalesce("below", "high").alias("below"), "first")
    inside = Window.partitionBy("part").orderBy(*by)
    rows = placed.withColumn("before", F.lag(own).over(inside)).withColumn("at", F.row_number().over(inside)).join(edges, "part")
    return rows.select(*ids.columns, (F.col("first") + F.col("at") - 1).alias("place"), F.coalesce("before", "below").alias("before"))


def keyed_texts(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """(key, text) with one row a key; (key, next_key); and (key, doc_id, copies), or None where each row has a doc_id of its own as key."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    n, ids = own.agg(F.count("*"), F.count_distinct("doc_id")).first()
    if n == ids:
        order = written(ordered(own.select(F.col("doc_id").alias("key")), ["key"]).select("key", F.col("before.key").alias("next_key")), "order")
        return own.select(F.col("doc_id").alias("key"), "text"), order, None
    # Texts of one doc_id are told apart by their hashes; a key is the place in the order.
    by = ["known", "id", "h"]
    own = own.select(F.col("doc_id").isNotNull().alias("known"), F.coalesce("doc_id", F.lit(0)).alias("id"), F.xxhash64("text").alias("h"), "text")
    placed = written(ordered(written(own.groupBy(*by).agg(F.count("*").alias("copies")), "ids"), by).drop("before"), "order")
    last = placed.agg(F.max("place").alias("last"))
    order = placed.join(last, how="left").select(F.col("place").alias("key"), F.when(F.col("place") > 0, F.col("place") - 1).otherwise(F.col("last")).alias("next_key"))
    texts = own.join(placed.select(*by, F.col("place").alias("key")), by).groupBy("key").agg(F.min("text").alias("text"))
    return texts, order, placed.select(F.col("place").alias("key"), F.when(F.col("known"), F.col("id")).alias("doc_id"), "copies")


def edited_pairs(texts: DataFrame, order: DataFrame) -> DataFrame:
    """key, text and edited: the text with its last third replaced by the beginning of the next document's."""
    lengths = texts.select(F.col("key").alias("target"), F.floor(F.length("text") / 3).cast("int").alias("take"))
    wanted = order.select(F.col("key").alias("target"), F.col("next_key").alias("key")).join(lengths, "target")
    heads = texts.join(wanted, "key").select(F.col("target").alias("key"), F.expr("substring(text, 1, take)").alias("head"))
    stays = F.expr("substring(text, 1, length(text) - int(floor(length(text) / 3)))")
    return texts.join(heads, "key").select("key", "text", F.concat(stays, "head").alias("edited"))


def fingerprints(docs: DataFrame, samples: int = SAMPLES) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next."""
    texts, order, named = keyed_texts(docs)
    pairs = edited_pairs(texts, order)
    both = F.array(F.struct(F.lit(1).alias("own"), F.col("text").alias("t")), F.struct(F.lit(0).alias("own"), F.col("edited").alias("t")))
    words = pairs.select("key", F.explode(both).alias("v")).select("key", F.col("v.own").alias("own"), F.explode_outer(terms(F.col("v.t"))).alias("word"))
    counted = words.groupBy("key", F.xxhash64(F.coalesce("word", F.lit(""))).alias("term")).agg(F.sum("own").alias("own"), F.sum(1 - F.col("own")).alias("new"))
    # Joined in one plan: the exchanges by key under both sides are the same and run once.
    facts = pairs.select("key", F.length("text").cast("long").alias("n_chars"), F.sha2(F.encode("edited", "UTF-8"), 256).alias("edited_sha256"))
    signed = written(facts.join(signatures(counted, ["key"], {"fp": "own", "edited_fp": "new"}, samples), "key"), "signed")
    following = order.join(signed.select(F.col("key").alias("next_key"), F.col("fp").alias("next_fp")), "next_key").select("key", "next_fp")
    out = signed.join(following, "key")
    out = out.withColumn("doc_id", F.col("key")) if named is None else out.join(named, "key").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return out.select("doc_id", "n_chars", "edited_sha256", as_text(F.col("fp")).alias("fingerprint"), as_text(F.col("edited_fp")).alias("edited_fingerprint"), likeness(F.col("fp"), F.col("edited_fp")).alias("near_edited"), likeness(F.col("fp"), F.col("next_fp")).alias("near_next"))
