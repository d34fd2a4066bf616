"""Mixing sources to target weights by a low-discrepancy schedule.

The mix is a sequence of slots of like numbers of words. Slot k has the point k x the golden ratio, modulo 1, which the
cumulative targets of the sources map to a source: any stretch of the schedule holds each source in close to its share.
The slots of a source are ranked. Its documents, shuffled by a keyed digest of their ids, form a stream of words, as often
repeated as the target needs, which is cut into as many equal blocks as the source has slots; slot and block of the same
source and rank are joined. A source whose interval no point meets has one slot behind the others.

Targets: sources by code point, null last, weigh ``WEIGHTS`` in turn and share ``SHARE`` per cent of all words. None goes
beyond ``LIMIT`` times its source; what is over goes to the others by weight. A source with a target takes just as many
words, rounded. Ranks and places in streams are sums over ranges of a global order, so no task holds a source.

Defined results. Null or empty text, or white space: size 0, nothing taken. A null source is one of its own, behind the
others. Rows that share a doc_id stand in order of their sizes; they and those with a null doc_id, which stand together
somewhere in the shuffle, are documents each. Which of repeated rows is taken does not show in the rows. Without words all
targets are 0. An empty table gives an empty result. Columns other than doc_id, source and text are not read.
"""

from __future__ import annotations

import math
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import sums_before, written

WEIGHTS, SHARE, LIMIT, SEED = (5, 2, 1), 150, 2, 7
#: Words of a slot, in the mean.
BLOCK = 1024
#: The fractional part of the golden ratio, and of its product with 2 ** 20.
GOLDEN = (math.sqrt(5) - 1) / 2
GOLDEN_HIGH = (GOLDEN * 2**20) % 1
WORD = r"[^\x20\x09-\x0D]+"


class Mix(NamedTuple):
    documents: DataFrame  # doc_id, source, digest, size, source_size, target, row
    sources: DataFrame  # source, place, source_size, target, words (to take), slots
    pieces: DataFrame  # slot, row, doc_id, digest, epoch, first, last: words of a document (last exclusive) in a slot


def sized(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """doc_id, source, digest of the text, size, shuffle key and a number of its own for each document."""
    doc_id, text = F.col("doc_id").cast("long"), F.col("text").cast("string")
    key = F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256), 1, 16)
    size = F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")
    own = docs.select(doc_id.alias("doc_id"), F.col("source").cast("string").alias("source"), F.xxhash64(text).alias("digest"), size.alias("size"), key.alias("key"))
    return written(own.withColumn("row", F.monotonically_increasing_id()), "sizes")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: int = SHARE, limit: int = LIMIT) -> DataFrame:
    """source, place, source_size, target, the words to take and the sums of both over the sources before, of every source of sizes(source, size).

    Sources are filled in order of size over weight.
    """
    own = written(sizes.groupBy("source").agg(F.sum("size").alias("source_size")).withColumn("one", F.lit(1).cast("long")), "sources")
    placed = sums_before(own, [F.asc_nulls_last("source")], {"place": "one"})
    weight = F.element_at(F.array(*[F.lit(w).cast("long") for w in weights]), (F.col("place") % len(weights) + 1).cast("int"))
    ratio = F.col("source_size") * (F.lit(math.lcm(*weights)) / F.col("weight")).cast("long")
    weighed = placed.withColumn("weight", weight).withColumn("ratio", ratio)
    filled = sums_before(weighed, [F.col("ratio"), F.col("place")], {"size_before": "source_size", "weight_before": "weight"})
    total, all_weights = weighed.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0))).first()
    # Whole numbers of up to 38 digits: words times weights of all sources.
    exact = lambda c: c.cast("decimal(19,0)")
    left = F.lit(share * total).cast("decimal(19,0)") - exact(100 * limit * F.col("size_before"))
    full = left * exact(F.col("weight")) > exact(100 * limit * F.col("source_size")) * exact(F.lit(all_weights) - F.col("weight_before"))
    filled = filled.withColumn("full", full)
    full_size, full_weight = filled.filter("full").agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0))).first()
    open_share = F.col("weight").cast("double") * float(share * total - 100 * limit * full_size) / float(max(100 * (all_weights - full_weight), 1))
    target = F.when(F.col("full"), (limit * F.col("source_size")).cast("double")).otherwise(open_share)
    aims = filled.select("source", "place", "source_size", target.alias("target")).withColumn("words", F.floor(F.col("target") + 0.5).cast("long"))
    return sums_before(aims, [F.col("place")], {"begin": "words", "size_begin": "source_size"})


def schedule(sources: DataFrame, block: int = BLOCK) -> DataFrame:
    """(slot, place) for the sources(place, words, begin): as many slots as blocks of words, and one for each source that no point meets."""
    spark, placed = sources.sparkSession, sources.select("place", "words", "begin")
    total, many = placed.agg(F.coalesce(F.sum("words"), F.lit(0)), F.count("*")).first()
    if not total:
        return spark.createDataFrame([], "slot long, place long")
    points, width = math.ceil(total / block), math.ceil(total / (4 * many + 1024))
    # The multiple is split, so that no digits of the fraction are lost for large slots.
    high, low = F.shiftright("slot", 20).cast("double"), F.col("slot").bitwiseAND(F.lit((1 << 20) - 1)).cast("double")
    multiple = high * GOLDEN_HIGH + low * GOLDEN + 0.5
    at = F.least(F.floor((multiple - F.floor(multiple)) * total).cast("long"), F.lit(total - 1))
    slots = spark.range(points).withColumnRenamed("id", "slot").select("slot", at.alias("at")).withColumn("cell", F.expr(f"at div {width}"))
    # Intervals meet points in cells of equal width, which the points fill evenly; a source of any size has all the cells that it covers.
    cells = placed.filter("words > 0").withColumn("cell", F.explode(F.sequence(F.expr(f"begin div {width}"), F.expr(f"(begin + words - 1) div {width}"))))
    met = slots.join(cells, "cell").filter("at >= begin and at < begin + words").select("slot", "place")
    unmet = placed.filter("words > 0").join(met.select("place").distinct(), "place", "left_anti").select((F.lit(points) + F.col("place")).alias("slot"), "place")
    return met.unionByName(unmet)


def _block_of(word: Column) -> Column:
    """The block that holds a word of a source's stream: the first ``longer`` blocks have a word more than ``block``."""
    head = F.col("longer") * (F.col("block") + 1)
    return F.when(word < head, F.call_function("div", word, F.col("block") + 1)).otherwise(F.col("longer") + F.call_function("div", word - head, F.greatest(F.col("block"), F.lit(1))))


def _begin_of(block: Column) -> Column:
    return block * F.col("block") + F.least(block, F.col("longer"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: int = SHARE, limit: int = LIMIT, block: int = BLOCK, seed: int = SEED) -> Mix:
    """The schedule's slots with the pieces of documents that fill them."""
    sizes = sized(docs, seed)
    aims = targets(sizes, weights, share, limit)
    slots = written(schedule(aims, block).withColumn("one", F.lit(1).cast("long")), "schedule")
    ranked = sums_before(slots, [F.col("place"), F.col("slot")], {"number": "one"})
    of_source = ranked.groupBy("place").agg(F.min("number").alias("first_number"), F.count("*").alias("slots"))
    ranked = ranked.join(of_source, "place").select("slot", "place", (F.col("number") - F.col("first_number")).alias("rank"))
    # No more blocks than words; slots beyond that stay empty.
    cut = F.least(F.coalesce("slots", F.lit(0)), "words")
    sources = written(aims.join(of_source, "place", "left").withColumn("slots", cut).withColumn("block", F.expr("coalesce(words div nullif(slots, 0), 0)")).withColumn("longer", F.expr("coalesce(words % nullif(slots, 0), 0)")).drop("first_number", "begin"), "source-slots")
    named = sources.withColumnRenamed("source", "__source")
    known = sizes.join(named, F.col("source").eqNullSafe(F.col("__source"))).drop("__source")
    placed = sums_before(written(known, "known"), [F.col("place"), F.col("key"), F.asc_nulls_last("doc_id"), F.col("size"), F.col("row")], {"words_before": "size"})
    placed = written(placed.withColumn("at", F.col("words_before") - F.col("size_begin")), "placed")
    # Each time that the stream comes round, a document takes its words again, as far as the target goes.
    epochs = placed.filter("size > 0").withColumn("epoch", F.explode(F.array(*[F.lit(e).cast("long") for e in range(limit)])))
    epochs = epochs.withColumn("begin", F.col("at") + F.col("epoch") * F.col("source_size")).withColumn("end", F.least(F.col("begin") + F.col("size"), F.col("words"))).filter("begin < end")
    parts = epochs.withColumn("rank", F.explode(F.sequence(_block_of(F.col("begin")), _block_of(F.col("end") - 1))))
    first, last = F.greatest(F.col("begin"), _begin_of(F.col("rank"))) - F.col("begin"), F.least(F.col("end"), _begin_of(F.col("rank") + 1)) - F.col("begin")
    cut_parts = parts.select("place", "rank", "row", "doc_id", "digest", "epoch", first.alias("first"), last.alias("last"))
    pieces = cut_parts.join(ranked, ["place", "rank"]).select("slot", "row", "doc_id", "digest", "epoch", "first", "last")
    return Mix(placed.select("doc_id", "source", "digest", "size", "source_size", "target", "row"), sources.select("source", "place", "source_size", "target", "words", "slots"), pieces)


def texts(docs: DataFrame, pieces: DataFrame) -> DataFrame:
    """(slot, row, doc_id, epoch, first, text): the words of each piece, with a space between them."""
    text = F.col("text").cast("string")
    own = docs.select(F.col("doc_id").cast("long").alias("__doc_id"), F.xxhash64(text).alias("__digest"), text.alias("text")).dropDuplicates(["__doc_id", "__digest"])
    met = pieces.join(own, F.col("doc_id").eqNullSafe(F.col("__doc_id")) & (F.col("digest") == F.col("__digest")))
    words = F.slice(F.regexp_extract_all("text", F.lit(WORD), F.lit(0)), (F.col("first") + 1).cast("int"), (F.col("last") - F.col("first")).cast("int"))
    return met.select("slot", "row", "doc_id", "epoch", "first", F.array_join(words, " ").alias("text"))


def report(docs: DataFrame, **how) -> DataFrame:
    """doc_id, size, source_size, target and taken, the words that the mix takes of each document, repeats counted."""
    made = mix(docs, **how)
    taken = made.pieces.groupBy("row").agg(F.sum(F.col("last") - F.col("first")).alias("taken"))
    return made.documents.join(taken, "row", "left").select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))
