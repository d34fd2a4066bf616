"""From raw documents to token ids: quality, near duplicates, contamination, personal data, encoding.

Each stage takes (spark, docs, sf_dir) and returns the rows it keeps, all but the last with the columns of documents.
``run`` writes each stage's result to the folder that the cluster shares and hands the next one what it reads there.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm import chosen_path, disclosure, merge_dropout, nb_svm, wu_manber
from graphloom.llm.common import sums_before, table, written
from graphloom.llm.queries import tokenizer_file


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    return nb_svm.accepted(docs, nb_svm.fit(docs, table(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: shingles of five words, similarity of 0.8 or more.

    Each row is a document of its own, also where rows share a doc_id or have none: no text goes but for one that it resembles.
    """
    rows, ids = docs.agg(F.count("*"), F.count_distinct("doc_id")).first()
    if rows == ids:
        return _without_copies(docs, "doc_id").select(*docs.columns)
    # Rows get numbers in order of their ids, so that the first of a group is the one with the least.
    whole = docs.select(F.struct(*docs.columns).alias("row"), "doc_id", "text", F.xxhash64("text").alias("digest"), F.monotonically_increasing_id().alias("nth"), F.lit(1).cast("long").alias("one"))
    order = [F.asc_nulls_last("doc_id"), F.col("digest"), F.col("nth")]
    numbered = written(sums_before(written(whole, "rows"), order, {"number": "one"}).select("row", F.col("number").alias("doc_id"), "text"), "numbered")
    return _without_copies(numbered, "doc_id").select("row.*")


def _without_copies(docs: DataFrame, key: str) -> DataFrame:
    found = written(chosen_path.near_duplicates(docs.select(F.col(key).alias("doc_id"), "text")).filter("not kept").select(F.col("doc_id").alias(key)), "near-duplicates")
    return docs.join(found, key, "left_anti")


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the contract does not call contaminated."""
    return wu_manber.clean(docs, table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data and what discloses it taken out of the texts."""
    return disclosure.sanitise(docs)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of all documents."""
    return merge_dropout.encode(docs, tokenizer_file("piece_bpe_32k.model")).select("doc_id", "ids", "n_pieces", "lossless")


STAGES = [("quality", quality), ("near duplicates", near_duplicates), ("decontamination", decontamination), ("personal data", personal_data), ("encoding", encoding)]

#: A fitted model and keyed hashes are beyond SQL; tests/llm compares each stage with a brute-force version on a small table.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)
