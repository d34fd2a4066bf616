"""Small helpers that the text operators share."""

from __future__ import annotations

import math
import re
import tempfile
import uuid
from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

WHITE_SPACE = bytes([9, 10, 11, 12, 13, 32])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@lru_cache(maxsize=1)
def _own_folder() -> str:
    return "file://" + tempfile.mkdtemp(prefix="graphloom-")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; where that is unset and all run on this machine, one of our own."""
    if folder := spark.conf.get("spark.checkpoint.dir", None):
        return folder
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return _own_folder()


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder. It cuts the lineage: a lost executor costs a read, not the work so far."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows in a range of ``sums_before``: as many ranges as a shuffle has parts, unless these would be longer than the second number.
RANGE_ROWS = (50_000, 2_000_000)


def sums_before(df: DataFrame, order: list[Column], values: dict[str, str]) -> DataFrame:
    """df, a written table, with a column for each of values (new name: column of whole numbers): its sum over all rows that stand before in order.

    The order is that of ranges which tasks add up by themselves; the ranges' totals, one row each, are added up apart.
    So no key's rows come together, and none of the columns of order needs many values. Rows that tie share no sum:
    order has to say which comes first, or it does not matter.
    """
    rows, spark = df.count(), df.sparkSession
    ranges = max(1, min(math.ceil(rows / RANGE_ROWS[0]), max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(rows / RANGE_ROWS[1]))))
    ranged = written(df.repartitionByRange(ranges, *order).withColumn("__range", F.spark_partition_id()), "ranges")
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    totals = ranged.groupBy("__range").agg(*[F.sum(v).alias(f"__{n}") for n, v in values.items()])
    over_ranges = before(Window.orderBy("__range"))  # a row for each range
    starts = totals.select("__range", *[F.coalesce(F.sum(f"__{n}").over(over_ranges), F.lit(0)).alias(f"__{n}") for n in values])
    within = before(Window.partitionBy("__range").orderBy(*order))
    summed = ranged.select("*", *[F.coalesce(F.sum(v).over(within), F.lit(0)).alias(n) for n, v in values.items()])
    return summed.join(starts, "__range").select(*df.columns, *[(F.col(n) + F.col(f"__{n}")).alias(n) for n in values])
