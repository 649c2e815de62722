"""What several operators share: the notion of a word, and rows that stand for several copies."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Words are what stands between runs of these six characters.
SPACE = "[\\x20\\x09-\\x0D]"
COPIES_PER_STEP = 10_000


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(folder, f"{name}.parquet"))


def words(text: str | Column) -> Column:
    """The words of a text in order; none for null."""
    text = F.col(text) if isinstance(text, str) else text
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), f"{SPACE}+"), "")


def number(text: Column, hex_digits: int = 8) -> Column:
    """An even whole number from the md5 of a text."""
    return F.conv(F.substring(F.md5(text), 1, hex_digits), 16, 10).cast("bigint")


def numbered_copies(df: DataFrame, copies: str, number: str) -> DataFrame:
    """Each row as often as `copies` says, numbered from 0. Counts are cut into steps that are
    dealt over the cluster before they are written out, so one hot row is no single task."""
    first, step = F.lit(0).cast("bigint"), F.lit(COPIES_PER_STEP).cast("bigint")
    keys = [c for c in df.columns if c != copies]
    steps = df.withColumn("_from", F.explode(F.sequence(first, F.col(copies) - 1, step)))
    last = F.least(F.col(copies), F.col("_from") + step) - 1
    rows = steps.repartition("_from", *keys).withColumn(number, F.explode(F.sequence("_from", last)))
    return rows.drop("_from", copies)


def bounded_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Keeps the Arrow batches that go to Python small, as texts can be long, and lets Python workers
    find this package where the driver found it."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    known = spark.sparkContext.environment.setdefault("PYTHONPATH", root)
    if root not in known.split(os.pathsep):
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join([root, known])
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > rows:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
