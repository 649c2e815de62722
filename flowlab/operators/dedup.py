"""Duplicates and set operations.

All of them are hash aggregations on the row itself: copies are merged before the shuffle, so a
group of copies that makes up a third of the table sends one row per task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlab.operators import clean
from flowlab.operators.ordering import COPIES, counted, repeat_rows
from flowlab.schemas import FEATURES, TARGET


SKETCH_BITS = 16


def distinct_rows(df: DataFrame) -> DataFrame:
    return df.dropDuplicates()


def distinct_projection(df: DataFrame, features: Sequence[str] = FEATURES, target: str = TARGET) -> DataFrame:
    """Project first, so only the features and the target are shuffled."""
    return clean.feature_projection(df, features, target).distinct()


def dedup_after_clean(df: DataFrame, features: Sequence[str] = FEATURES, target: str = TARGET) -> DataFrame:
    """Clean the values, then drop rows that have become equal."""
    table = clean.cast_features(clean.feature_projection(df, features, target), features, target)
    return clean.drop_null_label(clean.zero_fill_inf(table, features), target).dropDuplicates()


def duplicate_report(df: DataFrame) -> DataFrame:
    """Total, distinct and duplicate rows and the duplicate rate in percent, in one pass."""
    counts = counted(df).agg(
        F.coalesce(F.sum(COPIES), F.lit(0)).alias("total_rows"), F.count(F.lit(1)).alias("unique_rows")
    )
    extra = F.col("total_rows") - F.col("unique_rows")
    return counts.select(
        "total_rows",
        "unique_rows",
        extra.alias("duplicate_rows"),
        F.coalesce(F.try_divide(100.0 * extra, F.col("total_rows")), F.lit(0.0)).alias("duplicate_rate"),
    )


def distinct_sketches(df: DataFrame, by: str) -> DataFrame:
    """(by, total_rows, sketch): a mergeable sketch of the distinct rows of each group, without `by` itself: one row per
    task and group is shuffled, never the rows. Sketches can be stored and merged later."""
    row = F.xxhash64(*(F.struct(F.col(c).isNull(), c) for c in df.columns if c != by))
    return df.groupBy(by).agg(F.count(F.lit(1)).alias("total_rows"), F.hll_sketch_agg(row, SKETCH_BITS).alias("sketch"))


def approximate_duplicates(sketches: DataFrame) -> DataFrame:
    """total_rows, unique_rows and duplicate_rate over all groups, from their merged sketches. The standard error of
    unique_rows is 1.04 / sqrt(2^SKETCH_BITS), about 0.4 %."""
    merged = sketches.agg(F.sum("total_rows").alias("total_rows"), F.hll_union_agg("sketch").alias("_all"))
    unique = F.least(F.hll_sketch_estimate("_all"), F.col("total_rows"))
    rate = F.coalesce(F.try_divide(100.0 * (F.col("total_rows") - F.col("unique_rows")), F.col("total_rows")), F.lit(0.0))
    return merged.withColumn("unique_rows", unique).select("total_rows", "unique_rows", rate.alias("duplicate_rate"))


def _tally(left: DataFrame, right: DataFrame) -> DataFrame:
    """Each distinct row with its copies on either side: one shuffle, no join."""
    sides = left.select("*", F.lit(1).alias("_l"), F.lit(0).alias("_r")).unionByName(
        right.select(*left.columns, F.lit(0).alias("_l"), F.lit(1).alias("_r"))
    )
    return sides.groupBy(*left.columns).agg(F.sum("_l").alias("_l"), F.sum("_r").alias("_r"))


def except_distinct(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows of left that right does not have, each once."""
    return _tally(left, right).where((F.col("_l") > 0) & (F.col("_r") == 0)).select(left.columns)


def except_all(left: DataFrame, right: DataFrame) -> DataFrame:
    """Multiset difference: a row stays as often as left has it more than right."""
    rest = _tally(left, right).withColumn(COPIES, F.col("_l") - F.col("_r"))
    return repeat_rows(rest.where(F.col(COPIES) > 0).select(*left.columns, COPIES))


def union_results(*tables: DataFrame, condition: Sequence[str] = (), algorithm: str = "Logistic Regression") -> DataFrame:
    """Result tables under one another: absent columns become null, an absent algorithm gets the
    default name, and `condition` tags each table."""
    ready = []
    for i, table in enumerate(tables):
        if "algorithm" not in table.columns:
            table = table.withColumn("algorithm", F.lit(algorithm))
        if condition:
            table = table.withColumn("condition", F.lit(condition[i]))
        ready.append(table)
    union = ready[0]
    for table in ready[1:]:
        union = union.unionByName(table, allowMissingColumns=True)
    return union
