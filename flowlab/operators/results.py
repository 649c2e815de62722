"""Reports over result tables: one row per run."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from flowlab.operators.profile import melt
from flowlab.schemas import COMPARED_METRICS, SIZE_LABELS

STABLE = 0.005
FULL = "100%"


def time_per_row(runs: DataFrame) -> DataFrame:
    return runs.withColumn("time_per_row", F.try_divide(F.col("training_time_sec"), F.col("n_rows")))


def scalability_growth(runs: DataFrame, by: Sequence[str] = ("condition", "algorithm")) -> DataFrame:
    """Times against the smallest run of the series, and rows per second."""
    first = W.partitionBy(*by).orderBy("fraction").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)

    def growth(c: str) -> Column:
        return F.try_divide(F.col(c), F.first(c).over(first))

    return runs.withColumns({
        "training_time_growth": growth("training_time_sec"),
        "prediction_time_growth": growth("prediction_time_sec"),
        "rows_per_second_training": F.try_divide(F.col("train_rows"), F.col("training_time_sec")),
        "rows_per_second_prediction": F.try_divide(F.col("test_rows"), F.col("prediction_time_sec")),
    })


def scalability_findings(runs: DataFrame, by: Sequence[str] = ("condition", "algorithm")) -> DataFrame:
    """Per series: the largest run, the fastest training and the best F1; ties go to the
    smaller size."""
    # Structs compare field by field: the measure first, then the fraction.
    size = F.col("fraction")
    return runs.groupBy(*by).agg(
        F.max("n_rows").alias("largest_rows"),
        F.max_by("dataset_size", F.struct("n_rows", -size)).alias("largest_size"),
        F.min("training_time_sec").alias("fastest_training_sec"),
        F.min_by("dataset_size", F.struct("training_time_sec", size)).alias("fastest_size"),
        F.max("f1").alias("best_f1"),
        F.max_by("dataset_size", F.struct("f1", -size)).alias("best_f1_size"),
    )


def size_position(label: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, SIZE_LABELS)), label)


def ordered_results(runs: DataFrame) -> DataFrame:
    """Sorted by size label in ladder order, then by algorithm."""
    return runs.withColumn("size_order", size_position(F.col("dataset_size"))).orderBy("size_order", "algorithm")


def algorithm_pivot(runs: DataFrame, algorithms: dict[str, str]) -> DataFrame:
    """Size by algorithm: training and total time, one column pair per algorithm (name to column
    prefix). Two runs for one cell are an error."""
    once = F.when(
        F.count(F.lit(1)) > 1, F.raise_error(F.lit("more than one run for a cell")).cast("double")
    )
    table = runs.groupBy("dataset_size").pivot("algorithm", list(algorithms)).agg(
        once.otherwise(F.max("training_time_sec")).alias("training"),
        once.otherwise(F.max("total_ml_time_sec")).alias("total"),
    )
    return table.select("dataset_size", *(
        F.col(f"`{name}_{m}`").alias(f"{prefix}_{m}_sec")
        for name, prefix in algorithms.items() for m in ("training", "total")
    )).orderBy(size_position(F.col("dataset_size")))


def algorithm_ratio(runs: DataFrame, slow: str, fast: str, by: Sequence[str] = ("condition",)) -> DataFrame:
    """Training and total time of one algorithm over another at full size."""

    def time(algorithm: str, c: str) -> Column:
        return F.max(F.when(F.col("algorithm") == algorithm, F.col(c)))

    return runs.where(F.col("dataset_size") == FULL).groupBy(*by).agg(
        F.try_divide(time(slow, "training_time_sec"), time(fast, "training_time_sec")).alias("training_ratio"),
        F.try_divide(time(slow, "total_ml_time_sec"), time(fast, "total_ml_time_sec")).alias("total_ratio"),
    )


def robustness_delta(runs: DataFrame, old: str = "Original", new: str = "Deduplicated") -> DataFrame:
    """Full-size metrics under two conditions: old, new, difference, and whether they are stable;
    with the share of rows that the new condition removes, in percent."""

    def value(condition: str, c: str) -> Column:
        return F.max(F.when(F.col("condition") == condition, F.col(c)))

    full = runs.where(F.col("dataset_size") == FULL).groupBy("algorithm").agg(
        value(old, "n_rows").alias("_old_rows"),
        value(new, "n_rows").alias("_new_rows"),
        *(value(s, c).alias(f"{k}{c}") for k, s in (("_old_", old), ("_new_", new)) for c in COMPARED_METRICS),
    )
    removed = (1 - F.try_divide(F.col("_new_rows"), F.col("_old_rows"))) * 100
    entries = {
        c: [F.col("algorithm"), removed, F.col(f"_old_{c}"), F.col(f"_new_{c}")] for c in COMPARED_METRICS
    }
    long = melt(full, entries, ["metric", "algorithm", "rows_removed_percent", "old_value", "new_value"])
    change = F.col("new_value") - F.col("old_value")
    judged = F.col("metric").isin("f1", "roc_auc")
    return long.withColumn("difference", change).withColumn(
        "is_stable", F.when(judged, F.abs(change) < STABLE)
    )


def first_last(runs: DataFrame, by: Sequence[str] = ("condition", "algorithm")) -> DataFrame:
    """The smallest and the largest run of each series side by side."""
    columns = ["n_rows", "training_time_sec", "prediction_time_sec", "f1", "roc_auc"]
    return runs.groupBy(*by).agg(*(
        pick(c, "fraction").alias(f"{side}_{c}")
        for c in columns for side, pick in (("first", F.min_by), ("last", F.max_by))
    ))
