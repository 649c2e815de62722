"""Counts, summaries and data checks. Each report is one aggregation pass."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowlab.functions.cleaning import is_missing
from flowlab.operators.clean import is_floating
from flowlab.schemas import RAW_LABEL, SAMPLE_NOT_NULL, SAMPLE_NUMERIC, SOURCE, TARGET

CLASS_NAMES = {0: "Normal", 1: "Attack"}


def melt(row: DataFrame, entries: dict[str, Sequence[Column]], names: Sequence[str]) -> DataFrame:
    """Turns one wide row into a long table: one output row per entry."""
    structs = [
        F.struct(F.lit(key).alias(names[0]), *(v.alias(n) for v, n in zip(values, names[1:])))
        for key, values in entries.items()
    ]
    return row.select(F.inline(F.array(*structs)))


def preview(df: DataFrame, order: Sequence[str], n: int = 5) -> DataFrame:
    return df.orderBy(*order).limit(n)


def table_profile(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("n_rows")).withColumn("n_columns", F.lit(len(df.columns)))


def null_counts(df: DataFrame) -> DataFrame:
    """Missing values (null, NaN) per column; the entry '*' is the sum over the table."""
    names = {c: f"_{i}" for i, c in enumerate(df.columns)}
    row = df.agg(*(
        F.count_if(is_missing(F.col(f"`{c}`"), is_floating(df, c))).alias(a) for c, a in names.items()
    ))
    total = sum((F.col(a) for a in names.values()), F.lit(0).cast("bigint"))
    entries = {c: [F.col(a)] for c, a in names.items()} | {"*": [total]}
    return melt(row, entries, ["column_name", "null_count"])


def schema_report(df: DataFrame) -> DataFrame:
    """Position, name and type of every column, and how many values it holds."""
    row = df.agg(*(
        F.count_if(~is_missing(F.col(f"`{c}`"), is_floating(df, c))).alias(f"_{i}")
        for i, c in enumerate(df.columns)
    ))
    entries = {c: [F.lit(i), F.lit(t), F.col(f"_{i}")] for i, (c, t) in enumerate(df.dtypes)}
    return melt(row, entries, ["column_name", "position", "column_type", "n_values"])


def label_counts(df: DataFrame, label: str = RAW_LABEL) -> DataFrame:
    """Rows per file and label, most frequent first; null labels are left out."""
    counts = df.where(F.col(label).isNotNull()).groupBy(SOURCE, label).agg(F.count(F.lit(1)).alias("n_rows"))
    return counts.orderBy(SOURCE, F.desc("n_rows"), label)


def class_distribution(df: DataFrame, target: str = TARGET) -> DataFrame:
    return df.groupBy(target).agg(F.count(F.lit(1)).alias("n_rows")).orderBy(target)


def class_share(df: DataFrame, target: str = TARGET) -> DataFrame:
    """Rows and percentage per named class."""
    row = df.agg(
        F.count(F.lit(1)).alias("_n"),
        *(F.count_if(F.col(target) == k).alias(f"_{k}") for k in CLASS_NAMES),
    )
    entries = {
        name: [F.col(f"_{k}"), F.try_divide(100.0 * F.col(f"_{k}"), F.col("_n"))]
        for k, name in CLASS_NAMES.items()
    }
    return melt(row, entries, ["class_name", "n_rows", "share_percent"])


def describe_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Count, mean, sample standard deviation, minimum and maximum per column."""
    measures = {"n_values": F.count, "mean": F.avg, "stddev": F.stddev_samp, "min": F.min, "max": F.max}
    row = df.agg(*(
        f(F.col(c).cast("double")).alias(f"{c}.{m}") for c in columns for m, f in measures.items()
    ))
    entries = {c: [F.col(f"`{c}.{m}`") for m in measures] for c in columns}
    return melt(row, entries, ["column_name", *measures])


def constraint_report(
    df: DataFrame,
    not_null: Sequence[str] = SAMPLE_NOT_NULL,
    not_negative: Sequence[str] = SAMPLE_NUMERIC,
    strict: bool = False,
) -> DataFrame:
    """Violations per rule. Null and NaN fail a range rule. Strict: raise on any violation."""
    rules = {f"{c} is not null": ~is_missing(F.col(c), is_floating(df, c)) for c in not_null}
    for c in not_negative:
        value = F.col(c)
        rules[f"{c} >= 0"] = F.coalesce((value >= 0) & ~F.isnan(value), F.lit(False))
    names = {r: f"_{i}" for i, r in enumerate(rules)}
    row = df.agg(*(F.count_if(~ok).alias(names[r]) for r, ok in rules.items()))
    report = melt(
        row, {r: [F.col(a), F.col(a) == 0] for r, a in names.items()}, ["rule", "violations", "passed"]
    )
    if strict:
        failed = [f"{r.rule} ({r.violations} rows)" for r in report.collect() if not r.passed]
        if failed:
            raise ValueError("data checks failed: " + "; ".join(failed))
    return report
