"""Raw to bronze to silver to gold. Each stage is one plan from scan to write."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from flowlab.operators import clean, dedup, features, profile
from flowlab.schemas import GOLD_COLUMNS, SAMPLE_RAW, SOURCE
from flowlab.sources import tables


def flows_to_silver(bronze: DataFrame) -> DataFrame:
    """Drop empty columns, normalise names, drop copies, normalise labels.

    Copies are dropped before the labels are cleaned, as rows that differ in raw form are
    different records. Emptiness does not depend on copies, so it is checked on the scan, where
    only the suspect columns are read.
    """
    named = clean.normalise_names(clean.drop_empty_columns(bronze))
    return clean.normalise_label(dedup.distinct_rows(named))


def flows_to_gold(silver: DataFrame, keep: tuple[str, ...] = (SOURCE,), null_label: str = "attack") -> DataFrame:
    """The target and the model features, with the columns to keep in front."""
    return clean.keep_present(features.add_target(silver, null_label=null_label), [*keep, *GOLD_COLUMNS])


def sample_to_silver(bronze: DataFrame) -> DataFrame:
    """The small traffic sample: drop copies, type the columns, normalise the texts."""
    unique = dedup.distinct_rows(bronze)
    typed = clean.coerce_numeric(clean.parse_timestamp(unique))
    return clean.normalise_strings(typed)


def sample_to_gold(silver: DataFrame) -> DataFrame:
    return features.add_target(features.add_ratio(silver), label="label")


def run_flows(spark: SparkSession, raw: str, area: str) -> DataFrame:
    """All stages of the flow tables, from a folder of Parquet files; returns the gold table."""
    bronze = tables.ingest(spark, raw, f"{area}/bronze")
    tables.write_table(flows_to_silver(bronze), f"{area}/silver")
    silver = tables.read_table(spark, f"{area}/silver")
    tables.write_table(flows_to_gold(silver), f"{area}/gold")
    return tables.read_table(spark, f"{area}/gold")


def run_sample(spark: SparkSession, csv: str, area: str) -> DataFrame:
    """All stages of the traffic sample, from CSV; bad silver data fails the run before gold."""
    tables.write_table(tables.read_csv(spark, csv, SAMPLE_RAW), f"{area}/bronze")
    bronze = tables.read_table(spark, f"{area}/bronze")
    tables.write_table(sample_to_silver(bronze), f"{area}/silver")
    silver = tables.read_table(spark, f"{area}/silver")
    profile.constraint_report(silver, strict=True)
    tables.write_table(sample_to_gold(silver), f"{area}/gold")
    return tables.read_table(spark, f"{area}/gold")
