"""Scans and sinks: CSV and Parquet, one table per stage, partitioned by source file."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowlab.schemas import SOURCE

PREFERRED = "*CICFlowMeter*.parquet"
INTEGER = r"^[+-]?[0-9]+$"
NUMBER = r"^[+-]?(([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?|[iI]nf(inity)?|NaN)$"
TIMESTAMP = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}([ T][0-9:.]+)?$"
KINDS = {"long": T.LongType(), "double": T.DoubleType(), "boolean": T.BooleanType(), "timestamp_ntz": T.TimestampNTZType()}


def read_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """CSV with a header. The schema is given, so the file is read once."""
    return spark.read.schema(schema).option("header", True).csv(path)


def infer_types(df: DataFrame) -> T.StructType:
    """The narrowest type that holds every value of each text column: bigint, double, boolean, timestamp or string. One
    aggregate over all rows, so a late value widens the type. Null and empty texts fit any type; a
    column without values is a string. Columns of other types are kept."""
    texts = [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]
    filled = {c: F.nullif(F.trim(F.col(f"`{c}`")), F.lit("")) for c in texts}
    checks = {
        "long": lambda x: x.rlike(INTEGER) & x.try_cast("bigint").isNotNull(),
        "double": lambda x: x.rlike(NUMBER),
        "boolean": lambda x: F.lower(x).isin("true", "false"),
        "timestamp_ntz": lambda x: x.rlike(TIMESTAMP) & x.try_cast("timestamp_ntz").isNotNull(),
    }
    row = df.agg(*(
        F.struct(F.count(x).alias("n"), *(F.count_if(check(x)).alias(t) for t, check in checks.items())).alias(f"c{i}")
        for i, x in enumerate(filled.values())
    )).first() if texts else {}
    fields = {f.name: f for f in df.schema}
    for i, c in enumerate(texts):
        counts = row[f"c{i}"]
        fits = [t for t in checks if counts["n"] and counts[t] == counts["n"]]
        fields[c] = T.StructField(c, KINDS[fits[0]] if fits else T.StringType())
    return T.StructType(list(fields.values()))


def typed(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Text columns cast to their inferred types; an empty text of a typed column is null."""
    return df.select(*(
        F.col(f"`{f.name}`") if isinstance(f.dataType, T.StringType) or not isinstance(df.schema[f.name].dataType, T.StringType)
        else F.nullif(F.trim(F.col(f"`{f.name}`")), F.lit("")).cast(f.dataType).alias(f.name)
        for f in schema
    ))


def read_csv_typed(spark: SparkSession, path: str) -> DataFrame:
    """CSV with a header and types inferred from all rows."""
    text = spark.read.option("header", True).csv(path)
    return typed(text, infer_types(text))


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with a header; white space at the edges of a value is kept."""
    keep = {"ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    df.write.mode("overwrite").options(header=True, **keep).csv(path)


def read_files(spark: SparkSession, folder: str, files: str = "*.parquet") -> DataFrame:
    """The Parquet files directly in a folder as one table; each row knows its file. Columns that
    only some files have are null for the others; conflicting types fail."""
    rows = spark.read.option("pathGlobFilter", files).option("mergeSchema", True).parquet(folder)
    return rows.withColumn(SOURCE, F.col("_metadata.file_name"))


def ingest(spark: SparkSession, raw: str, bronze: str, files: str = "*.parquet") -> DataFrame:
    """Raw files into one bronze table with a partition per file."""
    write_table(read_files(spark, raw, files), bronze)
    return read_table(spark, bronze)


def read_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def scan_source(table: DataFrame, name: str) -> DataFrame:
    """The rows of one named source; on a partitioned table only that partition is read."""
    return table.where(F.col(SOURCE) == name)


def require_sources(table: DataFrame, names: Sequence[str]) -> None:
    """Raise before any work if a named source has no rows."""
    found = {r[0] for r in table.select(SOURCE).where(F.col(SOURCE).isin(*names)).distinct().collect()}
    missing = [n for n in names if n not in found]
    if missing:
        raise FileNotFoundError(f"no such source: {missing}")


def read_recursive(spark: SparkSession, root: str, preferred: str = PREFERRED) -> DataFrame:
    """Parquet files at any depth: those with the preferred name, else all."""
    reader = spark.read.option("recursiveFileLookup", True)
    try:
        return reader.option("pathGlobFilter", preferred).parquet(root)
    except Exception as error:
        # With no matching file Spark has no footer to take a schema from.
        if "UNABLE_TO_INFER_SCHEMA" not in str(error):
            raise
        return reader.option("pathGlobFilter", "*.parquet").parquet(root)


def write_table(df: DataFrame, path: str, gathered: bool = False) -> None:
    """Replace the partitions of a stage table that df has rows for.

    Rows in scan order meet few sources per task. After a shuffle every task holds every source, and writes
    a file for each. `gathered` moves all rows once more, by source, where AQE splits large sources
    over several tasks: fewer files for many sources, at the price of a second shuffle of whole rows.
    """
    if SOURCE not in df.columns:
        df.write.mode("overwrite").parquet(path)
        return
    table = df.hint("rebalance", SOURCE) if gathered else df
    table.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(SOURCE).parquet(path)


def write_results(df: DataFrame, path: str) -> None:
    """A result table as CSV with a header, and as Parquet beside it."""
    write_csv(df, f"{path}/csv")
    df.write.mode("overwrite").parquet(f"{path}/parquet")


def read_results(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return read_csv(spark, f"{path}/csv", schema)
