"""Intermediate tables in the folder the cluster shares.

A staged table cuts the lineage with plain Parquet: a lost executor costs a re-read, not a
re-run, and columns computed from the physical layout (such as a partition number) become data.
"""

from __future__ import annotations

import uuid
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession

_written: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or a folder in the warehouse where that is unset: both are shared by
    the driver and all executors."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    return folder or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/staged"


def new_folder(spark: SparkSession, name: str) -> str:
    """A path not used before, removed when the driver ends."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(target)
    return path


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write df once, return a scan of what was written."""
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    _written[out] = path
    return out


def remove(*tables: DataFrame) -> None:
    """Deletes staged tables that nothing reads any more, before the driver ends."""
    for df in tables:
        spark, path = df.sparkSession, _written.pop(df)
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
