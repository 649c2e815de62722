"""Targets, derived features, vectors, scalers and class weights."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlab.functions import cleaning as rule
from flowlab.schemas import FEATURES, RAW_LABEL, TARGET


def add_target(df: DataFrame, label: str = RAW_LABEL, null_label: str = "attack") -> DataFrame:
    flag = rule.attack_flag(F.col(label), "attack" if null_label == "attack" else "null")
    out = df.withColumn(TARGET, flag)
    return out.where(F.col(TARGET).isNotNull()) if null_label == "drop" else out


def add_ratio(df: DataFrame) -> DataFrame:
    return df.withColumn("duration_bytes", rule.bytes_per_packet(F.col("bytes"), F.col("packet_count")))


def assembler(features: Sequence[str] = FEATURES, output: str = "features") -> VectorAssembler:
    """Rows with a null or NaN feature are skipped; Infinity is kept."""
    return VectorAssembler(inputCols=list(features), outputCol=output, handleInvalid="skip")


def assemble(df: DataFrame, features: Sequence[str] = FEATURES, output: str = "features") -> DataFrame:
    return assembler(features, output).transform(df)


def scaler(centre: bool = False, source: str = "raw_features", output: str = "features") -> StandardScaler:
    """Sample standard deviation, with or without centring."""
    return StandardScaler(inputCol=source, outputCol=output, withStd=True, withMean=centre)


def scale(df: DataFrame, features: Sequence[str] = FEATURES, centre: bool = False, fit_on: DataFrame | None = None) -> DataFrame:
    """Scaled feature columns. The scaler is fitted on `fit_on` (the training side), else on df."""
    fitted = scaler(centre).fit(assemble(fit_on if fit_on is not None else df, features, "raw_features"))
    vector = fitted.transform(assemble(df, features, "raw_features"))
    array = vector_to_array("features")
    kept = [c for c in df.columns if c not in features]
    return vector.select(*kept, *(array[i].alias(f) for i, f in enumerate(features)))


def scale_population(df: DataFrame, fit_on: DataFrame, features: Sequence[str] = FEATURES) -> DataFrame:
    """Centre and scale by the population standard deviation of `fit_on`; a constant feature is
    only centred."""
    fits = [F.struct(F.avg(f).alias("mean"), F.stddev_pop(f).alias("std")).alias(f) for f in features]
    fit = fit_on.agg(*fits).first()

    def scaled(f: str):
        mean, std = fit[f]["mean"], fit[f]["std"]
        return ((F.col(f) - F.lit(mean)) / F.lit(std or 1.0)).alias(f)

    return df.select([scaled(c) if c in features else F.col(c) for c in df.columns])


def class_weights(df: DataFrame, target: str = TARGET) -> DataFrame:
    """n / (2 * n_class) for both classes; fails if one is missing."""
    row = df.where(F.col(target).isin(0, 1)).agg(
        F.count_if(F.col(target) == 0).alias("n0"), F.count_if(F.col(target) == 1).alias("n1")
    )
    n = F.col("n0") + F.col("n1")
    entries = []
    for k in (0, 1):
        weight = F.when(F.col(f"n{k}") == 0, F.raise_error(F.lit(f"no rows of class {k}")).cast("double"))
        weight = weight.otherwise(n / (2.0 * F.col(f"n{k}")))
        entries.append(F.struct(F.lit(k).alias(target), F.col(f"n{k}").alias("n_rows"), weight.alias("class_weight")))
    return row.select(F.inline(F.array(*entries)))


def add_class_weights(df: DataFrame, target: str = TARGET) -> DataFrame:
    weights = {r[target]: r["class_weight"] for r in class_weights(df, target).collect()}
    return df.withColumn(
        "class_weight", F.when(F.col(target) == 1, F.lit(weights[1])).otherwise(F.lit(weights[0]))
    )
