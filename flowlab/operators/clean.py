"""Table-level cleaning. Every step is one projection or one filter."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowlab.functions import cleaning as rule
from flowlab.schemas import FEATURES, RAW_LABEL, SAMPLE_NUMERIC, SAMPLE_TEXT, TARGET



def require_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns {missing}; the table has {df.columns}")
    return df


def keep_present(df: DataFrame, wanted: Sequence[str]) -> DataFrame:
    """The wanted columns that exist, in the wanted order."""
    return df.select([c for c in wanted if c in df.columns])


def feature_projection(df: DataFrame, features: Sequence[str] = FEATURES, target: str = TARGET) -> DataFrame:
    return df.select(*features, target)


def _with(df: DataFrame, changed: dict[str, Column]) -> DataFrame:
    return df.select([changed[c].alias(c) if c in changed else F.col(f"`{c}`") for c in df.columns])


def normal_name(name: str) -> str:
    return name.strip().replace(" ", "_").replace("/", "_per_")


def normalise_names(df: DataFrame) -> DataFrame:
    names = [normal_name(c) for c in df.columns]
    clashes = sorted({n for n in names if names.count(n) > 1})
    if clashes:
        raise ValueError(f"columns collide after normalisation: {clashes}")
    return df.toDF(*names)


def _filled(df: DataFrame, column: str) -> Column:
    c = F.col(f"`{column}`")
    return ~rule.is_missing(c, is_floating(df, column))


def is_floating(df: DataFrame, column: str) -> bool:
    return isinstance(df.schema[column].dataType, (T.DoubleType, T.FloatType))


def empty_columns(df: DataFrame) -> list[str]:
    """Columns without a single value (NaN is not a value).

    One aggregate over all rows that shuffles one row per task.
    """
    if not df.columns:
        return []
    found = df.agg(*(F.max(_filled(df, c)).alias(c) for c in df.columns)).first()
    return [c for i, c in enumerate(df.columns) if not found[i]]


def drop_empty_columns(df: DataFrame) -> DataFrame:
    empty = set(empty_columns(df))
    return df.select([f"`{c}`" for c in df.columns if c not in empty])


def normalise_strings(df: DataFrame, columns: Sequence[str] = SAMPLE_TEXT) -> DataFrame:
    return _with(df, {c: rule.normal_text(F.col(c)) for c in columns})


def parse_timestamp(df: DataFrame, column: str = "timestamp", strict: bool = True) -> DataFrame:
    parse = rule.strict_timestamp if strict else rule.lenient_timestamp
    return _with(df, {column: parse(F.col(column))})


def coerce_numeric(df: DataFrame, columns: Sequence[str] = SAMPLE_NUMERIC) -> DataFrame:
    return _with(df, {c: rule.lenient_double(F.col(c)) for c in columns})


def cast_features(df: DataFrame, features: Sequence[str] = FEATURES, target: str = TARGET) -> DataFrame:
    return _with(df, {c: F.col(c).cast("double") for c in [*features, target]})


def zero_fill_nan(df: DataFrame, features: Sequence[str] = FEATURES) -> DataFrame:
    return _with(df, {c: rule.zero_nan(F.col(c)) for c in features})


def zero_fill_inf(df: DataFrame, features: Sequence[str] = FEATURES) -> DataFrame:
    return _with(df, {c: rule.zero_inf(F.col(c)) for c in features})


def zero_fill_all(df: DataFrame, features: Sequence[str] = FEATURES) -> DataFrame:
    """Null, NaN and +/-Infinity to 0.0."""
    return _with(df, {c: F.coalesce(rule.finite(F.col(c)), F.lit(0.0)) for c in features})


def inf_to_null(df: DataFrame, features: Sequence[str] = FEATURES) -> DataFrame:
    return _with(df, {c: rule.finite(F.col(c)) for c in features})


def drop_incomplete(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Listwise deletion: null or NaN in any of the columns."""
    return df.na.drop(subset=list(columns) if columns is not None else None)


def drop_null_label(df: DataFrame, target: str = TARGET) -> DataFrame:
    return df.where(F.col(target).isNotNull())


def features_not_null(df: DataFrame, features: Sequence[str] = FEATURES) -> DataFrame:
    """No null in any feature; NaN stays."""
    return df.where(reduce(and_, [F.col(c).isNotNull() for c in features]))


def normalise_label(df: DataFrame, label: str = RAW_LABEL) -> DataFrame:
    return normalise_strings(df, [label]) if label in df.columns else df
