"""Scalar cleaning rules, each a Column in, a Column out.

There are three kinds of missing number (null, NaN, +/-Infinity), and the stages treat them
differently on purpose; every rule here names the kinds it touches.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from flowlab.schemas import BENIGN

INF = float("inf")

# Unicode white space plus the four separator controls; SQL trim() removes blanks only.
EDGE_SPACE = r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$"
# Java reads '1d' and '2.5f' as numbers; a data file that says so is not numeric.
JAVA_SUFFIX = r"(?i)^\s*[+-]?[0-9.].*[df]\s*$"


def normal_text(c: Column) -> Column:
    """Strip white space, then upper-case."""
    return F.upper(F.regexp_replace(c, EDGE_SPACE, ""))


def lenient_double(c: Column) -> Column:
    """Text to double; what does not parse becomes null."""
    text = c.cast("string")
    return F.when(~text.rlike(JAVA_SUFFIX), text.try_cast("double"))


def lenient_timestamp(c: Column) -> Column:
    return c.try_cast("timestamp_ntz")


def strict_timestamp(c: Column) -> Column:
    """Text to timestamp; a value that does not parse fails the job."""
    parsed = lenient_timestamp(c)
    message = F.concat(F.lit("not a timestamp: "), c.cast("string"))
    return F.when(c.isNotNull() & parsed.isNull(), F.raise_error(message).cast("timestamp_ntz")).otherwise(parsed)


def is_missing(c: Column, floating: bool = True) -> Column:
    """Null, or NaN for floating columns."""
    return c.isNull() | F.isnan(c) if floating else c.isNull()


def zero_nan(c: Column) -> Column:
    """Null and NaN to 0.0; Infinity passes through."""
    number = c.cast("double")
    return F.when(is_missing(number), 0.0).otherwise(number)


def zero_inf(c: Column) -> Column:
    """Null and +/-Infinity to 0.0; NaN passes through."""
    number = c.cast("double")
    return F.when(number.isNull() | (F.abs(number) == INF), 0.0).otherwise(number)


def finite(c: Column) -> Column:
    """NaN and +/-Infinity to null."""
    number = c.cast("double")
    return F.when(~F.isnan(number) & (F.abs(number) != INF), number)


def attack_flag(label: Column, null_label: str = "attack") -> Column:
    """1 unless the label is benign. A null label is an attack, or stays null on request."""
    if null_label == "attack":
        return (~label.eqNullSafe(F.lit(BENIGN))).cast("int")
    if null_label == "null":
        return (label != BENIGN).cast("int")
    raise ValueError(f"null_label must be 'attack' or 'null', not {null_label!r}")


def bytes_per_packet(size: Column, packets: Column) -> Column:
    """size / (packets + 1); null where that denominator is 0."""
    return F.try_divide(size, packets + 1)
