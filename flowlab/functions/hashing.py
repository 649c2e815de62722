"""Draws that depend on row content only, never on partitioning or file order."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fractions are cut from 60-bit digests: fine enough for any table.
DIGITS = 15
BUCKETS = 1 << 4 * DIGITS
SLOTS = 65_536


def row_digest(keys: list[str], seed: str = "") -> Column:
    """md5 of the key columns; another seed gives an independent draw."""
    parts = [F.col(k).cast("string") for k in keys]
    return F.md5(F.concat_ws("|", *([F.lit(seed)] if seed else []), *parts))


def leading_bits(digest: Column, hex_digits: int = 8) -> Column:
    """The first hex digits of a digest as a number (at most 15 digits: 60 bits)."""
    return F.conv(F.substring(digest, 1, hex_digits), 16, 10).cast("bigint")


def bucket(keys: list[str], seed: str = "") -> Column:
    """Even number 0 .. BUCKETS - 1 of a row."""
    return leading_bits(row_digest(keys, seed), DIGITS)


def edge(fraction: float) -> int:
    """Rows whose bucket lies below are that fraction of all."""
    return round(fraction * BUCKETS)
