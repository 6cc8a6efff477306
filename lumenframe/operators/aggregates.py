"""Aggregation helpers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def first_by(value: str, order: str) -> Column:
    """``first`` that does not depend on the rows' order: the value at the least ``order``."""
    return F.min_by(value, order)


def last_by(value: str, order: str) -> Column:
    return F.max_by(value, order)


def salted_sum(df: DataFrame, by: list[str], sums: list[str], salts: int = 16) -> DataFrame:
    """Sums in two exchanges, the first by key and salt. Plain sums are combined before the exchange
    already; this is for inputs whose hot keys reach the exchange uncombined."""
    salt = F.pmod(F.xxhash64(*[F.col(c) for c in df.columns]), F.lit(salts))
    part = df.groupBy(*by, salt.alias("_salt")).agg(*[F.sum(c).alias(c) for c in sums])
    return part.groupBy(*by).agg(*[F.sum(c).alias(c) for c in sums])
