"""Set operations with SQL's names."""

from __future__ import annotations

from pyspark.sql import DataFrame


def union_distinct(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.union(b).distinct()


def union_by_name(a: DataFrame, b: DataFrame) -> DataFrame:
    """Union by column name; a column that one side lacks is null there."""
    return a.unionByName(b, allowMissingColumns=True)


def intersect(a: DataFrame, b: DataFrame, every: bool = False) -> DataFrame:
    return a.intersectAll(b) if every else a.intersect(b)


def except_(a: DataFrame, b: DataFrame, every: bool = False) -> DataFrame:
    return a.exceptAll(b) if every else a.subtract(b)
