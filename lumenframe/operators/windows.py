"""Window helpers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_per_group(df: DataFrame, by: list[str], order: list[Column], k: int, ties: bool = False, name: str = "rank") -> DataFrame:
    """The first ``k`` rows of each group, numbered from 1; with ``ties``, all rows of rank up to k.

    The filter on the number lets the planner keep k rows per group on each side of the exchange."""
    number = (F.rank() if ties else F.row_number()).over(Window.partitionBy(*by).orderBy(*order))
    return df.withColumn(name, number).where(F.col(name) <= k)


def running(column: str, by: list[str], order: list[Column], fn=F.sum) -> Column:
    """An aggregate from the group's start to the current row and its peers."""
    return fn(column).over(Window.partitionBy(*by).orderBy(*order).rangeBetween(Window.unboundedPreceding, Window.currentRow))


def sliding(column: str, by: list[str], order: list[Column], before: int, after: int = 0, fn=F.sum) -> Column:
    """An aggregate over ``before`` rows before to ``after`` rows after the current one."""
    return fn(column).over(Window.partitionBy(*by).orderBy(*order).rowsBetween(-before, after))
