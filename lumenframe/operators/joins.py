"""Joins beyond ``DataFrame.join``: chosen strategies, NULL-aware anti join, marks, skew."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A side is only broadcast by hand if the planner's estimate of its size is below this. The estimate is of
#: compressed files: hashed in memory, three columns of `orders` took 18 times as much.
BROADCAST_LIMIT = 12 << 20


def estimated_bytes(df: DataFrame) -> int:
    """The optimizer's estimate of a DataFrame's size."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def broadcast_if_small(df: DataFrame, limit: int = BROADCAST_LIMIT) -> DataFrame:
    """Marks ``df`` for broadcast if its estimated size is known to be small, else leaves the choice
    to the planner."""
    return F.broadcast(df) if estimated_bytes(df) <= limit else df


def shuffle_hash(left: DataFrame, right: DataFrame, on, how: str = "inner") -> DataFrame:
    """A join that hashes the right side's shuffled partitions."""
    return left.join(right.hint("shuffle_hash"), on, how)


def sort_merge(left: DataFrame, right: DataFrame, on, how: str = "inner") -> DataFrame:
    """A join that merges both sides' sorted partitions, spilling where they exceed memory."""
    return left.join(right.hint("merge"), on, how)


def not_in(left: DataFrame, column: str, right: DataFrame, right_column: str) -> DataFrame:
    """Rows whose value is NOT IN the right column, by SQL's rules: all rows if it is empty, none
    if it holds a NULL, never rows whose own value is NULL (unless it is empty).

    The right side's two facts are a scalar subquery of the same plan, so the join itself stays an
    equi anti join, which scales where a nested-loop NOT IN does not."""
    facts = right.agg(F.struct(F.count(F.lit(1)).alias("n"), F.count(right_column).alias("known")).alias("facts")).scalar()
    empty, whole = facts["n"] == 0, facts["known"] == facts["n"]
    keys = right.select(F.col(right_column).alias(column)).distinct()
    return left.where(empty | (whole & F.col(column).isNotNull())).join(keys, column, "left_anti").select(*left.columns)


def with_mark(left: DataFrame, right: DataFrame, on: list[str], mark: str = "present") -> DataFrame:
    """Adds a boolean column: whether the right side has a row of the same keys."""
    keys = right.select(*on).distinct().withColumn(mark, F.lit(True))
    return left.join(keys, on, "left").withColumn(mark, F.coalesce(F.col(mark), F.lit(False)))


def null_safe(left: DataFrame, right: DataFrame, pairs: list[tuple[str, str]], how: str = "inner") -> DataFrame:
    """An equi join in which NULL equals NULL."""
    condition = functools.reduce(lambda a, b: a & b, [left[a].eqNullSafe(right[b]) for a, b in pairs])
    return left.join(right, condition, how)


def salted(left: DataFrame, right: DataFrame, on: list[str], salts: int = 16, how: str = "inner") -> DataFrame:
    """A join whose keys are dealt over ``salts`` partitions each: the left rows get a salt from
    their own values, the right rows are repeated for all. For hot keys on the left that run-time
    skew handling cannot split; ``how`` is inner, left, left_semi or left_anti."""
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError(f"a salted join cannot be {how}")
    salt = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in left.columns]), F.lit(salts)).cast("int")
    dealt = left.withColumn("_salt", salt)
    repeated = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return dealt.join(repeated, [*on, "_salt"], how).drop("_salt")


def interval_join(points: DataFrame, spans: DataFrame, point: Column, low: Column, high: Column, on: list[str], width: int) -> DataFrame:
    """Points inside spans of the same keys: low <= point <= high. Spans are repeated for each
    stretch of ``width`` they touch, so the join is by equal stretches and keys, not a nested loop."""
    p = points.withColumn("_stretch", F.floor(point / width))
    s = spans.withColumn("_stretch", F.explode(F.sequence(F.floor(low / width), F.floor(high / width))))
    return p.join(s, [*on, "_stretch"]).where((point >= low) & (point <= high)).drop("_stretch")


#: Keys in one block of ``pairs_within``: two blocks make up to 65,536 pairs.
BLOCK = 256


def pairs_within(df: DataFrame, on: list[str], key: str, low: str, high: str) -> DataFrame:
    """All pairs of rows that agree in ``on``, the smaller ``key`` as ``low`` and the greater as ``high``. A group
    is cut into blocks by its keys' hash, each two blocks meet once, and the meetings are dealt over all
    tasks: neither a large group nor a small table leaves the work to a few."""
    rows = df.select(*on, F.col(key).alias("_key")).dropna()
    blocks = rows.groupBy(*on).agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("_blocks"))
    block = F.pmod(F.xxhash64("_key"), F.col("_blocks")).alias("_block")
    held = rows.join(blocks, on).groupBy(*on, "_blocks", block).agg(F.collect_list("_key").alias("_xs"))
    left = held.withColumn("_other", F.explode(F.sequence(F.col("_block"), F.col("_blocks") - 1)))
    right = held.select(*on, F.col("_block").alias("_other"), F.col("_xs").alias("_ys"))
    met = left.join(right, [*on, "_other"]).repartition(*on, "_block", "_other")
    each = met.select((F.col("_block") == F.col("_other")).alias("_same"), F.explode("_xs").alias("_x"), "_ys")
    pairs = each.select("_same", "_x", F.explode("_ys").alias("_y")).where(~F.col("_same") | (F.col("_x") < F.col("_y")))
    return pairs.select(F.least("_x", "_y").alias(low), F.greatest("_x", "_y").alias(high))
