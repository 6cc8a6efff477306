"""Connected components by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenframe.llm.scratch import discard, materialize


def connected_components(links: DataFrame) -> DataFrame:
    """node, component (its smallest node) of the ends of ``links`` (columns x and y).

    A large star ties each node's larger neighbours to the smallest one, a small star its smaller
    neighbours and itself; equal ties fold, so a dense group shrinks to a star within a few rounds
    and the ties never grow in number. Ties live in tables in the shared folder; the driver only
    sees whether they are stars yet: every node tied to one smaller node or to larger ones alone.
    """
    ties = links.select(F.greatest("x", "y").alias("u"), F.least("x", "y").alias("v")).where("u <> v").distinct()
    ties = materialize(ties, "cc-ties")
    while True:
        least = ties.union(ties.select("v", "u")).groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")).withColumnRenamed("u", "_u")
        large = ties.join(least, F.col("v") == F.col("_u")).select("u", F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "_u")
        small = large.join(least, (F.col("u") == F.col("_u")) & (F.col("v") != F.col("m"))).select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = materialize(small.union(least.select("_u", "m")).distinct(), "cc-ties")
        discard(ties)
        ties = small
        ends = ties.select(F.col("u").alias("node"), F.lit(1).alias("ups"), F.lit(0).alias("downs")).union(ties.select("v", F.lit(0), F.lit(1)))
        if not ends.groupBy("node").agg(F.sum("ups").alias("ups"), F.max("downs").alias("downs")).where("ups + downs > 1 and ups > 0").limit(1).count():
            break
    return ties.select(F.col("u").alias("node"), F.col("v").alias("component")).union(ties.select("v", "v").distinct())
