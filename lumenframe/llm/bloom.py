"""A blocked Bloom filter in DataFrame functions, and exact joins behind it.

The filter is a table of at most ``blocks`` rows of four 64-bit words; a key sets one bit in each
word of its block. ``blocks`` is a parameter, so what is broadcast has a size bound whatever the
number of keys: a fuller filter lets more rows through to the exact join, nothing else.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCKS = 1 << 14
#: More blocks than these are never made: 38 MB in all.
MOST_BLOCKS = 1 << 20


def blocks_for(keys: int) -> int:
    """Blocks for about 16 bits a key, up to the bound."""
    return min(MOST_BLOCKS, max(1 << 10, 1 << max(0, keys // 16).bit_length()))


def bloom_place(key: Column, blocks: int) -> tuple[Column, list[Column]]:
    """The key's block, and for each of the block's four words the bit that it sets."""
    h, g = F.xxhash64(F.lit(1), key), F.xxhash64(F.lit(2), key)
    bit = lambda k: F.shiftrightunsigned(g, 6 * k).bitwiseAND(F.lit(63)).cast("int")
    one = F.lit(1).cast("long")
    return F.pmod(h, F.lit(blocks)).cast("int"), [F.call_function("shiftleft", one, bit(k)) for k in range(4)]


def build_bloom(keys: DataFrame, column: str, blocks: int = BLOCKS) -> DataFrame:
    """At most ``blocks`` rows: block, w0 to w3."""
    block, words = bloom_place(F.col(column), blocks)
    return keys.groupBy(block.alias("block")).agg(*[F.bit_or(w).alias(f"w{k}") for k, w in enumerate(words)])


def pass_bloom(rows: DataFrame, column: str, bloom: DataFrame, blocks: int = BLOCKS) -> DataFrame:
    """The rows whose key may be listed. The broadcast side has ``blocks`` rows of 36 bytes at most."""
    block, words = bloom_place(F.col(column), blocks)
    hit = None
    for k, w in enumerate(words):
        set_ = F.col(f"w{k}").bitwiseAND(w) != 0
        hit = set_ if hit is None else hit & set_
    joined = rows.withColumn("block", block).join(F.broadcast(bloom), "block").where(hit)
    return joined.drop("block", "w0", "w1", "w2", "w3")


def probed(rows: DataFrame, key: str, ids: DataFrame, blocks: int) -> DataFrame:
    """``rows`` with a column _hit: whether the key may be among ``ids`` (one column of that name)."""
    bloom = build_bloom(ids, key, blocks)
    block, words = bloom_place(F.col(key), blocks)
    hit = F.lit(True)
    for k, w in enumerate(words):
        hit = hit & (F.col(f"_w{k}").bitwiseAND(w) != 0)
    bloom = bloom.select("block", *[F.col(f"w{k}").alias(f"_w{k}") for k in range(4)]).withColumnRenamed("block", "_block")
    joined = rows.withColumn("_at", block).join(F.broadcast(bloom), F.col("_at") == F.col("_block"), "left")
    return joined.withColumn("_hit", F.coalesce(hit, F.lit(False))).drop("_at", "_block", "_w0", "_w1", "_w2", "_w3")


def only(rows: DataFrame, key: str, ids: DataFrame, blocks: int | None = None) -> DataFrame:
    """The rows whose key is among ``ids`` (a table already written); only possible hits are exchanged."""
    return probed(rows, key, ids, blocks or blocks_for(ids.count())).where("_hit").drop("_hit").join(ids, key, "left_semi")


def without(rows: DataFrame, key: str, ids: DataFrame, blocks: int | None = None) -> DataFrame:
    """The rows whose key is not among ``ids`` (a table already written); only possible hits are
    exchanged."""
    marked = probed(rows, key, ids, blocks or blocks_for(ids.count()))
    some = marked.where("_hit").drop("_hit").join(ids, key, "left_anti").select(*rows.columns)
    return marked.where("not _hit").drop("_hit").select(*rows.columns).union(some)
