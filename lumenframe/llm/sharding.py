"""Sharding by histogram sort: shards of near equal bytes from splitters found by counting.

Documents are ordered by (hash of the text, id), so equal texts are neighbours. The driver keeps,
for each splitter, the closest keys known to lie below and above its place, and probes evenly
spaced keys between them; a pass over the keys counts the bytes below all probes exactly, in sums
of one row per probe. Probing ends when every splitter is within tolerance or its two keys are
neighbours. Probes are keys of any hash, so a group of equal texts is only cut where it is too
large to lie on one side. The rows are then exchanged once, by ranges of the order that hold about
``RANGE_ROWS`` rows each, or more where a shard would have over ``MOST_RANGES`` of them; a row's slot
is its place in its range plus the rows in the shard's earlier ranges, which a last exact count has
told. The edges of ranges lie at keys of a sample of bounded size, so a group of equal texts is
divided like any other rows; they only spread work and do not change the result.

Defined cases: a null text has no bytes, size 8 and checksum 0; a null id sorts before all others;
rows that agree in text and id are one key and stay together; a very long text is one row like any
other, and its shard may exceed the others by its size; an empty table gives an empty result. Extra
columns are ignored by ``shard_rows`` and kept by ``write_shards``, which adds "_" to the name of
its own column until no column has it.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenframe.llm.scratch import discard, materialize

SHARDS = 24
#: A splitter's error, as a share of a shard's bytes.
TOLERANCE = 0.002
PROBES = 24
RANGE_ROWS = 65536
MOST_RANGES = 1024
#: Sampled keys for each range.
SAMPLED = 64
LOW = -(1 << 63)


def text_hash(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def slim(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, h (the text's hash), d (the id, for the order)."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(
        F.col(id_col).cast("long").alias("doc_id"), (F.octet_length(text) + 8).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"), text_hash(F.col(text_col)).alias("h"),
        F.coalesce(F.col(id_col).cast("long"), F.lit(LOW)).alias("d"),
    )


class Keys:
    """Keys (h, d) as integers in their order, h first."""

    def __init__(self, low: int, high: int):
        self.low, self.width = low, high - low + 1

    def whole(self, h: int, d: int) -> int:
        return (h - LOW) * self.width + d - self.low

    def parts(self, key: int) -> tuple[int, int]:
        return key // self.width + LOW, key % self.width + self.low

    @property
    def end(self) -> int:
        return (1 << 64) * self.width


def place(h: np.ndarray, d: np.ndarray, ph: np.ndarray, pd: np.ndarray) -> np.ndarray:
    """Number of probes (ph, pd), which ascend, at or below each key."""
    lo, hi = np.searchsorted(ph, h, side="left"), np.searchsorted(ph, h, side="right")
    tied = np.flatnonzero(hi > lo)
    for value in np.unique(h[tied]):
        rows = tied[h[tied] == value]
        a, b = lo[rows[0]], hi[rows[0]]
        lo[rows] = a + np.searchsorted(pd[a:b], d[rows], side="right")
    return lo


def count_between(keys: DataFrame, probes: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and rows in each of the len(probes) + 1 ranges between ascending probes."""
    ph, pd = columns_of(probes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size, rows = np.zeros(len(ph) + 1, np.int64), np.zeros(len(ph) + 1, np.int64)
        for batch in batches:
            h, d, s = (batch.column(k).to_numpy() for k in range(3))
            at = place(h, d, ph, pd)
            np.add.at(size, at, s)
            rows += np.bincount(at, minlength=len(rows))
        full = np.flatnonzero(rows)
        yield pa.RecordBatch.from_arrays([pa.array(full), pa.array(size[full]), pa.array(rows[full])], names=["at", "size", "rows"])

    sums = keys.select("h", "d", "size").mapInArrow(run, "at long, size long, rows long").groupBy("at").agg(F.sum("size").alias("size"), F.sum("rows").alias("rows"))
    size, rows = np.zeros(len(ph) + 1, np.int64), np.zeros(len(ph) + 1, np.int64)
    for r in sums.collect():  # one row per range at most
        size[r["at"]], rows[r["at"]] = r["size"], r["rows"]
    return size, rows


def find_splitters(keys: DataFrame, order: Keys, total: int, shards: int, tolerance: float = TOLERANCE, probes: int = PROBES) -> list[int]:
    """The shards - 1 keys at which the next shard begins."""
    slack = tolerance * total / shards
    below = [[0, 0] for _ in range(shards - 1)]  # key, bytes below it
    above = [[order.end, total] for _ in range(shards - 1)]
    found: dict[int, int] = {}
    while len(found) < shards - 1:
        ask = set()
        for k in range(shards - 1):
            if k not in found:
                a, b = below[k][0], above[k][0]
                ask.update(a + (b - a) * i // (probes + 1) for i in range(1, probes + 1))
        ask = sorted(ask - {0})
        size, _ = count_between(keys, [order.parts(p) for p in ask])
        under = np.cumsum(size)[:-1]
        for k in range(shards - 1):
            if k in found:
                continue
            want = total * (k + 1) / shards
            i = int(np.searchsorted(under, want, side="right"))
            if i and under[i - 1] >= below[k][1]:
                below[k] = [ask[i - 1], int(under[i - 1])]
            if i < len(ask) and under[i] <= above[k][1]:
                above[k] = [ask[i], int(under[i])]
            near = min((below[k], above[k]), key=lambda x: abs(x[1] - want))
            if abs(near[1] - want) <= slack or above[k][0] - below[k][0] <= 1:
                found[k] = near[0]
    out = [found[k] for k in range(shards - 1)]
    return [max(out[: k + 1]) for k in range(shards - 1)]


def sampled_keys(keys: DataFrame, order: Keys, n: int, ranges: int) -> list[int]:
    """Ascending keys of about ``SAMPLED`` times ``ranges`` rows, chosen by a hash of the key."""
    draw = F.shiftrightunsigned(F.xxhash64(F.lit(29), "h", "d"), 11) / float(1 << 53)
    some = keys.where(draw < min(1.0, ranges * SAMPLED / n)).select("h", "d").toArrow()  # bounded by MOST_RANGES
    return sorted({order.whole(h, d) for h, d in zip(some.column(0).to_pylist(), some.column(1).to_pylist())})


def plan_shards(keys: DataFrame, shards: int = SHARDS, tolerance: float = TOLERANCE, range_rows: int = RANGE_ROWS):
    """(probes between ranges, each range's shard, its first slot, its rows), or None for no rows."""
    top = keys.agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n"), F.min("d").alias("low"), F.max("d").alias("high")).first()
    if not top["n"]:
        return None
    order = Keys(top["low"], top["high"])
    splitters = find_splitters(keys, order, top["size"], shards, tolerance)
    pieces = min(MOST_RANGES, max(1, -(-top["n"] // (shards * range_rows))))
    some = sampled_keys(keys, order, top["n"], shards * pieces) if pieces > 1 else []
    edges = [0, *splitters, order.end]
    owners, starts = [], []
    for k in range(shards):
        inside = some[bisect_right(some, edges[k]) : bisect_left(some, edges[k + 1])]
        cuts = {inside[len(inside) * i // pieces] for i in range(1, pieces)} if inside else set()
        starts += [edges[k], *sorted(cuts)]
        owners += [k] * (1 + len(cuts))
    probes = [order.parts(min(s, order.end - 1)) for s in starts[1:]]
    _, rows = count_between(keys, probes)
    owners = np.array(owners)
    before = np.cumsum(rows) - rows
    first = np.array([before[owners == k][0] for k in range(shards)])
    return probes, owners, before - first[owners], rows


def shard_rows(docs: DataFrame, shards: int = SHARDS, tolerance: float = TOLERANCE, range_rows: int = RANGE_ROWS, **columns) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot: one row per document."""
    keys = materialize(slim(docs, **columns), "shard-keys")
    plan = plan_shards(keys, shards, tolerance, range_rows)
    if plan is None:
        return keys.select("doc_id", "size", "text_crc32", F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot"))
    probes, owners, starts, _ = plan
    shared = docs.sparkSession.sparkContext.broadcast((*columns_of(probes), owners, starts))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ph, pd, owners, starts = shared.value
        for batch in batches:
            at = place(batch.column(3).to_numpy(), batch.column(4).to_numpy(), ph, pd)
            columns = [*batch.columns, pa.array(at.astype(np.int32)), pa.array(owners[at].astype(np.int32)), pa.array(starts[at])]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, "range", "shard", "start"])

    schema = T.StructType(list(keys.schema.fields)).add("range", "integer").add("shard", "integer").add("start", "long")
    ranged = keys.mapInArrow(run, schema)
    inside = Window.partitionBy("range").orderBy("h", "d", "size", "text_crc32")
    slot = F.col("start") + F.row_number().over(inside) - 1
    return ranged.select("doc_id", "size", "text_crc32", "shard", slot.cast("long").alias("slot"))


def columns_of(probes: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    ph, pd = (np.array([p[k] for p in probes], dtype=np.int64) for k in (0, 1))
    return ph, pd


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS, tolerance: float = TOLERANCE, range_rows: int = RANGE_ROWS, id_col: str = "doc_id", text_col: str = "text") -> str:
    """Writes whole rows as Parquet under ``path``/shard=k, exchanged once. A shard's files are cut
    by ranges of the order, so no task holds a shard. Returns the name of the column for the shard."""
    keys = materialize(slim(docs, id_col, text_col), "shard-keys")
    plan = plan_shards(keys, shards, tolerance, range_rows)
    discard(keys)
    name = "shard"
    while name in {c.lower() for c in docs.columns}:
        name += "_"
    if plan is None:
        docs.withColumn(name, F.lit(0)).write.partitionBy(name).parquet(path)
        return name
    probes, owners, _, _ = plan
    shared = docs.sparkSession.sparkContext.broadcast((*columns_of(probes), owners))

    @F.arrow_udf("long")
    def where(h: pa.Array, d: pa.Array) -> pa.Array:
        """Shard and range in one number; the texts stay in the JVM."""
        ph, pd, owners = shared.value
        at = place(h.to_numpy(), d.to_numpy(), ph, pd)
        return pa.array(owners[at] << 32 | at)

    row = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
        where(text_hash(F.col(text_col)), F.coalesce(F.col(id_col).cast("long"), F.lit(LOW))).alias("at"))
    row = row.repartitionById(len(owners), F.col("at").bitwiseAND(F.lit((1 << 32) - 1)).cast("int"))
    row.select("row.*", F.shiftright("at", 32).cast("int").alias(name)).write.partitionBy(name).parquet(path)
    return name


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shard_rows(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


QUERIES = {"op6_sharding": op6_sharding}
ORACLES: dict[str, str] = {}
