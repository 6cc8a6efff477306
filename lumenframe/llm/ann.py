"""Nearest neighbours by cosine from randomly rotated one-bit codes.

Vectors are scaled to length 1, taken relative to the nearest of the centres (fitted to a bounded
sample), rotated at random, and kept as one bit per dimension, packed in 64-bit words, with three
correction scalars. A query is rotated alike and rounded to ``QUERY_BITS`` bits per dimension, kept as
that many planes of bits; counting the bits that a code and the planes have in common gives an
unbiased estimate of their inner product, and the scalars a bound on its error. A row is compared
exactly, on the original vectors in double precision, if its upper bound reaches the query's floor:
the k-th best lower bound met in the block, or the k-th best exact score among a few seeds (at most an
eighth of the rows), which count as found.

The rows of a centre are one list, cut into blocks of bounded size. A query visits the lists of its
nearest centres only, as many as hold ``SHARE`` of the neighbours within the sample: few where vectors
form clusters, most where they have no structure. Each row is exchanged once, with its code, and a
query once for each block that it visits; a task holds one block and streams the queries past it.
With ``exact``, all lists are visited and all rows compared.

Identical vectors are equally near to every query, so of each set only the k + 1 smallest ids are
indexed: no other copy can be among any query's k nearest, ties going to the smaller id.

Defined cases: vectors that are null, empty, zero or hold null, NaN or infinite components take no
part, nor do those whose dimension is not the most common one (the largest, if several are); of
rows that share an id the one with the smallest vector, in the order of arrays, takes part; a null id
takes no part; with fewer than k candidates all are returned; empty tables give empty results. Extra
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenframe.llm.scratch import discard, materialize

#: Bounds of the number of centres, which grows with the root of the number of rows.
FEWEST_CENTRES, MOST_CENTRES = 16, 1024
#: Rows of the sample to which centres and the number of lists to visit are fitted, and seeds among them.
SAMPLE, SEEDS = 8192, 1024
#: Queries of the sample that tell how many lists to visit, and the share of neighbours these must hold.
TRIALS, SHARE = 256, 0.98
QUERY_BITS = 4
#: Bytes of the vectors of a block.
BLOCK_BYTES = 32 << 20
#: Estimates made at once.
TILE = 1 << 18
#: Errors beyond this many standard deviations of the bound are left to chance.
EPSILON = 1.9


def usable(rows: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """vec_id, v (array of float or double)."""
    kind = rows.schema[vec_col].dataType
    single = isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.FloatType)
    v = F.col(vec_col) if single else F.transform(F.col(vec_col), lambda x: x.cast("double"))
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return rows.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v")).where(
        F.col("vec_id").isNotNull() & F.col("v").isNotNull() & ~F.coalesce(bad, F.lit(False)) & F.exists("v", lambda x: x != 0))


def rotation(dim: int, seed: int = 11) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def matrix(column: pa.Array) -> np.ndarray:
    """Rows of a list column of equal lengths."""
    n = len(column)
    return column.flatten().to_numpy(zero_copy_only=False).reshape(n, -1).astype(np.float64) if n else np.zeros((0, 1))


def unit(v: np.ndarray) -> np.ndarray:
    return v / np.sqrt((v * v).sum(axis=1))[:, None]


def cosines(v: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Of the rows of v with q."""
    return (v * q).sum(axis=1) / (np.sqrt((v * v).sum(axis=1)) * np.sqrt((q * q).sum()))


def closeness(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Of each x to each centre: larger is nearer."""
    return x @ c.T - (c * c).sum(axis=1) / 2


def words(bits: np.ndarray) -> np.ndarray:
    """Rows of bits packed in 64-bit words, filled up with zeros."""
    packed = np.packbits(bits, axis=-1)
    return np.pad(packed, [(0, 0)] * (packed.ndim - 1) + [(0, -packed.shape[-1] % 8)]).view(np.uint64)


class Codes:
    """One-bit codes of vectors relative to one centre."""

    def __init__(self, x: np.ndarray, centre: np.ndarray, turn: np.ndarray):
        """``x``: unit vectors."""
        r = x - centre
        self.dim = x.shape[1]
        self.length = np.sqrt((r * r).sum(axis=1))
        o = (r / np.maximum(self.length, 1e-300)[:, None]) @ turn.T
        self.cosine = np.abs(o).sum(axis=1) / np.sqrt(self.dim)
        self.with_centre = (r * centre).sum(axis=1)
        self.bits = words(o > 0)

    @classmethod
    def of(cls, dim: int, bits: np.ndarray, length: np.ndarray, with_centre: np.ndarray, cosine: np.ndarray) -> Codes:
        self = cls.__new__(cls)
        self.dim, self.bits, self.length, self.with_centre, self.cosine = dim, bits, length, with_centre, cosine
        return self

    def estimate(self, uq: np.ndarray, centre: np.ndarray, turn: np.ndarray, epsilon: float) -> tuple[np.ndarray, np.ndarray]:
        """Queries x rows: inner products of unit vectors estimated from bits that are in common, and
        their error at ``epsilon`` standard deviations."""
        off = uq - centre
        rotated = off @ turn.T
        low = rotated.min(axis=1)
        step = np.maximum((rotated.max(axis=1) - low) / ((1 << QUERY_BITS) - 1), 1e-300)
        level = np.rint((rotated - low[:, None]) / step[:, None]).astype(np.uint8)
        common = np.zeros((len(uq), len(self.bits)), np.int32)
        for plane in range(QUERY_BITS):
            asked = words((level >> plane) & 1)
            for w in range(asked.shape[1]):
                common += np.bitwise_count(self.bits[None, :, w] & asked[:, w, None]).astype(np.int32) << plane
        ones = np.bitwise_count(self.bits).sum(axis=1, dtype=np.int64)
        inner = 2 * (step[:, None] * common + low[:, None] * ones) - (step * level.sum(axis=1, dtype=np.int64) + self.dim * low)[:, None]
        cosine = np.maximum(self.cosine, 1e-9)
        guess = (uq @ centre)[:, None] + self.with_centre + inner / np.sqrt(self.dim) * (self.length / cosine)
        # of the codes, in a random direction, and of rounding the query
        spread = np.maximum(1 - cosine * cosine, 0) / max(self.dim - 1, 1)
        error = epsilon * self.length / cosine * np.sqrt(spread * (off * off).sum(axis=1)[:, None] + (step * step)[:, None] / 12) + 1e-9
        return guess, error


class Fit:
    """What the bounded sample tells: centres, lists to visit, seeds."""

    def __init__(self, ids: np.ndarray, v: np.ndarray, n: int, k: int, exact: bool = False):
        self.k, x, seeds = k, unit(v), min(SEEDS, n // 8)
        self.ids, self.v = ids[:seeds], v[:seeds]
        most = min(max(isqrt(n) // 8, FEWEST_CENTRES), MOST_CENTRES)
        c = x[: max(1, min(most, len(v) // 8))]
        for _ in range(8):
            near = closeness(x, c).argmax(axis=1)
            c = np.stack([x[near == i].mean(axis=0) if (near == i).any() else c[i] for i in range(len(c))])
        self.c, self.turn, self.visits = c, rotation(v.shape[1]), len(c)
        if not exact and len(self.ids) > k:
            self.visits = self.lists_to_visit(x)

    def lists_to_visit(self, x: np.ndarray) -> int:
        tried = x[:TRIALS]
        score = tried @ x.T
        score[np.arange(len(tried)), np.arange(len(tried))] = -np.inf
        best = np.argpartition(-score, self.k - 1, axis=1)[:, : self.k]
        place = np.argsort(np.argsort(-closeness(tried, self.c), axis=1), axis=1)
        at = np.sort(np.take_along_axis(place, closeness(x, self.c).argmax(axis=1)[best], axis=1), axis=None)
        return int(at[min(len(at) - 1, int(np.ceil(SHARE * len(at))))]) + 1

    def lists(self, uq: np.ndarray) -> np.ndarray:
        """The centres whose lists each query visits."""
        return np.argsort(-closeness(uq, self.c), axis=1, kind="stable")[:, : self.visits]

    def seeded(self, own: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of each query's k nearest seeds; none if there are fewer."""
        if len(self.ids) <= self.k:
            return np.zeros((len(q), 0), np.int64), np.zeros((len(q), 0))
        score = unit(q) @ unit(self.v).T
        score[own[:, None] == self.ids] = -np.inf
        best = np.argpartition(-score, self.k - 1, axis=1)[:, : self.k]
        exact = np.stack([cosines(self.v[at], one) for at, one in zip(best, q)])
        return self.ids[best], exact


def distinct_vectors(rows: DataFrame, k: int) -> DataFrame:
    """Of identical vectors the rows with the k + 1 smallest ids."""
    copies = Window.partitionBy("same", "v").orderBy("vec_id")
    return rows.withColumn("same", F.xxhash64("v")).withColumn("k", F.row_number().over(copies)).where(F.col("k") <= k + 1).drop("same", "k")


def fit(rows: DataFrame, k: int, sample: int = SAMPLE, exact: bool = False) -> Fit:
    """Fits to about ``sample`` rows, more where there are many centres, chosen by a hash of the id."""
    n = rows.count()
    sample = max(sample, 16 * min(isqrt(n) // 8, MOST_CENTRES))
    draw = F.shiftrightunsigned(F.xxhash64(F.lit(3), "vec_id"), 11) / float(1 << 53)
    held = rows.where(draw < min(1.0, sample / max(n, 1))).orderBy(F.xxhash64(F.lit(3), "vec_id"), "vec_id").limit(2 * sample).toArrow()
    if not held.num_rows:  # by chance
        held = rows.orderBy("vec_id").limit(sample).toArrow()
    return Fit(held.column("vec_id").to_numpy(), matrix(held.column("v").combine_chunks()), n, k, exact)


def build_index(rows: DataFrame, fitted: Fit) -> DataFrame:
    """vec_id, v, centre, bits, length of the residual, its inner product with the centre, cosine of
    residual and code."""
    shared = rows.sparkSession.sparkContext.broadcast(fitted)
    schema = T.StructType(list(rows.schema.fields)).add("centre", "integer").add("bits", "binary").add("length", "double").add("with_centre", "double").add("cosine", "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            x = unit(matrix(batch.column(1)))
            near = closeness(x, fitted.c).argmax(axis=1)
            for i in np.unique(near):
                at = np.flatnonzero(near == i)
                codes = Codes(x[at], fitted.c[i], fitted.turn)
                held = batch.take(pa.array(at))
                yield pa.RecordBatch.from_arrays(
                    [*held.columns, pa.array(np.full(len(at), i, np.int32)), pa.array([b.tobytes() for b in codes.bits], pa.binary()), pa.array(codes.length), pa.array(codes.with_centre), pa.array(codes.cosine)],
                    names=schema.names)

    return materialize(rows.mapInArrow(run, schema), "ann-index")


def visits(queries: DataFrame, fitted: Fit, first: np.ndarray) -> DataFrame:
    """A row for each query and block that it visits: block, vec_id, v, floor. ``first``: the blocks'
    numbers by centre, and their end."""
    shared = queries.sparkSession.sparkContext.broadcast((fitted, first))
    schema = T.StructType().add("block", "integer").add(queries.schema["vec_id"]).add(queries.schema["v"]).add("floor", "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted, first = shared.value
        for whole in batches:
            for lo in range(0, whole.num_rows, 256):
                batch = whole.slice(lo, 256)
                q = matrix(batch.column(1))
                lists, score = fitted.lists(unit(q)), fitted.seeded(batch.column(0).to_numpy(), q)[1]
                floors = score.min(axis=1) - 1e-12 if score.size else np.full(len(q), -np.inf)
                for j in range(lists.shape[1]):
                    at = lists[:, j]
                    many = first[at + 1] - first[at]
                    who = np.repeat(np.arange(len(q)), many)
                    nth = np.arange(len(who)) - np.repeat(np.cumsum(many) - many, many)
                    held = batch.take(pa.array(who))
                    yield pa.RecordBatch.from_arrays([pa.array((first[at][who] + nth).astype(np.int32)), *held.columns, pa.array(floors[who])], names=schema.names)

    return queries.mapInArrow(run, schema)


def seeds_found(queries: DataFrame, fitted: Fit) -> DataFrame:
    """query_id, vec_id, score of the seeds that are nearest to each query."""
    shared = queries.sparkSession.sparkContext.broadcast(fitted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column(0).to_numpy()
            if len(own):
                ids, score = shared.value.seeded(own, matrix(batch.column(1)))
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(own, ids.shape[1])), pa.array(ids.ravel()), pa.array(score.ravel())], names=["query_id", "vec_id", "score"])

    return queries.mapInArrow(run, "query_id long, vec_id long, score double")


def search(index: DataFrame, fitted: Fit, queries: DataFrame, k: int, exact: bool = False, epsilon: float = EPSILON, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k nearest of the index but itself. ``queries``:
    vec_id, v."""
    dim = fitted.c.shape[1]
    counts = {r["centre"]: r["count"] for r in index.groupBy("centre").count().collect()}  # one row a centre
    rows = max(1, block_bytes // (8 * dim))
    blocks = np.array([-(-counts.get(i, 0) // rows) for i in range(len(fitted.c))])
    first = np.concatenate([[0], np.cumsum(blocks)])
    table = F.array(*[F.lit(int(x)) for x in first])
    at = lambda i: F.element_at(table, i + 1)
    place = F.pmod(F.xxhash64(F.lit(7), "vec_id"), at(F.col("centre") + 1) - at(F.col("centre"))).cast("int")
    data = index.select((at(F.col("centre")) + place).alias("block"), F.lit(0).alias("asks"), "*")
    asked = visits(queries, fitted, first).withColumn("asks", F.lit(1))
    both = data.unionByName(asked, allowMissingColumns=True).select("block", "asks", "vec_id", "v", "bits", "length", "with_centre", "cosine", "centre", "floor")
    both = both.repartition(max(1, int(first[-1])), "block").sortWithinPartitions("block", "asks")
    shared = index.sparkSession.sparkContext.broadcast((fitted.c, fitted.turn))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, turn = shared.value
        held: list[pa.RecordBatch] = []  # rows of the block that is being read
        block, scan = None, None
        for batch in batches:
            number, asks = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            edges = np.flatnonzero((np.diff(number) != 0) | (np.diff(asks) != 0)) + 1
            for lo, hi in zip([0, *edges], [*edges, len(number)]):
                if hi <= lo:
                    continue
                if number[lo] != block:
                    block, held, scan = number[lo], [], None
                if not asks[lo]:
                    held.append(batch.slice(lo, hi - lo))
                    continue
                if scan is None:
                    scan = Scan(pa.Table.from_batches(held), c, turn, k, np.inf if exact else epsilon)
                    held = []
                yield scan.answer(batch.slice(lo, hi - lo))

    found = both.mapInArrow(run, "query_id long, vec_id long, score double").union(seeds_found(queries, fitted))
    found = found.repartition("query_id").groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("vec_id"))
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


class Scan:
    """A block's rows, past which queries stream."""

    def __init__(self, rows: pa.Table, c: np.ndarray, turn: np.ndarray, k: int, epsilon: float):
        column = lambda name: rows.column(name).combine_chunks()
        self.ids, self.v = column("vec_id").to_numpy(), matrix(column("v"))
        self.centre, self.turn, self.k, self.epsilon = c[column("centre")[0].as_py()], turn, k, epsilon
        bits = np.frombuffer(b"".join(column("bits").to_pylist()), np.uint64).reshape(len(self.ids), -1)
        self.codes = Codes.of(self.v.shape[1], bits, *(column(x).to_numpy() for x in ("length", "with_centre", "cosine")))

    def answer(self, asked: pa.RecordBatch) -> pa.RecordBatch:
        """query_id, vec_id, score: the k best of the block for each query, those below its floor left out."""
        all_own, all_q, all_floor = asked.column(2).to_numpy(), matrix(asked.column(3)), asked.column(9).to_numpy()
        out_q, out_v, out_s = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
        n, tile = len(self.ids), max(1, TILE // len(self.ids))
        for lo in range(0, len(all_own), tile):
            own, q, floor = (x[lo : lo + tile] for x in (all_own, all_q, all_floor))
            other = self.ids != own[:, None]
            if np.isfinite(self.epsilon):
                guess, error = self.codes.estimate(unit(q), self.centre, self.turn, self.epsilon)
                if n > self.k:
                    low = np.where(other, guess - error, -np.inf)
                    known = np.maximum(floor, np.partition(low, n - self.k, axis=1)[:, n - self.k])
                else:
                    known = floor
                other &= guess + error >= known[:, None]
            for j in range(len(own)):
                some = np.flatnonzero(other[j])
                score = cosines(self.v[some], q[j])
                some, score = some[score >= floor[j]], score[score >= floor[j]]
                best = np.lexsort((self.ids[some], -score))[: self.k]
                out_q.append(np.full(len(best), own[j]))
                out_v.append(self.ids[some][best])
                out_s.append(score[best])
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (out_q, out_v, out_s)], names=["query_id", "vec_id", "score"])


def nearest(rows: DataFrame, is_query, k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding", exact: bool = False, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Each query row's k nearest rows; ``is_query`` is a condition on vec_id."""
    good = materialize(usable(rows, id_col, vec_col).groupBy("vec_id").agg(F.min("v").alias("v")), "ann-rows")
    dims = good.groupBy(F.size("v").alias("dim")).count().orderBy(F.desc("count"), F.desc("dim")).first()
    if dims is None:
        return rows.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    good_rows = good.where(F.size("v") == dims["dim"])
    distinct = materialize(distinct_vectors(good_rows, k), "ann-distinct")
    fitted = fit(distinct, k, exact=exact)
    index = build_index(distinct, fitted)
    discard(distinct)
    return search(index, fitted, good_rows.where(is_query), k, exact, block_bytes=block_bytes)


def op8_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 50 == 0)


QUERIES = {"op8_nearest": op8_nearest}
ORACLES: dict[str, str] = {}
