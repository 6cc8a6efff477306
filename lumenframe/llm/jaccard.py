"""N-gram Jaccard join: groups of documents whose shingle sets overlap.

1. Documents with equal shingle sets are one class; only the row with its smallest id goes on.
2. Shingles are ordered rare first: by their count over all documents in a table of hashed counters,
   then by hash. The table has 2**20 to 2**22 counters, by the size of the corpus, so it can be
   broadcast; in a large corpus counts below a counter's share of all shingles look alike, but those of
   frequent shingles stand out. Sets that overlap enough share a shingle among the first ones of that
   order, the prefix, whose length the threshold gives.
3. Prefix shingles that two or more classes have are joined, under the length, positional and suffix
   filters: no shingle before a pair's first common one is in both sets, and the suffixes after it,
   split at seven fixed pivots into eight parts, differ by at least the differences of their parts.
4. Joining all pairs of a shingle would grow with the square of a group of near copies. So each
   class is first compared with one pivot of each of its prefix shingles, which is linear, and
   the links found are closed to components. The pivot is the class with fewest rarer shingles,
   so the one nearest to what a group of near copies was made from. Then all pairs of a shingle that lie in different
   components are compared, which needs one of them to be outside the pivot's component; pairs
   inside one component cannot change it. No link between components is lost. A shingle that many
   classes have is split there: by bands of set sizes, of which only neighbours can be similar, and
   over as many tasks as its classes need.
5. A pair is verified once, on the sets built from the whole texts.

Words and shingles are compared by 64-bit hashes.

Defined cases: a null text, or one without words, has no shingles and is linked with nothing; with
fewer words than a shingle takes, the whole sequence is the one shingle; rows with equal ids are one
document, linked with all that any of their texts is linked with; a row with a null id belongs to the
group of the documents with its very set, if there are any, links nothing itself, and is never
dropped; very long texts are compared whole; empty tables give empty results. Extra columns are
ignored by ``jaccard_groups`` and kept by ``drop_near_copies``.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenframe.llm.arrowtext import bounded_batches, pieces
from lumenframe.llm.bloom import only, without
from lumenframe.llm.components import connected_components
from lumenframe.llm.scratch import discard, materialize
from lumenframe.llm.wordhash import shingle_sets
from lumenframe.operators.joins import estimated_bytes

#: Counters of the shingle order, of four bytes, are a power of two between these, about one for each
#: MB of documents.
FEWEST_BITS, MOST_BITS = 20, 22
CHUNK = 4096
#: Classes of a shingle from which on it is split by set sizes, and over further tasks.
BANDED, SALTED = 256, 4096


def needed(a: Column, b: Column, percent: int) -> Column:
    """Least overlap of sets of sizes a and b that reaches the similarity."""
    return F.ceil((a + b) * percent / (100.0 + percent) - 1e-9)


def counter_bits(docs: DataFrame) -> int:
    return min(MOST_BITS, max(FEWEST_BITS, (estimated_bytes(docs) >> 20).bit_length()))


def measure(docs: DataFrame, width: int, bits: int) -> DataFrame:
    """One row per document (doc_id, h of its text, n, print of its set), and one per task and chunk of
    counters (chunk, its counts in numbers of n bytes): the counts of the task's hashed shingles."""
    names = ["doc_id", "h", "n", "print", "chunk"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counters = np.zeros(1 << bits, np.int64)
        for batch in batches:
            for lo, hi, data, offsets in pieces(batch, 2):
                sets = shingle_sets(data, offsets, width)
                np.add.at(counters, (np.concatenate(sets) >> np.uint64(64 - bits)).astype(np.int64), 1)
                prints = [hashlib.md5(s.tobytes()).digest() if len(s) else None for s in sets]
                keys = [batch.column(k).slice(lo, hi - lo) for k in (0, 1)]
                yield pa.RecordBatch.from_arrays([*keys, pa.array([len(s) for s in sets], pa.int64()), pa.array(prints, pa.binary()), pa.nulls(hi - lo, pa.int32())], names=names)
        full = [k for k in range(len(counters) // CHUNK) if counters[k * CHUNK : (k + 1) * CHUNK].any()]
        parts = [counters[k * CHUNK : (k + 1) * CHUNK] for k in full]
        parts = [p.astype(np.min_scalar_type(p.max())) for p in parts]
        none = pa.nulls(len(full), pa.int64())
        yield pa.RecordBatch.from_arrays([none, none, pa.array([p.itemsize for p in parts], pa.int64()), pa.array([p.tobytes() for p in parts], pa.binary()), pa.array(full, pa.int32())], names=names)

    return docs.mapInArrow(run, "doc_id long, h long, n long, print binary, chunk int")


def add_counters(measured: DataFrame, bits: int) -> np.ndarray:
    """The counters of all tasks summed, as 32-bit numbers. A chunk's sum needs a chunk of memory."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for chunk, size, counts in zip(*(batch.column(k).to_pylist() for k in range(3))):
                sums[chunk] = sums.get(chunk, 0) + np.frombuffer(counts, f"u{size}").astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([np.minimum(s, 2**32 - 1).astype(np.uint32).tobytes() for s in sums.values()], pa.binary())], names=["chunk", "counts"])

    out = np.zeros(1 << bits, np.uint32)
    rows = measured.where("chunk is not null").select("chunk", "n", "print").repartition("chunk")  # 256 chunks or more
    for r in rows.mapInArrow(run, "chunk int, counts binary").toLocalIterator():  # 16 MB at most
        out[r["chunk"] * CHUNK : (r["chunk"] + 1) * CHUNK] = np.frombuffer(r["counts"], np.uint32)
    return out


def suffix_parts(s: np.ndarray, p: int) -> np.ndarray:
    """For each of the first p places of an ordered set, how many of the shingles after it lie in each
    of eight ranges of hashes, up to 255 each, in one 64-bit number."""
    part = ((s >> np.uint64(37)) & np.uint64(7)).astype(np.int64)
    upto = np.cumsum(part[:p, None] == np.arange(8), axis=0)
    after = np.minimum(np.bincount(part, minlength=8) - upto, 255)
    return np.ascontiguousarray(after.astype(np.uint8)).view(np.int64)[:, 0]


def prefixes(docs: DataFrame, counters: np.ndarray, width: int, percent: int) -> DataFrame:
    """gram, doc_id, n, pos, parts (of the suffix): a row for each prefix shingle."""
    shared = docs.sparkSession.sparkContext.broadcast(counters)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counters = shared.value
        bits = len(counters).bit_length() - 1
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for lo, hi, data, offsets in pieces(batch, 1):
                gram, who, size, pos, parts = [], [], [], [], []
                for doc, s in zip(ids[lo:hi], shingle_sets(data, offsets, width)):
                    n = len(s)
                    if not n:
                        continue
                    p = n - -(-n * percent // 100) + 1
                    s = s[np.lexsort((s, counters[(s >> np.uint64(64 - bits)).astype(np.int64)]))]
                    gram.append(s[:p])
                    who.append(np.full(p, doc, np.int64))
                    size.append(np.full(p, n, np.int32))
                    pos.append(np.arange(p, dtype=np.int32))
                    parts.append(suffix_parts(s, p))
                if gram:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(gram).view(np.int64)), *(pa.array(np.concatenate(x)) for x in (who, size, pos, parts))], names=["gram", "doc_id", "n", "pos", "parts"])

    return docs.mapInArrow(run, "gram long, doc_id long, n int, pos int, parts long")


def may_link(a: str, b: str, percent: int) -> Column:
    """Whether rows a and b of one prefix shingle can be a pair's first common one."""
    na, nb, pa_, pb = (F.col(f"{t}.{c}") for c in ("n", "pos") for t in (a, b))
    overlap = needed(na, nb, percent)
    apart = F.lit(0)
    for k in range(8):
        byte = lambda t: F.shiftrightunsigned(F.col(f"{t}.parts"), 8 * k).bitwiseAND(F.lit(255))  # noqa: B023, E731
        apart = apart + F.abs(byte(a) - byte(b))
    return (
        (na * 100 >= nb * percent) & (nb * 100 >= na * percent)
        & (F.least(na - pa_, nb - pb) >= overlap)
        & (apart <= na + nb - 2 * overlap - pa_ - pb)
    )


def verify(pairs: DataFrame, docs: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs (x, y) any of whose sets are similar enough. ``docs``: doc_id, h, text."""
    ids = materialize(pairs.select(F.col("x").alias("doc_id")).union(pairs.select("y")).distinct(), "jaccard-ids")
    texts = only(docs, "doc_id", ids).repartition("doc_id").dropDuplicates(["doc_id", "h"])
    both = pairs.join(texts.select(F.col("doc_id").alias("x"), F.col("text").alias("tx")), "x")
    both = both.join(texts.select(F.col("doc_id").alias("y"), F.col("text").alias("ty")), "y").select("x", "y", "tx", "ty")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left = (s for piece in pieces(batch, 2) for s in shingle_sets(piece[2], piece[3], width))
            right = (s for piece in pieces(batch, 3) for s in shingle_sets(piece[2], piece[3], width))
            good = []
            for a, b in zip(left, right):
                common = len(a) + len(b) - len(np.union1d(a, b))
                good.append(len(a) > 0 and 100 * common >= percent * (len(a) + len(b) - common))
            keep = pa.array(good, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], names=["x", "y"])

    links = materialize(both.mapInArrow(run, "x long, y long"), "jaccard-links")
    discard(ids)
    return links


def dealt(rows: DataFrame, percent: int, everywhere: bool) -> DataFrame:
    """Adds band and salt to rows of prefix shingles (with c, the shingle's classes): a shingle's rows
    of similar sizes meet if one side lies at its own place and the other ``everywhere`` it may be."""
    step = max(math.log(100 / percent), 0.01) * (1 + 1e-6)  # sizes of similar sets are at most one band apart
    band = F.when(F.col("c") > BANDED, F.floor(F.log("n") / step)).otherwise(0)
    salts = F.ceil(F.col("c") / SALTED)
    if not everywhere:
        return rows.withColumn("band", band).withColumn("salt", F.pmod(F.xxhash64("doc_id"), salts))
    near = F.when(F.col("c") > BANDED, F.array(band - 1, band, band + 1)).otherwise(F.array(band))
    return rows.withColumn("band", F.explode(near)).withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), salts - 1)))


def jaccard_groups(docs: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, class_id (the smallest id of the same set)."""
    bounded_batches(docs.sparkSession)
    bits = counter_bits(docs)
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.col(text_col)).alias("h"), F.col(text_col).alias("text"))
    measured = materialize(measure(docs, width, bits), "jaccard-sets")
    counters = add_counters(measured, bits)
    rows = measured.where("chunk is null").select("doc_id", "h", "n", "print")
    classes = rows.where("n > 0").groupBy("n", "print").agg(F.min("doc_id").alias("class_id"), F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "h"))).alias("first"))
    classes = materialize(classes.select("n", "print", "class_id", F.col("first.h").alias("class_h")), "jaccard-classes")
    member = rows.join(classes, ["n", "print"], "left").select("doc_id", "h", "n", F.coalesce("class_id", "doc_id").alias("class_id"), "class_h")
    member = materialize(member, "jaccard-members")
    discard(measured)
    # all rows but each class's first go; they are told by id and text
    key = F.struct("doc_id", "h").alias("row")
    copies = member.where("class_id is not null and (class_id <> doc_id or class_h <> h)").select(key).distinct()
    copies = materialize(copies, "jaccard-copies")
    known = docs.where("doc_id is not null").select("doc_id", "text", key)
    singles = without(known, "row", copies).select("doc_id", "text")
    index = materialize(prefixes(singles, counters, width, percent), "jaccard-prefixes")
    shared = index.groupBy("gram").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("gram")
    held = materialize(index.join(shared, "gram", "left_semi"), "jaccard-shared")
    for done in (index, copies, classes):
        discard(done)
    pivots = held.groupBy("gram").agg(F.min_by(F.struct("doc_id", "n", "pos", "parts"), F.struct("pos", F.xxhash64("doc_id"), "doc_id")).alias("p"), F.count(F.lit(1)).alias("c")).where("c > 1")
    pivots = materialize(pivots.select("gram", "c", "p.*"), "jaccard-pivots")
    pair = lambda a, b: (F.least(F.col(f"{a}.doc_id"), F.col(f"{b}.doc_id")).alias("x"), F.greatest(F.col(f"{a}.doc_id"), F.col(f"{b}.doc_id")).alias("y"))
    star = held.alias("a").join(pivots.alias("b"), (F.col("a.gram") == F.col("b.gram")) & (F.col("a.doc_id") != F.col("b.doc_id")) & may_link("a", "b", percent))
    tried = materialize(star.select(*pair("a", "b")).distinct(), "jaccard-tried")
    # an id with several sets links the classes of them
    several = member.where("doc_id is not null").groupBy("doc_id").agg(F.min("class_id").alias("a"), F.max("class_id").alias("b")).where("a <> b").select("doc_id")
    same = member.join(several, "doc_id", "left_semi").where("class_id <> doc_id").select(F.col("doc_id").alias("x"), F.col("class_id").alias("y"))
    found = verify(tried, docs, width, percent)
    links = materialize(found.union(same).distinct(), "jaccard-links")
    parts = connected_components(links)
    # every row with its component, and its pivot's
    named = held.join(parts.withColumnRenamed("node", "doc_id"), "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id"))
    top = pivots.select("gram", "c", "doc_id").join(parts.withColumnRenamed("node", "doc_id"), "doc_id", "left").select("gram", "c", F.coalesce("component", "doc_id").alias("top"))
    named = materialize(named.join(top, "gram"), "jaccard-named")
    outside = dealt(named.where("component <> top"), percent, everywhere=False)
    rest = outside.alias("a").join(
        dealt(named, percent, everywhere=True).alias("b"),
        (F.col("a.gram") == F.col("b.gram")) & (F.col("a.band") == F.col("b.band")) & (F.col("a.salt") == F.col("b.salt")) & (F.col("a.component") != F.col("b.component"))
        & ((F.col("b.component") == F.col("b.top")) | (F.col("a.doc_id") < F.col("b.doc_id"))) & may_link("a", "b", percent),
    )
    rest = rest.select(*pair("a", "b")).distinct().join(tried, ["x", "y"], "left_anti")
    rest = materialize(rest, "jaccard-rest")
    more = verify(rest, docs, width, percent)
    if more.limit(1).count():
        discard(parts)
        parts = connected_components(links.union(more))
    for done in (found, held, pivots, tried, links, named, rest, more):
        discard(done)
    parts = parts.select(F.col("node").alias("class_id"), F.col("component").alias("component_id"))
    out = member.join(parts, "class_id", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "class_id").alias("component_id"), "class_id")


def drop_near_copies(docs: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` but those whose group has a smaller id; of rows that share an id and
    text, all stay or go together."""
    groups = jaccard_groups(docs, width, percent, id_col, text_col)
    gone = materialize(groups.where("component_id <> doc_id").select("doc_id").distinct(), "jaccard-gone")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    return without(rows, "doc_id", gone).select("row.*")


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return jaccard_groups(docs, width=3, percent=90).select("doc_id", "n_shingles", "component_id")


QUERIES = {"op3_jaccard_join": op3_jaccard_join}
ORACLES = {
    "op3_jaccard_join": r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT doc_id, CASE WHEN len(ws) = 0 THEN []::VARCHAR[] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')]
             ELSE list_distinct(list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2])) END AS sh FROM w),
e AS (SELECT doc_id, len(sh) AS n, unnest(sh) AS g FROM s),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, a.n AS nx, b.n AS ny, count(*) AS c FROM e a JOIN e b ON a.g = b.g AND a.doc_id < b.doc_id
      WHERE a.n * 100 >= b.n * 90 AND b.n * 100 >= a.n * 90 GROUP BY a.doc_id, b.doc_id, a.n, b.n),
l AS (SELECT x, y FROM p WHERE 100 * c >= 90 * (nx + ny - c)),
lk AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r(node, top) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.node, lk.y FROM r JOIN lk ON r.top = lk.x),
t AS (SELECT node, min(top) AS top FROM r GROUP BY node)
SELECT doc_id, len(sh)::BIGINT AS n_shingles, t.top AS component_id FROM s JOIN t ON s.doc_id = t.node
"""
}
