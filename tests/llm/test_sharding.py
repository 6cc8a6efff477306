from __future__ import annotations

import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from lumenframe.llm import sharding


def check(rows, texts, shards, slack):
    by = defaultdict(list)
    assert len(rows) == len(texts)
    for r in rows:
        by[r.shard].append(r)
    assert set(by) <= set(range(shards))
    for held in by.values():
        assert sorted(r.slot for r in held) == list(range(len(held)))
    total = sum(r.size for r in rows)
    for k in range(shards):
        assert abs(sum(r.size for r in by[k]) - total / shards) <= slack
    return by


def test_sizes_and_checksums(docs):
    texts = {1: None, 2: "", 3: "é🙂", 4: "x" * 50_000}
    got = {r.doc_id: r for r in sharding.shard_rows(docs(list(texts.items())), 3).collect()}
    for k, t in texts.items():
        raw = (t or "").encode()
        assert (got[k].size, got[k].text_crc32) == (len(raw) + 8, zlib.crc32(raw))


@pytest.mark.parametrize("hot", [0, 1, 2])
def test_bytes_are_near_equal(docs, hot):
    """hot: a third of all rows are equal texts, or one text a row."""
    rng = random.Random(7)
    texts = {i: "same text" if hot and i % 3 == 0 else f"{i} " + "w " * rng.randint(0, 60) for i in range(3000)}
    rows = sharding.shard_rows(docs(list(texts.items())), 24, range_rows=40 if hot == 2 else 4096).collect()
    check(rows, texts, 24, 300)
    where = defaultdict(set)
    for r in rows:
        where[texts[r.doc_id]].add(r.shard)
    split = [t for t, s in where.items() if len(s) > 1]
    assert split == (["same text"] if hot else [])


def brute(keys, shards, tolerance):
    """Per shard number the least and greatest bytes that may lie below its end: within tolerance of its
    even part, or as near to it as a whole key allows."""
    total, sums = sum(s for *_, s in keys), [0]
    for i, (h, d, s) in enumerate(keys):
        if i and (h, d) == keys[i - 1][:2]:
            sums[-1] += s
        else:
            sums.append(sums[-1] + s)
    out = []
    for k in range(1, shards):
        want = total * k / shards
        off = max(tolerance * total / shards, min(abs(x - want) for x in sums))
        out.append((want - off, want + off))
    return out


@pytest.mark.parametrize("hot, shards, range_rows", [(False, 24, 65536), (True, 24, 50), (True, 7, 3)])
def test_splitters_and_slots_match_brute_force(docs, hot, shards, range_rows):
    """A sort of all keys in plain Python: splitters are as good as whole keys allow, and shards and
    slots follow the order."""
    rng = random.Random(5)
    df = docs([(i, "same text" if hot and i % 2 else f"{i} " + "w " * rng.randint(0, 90)) for i in range(2500)] + [(3, "twice")] * 2)
    keys = sharding.slim(df).collect()
    ordered = sorted((r.h, r.d, r.size) for r in keys)
    place = {r.doc_id: (r.h, r.d) for r in keys if r.doc_id != 3}
    rows = sharding.shard_rows(df, shards, range_rows=range_rows).collect()
    below = 0
    for k, (low, high) in enumerate(brute(ordered, shards, sharding.TOLERANCE)):
        below += sum(r.size for r in rows if r.shard == k)
        assert low - 1e-6 <= below <= high + 1e-6
    in_order = [place[r.doc_id] for r in sorted(rows, key=lambda r: (r.shard, r.slot)) if r.doc_id != 3]
    assert in_order == sorted(in_order)


def test_ranges_hold_counted_rows(docs):
    """Half of the rows are equal texts: the ranges still hold about as many rows each."""
    df = docs([(i, "same text" if i % 2 else f"text {i}") for i in range(20_000)])
    keys = sharding.slim(df).cache()
    probes, owners, _, rows = sharding.plan_shards(keys, 4, range_rows=200)
    assert len(probes) + 1 == len(owners) == len(rows) and 80 <= len(rows) <= 104 and rows.sum() == 20_000
    assert max(rows) <= 2 * sorted(rows)[len(rows) // 2]
    keys.unpersist()


def test_thousands_of_ranges(docs, spark, tmp_path):
    df = docs([(i, "same text" if i % 3 == 0 else f"text {i}") for i in range(5100)])
    rows = sharding.shard_rows(df, 24, range_rows=1).collect()
    check(rows, {r.doc_id: None for r in rows}, 24, 60)
    sharding.write_shards(df, str(tmp_path / "out"), 24, range_rows=1)
    assert {r.doc_id: r.shard for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {r.doc_id: r.shard for r in rows}


def test_few_groups_are_cut_only_by_splitters(docs):
    texts = {i: f"text {i % 150}" for i in range(3000)}
    rows = sharding.shard_rows(docs(list(texts.items())), 5).collect()
    check(rows, texts, 5, 40)


def test_edge_tables(docs):
    df = docs([(5, "a"), (5, "a"), (None, None), (None, "b")]).withColumn("shard", F.lit("clash")).withColumn("h", F.lit(0))
    rows = sharding.shard_rows(df, 4).collect()
    assert len(rows) == 4 and len({r.shard for r in rows if r.doc_id == 5}) == 1
    by = defaultdict(list)
    for r in rows:
        by[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in by.values())
    assert sharding.shard_rows(df.limit(0), 4).count() == 0
    assert sharding.shard_rows(df.limit(1), 4).count() == 1


def test_files_hold_whole_rows(docs, spark, tmp_path):
    df = docs([(i, f"text {i}") for i in range(200)])
    sharding.write_shards(df, str(tmp_path / "out"), 4)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(map(tuple, back.drop("shard").collect())) == sorted(map(tuple, df.collect()))
    want = {r.doc_id: r.shard for r in sharding.shard_rows(df, 4).collect()}
    assert {r.doc_id: r.shard for r in back.collect()} == want
    clash = df.withColumn("Shard", F.lit("mine")).withColumn("at", F.lit(1)).withColumn("row", F.lit(2))
    assert sharding.write_shards(clash, str(tmp_path / "clash"), 4) == "shard_"
    back = spark.read.parquet(str(tmp_path / "clash"))
    assert {(r.doc_id, r.shard_, r.Shard, r.at, r.row) for r in back.collect()} == {(k, v, "mine", 1, 2) for k, v in want.items()}
    assert sharding.write_shards(df.limit(0), str(tmp_path / "none"), 4) == "shard"


def test_reruns_agree(docs):
    df = docs([(i, f"t {i % 40}") for i in range(400)])
    a, b = sharding.shard_rows(df, 6), sharding.shard_rows(df.repartition(5), 6)
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))


def test_query(spark, sf_dir):
    rows = sharding.op6_sharding(spark, sf_dir).collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    keys = sorted((r.h, r.d, r.size) for r in sharding.slim(spark.read.parquet(f"{sf_dir}/documents.parquet")).collect())
    by, below = check(rows, texts, 24, max(r.size for r in rows)), 0
    for k, (low, high) in enumerate(brute(keys, 24, sharding.TOLERANCE)):
        below += sum(r.size for r in by[k])
        assert low - 1e-6 <= below <= high + 1e-6
    assert {r.law for r in rows} == {"bytes"} and {r.grown_shard for r in rows} == {None}
