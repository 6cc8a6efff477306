"""Queries on rows and plans that tell whether they still hold on larger tables."""

from __future__ import annotations

import zlib

import pyarrow as pa
from compare import connect, duck_rows, spark_rows
from test_plans import plan
from test_whole_tables import both

from lumenframe.operators.joins import broadcast_if_small
from lumenframe.plans import io_queries
from lumenframe.plans.catalogue import ORACLES, QUERIES
from lumenframe.sources.io import table


def test_sketches_are_not_kept_by_distinct_value(spark, tmp_path):
    keys = [7, 8, 8, None, 7, 7]
    columns = {"l_returnflag": ["A", "A", "A", "A", None, None], "l_partkey": keys, "l_quantity": [1.0, 2.0, 3.0, 3.0, 5.0, 5.0]}
    rows = both(spark, tmp_path, "agg_approx", "lineitem", columns)
    assert {(r.l_returnflag, r.parts) for r in rows} == {("A", 2), (None, 1)}
    sketched = [line for line in plan(QUERIES["agg_approx"](spark, str(tmp_path))).splitlines() if "percentile_approx" in line]
    assert sketched and not any("l_partkey" in line[line.index("keys=") : line.index("functions=")] for line in sketched)


def test_sides_too_large_for_a_driver_are_not_marked(spark, tmp_path):
    """Three narrow columns of a file over the limit; in memory they would take a driver's whole heap."""
    side = spark.range(2_000_000).selectExpr("id AS o_orderkey", "xxhash64(id) AS o_custkey", "rand(1) AS o_totalprice")
    side.coalesce(2).write.parquet(f"{tmp_path}/orders.parquet")
    read = spark.read.parquet(f"{tmp_path}/orders.parquet")
    assert broadcast_if_small(read) is read
    spark.range(9).selectExpr("id AS c_custkey", "CAST(id AS STRING) AS c_name", "1D AS c_acctbal").write.parquet(f"{tmp_path}/customer.parquet")
    assert "BroadcastHashJoin" not in plan(QUERIES["join_bhj_left"](spark, str(tmp_path)))


def test_pairs_of_one_large_group(spark, tmp_path):
    """More keys than a block holds, in one group; equal keys, nulls and a lone row make no pair."""
    keys = [*range(600), 5, 5, None, 7000]
    columns = {"c_custkey": keys, "c_nationkey": [1] * 601 + [None, 1, 2], "c_mktsegment": ["M"] * 604}
    rows = both(spark, tmp_path, "join_self", "customer", columns)
    assert len(rows) == 600 * 599 // 2 + 599


def test_pairs_are_dealt_by_blocks(spark, sf_dir):
    made = plan(QUERIES["join_self"](spark, sf_dir))
    last = next(line for line in made.splitlines() if "Exchange" in line)
    assert "_block" in last and "_other" in last


def test_first_of_equal_balances(spark, tmp_path):
    columns = {"c_custkey": [3, 4, 5, 6, 7, 8, 9], "c_name": ["b", "a", "c", None, "d", "e", None], "c_nationkey": [1, 1, 1, 1, 1, 1, 2], "c_acctbal": [9.0, 9.0, 9.0, 10.0, None, 9.0, 1.0]}
    rows = both(spark, tmp_path, "agg_max_by", "customer", columns)
    assert {tuple(r) for r in rows} == {(1, "b", "b"), (2, None, None)}
    spark.read.parquet(f"{tmp_path}/customer.parquet").orderBy("c_name").coalesce(1).write.parquet(f"{tmp_path}/again/customer.parquet")
    assert {tuple(r) for r in QUERIES["agg_max_by"](spark, f"{tmp_path}/again").collect()} == {(1, "b", "b"), (2, None, None)}


def test_names_of_one_digest_are_all_counted(spark, tmp_path):
    """Two names of one CRC-32, a repeated name, a null."""
    names = ["plumless", "buckeroo", "x", "x", None]
    columns = {"c_name": pa.array(names), "c_nationkey": pa.array([1, 1, 2, 2, 3], pa.int32())}
    assert zlib.crc32(b"plumless") == zlib.crc32(b"buckeroo")
    assert [tuple(r) for r in both(spark, tmp_path, "digest_hash", "customer", columns)] == [(5, 5, 5, 5)]


def test_buckets_grow_in_number(spark, sf_dir, monkeypatch):
    rows = table(spark, sf_dir, "lineitem").count()
    monkeypatch.setattr(io_queries, "BUCKET_ROWS", -(-rows // 12))
    n = io_queries.buckets(rows)
    assert n > 4
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = QUERIES["io_bucketed_join"](spark, sf_dir)
        made = plan(df)
        assert made.count(f"SelectedBucketsCount: {n} out of {n}") == 2 and "Exchange" not in made
        assert spark_rows(df) == duck_rows(connect(sf_dir), ORACLES["io_bucketed_join"])
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    monkeypatch.undo()
    assert [io_queries.buckets(n) for n in (0, 4_000_001, 10**12)] == [4, 5, 100_000]
