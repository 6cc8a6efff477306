"""Operators on small hand-made inputs."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from lumenframe.operators import joins as J
from lumenframe.operators.aggregates import first_by, salted_sum
from lumenframe.sources.formats import read
from lumenframe.streaming.operators import windowed_counts
from lumenframe.streaming.runner import open_stream, run_to_end


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


@pytest.mark.parametrize("right, want", [([], [1, 2, None]), ([1], [2]), ([1, None], []), ([3], [1, 2])])
def test_not_in(spark, right, want):
    a = frame(spark, [(1,), (2,), (None,)], "k int")
    b = frame(spark, [(x,) for x in right], "v int")
    got = [r.k for r in J.not_in(a, "k", b, "v").collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    a.createOrReplaceTempView("left_t")
    b.createOrReplaceTempView("right_t")
    sql = [r.k for r in spark.sql("SELECT k FROM left_t WHERE k NOT IN (SELECT v FROM right_t)").collect()]
    assert sorted(got, key=str) == sorted(sql, key=str)


def test_null_safe_join_matches_nulls(spark):
    a, b = frame(spark, [(1,), (None,)], "a int"), frame(spark, [(None,), (2,)], "b int")
    assert [tuple(r) for r in J.null_safe(a, b, [("a", "b")]).collect()] == [(None, None)]


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_salted_join_equals_plain(spark, how):
    a = frame(spark, [(i % 3, i) for i in range(40)] + [(9, 99), (None, 1)], "k int, v int")
    b = frame(spark, [(0, "x"), (0, "y"), (1, "z")], "k int, w string")
    got = sorted(map(str, J.salted(a, b, ["k"], 4, how).collect()))
    assert got == sorted(map(str, a.join(b, ["k"], how).select(*J.salted(a, b, ["k"], 4, how).columns).collect()))


def test_salted_join_refuses_full(spark):
    a = frame(spark, [(1,)], "k int")
    with pytest.raises(ValueError):
        J.salted(a, a, ["k"], how="full")


def test_mark_join(spark):
    a, b = frame(spark, [(1,), (2,), (None,)], "k int"), frame(spark, [(1,), (1,)], "k int")
    assert {r.k: r.present for r in J.with_mark(a, b, ["k"]).collect()} == {1: True, 2: False, None: False}


def test_interval_join_includes_both_ends(spark):
    p = frame(spark, [(1, 0), (1, 10), (1, 25), (2, 5)], "k int, at long")
    s = frame(spark, [(1, 0, 10), (1, 20, 24)], "k int, low long, high long")
    got = J.interval_join(p, s, F.col("at"), F.col("low"), F.col("high"), ["k"], 7)
    assert sorted((r.at, r.low) for r in got.collect()) == [(0, 0), (10, 0)]


def test_aggregates_on_nulls(spark):
    df = frame(spark, [("a", 2, None), ("a", 1, 5), ("b", None, None)], "k string, o int, v int")
    got = {r.k: r.f for r in df.groupBy("k").agg(first_by("v", "o").alias("f")).collect()}
    assert got == {"a": 5, "b": None}
    assert {r.k: r.o for r in salted_sum(df, ["k"], ["o"], 3).collect()} == {"a": 3, "b": None}


def test_unknown_format(spark):
    with pytest.raises(ValueError):
        read(spark, "x", "tape")


def test_late_rows_are_dropped(spark, tmp_path):
    """The watermark moves between batches; a row older than it no longer counts."""
    schema = "event_id long, ts timestamp, event_type string, value double"
    import datetime as dt

    at = lambda h: dt.datetime(2024, 1, 1 + h // 24, h % 24)
    for i, rows in enumerate([[(1, at(1), "a", 1.0)], [(2, at(60), "a", 1.0)], [(6, at(61), "a", 1.0)], [(3, at(2), "a", 1.0), (4, at(70), "a", 1.0)], [(5, at(200), "a", 1.0)]]):
        frame(spark, rows, schema).coalesce(1).write.parquet(str(tmp_path / f"in/batch={i}"))
    stream = open_stream(spark, str(tmp_path / "in"), max_files=1)
    got = run_to_end(windowed_counts(stream, "1 hour", late="5 hours"))
    assert sorted((r.start.hour, r.n) for r in got.collect()) == [(1, 1), (12, 1), (13, 1), (22, 1)]


def test_packing_reads_many_files_in_few_splits(spark, tmp_path):
    spark.range(1000).repartition(24).write.parquet(str(tmp_path / "x"))
    assert read(spark, str(tmp_path / "x")).rdd.getNumPartitions() < 12


def test_stream_goes_on_from_its_checkpoint(spark, tmp_path):
    """A second run reads only what is new and keeps the first run's state."""
    schema, place = "user_id long, value double", str(tmp_path / "state")

    def run(i, rows):
        frame(spark, rows, schema).coalesce(1).write.parquet(str(tmp_path / f"in/batch={i}"))
        counted = spark.readStream.schema(schema).parquet(str(tmp_path / "in")).groupBy("user_id").count()
        seen = []
        running = counted.writeStream.outputMode("update").option("checkpointLocation", place).trigger(availableNow=True).foreachBatch(lambda df, n: seen.extend(tuple(r) for r in df.collect()))
        running.start().awaitTermination()
        return sorted(seen)

    assert run(1, [(1, 0.0), (1, 0.0), (2, 0.0)]) == [(1, 2), (2, 1)]
    assert run(2, [(2, 0.0)]) == [(2, 2)]


def test_memory_and_rate_streams(spark):
    running = spark.readStream.format("rate").option("rowsPerSecond", 50).load().selectExpr("value % 3 AS k").writeStream.format("memory").queryName("rated").start()
    import time

    for _ in range(40):
        if spark.table("rated").count():
            break
        time.sleep(0.5)
    running.stop()
    assert {r.k for r in spark.table("rated").distinct().collect()} <= {0, 1, 2}


@pytest.mark.parametrize("text", ["SELECT a.k FROM (SELECT 1 AS k) a WHERE k = (SELECT k FROM (VALUES (1), (2)) t(k))", "SELECT nothing FROM (SELECT 1 AS k) a", "SELECT k, sum(v) FROM (SELECT 1 AS k, 2 AS v) a", "SELECT count(sum(v)) FROM (SELECT 2 AS v) a"])
def test_invalid_sql_is_refused(spark, text):
    with pytest.raises(Exception):  # noqa: B017
        spark.sql(text).collect()
