"""Event-time windows, watermark policies, outer joins, and sources and sinks of streams."""

from __future__ import annotations

import datetime as dt
import socket
import threading

import pytest
from pyspark.sql import functions as F

from lumenframe.sources.formats import read, write
from lumenframe.streaming.operators import followed_by, idle_users, windowed_counts
from lumenframe.streaming.runner import open_stream, run_to_end

SCHEMA = "event_id long, user_id long, ts timestamp, event_type string, value double"


def at(hour, minute=0):
    return dt.datetime(2024, 1, 1) + dt.timedelta(hours=hour, minutes=minute)


def batches(spark, place, *parts):
    """A stream that takes one part a batch. Each is (id, user, time)."""
    for i, rows in enumerate(parts):
        spark.createDataFrame([(e, u, t, "a", 1.0) for e, u, t in rows], SCHEMA).coalesce(1).write.parquet(f"{place}/batch={i}")
    return open_stream(spark, str(place), max_files=1).drop("batch")


def test_windows_of_null_and_early_times(spark):
    """No time, no window; before the epoch windows are aligned as after it."""
    rows = [(1, 1, None), (2, 1, dt.datetime(1969, 12, 31, 23, 59, 59)), (3, 1, dt.datetime(1970, 1, 1)), (4, 1, dt.datetime(1960, 2, 29, 5, 59))]
    df = spark.createDataFrame([(e, u, t, "a", 1.0) for e, u, t in rows], SCHEMA)
    found = lambda **how: sorted((r.start, r.n) for r in windowed_counts(df, "1 day", **how).collect())
    assert found() == [(dt.datetime(1960, 2, 29), 1), (dt.datetime(1969, 12, 31), 1), (dt.datetime(1970, 1, 1), 1)]
    assert found(offset="6 hours") == [(dt.datetime(1960, 2, 28, 6), 1), (dt.datetime(1969, 12, 31, 6), 2)]
    assert len(found(slide="8 hours")) == len({s for s, _ in found(slide="8 hours")}) >= 6


@pytest.mark.parametrize("policy, mark", [("min", "2024-01-01T10:00"), ("max", "2024-01-04T03:00")])
def test_watermark_policies_of_two_streams(spark, tmp_path, policy, mark):
    first = batches(spark, tmp_path / "a", [(1, 1, at(11))]).withWatermark("ts", "1 hour")
    second = batches(spark, tmp_path / "b", [(2, 1, at(76))]).withWatermark("ts", "1 hour")
    spark.conf.set("spark.sql.streaming.multipleWatermarkPolicy", policy)
    try:
        counted = first.union(second).groupBy(F.window("ts", "1 hour")).count()
        running = counted.writeStream.outputMode("append").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).format("noop").start()
        running.awaitTermination()
        assert running.recentProgress[-1].eventTime["watermark"].startswith(mark)
    finally:
        spark.conf.unset("spark.sql.streaming.multipleWatermarkPolicy")


@pytest.mark.parametrize("how", ["left_outer", "right_outer", "full_outer"])
def test_outer_joins_wait_for_the_watermark(spark, tmp_path, how):
    a = batches(spark, tmp_path / "a", [(1, 1, at(0)), (2, 2, at(1))], [(3, 1, at(90))])
    b = batches(spark, tmp_path / "b", [(11, 1, at(0, 30)), (12, 9, at(1))], [(13, 5, at(90))])
    got = {(r.a_id, r.b_id) for r in run_to_end(followed_by(a, b, "1 HOUR", how=how)).collect()}
    left, right = {(2, None)}, {(None, 12)}
    assert got == {(1, 11)} | (left if how != "right_outer" else set()) | (right if how != "left_outer" else set())


def test_state_times_out_by_event_time(spark, tmp_path):
    """A user comes out once the watermark is past its wait, and begins anew after that."""
    stream = batches(spark, tmp_path / "in", [(1, 1, at(0)), (2, 1, at(2)), (3, 2, at(20))], [(4, 2, at(60))], [(5, 1, at(61))], [(6, 3, at(200))])
    got = sorted((r.user_id, r.n, r.seen) for r in run_to_end(idle_users(stream, 5, late="1 hour")).collect())
    assert got == [(1, 1, at(61)), (1, 2, at(2)), (2, 2, at(60))]


def test_foreach_and_console(spark, tmp_path):
    stream = batches(spark, tmp_path / "in", [(1, 1, at(0)), (2, 2, at(1))], [(3, 3, at(2))])
    out = tmp_path / "rows"
    out.mkdir()

    class Writer:
        def __init__(self, place):
            self.place = place

        def open(self, partition, epoch):
            self.file = open(f"{self.place}/{epoch}-{partition}", "a")
            return True

        def process(self, row):
            self.file.write(f"{row.event_id}\n")

        def close(self, error):
            self.file.close()

    def run(sink):
        running = sink.trigger(availableNow=True).start()
        running.awaitTermination()
        return running.lastProgress

    run(stream.writeStream.option("checkpointLocation", str(tmp_path / "s1")).foreach(Writer(str(out))))
    assert sorted(int(x) for f in out.iterdir() for x in f.read_text().split()) == [1, 2, 3]
    told = run(stream.select("event_id").writeStream.option("checkpointLocation", str(tmp_path / "s2")).format("console"))
    assert "Console" in told.sink.description and told.sink.numOutputRows == 1


def test_socket_source(spark):
    with socket.create_server(("127.0.0.1", 0)) as server:

        def serve():
            peer, _ = server.accept()
            with peer:
                peer.sendall(b"one two\nthree\n")
                done.wait(60)

        done = threading.Event()
        threading.Thread(target=serve, daemon=True).start()
        lines = spark.readStream.format("socket").option("host", "127.0.0.1").option("port", server.getsockname()[1]).load()
        running = lines.select(F.explode(F.split("value", " ")).alias("w")).writeStream.format("memory").queryName("heard").start()
        try:
            for _ in range(60):
                running.processAllAvailable()
                if spark.table("heard").count() == 3:
                    break
                done.wait(0.5)
            assert {r.w for r in spark.table("heard").collect()} == {"one", "two", "three"}
        finally:
            running.stop()
            done.set()


def test_jdbc_round_trip(spark):
    """The database that comes with Spark, in memory; the filter and the columns reach it."""
    where = {"url": "jdbc:derby:memory:lumen;create=true", "driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver", "dbtable": "things"}
    df = spark.createDataFrame([(1, "a", 1.5), (2, "b", None), (3, None, 2.5)], "id int, name string, x double")
    write(df, None, "jdbc", mode="overwrite", **where)
    back = read(spark, None, "jdbc", columns=["id", "x"], where="id > 1", **where)
    assert sorted(map(tuple, back.collect())) == [(2, None), (3, 2.5)]
    assert "PushedFilters: [*IsNotNull(id), *GreaterThan(id,1)]" in back._jdf.queryExecution().executedPlan().toString()
