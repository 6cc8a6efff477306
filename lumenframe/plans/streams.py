"""Streams over the events table, run to the end of their input and checked against batch SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumenframe.plans.registry import query
from lumenframe.session import configure
from lumenframe.streaming import operators as S
from lumenframe.streaming.runner import open_stream, run_to_end


def _events(spark, sf_dir):
    """Watermarks need a time with a zone; the session's is UTC."""
    return open_stream(configure(spark), f"{sf_dir}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))


@query("SELECT time_bucket(INTERVAL 1 DAY, ts, TIMESTAMP '1970-01-01') AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def stream_tumbling(spark, sf_dir):
    return run_to_end(S.windowed_counts(_events(spark, sf_dir), "1 day"), "complete")


@query("SELECT time_bucket(INTERVAL 12 HOUR, ts, TIMESTAMP '1970-01-01') - o * INTERVAL 12 HOUR AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events, range(2) AS r(o) GROUP BY 1, 2")
def stream_sliding(spark, sf_dir):
    return run_to_end(S.windowed_counts(_events(spark, sf_dir), "24 hours", "12 hours"), "complete")


@query("SELECT event_id, user_id FROM events")
def stream_dedup(spark, sf_dir):
    """Every event twice, as two streams; each stays once."""
    twice = _events(spark, sf_dir).union(_events(spark, sf_dir))
    return run_to_end(S.deduplicated(twice, ["event_id"]).select("event_id", "user_id"))


@query("SELECT DISTINCT user_id, event_type FROM events")
def stream_distinct(spark, sf_dir):
    return run_to_end(_events(spark, sf_dir).select("user_id", "event_type").dropDuplicates())


@query("SELECT a.event_id AS a_id, b.event_id AS b_id FROM events a JOIN events b ON a.user_id = b.user_id AND a.event_type = 'click' AND b.event_type = 'purchase' AND b.ts >= a.ts AND b.ts <= a.ts + INTERVAL 12 HOUR")
def stream_join(spark, sf_dir):
    events = _events(spark, sf_dir)
    return run_to_end(S.followed_by(events.where("event_type = 'click'"), events.where("event_type = 'purchase'"), "12 HOURS"))


@query("SELECT user_id, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY user_id")
def stream_state(spark, sf_dir):
    return run_to_end(S.totals_by_user(_events(spark, sf_dir).select("user_id", "value")), "update")


@query("SELECT event_type, count(*) AS n FROM events GROUP BY event_type ORDER BY n DESC, event_type")
def stream_sorted_complete(spark, sf_dir):
    counted = _events(spark, sf_dir).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))
    return run_to_end(counted.orderBy(F.desc("n"), "event_type"), "complete")


@query("""SELECT user_id, min(ts) AS start, count(*) AS n FROM (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM (
  SELECT *, CASE WHEN ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 6 HOUR THEN 1 ELSE 0 END AS fresh FROM events) a) b GROUP BY user_id, s""")
def stream_sessions(spark, sf_dir):
    return run_to_end(S.sessions(_events(spark, sf_dir), "6 hours"), "complete")


@query("SELECT event_id, upper(event_type) AS kind, value * 2 AS twice FROM events WHERE value > 10")
def stream_stateless(spark, sf_dir):
    return run_to_end(_events(spark, sf_dir).where("value > 10").select("event_id", F.upper("event_type").alias("kind"), (F.col("value") * 2).alias("twice")))


@query("SELECT e.event_id, c.c_name FROM events e JOIN customer c ON e.user_id = c.c_custkey")
def stream_static_join(spark, sf_dir):
    customer = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").alias("user_id"), "c_name")
    return run_to_end(_events(spark, sf_dir).join(customer, "user_id").select("event_id", "c_name"))


@query("""WITH c AS (SELECT * FROM events WHERE event_type = 'click'), p AS (SELECT * FROM events WHERE event_type = 'purchase'),
w AS (SELECT least((SELECT max(ts) FROM c), (SELECT max(ts) FROM p)) - INTERVAL 1 DAY AS mark)
SELECT c.event_id AS a_id, p.event_id AS b_id FROM c LEFT JOIN p ON c.user_id = p.user_id AND p.ts >= c.ts AND p.ts <= c.ts + INTERVAL 2 HOUR CROSS JOIN w
WHERE p.event_id IS NOT NULL OR c.ts + INTERVAL 2 HOUR < mark""")
def stream_outer_join(spark, sf_dir):
    """Clicks without a purchase come out once the watermark has passed their time for one."""
    events = _events(spark, sf_dir)
    return run_to_end(S.followed_by(events.where("event_type = 'click'"), events.where("event_type = 'purchase'"), "2 HOURS", how="left_outer"))


@query("SELECT a.event_id AS a_id, b.event_id AS b_id FROM events a JOIN events b ON a.user_id = b.user_id AND a.event_id <> b.event_id AND b.ts >= a.ts AND b.ts <= a.ts + INTERVAL 1 HOUR")
def stream_self_join(spark, sf_dir):
    return run_to_end(S.followed_by(_events(spark, sf_dir), _events(spark, sf_dir), "1 HOUR").where("a_id <> b_id"))


@query("SELECT user_id, count(*) AS n, max(ts) AS seen FROM events GROUP BY user_id HAVING max(ts) + INTERVAL 12 HOUR < (SELECT max(ts) - INTERVAL 1 DAY FROM events)")
def stream_state_timeout(spark, sf_dir):
    return run_to_end(S.idle_users(_events(spark, sf_dir), 12))


@query("SELECT time_bucket(INTERVAL 1 DAY, ts, TIMESTAMP '1970-01-01 06:00:00') AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def stream_window_offset(spark, sf_dir):
    return run_to_end(S.windowed_counts(_events(spark, sf_dir), "1 day", "1 day", offset="6 hours"), "complete")
