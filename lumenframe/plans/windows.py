"""Window functions and frames."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumenframe.operators.windows import running, sliding, top_per_group
from lumenframe.plans.registry import query, sql
from lumenframe.sources.io import table

sql("win_sum_total", "SELECT o_orderkey, round(sum(o_totalprice) OVER (PARTITION BY o_custkey), 2) AS total FROM {orders}")
sql("win_sum_running_range", "SELECT o_orderkey, sum(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate) AS running FROM {orders}", "SELECT o_orderkey, CAST(sum(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate) AS BIGINT) AS running FROM {orders}")
sql("win_avg", "SELECT o_orderkey, round(avg(o_totalprice) OVER (PARTITION BY o_orderpriority), 4) AS mean FROM {orders}")
sql("win_min_max", "SELECT o_orderkey, min(o_orderdate) OVER (PARTITION BY o_custkey) AS first_day, max(o_totalprice) OVER (PARTITION BY o_custkey) AS top FROM {orders}")
sql("win_count", "SELECT event_id, count(*) OVER (PARTITION BY user_id) AS n, count(value) OVER (PARTITION BY event_type) AS n_value FROM {events}")
sql("win_rank", "SELECT c_custkey, rank() OVER (PARTITION BY c_nationkey ORDER BY c_mktsegment) AS r, rank() OVER (PARTITION BY c_mktsegment ORDER BY c_nationkey DESC) AS d FROM {customer}", "SELECT c_custkey, CAST(rank() OVER (PARTITION BY c_nationkey ORDER BY c_mktsegment) AS INTEGER) AS r, CAST(rank() OVER (PARTITION BY c_mktsegment ORDER BY c_nationkey DESC) AS INTEGER) AS d FROM {customer}")
sql("win_row_number", "SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS n FROM {orders}", "SELECT o_orderkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS INTEGER) AS n FROM {orders}")
sql("win_lag_lead", "SELECT event_id, lag(value, 1, -1.0D) OVER w AS before, lead(value, 2) OVER w AS after, lag(event_type) OVER w AS kind FROM {events} WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)", "SELECT event_id, lag(value, 1, -1.0) OVER w AS before, lead(value, 2) OVER w AS after, lag(event_type) OVER w AS kind FROM {events} WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)")
sql("win_dense_ntile_pct", "SELECT c_custkey, dense_rank() OVER w AS dr, ntile(4) OVER (PARTITION BY c_mktsegment ORDER BY c_custkey) AS q, round(percent_rank() OVER w, 8) AS pr, round(cume_dist() OVER w, 8) AS cd FROM {customer} WINDOW w AS (PARTITION BY c_mktsegment ORDER BY c_nationkey)",
    "SELECT c_custkey, CAST(dense_rank() OVER w AS INTEGER) AS dr, CAST(ntile(4) OVER (PARTITION BY c_mktsegment ORDER BY c_custkey) AS INTEGER) AS q, round(percent_rank() OVER w, 8) AS pr, round(cume_dist() OVER w, 8) AS cd FROM {customer} WINDOW w AS (PARTITION BY c_mktsegment ORDER BY c_nationkey)")
sql("win_nth_first_last", "SELECT o_orderkey, first_value(o_orderkey) OVER w AS f, last_value(o_orderkey) OVER w AS l, nth_value(o_orderkey, 2) OVER w AS n FROM {orders} WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)")
sql("win_rows_frame", "SELECT o_orderkey, round(avg(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING), 4) AS m FROM {orders}")
sql("win_range_frame", "SELECT c_custkey, count(*) OVER (PARTITION BY c_mktsegment ORDER BY c_nationkey RANGE BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS near FROM {customer}")
sql("win_range_interval", "SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL '1' DAY PRECEDING AND CURRENT ROW) AS n FROM {events}", "SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 1 DAY PRECEDING AND CURRENT ROW) AS n FROM {events}")
sql("win_ordered_min_max", "SELECT o_orderkey, min(o_totalprice) OVER w AS low, max(o_totalprice) OVER w AS high, count(*) OVER w AS n FROM {orders} WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate)")
sql("win_after_aggregate", "SELECT o_orderpriority, o_orderstatus, n, sum(n) OVER (PARTITION BY o_orderpriority) AS total FROM (SELECT o_orderpriority, o_orderstatus, count(*) AS n FROM {orders} GROUP BY o_orderpriority, o_orderstatus) t", "SELECT o_orderpriority, o_orderstatus, n, CAST(sum(n) OVER (PARTITION BY o_orderpriority) AS BIGINT) AS total FROM (SELECT o_orderpriority, o_orderstatus, count(*) AS n FROM {orders} GROUP BY o_orderpriority, o_orderstatus) t")
sql("win_no_partition", "SELECT n_name, row_number() OVER (ORDER BY n_name) AS n FROM {nation}", "SELECT n_name, CAST(row_number() OVER (ORDER BY n_name) AS INTEGER) AS n FROM {nation}")
sql("win_ignore_nulls", "SELECT event_id, last_value(nullif(event_type, 'click')) IGNORE NULLS OVER (PARTITION BY user_id ORDER BY ts, event_id) AS kind FROM {events}", "SELECT event_id, last_value(nullif(event_type, 'click') IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS kind FROM {events}")
sql("win_nulls_order", "SELECT c_custkey, row_number() OVER (ORDER BY nullif(c_nationkey, 3) DESC NULLS LAST, c_custkey) AS n FROM {customer}", "SELECT c_custkey, CAST(row_number() OVER (ORDER BY nullif(c_nationkey, 3) DESC NULLS LAST, c_custkey) AS INTEGER) AS n FROM {customer}")
sql("win_sessions", """
SELECT user_id, session, count(*) AS n, min(ts) AS begin_ts FROM (
  SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session FROM (
    SELECT *, CASE WHEN ts > lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL 6 HOURS THEN 1 ELSE 0 END AS fresh FROM {events}) a) b
GROUP BY user_id, session""", """
SELECT user_id, session::BIGINT AS session, count(*) AS n, min(ts) AS begin_ts FROM (
  SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session FROM (
    SELECT *, CASE WHEN ts > lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL 6 HOURS THEN 1 ELSE 0 END AS fresh FROM {events}) a) b
GROUP BY user_id, session""")


@query("SELECT c_nationkey, c_custkey, rank FROM (SELECT *, CAST(rank() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC) AS INTEGER) AS rank FROM customer) t WHERE rank <= 3")
def win_topk_rank_lt(spark, sf_dir):
    return top_per_group(table(spark, sf_dir, "customer"), ["c_nationkey"], [F.desc("c_acctbal")], 3, ties=True).select("c_nationkey", "c_custkey", "rank")


@query("SELECT o_custkey, o_orderkey, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS INTEGER) AS rank FROM orders) t WHERE rank <= 2")
def win_topk_rows(spark, sf_dir):
    return top_per_group(table(spark, sf_dir, "orders"), ["o_custkey"], [F.desc("o_totalprice"), F.asc("o_orderkey")], 2).select("o_custkey", "o_orderkey", "rank")


@query("SELECT o_orderkey, CAST(sum(o_orderkey) OVER (PARTITION BY o_orderstatus ORDER BY o_orderdate) AS BIGINT) AS total, CAST(sum(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) AS BIGINT) AS four FROM orders")
def win_running_and_sliding(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    return orders.select("o_orderkey", running("o_orderkey", ["o_orderstatus"], [F.asc("o_orderdate")]).alias("total"), sliding("o_orderkey", ["o_custkey"], [F.asc("o_orderdate"), F.asc("o_orderkey")], 3).alias("four"))
