"""Aggregation: functions, DISTINCT, FILTER, grouping sets, pivot, sketches."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumenframe.operators.aggregates import first_by, last_by, salted_sum
from lumenframe.plans.registry import query, sql
from lumenframe.sources.io import table

sql("agg_sum_types", """
SELECT o_orderstatus, sum(o_custkey) AS s_long, round(sum(o_totalprice), 2) AS s_double, sum(CAST(o_custkey AS SMALLINT)) AS s_short,
       CAST(sum(CAST(o_totalprice AS DECIMAL(12,2))) AS DOUBLE) AS s_decimal FROM {orders} GROUP BY o_orderstatus""", """
SELECT o_orderstatus, sum(o_custkey)::BIGINT AS s_long, round(sum(o_totalprice), 2) AS s_double, sum((o_custkey % 65536 + 98304) % 65536 - 32768)::BIGINT AS s_short,
       CAST(sum(CAST(o_totalprice AS DECIMAL(12,2))) AS DOUBLE) AS s_decimal FROM {orders} GROUP BY o_orderstatus""")
sql("agg_avg", "SELECT l_returnflag, round(avg(l_quantity), 8) AS a_double, round(avg(l_partkey), 6) AS a_long, round(avg(l_linenumber), 8) AS a_int FROM {lineitem} GROUP BY l_returnflag")
sql("agg_count", "SELECT event_type, count(*) AS n, count(value) AS n_value, count(nullif(user_id, 1)) AS n_user FROM {events} GROUP BY event_type")
sql("agg_count_filter", "SELECT o_orderpriority, count(*) FILTER (WHERE o_totalprice > 150000) AS big, count(*) FILTER (WHERE o_orderstatus = 'F') AS done FROM {orders} GROUP BY o_orderpriority")
sql("agg_multi_distinct", "SELECT l_returnflag, count(DISTINCT l_suppkey) AS suppliers, count(DISTINCT l_partkey) AS parts, count(DISTINCT l_shipdate) AS days, count(*) AS n FROM {lineitem} GROUP BY l_returnflag")
sql("agg_distinct_sum", "SELECT o_orderstatus, sum(DISTINCT o_custkey) AS s, count(DISTINCT o_custkey, o_orderpriority) AS n FROM {orders} GROUP BY o_orderstatus",
    "SELECT o_orderstatus, sum(DISTINCT o_custkey)::BIGINT AS s, count(DISTINCT (o_custkey, o_orderpriority)) AS n FROM {orders} GROUP BY o_orderstatus")
sql("agg_min_max_types", """
SELECT o_orderstatus, min(o_custkey) AS mn_long, max(o_totalprice) AS mx_double, min(o_orderpriority) AS mn_str, max(o_orderdate) AS mx_ts,
       min(CAST(o_orderdate AS DATE)) AS mn_date, max(o_totalprice > 1000) AS mx_bool FROM {orders} GROUP BY o_orderstatus""")
sql("agg_stddev", "SELECT l_returnflag, round(stddev_samp(l_quantity), 8) AS sd, round(stddev_pop(l_quantity), 8) AS sp, round(var_samp(l_quantity), 6) AS vs, round(var_pop(l_quantity), 6) AS vp FROM {lineitem} GROUP BY l_returnflag")
sql("agg_stddev_single", "SELECT stddev_samp(c_acctbal) AS sd, var_pop(c_acctbal) AS vp FROM {customer} WHERE c_custkey = 1")
sql("agg_moments", "SELECT round(skewness(l_quantity), 6) AS sk, round(kurtosis(l_quantity), 6) AS ku FROM {lineitem}", "SELECT round(sqrt(1.0) * (avg(power(l_quantity - m, 3)) / power(var_pop(l_quantity), 1.5)), 6) AS sk, round(avg(power(l_quantity - m, 4)) / power(var_pop(l_quantity), 2) - 3, 6) AS ku FROM {lineitem}, (SELECT avg(l_quantity) AS m FROM {lineitem}) t")
sql("agg_correlation", "SELECT round(corr(l_quantity, l_extendedprice), 8) AS r, round(covar_pop(l_quantity, l_discount), 8) AS cp, round(covar_samp(l_quantity, l_tax), 8) AS cs FROM {lineitem}")
sql("agg_bool", "SELECT c_mktsegment, bool_and(c_acctbal > -900) AS every_, bool_or(c_acctbal > 9000) AS any_, count_if(c_acctbal > 0) AS n FROM {customer} GROUP BY c_mktsegment",
    "SELECT c_mktsegment, bool_and(c_acctbal > -900) AS every_, bool_or(c_acctbal > 9000) AS any_, count(*) FILTER (WHERE c_acctbal > 0) AS n FROM {customer} GROUP BY c_mktsegment")
sql("agg_bits", "SELECT c_nationkey, bit_and(c_custkey) AS a, bit_or(c_custkey) AS o, bit_xor(c_custkey) AS x FROM {customer} GROUP BY c_nationkey")
# of equal balances the smallest key's name; rows without a name or a balance do not count
sql("agg_max_by", """
SELECT c_nationkey, max_by(c_name, named_struct('balance', c_acctbal, 'first', -c_custkey)) FILTER (WHERE c_name IS NOT NULL AND c_acctbal IS NOT NULL) AS richest,
       min_by(c_name, named_struct('balance', c_acctbal, 'first', c_custkey)) FILTER (WHERE c_name IS NOT NULL AND c_acctbal IS NOT NULL) AS poorest
FROM {customer} GROUP BY c_nationkey""", "SELECT c_nationkey, max_by(c_name, c_acctbal) AS richest, min_by(c_name, c_acctbal) AS poorest FROM {customer} GROUP BY c_nationkey")
sql("agg_percentile", "SELECT l_returnflag, percentile(l_quantity, 0.5) AS med, percentile(l_extendedprice, 0.9) AS p90 FROM {lineitem} GROUP BY l_returnflag",
    "SELECT l_returnflag, quantile_cont(l_quantity, 0.5) AS med, quantile_cont(l_extendedprice, 0.9) AS p90 FROM {lineitem} GROUP BY l_returnflag")
sql("agg_collect", "SELECT n_regionkey, sort_array(collect_list(n_name)) AS names, sort_array(collect_set(n_nationkey % 3)) AS rests FROM {nation} GROUP BY n_regionkey",
    "SELECT n_regionkey, list_sort(list(n_name)) AS names, list_sort(list(DISTINCT n_nationkey % 3)) AS rests FROM {nation} GROUP BY n_regionkey")
# beside a DISTINCT, Spark keeps each sketch once per distinct value before it merges them, so the two are apart
sql("agg_approx", """
SELECT s.l_returnflag, parts, abs(near - parts) < 0.2 * parts AS distinct_near, middle - median AS median_off
FROM (SELECT l_returnflag, approx_count_distinct(l_partkey) AS near, round(percentile_approx(l_quantity, 0.5, 10000), 0) AS middle, percentile(l_quantity, 0.5) AS median FROM {lineitem} GROUP BY l_returnflag) s
JOIN (SELECT l_returnflag, count(DISTINCT l_partkey) AS parts FROM {lineitem} GROUP BY l_returnflag) d ON s.l_returnflag <=> d.l_returnflag""",
    "SELECT l_returnflag, count(DISTINCT l_partkey) AS parts, abs(approx_count_distinct(l_partkey) - count(DISTINCT l_partkey)) < 0.2 * count(DISTINCT l_partkey) AS distinct_near, round(quantile_disc(l_quantity, 0.5), 0) - quantile_cont(l_quantity, 0.5) AS median_off FROM {lineitem} GROUP BY l_returnflag")
sql("agg_count_min_sketch", "SELECT l_returnflag, count(*) AS n, CAST(conv(substr(hex(count_min_sketch(l_suppkey, 0.01D, 0.9D, 42)), 9, 16), 16, 10) AS BIGINT) AS held FROM {lineitem} GROUP BY l_returnflag", "SELECT l_returnflag, count(*) AS n, count(l_suppkey) AS held FROM {lineitem} GROUP BY l_returnflag")
sql("agg_global_empty", "SELECT count(*) AS n, sum(o_totalprice) AS s, max(o_orderkey) AS m FROM {orders} WHERE o_totalprice < 0")
sql("agg_group_empty", "SELECT o_orderstatus, count(*) AS n FROM {orders} WHERE o_totalprice < 0 GROUP BY o_orderstatus")
sql("agg_distinct_only", "SELECT o_orderstatus, o_orderpriority FROM {orders} GROUP BY o_orderstatus, o_orderpriority")
sql("agg_rollup", "SELECT o_orderstatus, o_orderpriority, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM {orders} GROUP BY ROLLUP (o_orderstatus, o_orderpriority)")
sql("agg_cube", "SELECT c_mktsegment, c_nationkey % 2 AS half, count(*) AS n, CAST(grouping(c_mktsegment) AS BIGINT) AS g FROM {customer} GROUP BY CUBE (c_mktsegment, c_nationkey % 2)", "SELECT c_mktsegment, half, count(*) AS n, grouping(c_mktsegment) AS g FROM (SELECT *, c_nationkey % 2 AS half FROM {customer}) t GROUP BY CUBE (c_mktsegment, half)")
sql("agg_grouping_sets", "SELECT l_returnflag, l_linestatus, CAST(grouping_id(l_returnflag, l_linestatus) AS BIGINT) AS gid, count(*) AS n FROM {lineitem} GROUP BY GROUPING SETS ((l_returnflag), (l_linestatus), ())", "SELECT l_returnflag, l_linestatus, grouping_id(l_returnflag, l_linestatus) AS gid, count(*) AS n FROM {lineitem} GROUP BY GROUPING SETS ((l_returnflag), (l_linestatus), ())")
sql("agg_having", "SELECT o_custkey, count(*) AS n FROM {orders} GROUP BY o_custkey HAVING count(*) > 10 AND sum(o_totalprice) > 1000000")
sql("agg_ordinal_alias", "SELECT upper(o_orderstatus) AS st, count(*) AS n FROM {orders} GROUP BY 1 ORDER BY n DESC")
sql("agg_expression_key", "SELECT floor(o_totalprice / 50000) AS band, count(*) AS n FROM {orders} GROUP BY floor(o_totalprice / 50000)", "SELECT CAST(floor(o_totalprice / 50000) AS BIGINT) AS band, count(*) AS n FROM {orders} GROUP BY 1")
sql("agg_nan_zero_keys", """
SELECT count(*) AS groups, sum(n) AS total FROM (SELECT k, count(*) AS n FROM (
  SELECT CASE o_custkey % 4 WHEN 0 THEN CAST('NaN' AS DOUBLE) WHEN 1 THEN -0.0D WHEN 2 THEN 0.0D END AS k FROM {orders}) t GROUP BY k) g""",
    "SELECT 3::BIGINT AS groups, count(*)::BIGINT AS total FROM {orders}")
sql("agg_decimal", "SELECT o_orderstatus, CAST(sum(CAST(o_totalprice AS DECIMAL(12,2))) AS DECIMAL(22,2)) AS s, CAST(max(CAST(o_totalprice AS DECIMAL(12,2))) AS DECIMAL(12,2)) AS m FROM {orders} GROUP BY o_orderstatus")
sql("agg_first_det", "SELECT o_custkey, min_by(o_orderkey, struct(o_orderdate, o_orderkey)) AS first_order FROM {orders} GROUP BY o_custkey", "SELECT o_custkey, first(o_orderkey ORDER BY o_orderdate, o_orderkey) AS first_order FROM {orders} GROUP BY o_custkey")
sql("agg_first_ignore_nulls", "SELECT k, first(v, true) AS a, last(v, true) AS b, any_value(v) IS NULL AS c FROM VALUES (1, CAST(NULL AS INT)), (1, 7), (2, CAST(NULL AS INT)) AS t(k, v) GROUP BY k", "SELECT * FROM (VALUES (1, 7, 7, true), (2, NULL, NULL, true)) t(k, a, b, c)")
sql("agg_pivot", "SELECT * FROM (SELECT o_orderstatus, o_orderpriority, o_orderkey FROM {orders}) PIVOT (count(o_orderkey) FOR o_orderstatus IN ('F' AS f, 'O' AS o, 'P' AS p))",
    "SELECT o_orderpriority, nullif(count(*) FILTER (WHERE o_orderstatus = 'F'), 0) AS f, nullif(count(*) FILTER (WHERE o_orderstatus = 'O'), 0) AS o, nullif(count(*) FILTER (WHERE o_orderstatus = 'P'), 0) AS p FROM {orders} GROUP BY o_orderpriority")
sql("agg_unpivot", "SELECT * FROM (SELECT s_suppkey, s_nationkey AS nation, CAST(s_suppkey % 7 AS INT) AS rest FROM {supplier}) UNPIVOT (v FOR k IN (nation, rest))",
    "SELECT s_suppkey, 'nation' AS k, s_nationkey AS v FROM {supplier} UNION ALL SELECT s_suppkey, 'rest', CAST(s_suppkey % 7 AS INTEGER) FROM {supplier}")
sql("agg_regr", "SELECT round(regr_slope(l_extendedprice, l_quantity), 4) AS slope, regr_count(l_extendedprice, l_quantity) AS n FROM {lineitem}", "SELECT round(regr_slope(l_extendedprice, l_quantity), 4) AS slope, CAST(regr_count(l_extendedprice, l_quantity) AS BIGINT) AS n FROM {lineitem}")
sql("agg_mode_listagg", "SELECT n_regionkey, listagg(n_name, ',') WITHIN GROUP (ORDER BY n_name) AS names FROM {nation} GROUP BY n_regionkey", "SELECT n_regionkey, string_agg(n_name, ',' ORDER BY n_name) AS names FROM {nation} GROUP BY n_regionkey")


@query("SELECT c_nationkey, first(c_name ORDER BY c_custkey) AS first_name, first(c_name ORDER BY c_custkey DESC) AS last_name FROM customer GROUP BY c_nationkey")
def agg_first_last_by(spark, sf_dir):
    customer = table(spark, sf_dir, "customer")
    return customer.groupBy("c_nationkey").agg(first_by("c_name", "c_custkey").alias("first_name"), last_by("c_name", "c_custkey").alias("last_name"))


@query("SELECT l_returnflag, sum(l_partkey)::BIGINT AS l_partkey FROM lineitem GROUP BY l_returnflag")
def agg_salted(spark, sf_dir):
    return salted_sum(table(spark, sf_dir, "lineitem").select("l_returnflag", "l_partkey"), ["l_returnflag"], ["l_partkey"])


@query("SELECT c_mktsegment, c_nationkey, count(*) AS n FROM customer GROUP BY c_mktsegment, c_nationkey")
def agg_drop_duplicates(spark, sf_dir):
    customer = table(spark, sf_dir, "customer")
    counted = customer.groupBy("c_mktsegment", "c_nationkey").agg(F.count(F.lit(1)).alias("n"))
    return customer.select("c_mktsegment", "c_nationkey").dropDuplicates().join(counted, ["c_mktsegment", "c_nationkey"])
