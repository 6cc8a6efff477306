"""Set operations, sorts, limits, repartitioning, sampling, projections."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumenframe.operators import setops
from lumenframe.plans.registry import query, sql
from lumenframe.sources.io import table, tables

A, B = "SELECT c_nationkey AS k FROM {customer}", "SELECT s_nationkey AS k FROM {supplier} WHERE s_nationkey < 15"
for _name, _op in (("union_all", "UNION ALL"), ("union", "UNION"), ("intersect", "INTERSECT"), ("intersect_all", "INTERSECT ALL"), ("except", "EXCEPT"), ("except_all", "EXCEPT ALL")):
    sql(f"set_{_name}", f"{A} {_op} {B}")
sql("set_minus", f"{A} MINUS {B}", f"{A} EXCEPT {B}")
sql("set_widening", "SELECT c_nationkey AS k FROM {customer} UNION ALL SELECT s_acctbal FROM {supplier}")


@query("SELECT c_custkey AS id, c_name AS name, NULL::DOUBLE AS bal FROM customer UNION ALL SELECT s_suppkey, s_name, s_acctbal FROM supplier")
def set_union_by_name(spark, sf_dir):
    customer, supplier = tables(spark, sf_dir, "customer", "supplier")
    a = customer.select(F.col("c_name").alias("name"), F.col("c_custkey").alias("id"))
    return setops.union_by_name(a, supplier.select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("bal")))


@query("SELECT n_regionkey FROM nation INTERSECT SELECT r_regionkey FROM region WHERE r_regionkey < 3")
def set_intersect_frames(spark, sf_dir):
    nation, region = tables(spark, sf_dir, "nation", "region")
    return setops.intersect(nation.select("n_regionkey"), region.where("r_regionkey < 3").select("r_regionkey"))


@query("SELECT n_regionkey FROM nation EXCEPT ALL SELECT r_regionkey FROM region")
def set_except_frames(spark, sf_dir):
    nation, region = tables(spark, sf_dir, "nation", "region")
    return setops.except_(nation.select("n_regionkey"), region.select("r_regionkey"), every=True)


@query("SELECT o_orderstatus AS k FROM orders UNION SELECT l_linestatus FROM lineitem")
def set_union_distinct_frames(spark, sf_dir):
    orders, lineitem = tables(spark, sf_dir, "orders", "lineitem")
    return setops.union_distinct(orders.select(F.col("o_orderstatus").alias("k")), lineitem.select("l_linestatus"))


sql("sort_multi_nulls", "SELECT c_custkey, nullif(c_nationkey, 5) AS k FROM {customer} ORDER BY k ASC NULLS LAST, c_acctbal DESC, c_custkey")
sql("sort_nested_payload", "SELECT c_custkey, pair.c_name AS name, pair.c_nationkey AS k FROM (SELECT c_custkey, c_acctbal, struct(c_name, c_nationkey) AS pair FROM {customer} ORDER BY c_acctbal, c_custkey) t", "SELECT c_custkey, c_name AS name, c_nationkey AS k FROM {customer}")
sql("topk", "SELECT o_orderkey, o_totalprice FROM {orders} ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
sql("limit_offset", "SELECT o_orderkey FROM {orders} ORDER BY o_orderkey LIMIT 10 OFFSET 15")
sql("limit_subquery", "SELECT count(*) AS n FROM (SELECT * FROM {lineitem} LIMIT 100) t")


@query("SELECT c_custkey, c_name FROM customer ORDER BY c_name LIMIT 7")
def sort_and_limit_frames(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", "c_name").orderBy("c_name").limit(7)


@query("SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY o_orderstatus")
def repartition_kinds(spark, sf_dir):
    """Hash, round-robin and range exchanges, then fewer partitions without one."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    dealt = orders.repartition(6, "o_orderstatus").repartition(5).repartitionByRange(4, "o_orderkey").coalesce(2)
    return dealt.groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"))


for _hint in ("COALESCE(2)", "REPARTITION(3)", "REPARTITION(3, n_regionkey)", "REPARTITION_BY_RANGE(3, n_name)", "REBALANCE(n_name)"):
    sql("hint_" + _hint.split("(")[0].lower() + ("_key" if _hint.endswith("n_regionkey)") and _hint.startswith("REPART") else ""), f"SELECT /*+ {_hint} */ n_name FROM {{nation}}", "SELECT n_name FROM {nation}")
sql("sort_within", "SELECT n_name, n_regionkey FROM {nation} DISTRIBUTE BY n_regionkey SORT BY n_name", "SELECT n_name, n_regionkey FROM {nation}")
sql("project_filter", "SELECT l_orderkey, l_extendedprice * (1 - l_discount) AS net, l_quantity + 1 AS q FROM {lineitem} WHERE l_quantity > 40 AND l_discount < 0.05 AND l_returnflag IS NOT NULL")
sql("filter_not_null", "SELECT event_id FROM {events} WHERE value IS NOT NULL AND props IS NOT NULL")
sql("scalar_subquery_project", "SELECT n_name, n_nationkey - (SELECT min(n_nationkey) FROM {nation}) AS d FROM {nation}")
sql("distinct_rows", "SELECT DISTINCT c_mktsegment, c_nationkey FROM {customer}")
sql("values_inline", "SELECT a, b FROM VALUES (1, 'x'), (2, NULL), (NULL, 'z') AS t(a, b)", "SELECT a, b FROM (VALUES (1, 'x'), (2, NULL), (NULL, 'z')) AS t(a, b)")


@query("SELECT range AS id, range * 2 AS twice FROM range(5, 50, 3)")
def range_source(spark, sf_dir):
    return spark.range(5, 50, 3).select("id", (F.col("id") * 2).alias("twice"))


@query("SELECT count(*) AS total, 0 AS strays, count(*) > 0 AS near FROM lineitem")
def sample_rows(spark, sf_dir):
    """A seeded sample: its rows are the table's, and its share is near the one asked for."""
    lineitem = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber")
    sample = lineitem.sample(0.3, seed=3)
    total = lineitem.agg(F.count(F.lit(1)).alias("total"))
    strays = sample.exceptAll(lineitem).agg(F.count(F.lit(1)).alias("strays"))
    taken = sample.agg(F.count(F.lit(1)).alias("n"))
    one = total.crossJoin(strays).crossJoin(taken)  # a row each
    return one.select("total", "strays", (F.abs(F.col("n") / F.col("total") - 0.3) < 0.05).alias("near"))


sql("table_sample", "SELECT (SELECT count(*) FROM {orders} TABLESAMPLE (100 PERCENT)) AS whole, (SELECT count(*) FROM {orders} TABLESAMPLE (0 PERCENT)) AS none, (SELECT count(*) FROM {orders} TABLESAMPLE (7 ROWS)) AS seven, (SELECT count(*) FROM {orders} TABLESAMPLE (20 PERCENT) REPEATABLE (7)) BETWEEN 0.1 * count(*) AND 0.3 * count(*) AS near FROM {orders}", "SELECT count(*) AS whole, 0 AS none, 7 AS seven, count(*) > 0 AS near FROM {orders}")


@query("SELECT c_custkey, coalesce(nullif(c_mktsegment, 'BUILDING'), 'none') AS seg, CASE c_nationkey WHEN 3 THEN 30 ELSE c_nationkey END AS k FROM customer WHERE nullif(c_nationkey, 7) IS NOT NULL")
def na_functions(spark, sf_dir):
    customer = table(spark, sf_dir, "customer")
    holed = customer.select("c_custkey", F.nullif("c_mktsegment", F.lit("BUILDING")).alias("seg"), F.nullif("c_nationkey", F.lit(7)).alias("k"))
    return holed.na.drop(subset=["k"]).na.fill({"seg": "none"}).na.replace(3, 30, subset=["k"])
