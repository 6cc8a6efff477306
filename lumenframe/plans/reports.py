"""Decision-support reports: many-table joins under aggregates."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumenframe.operators.joins import broadcast_if_small
from lumenframe.plans.registry import query, sql
from lumenframe.sources.io import table, tables

def revenue():
    """A line's price after discount."""
    return F.col("l_extendedprice") * (1 - F.col("l_discount"))



@query("""
SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty, round(sum(l_extendedprice), 4) AS sum_base_price,
       round(sum(l_extendedprice * (1 - l_discount)), 4) AS sum_disc_price,
       round(sum(l_extendedprice * (1 - l_discount) * (1 + l_tax)), 6) AS sum_charge,
       round(avg(l_quantity), 6) AS avg_qty, round(avg(l_extendedprice), 6) AS avg_price, round(avg(l_discount), 6) AS avg_disc, count(*) AS count_order
FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY l_returnflag, l_linestatus""")
def q1_pricing_summary(spark, sf_dir):
    lineitem = table(spark, sf_dir, "lineitem").where("l_shipdate <= timestamp_ntz'1998-09-02'")
    return lineitem.groupBy("l_returnflag", "l_linestatus").agg(
        F.sum("l_quantity").alias("sum_qty"),
        F.round(F.sum("l_extendedprice"), 4).alias("sum_base_price"),
        F.round(F.sum(revenue()), 4).alias("sum_disc_price"),
        F.round(F.sum(revenue() * (1 + F.col("l_tax"))), 6).alias("sum_charge"),
        F.round(F.avg("l_quantity"), 6).alias("avg_qty"), F.round(F.avg("l_extendedprice"), 6).alias("avg_price"),
        F.round(F.avg("l_discount"), 6).alias("avg_disc"), F.count(F.lit(1)).alias("count_order"),
    )


@query("""
SELECT l_orderkey, round(sum(l_extendedprice * (1 - l_discount)), 4) AS revenue, o_orderdate
FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey
WHERE c_mktsegment = 'BUILDING' AND o_orderdate < TIMESTAMP '1995-03-15' AND l_shipdate > TIMESTAMP '1995-03-15'
GROUP BY l_orderkey, o_orderdate ORDER BY revenue DESC, o_orderdate, l_orderkey LIMIT 10""")
def q3_shipping_priority(spark, sf_dir):
    customer, orders, lineitem = tables(spark, sf_dir, "customer", "orders", "lineitem")
    wanted = customer.where("c_mktsegment = 'BUILDING'").select("c_custkey")
    early = orders.where("o_orderdate < timestamp_ntz'1995-03-15'")
    late = lineitem.where("l_shipdate > timestamp_ntz'1995-03-15'")
    joined = late.join(early, late.l_orderkey == early.o_orderkey).join(wanted, F.col("o_custkey") == F.col("c_custkey"), "left_semi")
    return (
        joined.groupBy("l_orderkey", "o_orderdate").agg(F.round(F.sum(revenue()), 4).alias("revenue"))
        .orderBy(F.desc("revenue"), "o_orderdate", "l_orderkey").limit(10)
    )


@query("""
SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 4) AS revenue
FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey
JOIN supplier ON l_suppkey = s_suppkey AND c_nationkey = s_nationkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
WHERE r_name = 'ASIA' AND o_orderdate >= TIMESTAMP '1994-01-01' AND o_orderdate < TIMESTAMP '1996-01-01' GROUP BY n_name""")
def q5_local_supplier(spark, sf_dir):
    customer, orders, lineitem, supplier, nation, region = tables(spark, sf_dir, "customer", "orders", "lineitem", "supplier", "nation", "region")
    asia = nation.join(broadcast_if_small(region.where("r_name = 'ASIA'")), F.col("n_regionkey") == F.col("r_regionkey"), "left_semi")
    near = supplier.join(broadcast_if_small(asia), F.col("s_nationkey") == F.col("n_nationkey"))
    placed = orders.where("o_orderdate >= timestamp_ntz'1994-01-01' and o_orderdate < timestamp_ntz'1996-01-01'")
    return (
        lineitem.join(near, F.col("l_suppkey") == F.col("s_suppkey"))
        .join(placed, F.col("l_orderkey") == F.col("o_orderkey"))
        .join(customer, (F.col("o_custkey") == F.col("c_custkey")) & (F.col("c_nationkey") == F.col("s_nationkey")))
        .groupBy("n_name").agg(F.round(F.sum(revenue()), 4).alias("revenue"))
    )


@query("""
SELECT round(sum(l_extendedprice * l_discount), 4) AS revenue FROM lineitem
WHERE l_shipdate >= TIMESTAMP '1994-01-01' AND l_shipdate < TIMESTAMP '1995-01-01' AND l_discount BETWEEN 0.0499 AND 0.0701 AND l_quantity < 24""")
def q6_revenue_forecast(spark, sf_dir):
    lineitem = table(spark, sf_dir, "lineitem")
    wanted = lineitem.where("l_shipdate >= timestamp_ntz'1994-01-01' and l_shipdate < timestamp_ntz'1995-01-01' and l_discount between 0.0499D and 0.0701D and l_quantity < 24")
    return wanted.agg(F.round(F.sum(F.col("l_extendedprice") * F.col("l_discount")), 4).alias("revenue"))


sql("q7_volume_shipping", """
SELECT n1.n_name AS supp_nation, n2.n_name AS cust_nation, CAST(year(l_shipdate) AS BIGINT) AS l_year, round(sum(l_extendedprice * (1 - l_discount)), 4) AS revenue
FROM {supplier} JOIN {lineitem} ON s_suppkey = l_suppkey JOIN {orders} ON o_orderkey = l_orderkey JOIN {customer} ON c_custkey = o_custkey
JOIN {nation} n1 ON s_nationkey = n1.n_nationkey JOIN {nation} n2 ON c_nationkey = n2.n_nationkey
WHERE n1.n_regionkey IN (2, 3) AND n2.n_regionkey IN (2, 3) AND n1.n_name <> n2.n_name AND l_shipdate BETWEEN TIMESTAMP '1995-01-01' AND TIMESTAMP '1996-12-31'
GROUP BY n1.n_name, n2.n_name, year(l_shipdate)""")
sql("q8_market_share", """
SELECT o_year, round(sum(CASE WHEN nation = 'NATION_2' THEN volume ELSE 0 END) / sum(volume), 8) AS mkt_share FROM (
  SELECT CAST(year(o_orderdate) AS BIGINT) AS o_year, l_extendedprice * (1 - l_discount) AS volume, n2.n_name AS nation
  FROM {part} JOIN {lineitem} ON p_partkey = l_partkey JOIN {supplier} ON s_suppkey = l_suppkey JOIN {orders} ON l_orderkey = o_orderkey
  JOIN {customer} ON o_custkey = c_custkey JOIN {nation} n1 ON c_nationkey = n1.n_nationkey JOIN {region} ON n1.n_regionkey = r_regionkey
  JOIN {nation} n2 ON s_nationkey = n2.n_nationkey WHERE r_name = 'AMERICA' AND p_size < 25) t GROUP BY o_year""")
sql("q10_returned_items", """
SELECT c_custkey, c_name, round(sum(l_extendedprice * (1 - l_discount)), 4) AS revenue, c_acctbal, n_name
FROM {customer} JOIN {orders} ON c_custkey = o_custkey JOIN {lineitem} ON l_orderkey = o_orderkey JOIN {nation} ON c_nationkey = n_nationkey
WHERE l_returnflag = 'R' GROUP BY c_custkey, c_name, c_acctbal, n_name ORDER BY revenue DESC, c_custkey LIMIT 20""")
sql("q13_customer_distribution", """
SELECT c_count, count(*) AS custdist FROM (
  SELECT c_custkey, count(o_orderkey) AS c_count FROM {customer} LEFT JOIN {orders} ON c_custkey = o_custkey AND o_orderpriority <> '1-URGENT' GROUP BY c_custkey) t
GROUP BY c_count""")
sql("q14_promo_effect", """
SELECT round(100.0 * sum(CASE WHEN p_type LIKE 'PROMO%' THEN l_extendedprice * (1 - l_discount) ELSE 0 END) / sum(l_extendedprice * (1 - l_discount)), 6) AS promo_revenue
FROM {lineitem} JOIN {part} ON l_partkey = p_partkey WHERE l_shipdate >= TIMESTAMP '1995-09-01' AND l_shipdate < TIMESTAMP '1996-09-01'""")
sql("q15_top_supplier", """
WITH revenue AS (SELECT l_suppkey AS supplier_no, round(sum(l_extendedprice * (1 - l_discount)), 4) AS total_revenue FROM {lineitem} GROUP BY l_suppkey)
SELECT s_suppkey, s_name, total_revenue FROM {supplier} JOIN revenue ON s_suppkey = supplier_no WHERE total_revenue = (SELECT max(total_revenue) FROM revenue)""")
sql("q17_small_orders", """
SELECT round(sum(l_extendedprice) / 7.0, 4) AS avg_yearly FROM {lineitem} JOIN {part} ON p_partkey = l_partkey
WHERE p_size < 20 AND l_quantity < (SELECT 0.4 * avg(l.l_quantity) FROM {lineitem} l WHERE l.l_partkey = p_partkey)""")
sql("q18_large_orders", """
SELECT c_name, c_custkey, o_orderkey, o_orderdate, o_totalprice, sum(l_quantity) AS qty
FROM {customer} JOIN {orders} ON c_custkey = o_custkey JOIN {lineitem} ON o_orderkey = l_orderkey
WHERE o_orderkey IN (SELECT l_orderkey FROM {lineitem} GROUP BY l_orderkey HAVING sum(l_quantity) > 180)
GROUP BY c_name, c_custkey, o_orderkey, o_orderdate, o_totalprice ORDER BY o_totalprice DESC, o_orderkey LIMIT 100""")

FLIGHT = "{lineitem} JOIN {orders} ON l_orderkey = o_orderkey"
sql("ssb_1_1", f"SELECT round(sum(l_extendedprice * l_discount), 4) AS revenue FROM {FLIGHT} WHERE o_orderdate >= TIMESTAMP '1996-01-01' AND o_orderdate < TIMESTAMP '1997-01-01' AND l_discount BETWEEN 0.0099 AND 0.0301 AND l_quantity < 25")
sql("ssb_1_2", f"SELECT round(sum(l_extendedprice * l_discount), 4) AS revenue FROM {FLIGHT} WHERE o_orderdate >= TIMESTAMP '1997-01-01' AND o_orderdate < TIMESTAMP '1997-02-01' AND l_discount BETWEEN 0.0399 AND 0.0601 AND l_quantity BETWEEN 26 AND 35")
sql("ssb_1_3", f"SELECT round(sum(l_extendedprice * l_discount), 4) AS revenue FROM {FLIGHT} WHERE o_orderdate >= TIMESTAMP '1997-01-01' AND o_orderdate < TIMESTAMP '1998-01-01' AND weekofyear(o_orderdate) = 6 AND l_discount BETWEEN 0.0499 AND 0.0701 AND l_quantity BETWEEN 20 AND 35")
PARTS = FLIGHT + " JOIN {part} ON l_partkey = p_partkey JOIN {supplier} ON l_suppkey = s_suppkey JOIN {nation} sn ON s_nationkey = sn.n_nationkey JOIN {region} sr ON sn.n_regionkey = sr.r_regionkey"
BY_BRAND = "SELECT round(sum(l_extendedprice * (1 - l_discount)), 4) AS revenue, CAST(year(o_orderdate) AS BIGINT) AS d_year, p_brand FROM " + PARTS
sql("ssb_2_1", f"{BY_BRAND} WHERE p_brand LIKE 'Brand#1%' AND sr.r_name = 'AMERICA' GROUP BY year(o_orderdate), p_brand")
sql("ssb_2_2", f"{BY_BRAND} WHERE p_brand BETWEEN 'Brand#21' AND 'Brand#28' AND sr.r_name = 'ASIA' GROUP BY year(o_orderdate), p_brand")
sql("ssb_2_3", f"{BY_BRAND} WHERE p_brand = 'Brand#22' AND sr.r_name = 'EUROPE' GROUP BY year(o_orderdate), p_brand")
TRADE = FLIGHT + (
    " JOIN {customer} ON o_custkey = c_custkey JOIN {supplier} ON l_suppkey = s_suppkey JOIN {nation} cn ON c_nationkey = cn.n_nationkey JOIN {nation} sn ON s_nationkey = sn.n_nationkey"
    " JOIN {region} cr ON cn.n_regionkey = cr.r_regionkey JOIN {region} sr ON sn.n_regionkey = sr.r_regionkey")
BY_NATION = "SELECT cn.n_name AS c_nation, sn.n_name AS s_nation, CAST(year(o_orderdate) AS BIGINT) AS d_year, round(sum(l_extendedprice), 4) AS revenue FROM " + TRADE
sql("ssb_3_1", f"{BY_NATION} WHERE cr.r_name = 'ASIA' AND sr.r_name = 'ASIA' AND o_orderdate >= TIMESTAMP '1992-01-01' AND o_orderdate < TIMESTAMP '1998-01-01' GROUP BY cn.n_name, sn.n_name, year(o_orderdate)")
sql("ssb_3_2", f"{BY_NATION} WHERE cn.n_name = 'NATION_3' AND sn.n_name = 'NATION_3' GROUP BY cn.n_name, sn.n_name, year(o_orderdate)")
sql("ssb_3_3", f"{BY_NATION} WHERE cn.n_name IN ('NATION_3', 'NATION_7') AND sn.n_name IN ('NATION_3', 'NATION_8', 'NATION_2') GROUP BY cn.n_name, sn.n_name, year(o_orderdate)")
sql("ssb_3_4", f"{BY_NATION} WHERE cr.r_name = 'EUROPE' AND sr.r_name = 'ASIA' AND o_orderdate >= TIMESTAMP '1997-12-01' AND o_orderdate < TIMESTAMP '1998-01-01' GROUP BY cn.n_name, sn.n_name, year(o_orderdate)")
PROFIT = TRADE + " JOIN {part} ON l_partkey = p_partkey"
GAIN = "round(sum(l_extendedprice * (1 - l_discount) - 0.5 * p_retailprice * l_quantity), 4) AS profit FROM " + PROFIT
sql("ssb_4_1", f"SELECT CAST(year(o_orderdate) AS BIGINT) AS d_year, cn.n_name AS c_nation, {GAIN} WHERE cr.r_name = 'AMERICA' AND sr.r_name = 'AMERICA' GROUP BY year(o_orderdate), cn.n_name")
sql("ssb_4_2", f"SELECT CAST(year(o_orderdate) AS BIGINT) AS d_year, sn.n_name AS s_nation, p_type, {GAIN} WHERE cr.r_name = 'AMERICA' AND o_orderdate >= TIMESTAMP '1997-01-01' AND o_orderdate < TIMESTAMP '1999-01-01' GROUP BY year(o_orderdate), sn.n_name, p_type")
sql("ssb_4_3", f"SELECT CAST(year(o_orderdate) AS BIGINT) AS d_year, s_name, p_brand, {GAIN} WHERE sr.r_name = 'AMERICA' AND p_brand LIKE 'Brand#1%' GROUP BY year(o_orderdate), s_name, p_brand")

sql("q2_least_price", """
SELECT s_acctbal, s_name, n_name, p_partkey, p_brand, l_extendedprice FROM {part} JOIN {lineitem} ON p_partkey = l_partkey JOIN {supplier} ON s_suppkey = l_suppkey
JOIN {nation} ON s_nationkey = n_nationkey JOIN {region} ON n_regionkey = r_regionkey
WHERE p_size = 15 AND r_name = 'EUROPE' AND l_extendedprice = (
  SELECT min(m.l_extendedprice) FROM {lineitem} m JOIN {supplier} b ON b.s_suppkey = m.l_suppkey JOIN {nation} c ON b.s_nationkey = c.n_nationkey JOIN {region} d ON c.n_regionkey = d.r_regionkey
  WHERE m.l_partkey = p_partkey AND d.r_name = 'EUROPE')
ORDER BY s_acctbal DESC, n_name, s_name, p_partkey, l_extendedprice LIMIT 100""")
sql("q4_order_priority", """
SELECT o_orderpriority, count(*) AS order_count FROM {orders} WHERE o_orderdate >= TIMESTAMP '1997-01-01' AND o_orderdate < TIMESTAMP '1998-01-01'
AND EXISTS (SELECT 1 FROM {lineitem} WHERE l_orderkey = o_orderkey AND l_returnflag = 'R' AND l_quantity > 40) GROUP BY o_orderpriority""")
sql("q9_product_profit", """
SELECT n_name, CAST(year(o_orderdate) AS BIGINT) AS o_year, round(sum(l_extendedprice * (1 - l_discount) - 0.5 * p_retailprice * l_quantity), 4) AS profit
FROM {lineitem} JOIN {part} ON p_partkey = l_partkey JOIN {supplier} ON s_suppkey = l_suppkey JOIN {orders} ON o_orderkey = l_orderkey JOIN {nation} ON s_nationkey = n_nationkey
WHERE p_name LIKE '%ring%' GROUP BY n_name, year(o_orderdate)""")
sql("q11_important_parts", """
SELECT l_partkey, round(sum(l_extendedprice), 4) AS value FROM {lineitem} JOIN {supplier} ON l_suppkey = s_suppkey JOIN {nation} ON s_nationkey = n_nationkey WHERE n_name IN ('NATION_1', 'NATION_3')
GROUP BY l_partkey HAVING sum(l_extendedprice) > (
  SELECT 2 * avg(v) FROM (SELECT sum(l_extendedprice) AS v FROM {lineitem} JOIN {supplier} ON l_suppkey = s_suppkey JOIN {nation} ON s_nationkey = n_nationkey WHERE n_name IN ('NATION_1', 'NATION_3') GROUP BY l_partkey) t)""")
sql("q12_line_status", """
SELECT l_linestatus, CAST(sum(CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 1 ELSE 0 END) AS BIGINT) AS high_line_count,
       CAST(sum(CASE WHEN o_orderpriority NOT IN ('1-URGENT', '2-HIGH') THEN 1 ELSE 0 END) AS BIGINT) AS low_line_count
FROM {orders} JOIN {lineitem} ON o_orderkey = l_orderkey WHERE l_returnflag IN ('A', 'R') AND l_shipdate >= TIMESTAMP '1996-01-01' AND l_shipdate < TIMESTAMP '1997-01-01'
GROUP BY l_linestatus""")
sql("q16_part_suppliers", """
SELECT p_brand, p_type, p_size, count(DISTINCT l_suppkey) AS supplier_cnt FROM {lineitem} JOIN {part} ON p_partkey = l_partkey
WHERE p_brand <> 'Brand#5' AND p_type NOT LIKE 'PROMO%' AND p_size IN (3, 9, 14, 19, 23, 36, 45, 49) AND l_suppkey NOT IN (SELECT s_suppkey FROM {supplier} WHERE s_acctbal < 1000)
GROUP BY p_brand, p_type, p_size""")
sql("q19_discounted_revenue", """
SELECT round(sum(l_extendedprice * (1 - l_discount)), 4) AS revenue FROM {lineitem} JOIN {part} ON p_partkey = l_partkey
WHERE (p_brand = 'Brand#1' AND l_quantity BETWEEN 1 AND 11 AND p_size BETWEEN 1 AND 15) OR (p_brand = 'Brand#2' AND l_quantity BETWEEN 10 AND 20 AND p_size BETWEEN 1 AND 30)
   OR (p_brand = 'Brand#3' AND l_quantity BETWEEN 20 AND 30 AND p_size BETWEEN 1 AND 45)""")
sql("q20_part_promotion", """
SELECT s_name, s_acctbal FROM {supplier} JOIN {nation} ON s_nationkey = n_nationkey WHERE n_regionkey = 1 AND s_suppkey IN (
  SELECT l_suppkey FROM {lineitem} o WHERE l_partkey IN (SELECT p_partkey FROM {part} WHERE p_name LIKE 'small%')
  AND l_quantity > (SELECT 1.5 * avg(i.l_quantity) FROM {lineitem} i WHERE i.l_partkey = o.l_partkey AND i.l_shipdate >= TIMESTAMP '1994-01-01'))""")
sql("q21_waiting_suppliers", """
SELECT s_name, count(*) AS numwait FROM {supplier} JOIN {lineitem} a ON s_suppkey = a.l_suppkey JOIN {orders} ON o_orderkey = a.l_orderkey JOIN {nation} ON s_nationkey = n_nationkey
WHERE o_orderstatus = 'F' AND a.l_shipdate > o_orderdate AND n_name IN ('NATION_3', 'NATION_15')
AND EXISTS (SELECT 1 FROM {lineitem} b WHERE b.l_orderkey = a.l_orderkey AND b.l_suppkey <> a.l_suppkey)
AND NOT EXISTS (SELECT 1 FROM {lineitem} c WHERE c.l_orderkey = a.l_orderkey AND c.l_suppkey <> a.l_suppkey AND c.l_returnflag = 'R')
GROUP BY s_name ORDER BY numwait DESC, s_name LIMIT 100""")
sql("q22_idle_customers", """
SELECT c_mktsegment, count(*) AS numcust, round(sum(c_acctbal), 4) AS totacctbal FROM {customer}
WHERE c_nationkey IN (1, 3, 5, 7, 11, 13, 17) AND c_acctbal > (SELECT avg(c_acctbal) FROM {customer} WHERE c_acctbal > 0 AND c_nationkey IN (1, 3, 5, 7, 11, 13, 17))
AND NOT EXISTS (SELECT 1 FROM {orders} WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT') GROUP BY c_mktsegment""")

sql("ds_class_share", """
SELECT p_brand, p_type, revenue, round(revenue * 100 / sum(revenue) OVER (PARTITION BY p_type), 6) AS share
FROM (SELECT p_brand, p_type, round(sum(l_extendedprice), 4) AS revenue FROM {lineitem} JOIN {part} ON l_partkey = p_partkey GROUP BY p_brand, p_type) t""")
sql("ds_rank_in_month", """
SELECT * FROM (SELECT CAST(m AS TIMESTAMP_NTZ) AS m, o_orderpriority, total, CAST(rank() OVER (PARTITION BY m ORDER BY total DESC) AS BIGINT) AS rk
FROM (SELECT date_trunc('month', o_orderdate) AS m, o_orderpriority, round(sum(o_totalprice), 4) AS total FROM {orders} GROUP BY date_trunc('month', o_orderdate), o_orderpriority) a) b WHERE rk <= 2""",
    """SELECT * FROM (SELECT m, o_orderpriority, total, rank() OVER (PARTITION BY m ORDER BY total DESC) AS rk
FROM (SELECT date_trunc('month', o_orderdate) AS m, o_orderpriority, round(sum(o_totalprice), 4) AS total FROM {orders} GROUP BY 1, 2) a) b WHERE rk <= 2""")
sql("ds_year_over_year", """
WITH y AS (SELECT o_custkey, CAST(year(o_orderdate) AS BIGINT) AS yr, round(sum(o_totalprice), 4) AS total FROM {orders} GROUP BY o_custkey, year(o_orderdate))
SELECT a.o_custkey, a.yr, a.total, b.total AS before, round(a.total / b.total, 6) AS growth FROM y a JOIN y b ON a.o_custkey = b.o_custkey AND a.yr = b.yr + 1 WHERE a.total > 2 * b.total""")
sql("ds_rollup_rank", """
SELECT r_name, n_name, total, CAST(rank() OVER (PARTITION BY lvl ORDER BY total DESC) AS BIGINT) AS rk FROM (
  SELECT r_name, n_name, grouping(n_name) AS lvl, round(sum(c_acctbal), 4) AS total FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey JOIN {region} ON n_regionkey = r_regionkey
  GROUP BY ROLLUP (r_name, n_name)) t WHERE r_name IS NOT NULL""")
