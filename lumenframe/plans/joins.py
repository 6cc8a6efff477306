"""Joins of all types and strategies, and subqueries."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumenframe.operators import joins as J
from lumenframe.plans.registry import ORACLES, QUERIES, query, sql
from lumenframe.sources.io import table, tables

#: How each strategy is asked for.
STRATEGIES = {"bhj": "broadcast", "shj": "shuffle_hash", "smj": "merge"}
TYPES = {
    "inner": ("JOIN", "c_custkey, c_name, o_orderkey, o_totalprice"),
    "left": ("LEFT JOIN", "c_custkey, c_name, o_orderkey, o_totalprice"),
    "right": ("RIGHT JOIN", "c_custkey, c_name, o_orderkey, o_totalprice"),
    "semi": ("SEMI JOIN", "c_custkey, c_name"),
    "anti": ("ANTI JOIN", "c_custkey, c_name"),
}


def _strategy_join(strategy: str, how: str):
    def run(spark, sf_dir):
        customer, orders = tables(spark, sf_dir, "customer", "orders")
        # the broadcast form takes the dimension as build side where the type allows it
        some = orders.where("o_totalprice > 100000").select("o_orderkey", "o_custkey", "o_totalprice")
        left = customer.where("c_acctbal > 0").select("c_custkey", "c_name")
        on = left.c_custkey == some.o_custkey
        if strategy == "bhj" and how in ("inner", "right"):
            joined = J.broadcast_if_small(left).join(some, on, how)
        elif strategy == "bhj":
            joined = left.join(J.broadcast_if_small(some), on, how)
        else:
            joined = left.join(some.hint(STRATEGIES[strategy]), on, how)
        return joined.drop("o_custkey")

    return run


for _s in STRATEGIES:
    for _t, (_word, _columns) in TYPES.items():
        QUERIES[f"join_{_s}_{_t}"] = _strategy_join(_s, {"semi": "left_semi", "anti": "left_anti"}.get(_t, _t))
        ORACLES[f"join_{_s}_{_t}"] = (
            f"SELECT {_columns} FROM (SELECT * FROM customer WHERE c_acctbal > 0) c {_word} "
            "(SELECT * FROM orders WHERE o_totalprice > 100000) o ON c_custkey = o_custkey")

sql("join_full_outer", "SELECT n_name, s_name FROM (SELECT * FROM {nation} WHERE n_nationkey < 15) n FULL OUTER JOIN (SELECT * FROM {supplier} WHERE s_acctbal > 3000) s ON s_nationkey = n_nationkey")
sql("join_cross", "SELECT r_name, n_name FROM {region} CROSS JOIN {nation}")
sql("join_theta", "SELECT a.n_name AS a_name, b.n_name AS b_name FROM {nation} a JOIN {nation} b ON a.n_regionkey < b.n_regionkey AND a.n_nationkey > b.n_nationkey")
sql("join_residual", "SELECT o_orderkey, l_linenumber FROM {orders} JOIN {lineitem} ON o_orderkey = l_orderkey AND l_extendedprice > o_totalprice / 4")
sql("join_residual_left", "SELECT o_orderkey, l_linenumber FROM {orders} LEFT JOIN {lineitem} ON o_orderkey = l_orderkey AND l_extendedprice > o_totalprice / 2")
sql("join_using", "SELECT n_nationkey, a.n_name FROM {nation} a JOIN {nation} b USING (n_nationkey)")
sql("join_natural", "SELECT n_nationkey, n_name, n_regionkey FROM {nation} NATURAL JOIN (SELECT n_nationkey, n_regionkey FROM {nation} WHERE n_regionkey > 1) t")
sql("join_lateral", "SELECT n_name, t.top FROM {nation}, LATERAL (SELECT max(s_acctbal) AS top FROM {supplier} WHERE s_nationkey = n_nationkey) t")
sql("lateral_view", "SELECT word, count(*) AS n FROM (SELECT explode(split(p_name, ' ')) AS word FROM {part}) t GROUP BY word", "SELECT word, count(*) AS n FROM (SELECT unnest(string_split(p_name, ' ')) AS word FROM {part}) t GROUP BY word")


@query("SELECT a.c_custkey AS a_key, b.c_custkey AS b_key FROM customer a JOIN customer b ON a.c_nationkey = b.c_nationkey AND a.c_mktsegment = b.c_mktsegment AND a.c_custkey < b.c_custkey")
def join_self(spark, sf_dir):
    return J.pairs_within(table(spark, sf_dir, "customer"), ["c_nationkey", "c_mktsegment"], "c_custkey", "a_key", "b_key")


@query("SELECT a.n_name AS a_name, b.n_name AS b_name FROM (SELECT *, nullif(n_regionkey, 2) AS k FROM nation) a JOIN (SELECT *, nullif(n_regionkey, 2) AS k FROM nation) b ON a.k IS NOT DISTINCT FROM b.k")
def join_null_safe(spark, sf_dir):
    nation = table(spark, sf_dir, "nation").select("n_name", F.nullif("n_regionkey", F.lit(2)).alias("k"))
    a, b = nation.select(F.col("n_name").alias("a_name"), F.col("k").alias("ka")), nation.select(F.col("n_name").alias("b_name"), F.col("k").alias("kb"))
    return J.null_safe(a, b, [("ka", "kb")]).select("a_name", "b_name")


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)")
def join_not_in(spark, sf_dir):
    customer, orders = tables(spark, sf_dir, "customer", "orders")
    return J.not_in(customer, "c_custkey", orders.where("o_totalprice > 300000"), "o_custkey").select("c_custkey")


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT nullif(o_custkey, 1) FROM orders)")
def join_not_in_null(spark, sf_dir):
    customer, orders = tables(spark, sf_dir, "customer", "orders")
    held = orders.select(F.nullif("o_custkey", F.lit(1)).alias("k"))
    return J.not_in(customer, "c_custkey", held, "k").select("c_custkey")


@query("SELECT c_custkey, EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'O') AS has_open FROM customer")
def join_existence(spark, sf_dir):
    customer, orders = tables(spark, sf_dir, "customer", "orders")
    still_open = orders.where("o_orderstatus = 'O'").select(F.col("o_custkey").alias("c_custkey"))
    return J.with_mark(customer.select("c_custkey"), still_open, ["c_custkey"], "has_open")


@query("SELECT l_orderkey, l_linenumber, o_orderdate FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_quantity > 45")
def join_salted(spark, sf_dir):
    lineitem, orders = tables(spark, sf_dir, "lineitem", "orders")
    left = lineitem.where("l_quantity > 45").select("l_orderkey", "l_linenumber")
    return J.salted(left, orders.select(F.col("o_orderkey").alias("l_orderkey"), "o_orderdate"), ["l_orderkey"], 4)


@query("""SELECT e.event_id, s.event_id AS start_id FROM events e JOIN (SELECT event_id, user_id, ts FROM events WHERE event_type = 'purchase') s
ON e.user_id = s.user_id AND e.ts >= s.ts AND e.ts <= s.ts + INTERVAL 1 HOUR""")
def join_interval(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    points = events.select("event_id", "user_id", micros.alias("at"))
    spans = events.where("event_type = 'purchase'").select(F.col("event_id").alias("start_id"), "user_id", micros.alias("low"))
    hour = 3_600_000_000
    return J.interval_join(points, spans, F.col("at"), F.col("low"), F.col("low") + hour, ["user_id"], hour).select("event_id", "start_id")


for _name, _hint in (("broadcast", "BROADCAST(n)"), ("merge", "MERGE(n)"), ("shuffle_hash", "SHUFFLE_HASH(n)"), ("replicate_nl", "SHUFFLE_REPLICATE_NL(n)")):
    sql(f"join_hint_{_name}", f"SELECT /*+ {_hint} */ c_custkey, n_name FROM {{customer}} c JOIN {{nation}} n ON c_nationkey = n_nationkey", "SELECT c_custkey, n_name FROM {customer} c JOIN {nation} n ON c_nationkey = n_nationkey")

sql("sub_exists", "SELECT c_custkey FROM {customer} WHERE EXISTS (SELECT 1 FROM {orders} WHERE o_custkey = c_custkey AND o_totalprice > 200000)")
sql("sub_not_exists", "SELECT c_custkey FROM {customer} WHERE NOT EXISTS (SELECT 1 FROM {orders} WHERE o_custkey = c_custkey AND o_totalprice > 300000)")
sql("sub_exists_or", "SELECT c_custkey FROM {customer} WHERE c_acctbal > 8000 OR EXISTS (SELECT 1 FROM {orders} WHERE o_custkey = c_custkey AND o_totalprice > 300000)")
sql("sub_exists_aggregate", "SELECT s_suppkey FROM {supplier} WHERE EXISTS (SELECT l_suppkey FROM {lineitem} WHERE l_suppkey = s_suppkey GROUP BY l_suppkey HAVING count(*) > 10)")
sql("sub_exists_cte", "WITH big AS (SELECT * FROM {orders} WHERE o_totalprice > 250000) SELECT c_custkey FROM {customer} WHERE EXISTS (SELECT 1 FROM big WHERE o_custkey = c_custkey)")
sql("sub_in", "SELECT o_orderkey FROM {orders} WHERE o_custkey IN (SELECT c_custkey FROM {customer} WHERE c_mktsegment = 'MACHINERY')")
sql("sub_in_multi", "SELECT l_orderkey, l_linenumber FROM {lineitem} WHERE (l_partkey, l_suppkey) IN (SELECT p_partkey, p_size FROM {part})")
sql("sub_in_group_having", "SELECT c_custkey FROM {customer} WHERE c_custkey IN (SELECT o_custkey FROM {orders} GROUP BY o_custkey HAVING count(*) > 12)")
sql("sub_in_limit", "SELECT n_name FROM {nation} WHERE n_regionkey IN (SELECT r_regionkey FROM {region} ORDER BY r_name LIMIT 2)")
sql("sub_in_set_op", "SELECT n_name FROM {nation} WHERE n_nationkey IN (SELECT c_nationkey FROM {customer} INTERSECT SELECT s_nationkey FROM {supplier})")
sql("sub_not_in", "SELECT s_suppkey FROM {supplier} WHERE s_nationkey NOT IN (SELECT n_nationkey FROM {nation} WHERE n_regionkey = 1)")
sql("sub_not_in_multi", "SELECT n_name FROM {nation} WHERE (n_nationkey, n_regionkey) NOT IN (SELECT n_nationkey, n_regionkey FROM {nation} WHERE n_regionkey = 1)")
sql("sub_nested_not_in", "SELECT c_custkey FROM {customer} WHERE c_nationkey NOT IN (SELECT n_nationkey FROM {nation} WHERE n_regionkey NOT IN (SELECT r_regionkey FROM {region} WHERE r_name LIKE 'A%'))")
sql("sub_scalar_where", "SELECT p_partkey FROM {part} WHERE p_retailprice > (SELECT avg(p_retailprice) FROM {part})")
sql("sub_scalar_select", "SELECT n_name, (SELECT count(*) FROM {customer} WHERE c_nationkey = n_nationkey) AS customers FROM {nation}")
sql("sub_scalar_correlated", "SELECT o_orderkey FROM {orders} o WHERE o_totalprice > (SELECT 1.5 * avg(o_totalprice) FROM {orders} i WHERE i.o_custkey = o.o_custkey)")
sql("sub_from", "SELECT seg, n FROM (SELECT c_mktsegment AS seg, count(*) AS n FROM {customer} GROUP BY c_mktsegment) t WHERE n > 1")
sql("cte_nested", "WITH a AS (WITH b AS (SELECT n_regionkey AS k FROM {nation}) SELECT k, count(*) AS n FROM b GROUP BY k) SELECT r_name, n FROM a JOIN {region} ON k = r_regionkey")
