"""Physical plans are the ones asked for."""

from __future__ import annotations

import pytest

from lumenframe.operators import joins as J
from lumenframe.operators.windows import top_per_group
from lumenframe.plans.catalogue import QUERIES
from lumenframe.sources.io import table


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name, node", [("bhj", "BroadcastHashJoin"), ("shj", "ShuffledHashJoin"), ("smj", "SortMergeJoin")])
@pytest.mark.parametrize("how", ["inner", "left", "semi", "anti"])
def test_join_strategy(spark, sf_dir, name, node, how):
    assert node in plan(QUERIES[f"join_{name}_{how}"](spark, sf_dir))


def test_scan_gets_filters_and_columns(spark, sf_dir):
    text = plan(QUERIES["io_pushed_filters"](spark, sf_dir))
    pushed = text[text.index("PushedFilters") :]
    assert "GreaterThan(l_quantity,49.0)" in pushed and "IsNotNull(l_orderkey)" in pushed
    assert "ReadSchema: struct<l_orderkey:bigint,l_quantity:double>" in text


def test_partition_filter(spark, sf_dir):
    assert "PartitionFilters: [isnotnull(o_orderstatus" in plan(QUERIES["io_partition_pruning"](spark, sf_dir))


def test_rank_limit_before_exchange(spark, sf_dir):
    from pyspark.sql import functions as F

    df = top_per_group(table(spark, sf_dir, "customer"), ["c_nationkey"], [F.desc("c_acctbal")], 3, ties=True)
    assert plan(df).count("WindowGroupLimit") == 2


def test_two_phase_aggregate(spark, sf_dir):
    text = plan(QUERIES["q1_pricing_summary"](spark, sf_dir))
    assert "partial_sum" in text and text.count("Exchange") == 1


def test_bucketed_join_needs_no_exchange(spark, sf_dir):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert "Exchange" not in plan(QUERIES["io_bucketed_join"](spark, sf_dir))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_interval_join_is_an_equi_join(spark, sf_dir):
    assert "NestedLoop" not in plan(QUERIES["join_interval"](spark, sf_dir))


def test_large_sides_are_not_marked(spark, sf_dir):
    lineitem = table(spark, sf_dir, "lineitem")
    assert J.broadcast_if_small(lineitem, limit=10) is lineitem
    assert J.broadcast_if_small(lineitem) is not lineitem


def test_chained_arrow_functions_run_once(spark, sf_dir):
    assert plan(QUERIES["udf_arrow_chain"](spark, sf_dir)).count("ArrowEvalPython") == 1


def test_mapped_function_stays_in_the_jvm(spark, sf_dir):
    assert "Python" not in plan(QUERIES["udf_urldecoder"](spark, sf_dir))


def test_runtime_filter_prunes_partitions(spark, sf_dir, tmp_path):
    """The small side's filter reaches the partitioned side's scan at run time."""
    table(spark, sf_dir, "orders").write.partitionBy("o_orderpriority").parquet(str(tmp_path / "orders"))
    orders = spark.read.parquet(str(tmp_path / "orders"))
    wanted = spark.createDataFrame([("1-URGENT", 1), ("5-LOW", 2)], "o_orderpriority string, k int").write
    wanted.parquet(str(tmp_path / "wanted"))
    joined = orders.join(spark.read.parquet(str(tmp_path / "wanted")).where("k = 1"), "o_orderpriority")
    assert "dynamicpruning" in plan(joined)
    assert {r.o_orderpriority for r in joined.collect()} == {"1-URGENT"}


@pytest.mark.parametrize("name", ["ssb_1_1", "ssb_1_2", "ssb_1_3", "ssb_3_1", "ssb_4_2", "q4_order_priority"])
def test_dates_reach_the_scan(spark, sf_dir, name):
    assert "GreaterThanOrEqual(o_orderdate" in plan(QUERIES[name](spark, sf_dir))


def test_not_in_is_an_anti_join(spark, sf_dir):
    nation, customer = table(spark, sf_dir, "nation"), table(spark, sf_dir, "customer")
    text = plan(J.not_in(nation, "n_nationkey", customer, "c_nationkey"))
    assert "LeftAnti" in text and "NestedLoop" not in text
