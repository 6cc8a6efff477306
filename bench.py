"""Times headline queries: one warm-up, then the median of three runs into a sink that keeps nothing.

Beside each, in turn with it, runs a baseline: the SQL that checks the query, as plain Spark SQL over
views of the files, in a session of its own with Spark's default settings. Both open the files of their
tables in each run. SQL that is not Spark's has no baseline.

Prints one JSON line: "queries" and "baseline" hold seconds, "ratio" the baseline's by the queries' total
over the queries that have both. BENCH_SF_DIR and BENCH_CPUS set the data and the number of cores.
"""

from __future__ import annotations

import json
import os
import re
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = (
    "q1_pricing_summary", "q3_shipping_priority", "q5_local_supplier", "q6_revenue_forecast", "q7_volume_shipping", "q8_market_share",
    "q10_returned_items", "q13_customer_distribution", "q14_promo_effect", "q15_top_supplier", "q17_small_orders", "q18_large_orders",
    "ssb_1_1", "ssb_2_1", "ssb_3_1", "ssb_4_1",
    "join_bhj_inner", "join_shj_inner", "join_smj_inner", "join_smj_semi", "join_not_in", "agg_multi_distinct", "agg_rollup", "agg_stddev",
    "win_rank", "win_sum_running_range", "win_topk_rank_lt", "set_intersect", "topk", "string_lengths", "regex", "json_object", "udf_pandas",
)


def main() -> None:
    from lumenframe import get_spark
    from lumenframe.plans.catalogue import ORACLES, QUERIES
    from lumenframe.sources.io import TABLES

    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = get_spark("bench", f"local[{cpus}]", **{
        "spark_sql_shuffle_partitions": cpus, "spark_ui_enabled": "false", "spark_driver_memory": "8g", "spark_ui_showConsoleProgress": "false",
    })
    spark.sparkContext.setLogLevel("ERROR")
    plain = spark.newSession()
    for key in ("spark.sql.ansi.enabled", "spark.sql.adaptive.enabled"):
        plain.conf.unset(key)
    plain.conf.set("spark.sql.timestampType", "TIMESTAMP_NTZ")  # literals as DuckDB reads them

    def plainly(name):
        for used in set(re.findall(r"\w+", ORACLES[name])) & set(TABLES):
            plain.read.parquet(f"{sf_dir}/{used}.parquet").createOrReplaceTempView(used)
        return plain.sql(ORACLES[name])

    took, baseline = {}, {}
    for name in HEADLINE:
        runs = {"took": lambda name=name: QUERIES[name](spark, sf_dir), "baseline": lambda name=name: plainly(name)}
        times: dict[str, list[float]] = {which: [] for which in runs}
        for _ in range(4):
            for which in list(runs):
                began = time.perf_counter()
                try:
                    runs[which]().write.format("noop").mode("overwrite").save()
                except Exception:  # only the baseline may fail: its SQL is DuckDB's
                    if which == "took":
                        raise
                    del runs[which], times[which]
                    continue
                times[which].append(time.perf_counter() - began)
        took[name] = round(statistics.median(times["took"][1:]), 4)
        if "baseline" in times:
            baseline[name] = round(statistics.median(times["baseline"][1:]), 4)
    ratio = round(sum(baseline.values()) / sum(took[name] for name in baseline), 3) if baseline else None
    spark.stop()
    print(json.dumps({"metric": "headline queries, total of medians", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "baseline": baseline, "ratio": ratio, "sf": sf_dir.rsplit("sf", 1)[-1]}))


if __name__ == "__main__":
    main()
