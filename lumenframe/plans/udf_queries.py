"""User functions of every kind, checked against built-in SQL."""

from __future__ import annotations

import pandas as pd
import pyarrow as pa
from pyspark.sql import Window
from pyspark.sql import functions as F

from lumenframe.functions import udfs
from lumenframe.plans.registry import query
from lumenframe.sources.io import table, tables


@query("SELECT l_orderkey, l_linenumber, round(l_extendedprice * (1 + l_tax), 4) AS gross FROM lineitem WHERE l_quantity > 45")
def udf_pandas(spark, sf_dir):
    lineitem = table(spark, sf_dir, "lineitem").where("l_quantity > 45")
    return lineitem.select("l_orderkey", "l_linenumber", F.round(udfs.plus_tax("l_extendedprice", "l_tax"), 4).alias("gross"))


@query("SELECT l_orderkey, l_linenumber, round(l_extendedprice * (1 + l_tax) / 2, 6) AS half FROM lineitem WHERE l_quantity > 45")
def udf_arrow_chain(spark, sf_dir):
    """Two Arrow functions, one on the other's result, evaluated in one Python step."""
    lineitem = table(spark, sf_dir, "lineitem").where("l_quantity > 45")
    return lineitem.select("l_orderkey", "l_linenumber", F.round(udfs.halved(udfs.plus_tax("l_extendedprice", "l_tax")), 6).alias("half"))


@query("SELECT c_custkey, c_acctbal * 2 AS twice FROM customer")
def udf_iterator(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", udfs.doubled("c_acctbal").alias("twice"))


@query("SELECT p_partkey, list_reduce(list_transform(string_split(p_name, ' '), lambda w: w[1]), lambda a, b: a || b) AS i FROM part")
def udf_scalar(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", udfs.initials("p_name").alias("i"))


@query("SELECT c_mktsegment, round(avg(c_acctbal), 6) AS mean FROM customer GROUP BY c_mktsegment")
def udaf_pandas(spark, sf_dir):
    return table(spark, sf_dir, "customer").groupBy("c_mktsegment").agg(F.round(udfs.mean_of("c_acctbal"), 6).alias("mean"))


@query("SELECT c_custkey, round(avg(c_acctbal) OVER (PARTITION BY c_mktsegment), 6) AS mean FROM customer")
def udf_window(spark, sf_dir):
    mean = udfs.mean_of("c_acctbal").over(Window.partitionBy("c_mktsegment"))
    return table(spark, sf_dir, "customer").select("c_custkey", F.round(mean, 6).alias("mean"))


@query("SELECT DISTINCT w AS word FROM (SELECT unnest(string_split(p_name, ' ')) AS w FROM part) t")
def udtf_words(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    spark.udtf.register("lumen_words", udfs.Words)
    return spark.sql("SELECT DISTINCT word FROM {part}, LATERAL lumen_words(p_name)", part=part)


@query("SELECT page_id, url AS plain FROM pages")
def udf_urldecoder(spark, sf_dir):
    """A registered name that a built-in replaces, from SQL and from the DataFrame API."""
    pages = table(spark, sf_dir, "pages")
    udfs.register(spark)
    coded = pages.select("page_id", udfs.call("UrlEncoder", F.col("url")).alias("coded"))
    return spark.sql("SELECT page_id, UrlDecoder(coded) AS plain FROM {coded}", coded=coded)


@query("SELECT c_nationkey, count(*) AS n, round(max(c_acctbal) - min(c_acctbal), 4) AS spread FROM customer GROUP BY c_nationkey")
def udf_grouped_map(spark, sf_dir):
    def spread(rows: pd.DataFrame) -> pd.DataFrame:
        x = rows["c_acctbal"]
        return pd.DataFrame({"c_nationkey": [rows["c_nationkey"].iloc[0]], "n": [len(rows)], "spread": [round(x.max() - x.min(), 4)]})

    customer = table(spark, sf_dir, "customer").select("c_nationkey", "c_acctbal")
    return customer.groupBy("c_nationkey").applyInPandas(spread, "c_nationkey int, n long, spread double")


@query("SELECT n_nationkey, (SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey) AS customers, (SELECT count(*) FROM supplier WHERE s_nationkey = n_nationkey) AS suppliers FROM nation WHERE n_nationkey IN (SELECT c_nationkey FROM customer)")
def udf_cogrouped_map(spark, sf_dir):
    def both(key, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"n_nationkey": [key[0]], "customers": [len(a)], "suppliers": [len(b)]}) if len(a) else pd.DataFrame({"n_nationkey": [], "customers": [], "suppliers": []})

    customer, supplier = tables(spark, sf_dir, "customer", "supplier")
    a, b = customer.select(F.col("c_nationkey").alias("k")), supplier.select(F.col("s_nationkey").alias("k"))
    return a.groupBy("k").cogroup(b.groupBy("k")).applyInPandas(both, "n_nationkey int, customers long, suppliers long")


@query("SELECT l_orderkey, l_quantity * 2 AS twice FROM lineitem WHERE l_linenumber = 1")
def udf_map_in_pandas(spark, sf_dir):
    def double(batches):
        for rows in batches:
            yield pd.DataFrame({"l_orderkey": rows["l_orderkey"], "twice": rows["l_quantity"] * 2})

    first = table(spark, sf_dir, "lineitem").where("l_linenumber = 1").select("l_orderkey", "l_quantity")
    return first.mapInPandas(double, "l_orderkey long, twice double")


@query("SELECT c_custkey, upper(c_name) AS name FROM customer")
def udf_map_in_arrow(spark, sf_dir):
    import pyarrow.compute as pc

    def upper(batches):
        for rows in batches:
            yield pa.RecordBatch.from_arrays([rows.column(0), pc.utf8_upper(rows.column(1))], names=["c_custkey", "name"])

    return table(spark, sf_dir, "customer").select("c_custkey", "c_name").mapInArrow(upper, "c_custkey long, name string")


@query("SELECT c_mktsegment, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE length(n_name) > 5 GROUP BY c_mktsegment HAVING count(*) > 1")
def udf_in_clauses(spark, sf_dir):
    """Functions in the WHERE, JOIN, GROUP BY and HAVING clauses."""
    customer, nation = tables(spark, sf_dir, "customer", "nation")
    same = F.pandas_udf(lambda x: x, "int")
    size = F.pandas_udf(lambda x: x.str.len(), "int")
    joined = customer.withColumn("k", same("c_nationkey")).join(nation.where(size("n_name") > 5), F.col("k") == F.col("n_nationkey"))
    text = F.pandas_udf(lambda x: x, "string")
    counted = joined.groupBy(text("c_mktsegment").alias("c_mktsegment")).agg(F.count(F.lit(1)).alias("n"))
    return counted.where(same(F.col("n").cast("int")) > 1)
