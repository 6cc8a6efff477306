"""Sources and sinks: each format written and read back, pruning, evolution, caching."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumenframe.plans.registry import query
from lumenframe.sources.formats import create_table, read, write
from lumenframe.sources.io import register, table
from lumenframe.streaming.runner import work_dir

#: Rows in one bucket, on average. One task reads and sorts a bucket, so buckets grow in number and not in size.
BUCKET_ROWS = 1_000_000


def buckets(rows: int) -> int:
    """How many buckets a table of so many rows gets: 4 at least, and as many as Spark allows at most."""
    return min(100_000, max(4, -(-rows // BUCKET_ROWS)))


NATION = "SELECT n_nationkey, n_name, n_regionkey FROM nation"


def _round_trip(fmt, **options):
    def run(spark, sf_dir):
        nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey")
        path = f"{work_dir(spark)}/nation"
        write(nation, path, fmt, **options)
        return read(spark, path, fmt, schema=nation.schema, columns=nation.columns, **options)

    return run


for _fmt, _options in (("parquet", {}), ("orc", {}), ("csv", {}), ("json", {})):
    _fn = _round_trip(_fmt, **_options)
    _fn.__name__ = f"io_{_fmt}"
    query(NATION)(_fn)
_fn = _round_trip("csv", sep="\t")
_fn.__name__ = "io_csv_tab"
query(NATION)(_fn)
_fn = _round_trip("parquet", compression="zstd")
_fn.__name__ = "io_parquet_zstd"
query(NATION)(_fn)


@query("SELECT n_name AS value FROM nation")
def io_text(spark, sf_dir):
    path = f"{work_dir(spark)}/names"
    write(table(spark, sf_dir, "nation").select(F.col("n_name").alias("value")), path, "text")
    return read(spark, path, "text")


@query("SELECT o_orderkey, o_totalprice, o_orderstatus FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 100000")
def io_partition_pruning(spark, sf_dir):
    path = f"{work_dir(spark)}/orders"
    write(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus"), path, partition_by=("o_orderstatus",))
    return read(spark, path, where="o_orderstatus = 'F' and o_totalprice > 100000", columns=["o_orderkey", "o_totalprice", "o_orderstatus"])


@query("SELECT n_nationkey, n_name, CASE WHEN n_nationkey < 10 THEN NULL ELSE n_regionkey END AS n_regionkey FROM nation")
def io_schema_merge(spark, sf_dir):
    """Files of two schemas in one folder; the column that one lacks is null there."""
    nation, path = table(spark, sf_dir, "nation"), f"{work_dir(spark)}/nation"
    write(nation.where("n_nationkey < 10").select("n_nationkey", "n_name"), f"{path}/part=1")
    write(nation.where("n_nationkey >= 10").select("n_nationkey", "n_name", "n_regionkey"), f"{path}/part=2")
    return read(spark, path, mergeSchema="true").select("n_nationkey", "n_name", "n_regionkey")


@query("SELECT n_nationkey, NULL::INTEGER AS missing FROM nation")
def io_missing_column(spark, sf_dir):
    path = f"{work_dir(spark)}/nation"
    write(table(spark, sf_dir, "nation").select("n_nationkey"), path)
    return read(spark, path, schema="n_nationkey int, missing int")


@query("SELECT l_orderkey, l_quantity FROM lineitem WHERE l_quantity > 49 AND l_orderkey IS NOT NULL")
def io_pushed_filters(spark, sf_dir):
    return read(spark, f"{sf_dir}/lineitem.parquet", where="l_quantity > 49 and l_orderkey is not null", columns=["l_orderkey", "l_quantity"])


@query("SELECT c_mktsegment, count(*) AS n FROM customer WHERE c_acctbal > 0 GROUP BY c_mktsegment")
def io_cached(spark, sf_dir):
    """A filtered scan of a cached table."""
    held = table(spark, sf_dir, "customer").select("c_mktsegment", "c_acctbal").cache()
    return held.where("c_acctbal > 0").groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT o_orderkey, count(*) AS n FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey")
def io_bucketed_join(spark, sf_dir):
    """Two tables bucketed alike: neither the join nor the aggregate exchanges them."""
    names = ("lumen_orders_b", "lumen_lineitem_b")
    orders = table(spark, sf_dir, "orders").select("o_orderkey")
    lineitem = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"))
    n = buckets(max(orders.count(), lineitem.count()))  # told by the files' footers
    for name, df in zip(names, (orders, lineitem)):
        spark.sql(f"DROP TABLE IF EXISTS {name}")
        # dealt like the buckets, so that each is one file
        create_table(df.repartition(n, "o_orderkey"), name, bucket_by=(n, ("o_orderkey",)), path=f"{work_dir(spark)}/{name}")
    return spark.table(names[0]).join(spark.table(names[1]), "o_orderkey").groupBy("o_orderkey").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT k, v FROM (VALUES (1, 'a'), (2, 'b'), (3, 'c')) t(k, v)")
def io_insert_into(spark, sf_dir):
    """CREATE TABLE, INSERT OVERWRITE and INSERT INTO."""
    spark.sql("DROP TABLE IF EXISTS lumen_insert")
    spark.sql(f"CREATE TABLE lumen_insert (k INT, v STRING) USING parquet LOCATION '{work_dir(spark)}/lumen_insert'")
    spark.sql("INSERT OVERWRITE lumen_insert VALUES (1, 'a')")
    spark.sql("INSERT INTO lumen_insert VALUES (2, 'b'), (3, 'c')")
    return spark.table("lumen_insert")


@query("SELECT r_name, count(*) AS n FROM region JOIN nation ON r_regionkey = n_regionkey GROUP BY r_name")
def io_views(spark, sf_dir):
    register(spark, sf_dir, ("region", "nation"))
    return spark.sql("SELECT r_name, count(*) AS n FROM region JOIN nation ON r_regionkey = n_regionkey GROUP BY r_name")


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation WHERE n_regionkey = 2")
def io_recover_partitions(spark, sf_dir):
    """A catalog table over folders that were written before it; the catalog learns its partitions."""
    path = f"{work_dir(spark)}/nation"
    write(table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey"), path, partition_by=("n_regionkey",))
    spark.sql("DROP TABLE IF EXISTS lumen_parts")
    spark.sql(f"CREATE TABLE lumen_parts (n_nationkey INT, n_name STRING, n_regionkey INT) USING parquet PARTITIONED BY (n_regionkey) LOCATION '{path}'")
    spark.sql("ALTER TABLE lumen_parts RECOVER PARTITIONS")
    return spark.table("lumen_parts").where("n_regionkey = 2")


@query("SELECT n_nationkey::VARCHAR AS k, n_name AS name FROM nation")
def io_script_transform(spark, sf_dir):
    """Rows through an external program."""
    nation = table(spark, sf_dir, "nation")
    return spark.sql("SELECT TRANSFORM(n_nationkey, n_name) ROW FORMAT DELIMITED FIELDS TERMINATED BY '\t' USING 'cat' AS (k STRING, name STRING) ROW FORMAT DELIMITED FIELDS TERMINATED BY '\t' FROM {nation}", nation=nation)


@query("SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY o_orderstatus")
def io_split_packing(spark, sf_dir):
    """Many small files read in few splits."""
    path = f"{work_dir(spark)}/orders"
    table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus").repartition(24).write.parquet(path)
    return read(spark, path).groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"))
