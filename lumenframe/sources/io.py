"""Tables of a data directory: one Parquet file or folder each."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from lumenframe.session import configure

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)


#: Schemas of files that have not changed since they were inferred, by path, time and length.
_known: dict[tuple[str, int, int], StructType] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table as a DataFrame; filters and columns are pushed into its scan. Inferring a schema takes
    a job, so that of a single file is kept for as long as the file stays as it was."""
    path = f"{sf_dir}/{name}.parquet"
    reader = configure(spark).read
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    status = at.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(at)
    if not status.isFile():
        return reader.parquet(path)
    key = (path, status.getModificationTime(), status.getLen())
    if key not in _known:
        _known[key] = reader.parquet(path).schema
    return reader.schema(_known[key]).parquet(path)


def tables(spark: SparkSession, sf_dir: str, *names: str) -> list[DataFrame]:
    return [table(spark, sf_dir, name) for name in names]


def register(spark: SparkSession, sf_dir: str, names: tuple[str, ...] = TABLES) -> None:
    """Makes the tables temporary views, for use from SQL."""
    for name in names:
        table(spark, sf_dir, name).createOrReplaceTempView(name)
