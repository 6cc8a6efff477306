"""One reader and writer for all formats.

``read`` takes a format name and the options of Spark's own source. Every file format goes through
Spark's scan, so partition discovery, column pruning, predicate push-down, schema merging and
missing columns (read as null) behave alike; small files are packed into splits by
``spark.sql.files.maxPartitionBytes`` and ``spark.sql.files.openCostInBytes``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

FORMATS = ("parquet", "orc", "csv", "json", "text", "jdbc")
#: Options that a format gets unless the caller names them.
DEFAULTS = {"csv": {"header": "true"}, "parquet": {"mergeSchema": "false"}}


def read(spark: SparkSession, path: str | list[str] | None, fmt: str = "parquet", schema=None, columns: list[str] | None = None, where: str | None = None, **options) -> DataFrame:
    """A source as a DataFrame; ``path`` is None for jdbc, whose options name the table. ``columns`` and ``where`` reach the scan where the format can
    use them; text formats should be given a ``schema``, as inferring one reads the files first."""
    if fmt not in FORMATS:
        raise ValueError(f"unknown format {fmt!r}; one of {', '.join(FORMATS)}")
    reader = spark.read.format(fmt).options(**DEFAULTS.get(fmt, {}) | {k: str(v) for k, v in options.items()})
    if schema is not None:
        reader = reader.schema(schema)
    df = reader.load(path) if path is not None else reader.load()
    if where:
        df = df.where(where)
    return df.select(*columns) if columns else df


def write(df: DataFrame, path: str | None, fmt: str = "parquet", mode: str = "error", partition_by: tuple[str, ...] = (), **options) -> None:
    """Writes a DataFrame; ``partition_by`` makes folders that later reads prune by."""
    writer = df.write.format(fmt).mode(mode).options(**DEFAULTS.get(fmt, {}) | {k: str(v) for k, v in options.items()})
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.save(path)


def create_table(df: DataFrame, name: str, fmt: str = "parquet", mode: str = "error", bucket_by: tuple[int, tuple[str, ...]] | None = None, partition_by: tuple[str, ...] = (), path: str | None = None) -> None:
    """A catalog table, external if it has a ``path``. Tables bucketed alike join on the bucket columns without an exchange."""
    writer = df.write.format(fmt).mode(mode)
    if path:
        writer = writer.option("path", path)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if bucket_by:
        writer = writer.bucketBy(bucket_by[0], *bucket_by[1]).sortBy(*bucket_by[1])
    writer.saveAsTable(name)
