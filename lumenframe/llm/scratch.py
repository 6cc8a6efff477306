"""Lineage cuts: intermediate tables written to the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``. Where it is unset, a local session gets a temporary
    folder of its own; a cluster must name one, as its executors share no local disk."""
    place = spark.conf.get("spark.checkpoint.dir", None)
    if place:
        return place.rstrip("/")
    master = spark.conf.get("spark.master", "")
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    place = tempfile.mkdtemp(prefix="lumenframe-")
    spark.conf.set("spark.checkpoint.dir", place)
    return place


def table_path(spark: SparkSession, label: str) -> str:
    """A path that no other call gets."""
    return f"{shared_dir(spark)}/lumenframe/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: the result has no lineage that a lost
    executor would make Spark repeat, and its size is known to the planner."""
    path = table_path(df.sparkSession, label)
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._lumen_path = path  # type: ignore[attr-defined]
    return out


def discard(df: DataFrame | None) -> None:
    """Delete a table that ``materialize`` wrote and that no later step reads."""
    path = getattr(df, "_lumen_path", None)
    if path is None:
        return
    jvm = df.sparkSession._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(target, True)
