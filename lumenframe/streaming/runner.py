"""Streams run to the end of their input."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def work_dir(spark: SparkSession) -> str:
    """A new folder under spark.checkpoint.dir; a local session without one gets a temporary one."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        master = spark.conf.get("spark.master", "")
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        top = tempfile.mkdtemp(prefix="lumenframe-stream-")
    return f"{top.rstrip('/')}/stream-{uuid.uuid4().hex}"


def open_stream(spark: SparkSession, path: str, fmt: str = "parquet", max_files: int = 100, **options) -> DataFrame:
    """A file source with the schema of the files that are there. ``path`` may be a single file,
    which is then picked from its folder, as the source watches folders only."""
    held = spark.read.format(fmt).options(**options).load(path)
    folder, _, name = path.rstrip("/").rpartition("/")
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if at.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(at).isFile():
        path, options = folder, options | {"pathGlobFilter": name}
    return spark.readStream.format(fmt).schema(held.schema).option("maxFilesPerTrigger", max_files).options(**options).load(path)


def run_to_end(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Processes all input that is there and returns what the sink holds: every batch's rows for
    append and update, the last batch's for complete. A batch is written under its own number, so
    one that is repeated after a failure replaces itself."""
    spark, place = stream.sparkSession, work_dir(stream.sparkSession)
    seen: list[int] = []

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{place}/out/batch={number}")
        seen.append(number)

    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{place}/state").trigger(availableNow=True)
    running = writer.foreachBatch(keep).start()
    running.awaitTermination()
    if not seen:
        return spark.createDataFrame([], stream.schema)
    batches = [max(seen)] if mode == "complete" else sorted(set(seen))
    return spark.read.schema(stream.schema).parquet(*[f"{place}/out/batch={n}" for n in batches])
