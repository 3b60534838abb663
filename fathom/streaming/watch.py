"""Keeping an index up to date from a stream of snapshots of files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from fathom.operators import tables as T


def watch(files: DataFrame, target: str, checkpoint: str, keys: list[str], order: str) -> StreamingQuery:
    """Merge each micro-batch of a stream of rows into Parquet snapshots below `target`, the last by `order` winning within a batch.

    Snapshots are named by batch and get their name once they are whole, so readers see no half of one; a batch that
    runs again after a failure leaves a snapshot that is there as it is.
    """

    def merge(batch: DataFrame, n: int) -> None:
        spark, new = batch.sparkSession, T.last_writer(batch, keys, order)
        fs_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        fs = fs_path(target).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        done = sorted(int(s.getPath().getName()[1:]) for s in fs.listStatus(fs_path(target)) if s.getPath().getName()[1:].isdigit()) if fs.exists(fs_path(target)) else []
        if n in done:
            return
        before = [k for k in done if k < n]
        old = spark.read.schema(batch.schema).parquet(f"{target}/b{before[-1]}") if before else None
        staging = f"{target}/_staging-{n}"
        (T.replace(old, new, keys) if old is not None else new).write.mode("overwrite").parquet(staging)
        if not fs.rename(fs_path(staging), fs_path(f"{target}/b{n}")):
            raise OSError(f"batch {n} could not be committed")

    return files.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, late: str = "10 minutes", window: str = "5 minutes") -> DataFrame:
    """Events (ts, event_type) by window and type, late ones up to `late` included."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", window), "event_type").agg(F.count("*").alias("n"))
