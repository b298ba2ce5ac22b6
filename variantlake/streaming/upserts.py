"""Streaming extensions: rows that arrive continuously are merged, deduplicated and counted."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.versions import current_version


def windowed_counts(stream: DataFrame, ts: str, group: list[str], length: str, delay: str) -> DataFrame:
    """Rows per tumbling window and group; rows later than ``delay`` don't count."""
    counted = stream.withWatermark(ts, delay).groupBy(F.window(ts, length), *group).agg(F.count("*").alias("n"))
    return counted.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), *group, "n")


def first_reports(stream: DataFrame, ts: str, key: list[str], delay: str) -> DataFrame:
    """Each report once, repeats within ``delay`` dropped."""
    return stream.withWatermark(ts, delay).dropDuplicatesWithinWatermark(key)


def upsert_stream(stream: DataFrame, path: str, checkpoint: str, key: list[str], version: str) -> StreamingQuery:
    """Keeps the newest row of each key at ``path``: every batch is merged with what is there and written beside it.

    A batch writes to a folder named by its number, and the table is what the largest finished number holds, so a
    batch that runs again after a failure gives the same folder.
    """
    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        rows = batch
        before = latest(spark, path, number)
        if before is not None:
            rows = spark.read.parquet(before).unionByName(batch, allowMissingColumns=True)
        current_version(rows, key, [F.desc(version)]).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest(spark, path: str, before: int | None = None) -> str | None:
    """The folder of the last finished batch (before a number, if given)."""
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(root):
        return None
    found = []
    for s in fs.listStatus(root):
        name = s.getPath().getName()
        done = fs.exists(spark._jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS"))
        if name.startswith("batch=") and done and (before is None or int(name[6:]) < before):
            found.append(int(name[6:]))
    return f"{path}/batch={max(found)}" if found else None
