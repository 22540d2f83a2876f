"""Scanned files as a stream: each batch takes the place of older rows of its paths."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from rolegraph.operators.sequences import latest_by


def keep_latest(scans: DataFrame, log: str, checkpoint: str) -> StreamingQuery:
    """Appends every batch of a stream of scanned rows to a log of Parquet, stamped with the batch; an append of the same
    batch after a failure is told apart by its number, so reading the log stays right."""

    def append(batch: DataFrame, number: int) -> None:
        batch.withColumn("_batch", F.lit(number).cast("long")).write.mode("append").parquet(log)

    return scans.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current(log: DataFrame) -> DataFrame:
    """The latest row of each path."""
    return latest_by(log, ["path"], ["_batch", "mtime"]).drop("_batch")


def late_events(events: DataFrame, key: str, time: str, width: str, late: str) -> DataFrame:
    """Counts by key and window of event time, final once the watermark has passed."""
    return events.withWatermark(time, late).groupBy(F.window(time, width), key).agg(F.count("*").alias("events"))
