"""Integrity checks in batches that outlive a stop: a queue of files is a stream, each batch of it one step that is kept.

The queue is a folder of small Parquet files, BATCH rows each, written once.  A stream reads one or a few of them at a time;
its checkpoint says which are done.  The verdicts of a batch go to a folder of the batch's own number, which a batch that is
run again replaces, so a run that was stopped goes on with the next batch, and at most the batch in hand is read again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from rolegraph.operators.frozen import durable, exists
from rolegraph.sources.listing import in_scope

#: Files that are checked between two steps.
BATCH = 250
QUEUE = "path string, size bigint, mtime bigint"
VERDICT = "path string, size bigint, mtime bigint, state string, method string, detail string, checked_at bigint, error string"


def enqueue(files: DataFrame, folder: str, places: list[str] | None = None, full: bool = False, batch: int = BATCH) -> None:
    """Writes the queue of those files (path, size, mtime, integrity) that have no verdict, or of all with ``full``; ``places``
    restricts them.  A folder that has a queue keeps it: the check that it belongs to is not over."""
    if exists(files.sparkSession, f"{folder}/queue/_SUCCESS"):
        return
    rows = in_scope(files, places or [])
    rows = durable((rows if full else rows.where(F.col("integrity").isNull())).select("path", "size", "mtime"))
    # Files of ``batch`` rows: in a range partition each run of so many rows is a file.
    rows.repartitionByRange("path").sortWithinPartitions("path").write.mode("overwrite").option("maxRecordsPerFile", batch).parquet(f"{folder}/queue")


def run(spark: SparkSession, folder: str, verify: Callable[[DataFrame], DataFrame], files_at_a_time: int = 1) -> StreamingQuery:
    """Goes through what is left of the queue.  ``verify`` makes verdicts (``VERDICT``; ``error`` where a file can't be read,
    which is no verdict) from (path, size, mtime)."""
    queue = spark.readStream.schema(QUEUE).option("maxFilesPerTrigger", files_at_a_time).parquet(f"{folder}/queue")

    def step(batch: DataFrame, number: int) -> None:
        verify(batch).select(*StructType.fromDDL(VERDICT).names).write.mode("overwrite").parquet(f"{folder}/verdicts/batch={number}")

    return queue.writeStream.foreachBatch(step).option("checkpointLocation", f"{folder}/steps").trigger(availableNow=True).start()


def verdicts(spark: SparkSession, folder: str) -> DataFrame:
    """What the check has said so far, one row a file."""
    if not exists(spark, f"{folder}/verdicts"):
        return spark.createDataFrame([], VERDICT)
    said = spark.read.schema(VERDICT).option("basePath", f"{folder}/verdicts").parquet(f"{folder}/verdicts/batch=*")
    return said.select(*StructType.fromDDL(VERDICT).names)


def applied(files: DataFrame, said: DataFrame) -> DataFrame:
    """``files`` with new verdicts in place of their own; a verdict on a file that changed since does not count."""
    told = said.where("error is null").select(
        F.col("path").alias("_path"), F.col("size").alias("_size"), F.col("mtime").alias("_mtime"), F.struct("state", "method", "detail", "checked_at").alias("_said"),
    )
    joined = files.join(told, (F.col("path") == F.col("_path")) & (F.col("size") == F.col("_size")) & (F.col("mtime") == F.col("_mtime")), "left")
    return joined.select(*[F.coalesce("_said", "integrity").alias("integrity") if c == "integrity" else F.col(c) for c in files.columns])


def progress(spark: SparkSession, folder: str) -> DataFrame:
    """One row: files in the queue, files with a verdict, files that could not be read."""
    queue = spark.read.schema(QUEUE).parquet(f"{folder}/queue").agg(F.count("*").alias("queued"))
    said = verdicts(spark, folder).agg(F.count_if(F.col("error").isNull()).alias("checked"), F.count_if(F.col("error").isNotNull()).alias("failed"))
    return queue.join(F.broadcast(said))  # one row each
