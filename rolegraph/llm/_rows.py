"""Row numbers without a single-task sort, and what is frozen in the shared folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def ship(spark: SparkSession) -> None:
    """Lets Python workers find this library where only the driver's path was set; a cluster gets it with ``--py-files``."""
    spark.sparkContext.environment.setdefault("PYTHONPATH", str(Path(__file__).resolve().parents[2]))


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; only where that is unset, as in tests on one machine, one is made."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not sc.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            folder = tempfile.mkdtemp(prefix="rolegraph-checkpoint-")
        sc.setCheckpointDir(folder)
    return sc.getCheckpointDir()


#: Narrow tables of more rows than this are not broadcast.
BROADCAST_ROWS = 200_000
#: Spark's own setting by which a finished query gives its shuffle files back.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_given_back(spark: SparkSession) -> Iterator[None]:
    """Queries made in here drop their shuffle files as they end, so disk holds those of one step at a time."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)


def durable(df: DataFrame) -> DataFrame:
    """``df`` frozen by ``checkpoint()`` in the shared folder; its shuffle files are dropped with it."""
    shared_folder(df.sparkSession)
    with shuffles_given_back(df.sparkSession):
        return df.select("*").checkpoint(eager=True)


class Stored:
    """``df`` written as Parquet in the shared folder: smaller than a checkpoint where it holds texts, and read by columns."""

    def __init__(self, df: DataFrame) -> None:
        self.spark, self.path = df.sparkSession, f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
        with shuffles_given_back(self.spark):
            df.select("*").write.option("compression", "zstd").parquet(self.path)

    def read(self) -> DataFrame:
        return self.spark.read.parquet(self.path)

    def drop(self) -> None:
        """Frees the disk; what was read from it and is not frozen is lost."""
        drop_folder(self.spark, self.path)


def drop_folder(spark: SparkSession, path: str) -> None:
    """Deletes a folder that this library wrote."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def fresh(df: DataFrame, name: str) -> str:
    """``name``, or, where ``df`` has such a column, one that it has not."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def loose(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` without what Spark knows of its partitioning by these long columns: a join then exchanges both sides, and
    adaptive execution can split the partition of a hot key."""
    return df.withColumns({k: F.col(k).bitwiseXOR(F.lit(0)) for k in keys})


def numbered(df: DataFrame, order: list[str], number: str, within: str | None = None) -> DataFrame:
    """Adds ``number``: 0, 1, 2... by ``order``, or, with ``within``, by ``order`` in each value of that column.

    The rows are range-partitioned and sorted, then frozen, so a value that holds a third of all rows is cut by the
    further order columns.  Only one count for each partition (and value) is added up in one place.
    """
    keys = ([within] if within else []) + order
    frozen = durable(df.repartitionByRange(*[F.col(k).asc_nulls_first() for k in keys]).sortWithinPartitions(*[F.col(k).asc_nulls_first() for k in keys]))
    at: Column = F.monotonically_increasing_id()
    placed = frozen.withColumns({"_part": F.shiftright(at, 33), "_at": at.bitwiseAND(F.lit((1 << 33) - 1))})
    group = ["_part"] + ([within] if within else [])
    counts = placed.groupBy(*group).agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    order_parts = (Window.partitionBy(within) if within else Window.partitionBy()).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.withColumn("_before", F.coalesce(F.sum("_n").over(order_parts), F.lit(0))).drop("_n")
    if within:
        starts = starts.withColumnRenamed(within, "_within")
    # A row of starts for each partition, and for each value on from it; values may be many, so their number is checked.
    starts = durable(starts.withColumnRenamed("_part", "_of_part"))
    on = F.col("_part") == F.col("_of_part")
    if within:
        on = on & F.col(within).eqNullSafe(F.col("_within"))
    joined = placed.join(F.broadcast(starts) if starts.count() <= BROADCAST_ROWS else starts, on).withColumn(number, F.col("_before") + F.col("_at") - F.col("_first"))
    return joined.select(*df.columns, number)
