"""Rows that are read more than once and have to be the same each time, and the folder that all executors share."""

from __future__ import annotations

import tempfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def ship(spark: SparkSession) -> None:
    """Lets Python workers find this library where only the driver's path was set; a cluster gets it with ``--py-files``."""
    spark.sparkContext.environment.setdefault("PYTHONPATH", str(Path(__file__).resolve().parents[2]))


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; one is made only where that is unset, on a single machine."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not sc.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            folder = tempfile.mkdtemp(prefix="rolegraph-checkpoint-")
        sc.setCheckpointDir(folder)
    return sc.getCheckpointDir()


def durable(df: DataFrame) -> DataFrame:
    """``df`` frozen by ``checkpoint()`` in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def _at(spark: SparkSession, path: str):
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder, folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    folder, fs = _at(spark, path)
    return fs.exists(folder)


def make_folder(spark: SparkSession, path: str) -> None:
    folder, fs = _at(spark, path)
    fs.mkdirs(folder)


def drop_folder(spark: SparkSession, path: str) -> None:
    """Deletes a folder that this library wrote."""
    folder, fs = _at(spark, path)
    fs.delete(folder, True)
