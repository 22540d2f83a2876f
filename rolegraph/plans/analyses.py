"""Measurements made elsewhere: how they attach to files, and when they stop to hold."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rolegraph.functions.text import file_name
from rolegraph.plans.incremental import upsert


def outcomes(records: DataFrame, files: DataFrame) -> DataFrame:
    """``records`` (path, size, mtime, ...) with ``outcome`` and ``at``: matched by path, moved (same name and size elsewhere,
    the first such path), stale (the file changed since), or waiting for its file."""
    known = files.select(F.col("path").alias("_path"), F.col("size").alias("_size"), F.col("mtime").alias("_mtime"))
    named = files.groupBy(file_name(F.col("path")).alias("_name"), F.col("size").alias("_same")).agg(F.min_by(F.struct("path", "mtime"), "path").alias("_other"))
    joined = records.join(known, F.col("path") == F.col("_path"), "left").join(named, (file_name(F.col("path")) == F.col("_name")) & (F.col("size") == F.col("_same")), "left")
    here, other = F.col("_path").isNotNull(), F.col("_other").isNotNull()
    holds = F.when(here, (F.col("size") == F.col("_size")) & (F.col("mtime") == F.col("_mtime"))).otherwise(F.col("mtime") == F.col("_other.mtime"))
    outcome = F.when(~here & ~other, "waiting").when(~holds, "stale").when(here, "matched").otherwise("moved")
    return joined.select(*records.columns, outcome.alias("outcome"), F.when(outcome == "moved", F.col("_other.path")).otherwise(F.col("path")).alias("at"))


def merge(old: DataFrame, records: DataFrame, files: DataFrame) -> DataFrame:
    """Analyses by (path, source) after an import: stale records go, later ones (by ``seq``) take the place of earlier ones."""
    placed = outcomes(records, files).where("outcome <> 'stale'").withColumn("path", F.col("at")).drop("outcome", "at")
    return upsert(old, placed, ["path", "source"], "seq")


def reconcile(analyses: DataFrame, files: DataFrame) -> DataFrame:
    """Waiting records move to a file of their name, size and time, unless its (path, source) is taken."""
    seen = outcomes(analyses, files)
    taken = analyses.select(F.col("path").alias("at"), "source")
    moved = seen.where("outcome = 'moved'").join(taken, ["at", "source"], "left_anti").withColumn("path", F.col("at")).select(*analyses.columns)
    stay = seen.where("outcome <> 'moved'").select(*analyses.columns)
    left = seen.where("outcome = 'moved'").join(taken, ["at", "source"], "left_semi").select(*analyses.columns)
    return upsert(stay.unionByName(left), moved, ["path", "source"], "seq")


def pending(analyses: DataFrame, files: DataFrame) -> DataFrame:
    return analyses.join(files.select("path"), "path", "left_anti")


def forget(analyses: DataFrame, source: str | None = None) -> DataFrame:
    return analyses.where(F.lit(False)) if source is None else analyses.where(F.col("source") != source)
