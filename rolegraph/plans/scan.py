"""Folders to a maintained catalog in one call: list, tell what changed, read heads of that alone, take it in."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rolegraph.operators.frozen import durable, exists
from rolegraph.plans import analyses, catalog
from rolegraph.plans.maintained import BUCKETS, Maintained
from rolegraph.sources import heads, listing


@dataclass
class Scan:
    """What a scan found: the catalog, counts of files, those it could not read (path, problem), and analyses, if any."""

    held: Maintained
    counts: dict[str, int]
    failures: DataFrame
    analysis: DataFrame | None


def read_files(files: DataFrame) -> DataFrame:
    """Scanned files, without covers and verdicts, and ``problem``, from listed ones (path, size, mtime)."""
    read = heads.read_heads(heads.heads(files))
    none = F.lit(None).cast("struct<state:string,method:string,detail:string,checked_at:bigint>")
    return read.withColumns({"folder_cover": F.lit(None).cast("string"), "integrity": none})


def scan(spark: SparkSession, places: list[str], folder: str, report_format: str | None = None, analysis: DataFrame | None = None, buckets: int = BUCKETS) -> Scan:
    """Brings the catalog below ``folder`` up to what stands below the places; makes it where there is none.

    Files with a problem keep their row and are listed as failures.  Reports (of ``report_format``) that lie among the files are
    taken in, and records of ``analysis`` that waited for a file find it.
    """
    found = durable(listing.listing(spark, [r["place"] for r in listing.top_places(spark.createDataFrame([(p,) for p in places], "place string")).collect()]))
    files, covers = listing.audio_files(found), listing.covers(found)
    problems: list[DataFrame] = []

    def read(again: DataFrame) -> DataFrame:
        rows = durable(read_files(again))
        problems.append(rows.where("problem is not null").select("path", "problem"))
        return rows.drop("problem")

    if exists(spark, f"{folder}/layout/_SUCCESS"):
        held = Maintained(spark, folder)
    else:
        empty = spark.createDataFrame([], catalog.SCANNED)
        held = Maintained.create(empty, folder, buckets)
    counts = held.refresh(files, covers, read)
    stand = held.table("file").select("path", "size", "mtime")
    if report_format:
        records = listing.reports_below(found, report_format)
        analysis = analyses.merge(records.where("false") if analysis is None else analysis, records, stand)
    if analysis is not None:
        analysis = analyses.reconcile(analysis, stand)
    return Scan(held, counts, problems[0], analysis)
