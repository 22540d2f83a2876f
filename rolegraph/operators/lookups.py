"""Lookups by key and ranked search, and windows of a listing."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rolegraph.functions.text import normalize, search_score


def needle_of(df: DataFrame, text: str) -> str:
    """The matching key of a typed text."""
    return df.sparkSession.range(1).select(normalize(F.lit(text))).first()[0]


def exact_or_partial(df: DataFrame, key: str, text: str) -> DataFrame:
    """Rows whose key is the typed text's, or, only if there are none, holds it; ``match`` says which."""
    needle = normalize(F.lit(text))
    hits = df.where((needle != "") & F.col(key).contains(needle)).withColumn("match", F.when(F.col(key) == needle, "exact").otherwise("partial"))
    any_exact = hits.agg(F.coalesce(F.bool_or(F.col("match") == "exact"), F.lit(False)).alias("_any"))  # one row
    return hits.join(F.broadcast(any_exact)).where((F.col("match") == "exact") | ~F.col("_any")).drop("_any")


def ranked_search(tables: list[tuple[str, DataFrame, str, str]], text: str, limit: int) -> DataFrame:
    """(score, kind, id, name): the best hits over (kind, table, id, name), by score, order of tables, length in bytes, name."""
    out = None
    for rank, (kind, df, key, name) in enumerate(tables):
        one = df.select(F.lit(rank).alias("_rank"), F.lit(kind).alias("kind"), F.col(key).cast("long").alias("id"), F.col(name).alias("name"), search_score(normalize(F.col(name)), normalize(F.lit(text))).alias("score")).where("score is not null")
        out = one if out is None else out.unionByName(one)
    return out.orderBy("score", "_rank", F.octet_length("name"), "name", "id").limit(limit).drop("_rank")


def append_distinct(parts: list[DataFrame], key: str) -> DataFrame:
    """The rows of the first table, then those of each next one whose key is not there yet; ``part`` counts tables from 0."""
    out = None
    for rank, df in enumerate(parts):
        one = df.withColumn("part", F.lit(rank))
        out = one if out is None else out.unionByName(one)
    names = [c for c in out.columns if c != key]
    kept = out.groupBy(key).agg(F.min(F.struct(F.col("part").alias("_first"), *names)).alias("_row"))
    return kept.select(key, *[F.col(f"_row.{c}").alias(c) for c in names]).orderBy("part", key)


@dataclass(frozen=True)
class Page:
    """A window of a listing: ``limit`` rows (None: all) from ``offset`` on."""

    limit: int | None = 50
    offset: int = 0

    def __post_init__(self) -> None:
        if self.limit is not None and self.limit < 1 or self.offset < 0:
            raise ValueError("a window needs a limit of 1 or more and an offset of 0 or more")

    def of(self, df: DataFrame) -> DataFrame:
        """The window of ``df``, which has to be in a total order."""
        df = df.offset(self.offset) if self.offset else df
        return df if self.limit is None else df.limit(self.limit)

    def shown(self, total: int) -> tuple[int, int] | None:
        """First and last place shown, from 1; None past the end."""
        if self.offset >= total:
            return None
        return self.offset + 1, total if self.limit is None else min(self.offset + self.limit, total)
