"""Counts, buckets, ratios and the worst of a group."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def buckets(df: DataFrame, label: Column, size: str | None = None) -> DataFrame:
    """(label, count, bytes), most first."""
    total = F.coalesce(F.sum(size), F.lit(0)).cast("long") if size else F.lit(0).cast("long")
    return df.groupBy(label.alias("label")).agg(F.count("*").alias("count"), total.alias("bytes")).orderBy(F.desc("count"), "label")


def decade(year: Column) -> Column:
    return F.coalesce((F.floor(year / 10) * 10).cast("string"), F.lit("No year"))


def ratio(part: Column, whole: Column) -> Column:
    """0 where there is nothing."""
    return F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(0.0))


def one_row(*frames: DataFrame) -> DataFrame:
    """One row from frames of one row each."""
    return reduce(lambda a, b: a.join(F.broadcast(b)), frames)


def worst_of(state: Column) -> Column:
    """Aggregate: the worst state of a group of files."""
    has = lambda x: F.coalesce(F.bool_or(state == x), F.lit(False))
    return (
        F.when(F.count("*") == 0, "").when(has("damaged"), "damaged").when(F.bool_or(state.isNull()), "not_verified")
        .when(F.bool_and(state == "nothing_to_check"), "nothing_to_check").otherwise("intact")
    )
