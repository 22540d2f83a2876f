"""What changed between two states, and how later records take the place of earlier ones."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rolegraph.operators.sequences import latest_by


def diff(before: DataFrame, now: DataFrame, key: list[str], fresh: list[str]) -> DataFrame:
    """(key, state): reused where ``fresh`` agrees, changed, new, or removed.  One full join on the key."""
    b, n = before.select(*[F.col(c).alias(f"b_{c}") for c in [*key, *fresh]]), now.select(*key, *fresh)
    same = F.lit(True)
    for c in key:
        same = same & (F.col(c) == F.col(f"b_{c}"))
    agree = F.lit(True)
    for c in fresh:
        agree = agree & F.col(c).eqNullSafe(F.col(f"b_{c}"))
    state = F.when(F.col(key[0]).isNull(), "removed").when(F.col(f"b_{key[0]}").isNull(), "new").when(agree, "reused").otherwise("changed")
    return n.join(b, same, "full").select(*[F.coalesce(c, f"b_{c}").alias(c) for c in key], state.alias("state"))


def carry_over(before: DataFrame, listing: DataFrame, key: list[str], fresh: list[str]) -> tuple[DataFrame, DataFrame]:
    """(rows of ``before`` that still hold, rows of ``listing`` that have to be read)."""
    on = [*key, *fresh]
    return before.join(listing.select(*on), on, "left_semi"), listing.join(before.select(*on), on, "left_anti")


def rescan(before: DataFrame, listing: DataFrame, read: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Scanned files after a new listing (path, size, mtime): rows that still hold are kept, ``read`` makes those of new and
    changed files, and files that are gone go."""
    kept, again = carry_over(before, listing, ["path"], ["size", "mtime"])
    return kept.unionByName(read(again), allowMissingColumns=True)


def upsert(old: DataFrame, new: DataFrame, key: list[str], seq: str) -> DataFrame:
    """Records by key, the one of largest ``seq`` winning; of equal ones the new."""
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    return latest_by(both, key, [seq, "_new"]).drop("_new")
