"""Edges between entities: pairs that occur together, sets of neighbours, roles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Roles of those who play; all others write or produce.
PERFORMING = ("main", "album", "featured", "performer", "conductor", "remixer")


#: Members of a group that are paired with each other in one place.
TOGETHER = 256


def cooccurrence(edges: DataFrame, group: str, member: str, together: int = TOGETHER) -> DataFrame:
    """(source, target, weight): in how many groups two members stand together, in both directions.

    The self-join is on the group, so its cost is the sum of squared group sizes.  A group of more than ``together`` members is
    dealt into blocks, and each pair of blocks (a block with itself too) is a place of its own: its pairs are made in as many
    tasks as there are places, and a member is sent as often as there are blocks.  Pairs are counted one way and doubled after
    the count, which halves the shuffle.
    """
    once = edges.where(F.col(group).isNotNull() & F.col(member).isNotNull()).select(group, member).distinct()
    sizes = once.groupBy(F.col(group).alias("_of")).agg(F.ceil(F.count("*") / F.lit(float(together))).cast("int").alias("_blocks"))
    large = sizes.where("_blocks > 1")
    dealt = once.join(large, F.col(group) == F.col("_of"), "left").select(group, member, F.coalesce("_blocks", F.lit(1)).alias("_n"))
    dealt = dealt.withColumn("_block", F.pmod(F.xxhash64(member), F.col("_n")).cast("int"))
    left = dealt.select(F.col(group).alias("_g"), F.col("_block").alias("_x"), F.explode(F.sequence(F.col("_block"), F.col("_n") - 1)).alias("_y"), F.col(member).alias("_a"))
    right = dealt.select(F.col(group).alias("_g"), F.explode(F.sequence(F.lit(0), F.col("_block"))).alias("_x"), F.col("_block").alias("_y"), F.col(member).alias("_b"))
    met = left.join(right, ["_g", "_x", "_y"]).where((F.col("_x") < F.col("_y")) | (F.col("_a") < F.col("_b")))
    pairs = met.groupBy(F.least("_a", "_b").alias("source"), F.greatest("_a", "_b").alias("target")).agg(F.count("*").alias("weight"))
    both = F.explode(F.array(F.struct("source", "target"), F.struct(F.col("target").alias("source"), F.col("source").alias("target"))))
    return pairs.select(both.alias("e"), "weight").select("e.source", "e.target", "weight")


def neighbours(pairs: DataFrame, names: DataFrame, key: str, name: str, source: int) -> DataFrame:
    """Targets of one source with their names, by weight, then name, then id."""
    return pairs.where(F.col("source") == source).join(names.select(F.col(key).alias("target"), F.col(name).alias("name")), "target").select("target", "name", "weight").orderBy(F.desc("weight"), "name", "target")


def common_groups(edges: DataFrame, group: str, member: str, a: int, b: int) -> DataFrame:
    """Groups in which both members stand; of one member with itself, all its groups."""
    of = lambda x: edges.where(F.col(member) == x).select(group)
    return of(a).intersect(of(b))


def role_counts(credits: DataFrame, keys: list[str], **counts: str) -> DataFrame:
    """Credits for each of ``keys``; ``counts`` names distinct counts of other columns."""
    return credits.groupBy(*keys).agg(F.count("*").alias("credits"), *[F.countDistinct(c).alias(n) for n, c in counts.items()])


def without(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """Distinct keys of ``left`` that ``right`` lacks."""
    return left.select(*on).distinct().join(right.select(*on).distinct(), on, "left_anti")
