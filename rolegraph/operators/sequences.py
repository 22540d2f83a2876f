"""Operators on ordered rows: gaps, clusters within a tolerance, first and last values, dense ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rolegraph.operators.frozen import durable


def sequence_gaps(df: DataFrame, keys: list[str], number: str, listed: int = 12) -> DataFrame:
    """(keys, present, missing, n_missing): numbers of 1..max that a group lacks, for groups that lack any.

    The numbers present are collected once a group, so one shuffle does; a gap is what lies between a number and the one before
    it, so its cost is that of the numbers present, however large they are.  ``missing`` lists the first ``listed``,
    ``n_missing`` counts all.
    """
    groups = df.where(F.col(number).isNotNull()).groupBy(*keys).agg(F.sort_array(F.collect_set(F.col(number).cast("long"))).alias("_all"))
    before = lambda i: F.greatest(F.coalesce(F.get("_all", i - 1), F.lit(0)), F.lit(0))
    gaps = F.transform("_all", lambda n, i: F.struct((before(i) + 1).alias("start"), F.greatest(n - 1 - before(i), F.lit(0)).alias("lack")))
    lacking = groups.withColumn("_gaps", F.filter(gaps, lambda g: g["lack"] > 0)).where(F.size("_gaps") > 0)
    some = F.flatten(F.transform(F.slice("_gaps", 1, listed), lambda g: F.sequence(g["start"], g["start"] + F.least(g["lack"], F.lit(listed)) - 1)))
    total = F.aggregate("_gaps", F.lit(0).cast("long"), lambda x, g: x + g["lack"])
    kind = df.schema[number].dataType.simpleString()
    return lacking.select(*keys, F.col("_all").cast(f"array<{kind}>").alias("present"), F.slice(some, 1, listed).cast("array<int>").alias("missing"), total.alias("n_missing"))


def tolerance_clusters(df: DataFrame, keys: list[str], value: str, tie: str, tolerance: float) -> DataFrame:
    """Adds ``cluster``, from 0 in each group: a value within ``tolerance`` of the one before it stays in its cluster.  Rows
    without a value come first and begin no cluster.

    No task holds a group.  Rows are range-partitioned by group, value and tie, so a group that holds a third of all rows is
    cut into as many segments as it fills partitions.  Clusters are numbered inside segments; then the segments of a group, one
    row each, say where a cluster goes on across a seam and how many clusters stand before.  Only segments behind a seam get
    a number to add, at most one a partition, so that table can be broadcast.
    """
    order = [*keys, value, tie]
    part, first = "_segment", F.row_number().over(Window.partitionBy("_segment", *keys).orderBy(value, tie)) == 1
    placed = durable(df.repartitionByRange(*order).sortWithinPartitions(*order)).withColumn(part, F.spark_partition_id())
    inside = Window.partitionBy(part, *keys).orderBy(value, tie)
    far = F.coalesce((F.col(value) - F.lag(value).over(inside) > tolerance).cast("int"), F.lit(0))
    flagged = placed.withColumn("_far", F.when(first, 0).otherwise(far))
    placed = flagged.withColumn("_own", F.sum("_far").over(inside.rowsBetween(Window.unboundedPreceding, 0)).cast("long"))
    ends = F.struct(value, tie)
    segments = placed.groupBy(part, *keys).agg(F.min(ends).alias("_low"), F.max(ends).alias("_high"), F.max("_own").alias("_breaks"))
    along = Window.partitionBy(*keys).orderBy(part)
    seam = F.coalesce((F.col("_low")[value] - F.lag("_high").over(along)[value] > tolerance).cast("long"), F.lit(0))
    before = F.sum(F.col("_seam") + F.coalesce("_past", F.lit(0))).over(along.rowsBetween(Window.unboundedPreceding, 0))
    told = segments.withColumns({"_seam": seam, "_past": F.lag("_breaks").over(along)}).withColumn("_before", before).where("_before > 0")
    told = told.select(F.col(part).alias("_at"), *[F.col(k).alias(f"_key{i}") for i, k in enumerate(keys)], "_before")
    same = F.col(part) == F.col("_at")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_key{i}"))
    # One group of a partition at most began in an earlier one, so ``told`` has fewer rows than there are partitions.
    return placed.join(F.broadcast(told), same, "left").select(*df.columns, (F.col("_own") + F.coalesce("_before", F.lit(0))).alias("cluster"))


def clusters_of_two(df: DataFrame, keys: list[str], value: str, tie: str, tolerance: float, size: str) -> DataFrame:
    """(keys, cluster, members, wasted): clusters of two or more; wasted is all sizes but that of the first member."""
    placed = tolerance_clusters(df, keys, value, tie, tolerance)
    first = F.min_by(size, F.struct(F.col(value), F.col(tie)))
    return placed.groupBy(*keys, "cluster").agg(F.count("*").alias("members"), (F.sum(size) - first).alias("wasted")).where("members > 1")


def first_wins(df: DataFrame, keys: list[str], columns: list[str], order: Column) -> DataFrame:
    """The first value that is not null of each column, by ``order``, in each group."""
    return df.groupBy(*keys).agg(*[F.min_by(F.col(c), F.when(F.col(c).isNotNull(), order)).alias(c) for c in columns])


def latest_by(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each group: an upsert in which later records replace earlier ones."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_row")).select(*keys, "_row.*")


def dense_ids(df: DataFrame, key: str, order: list[str], name: str = "id") -> DataFrame:
    """(name, key): 0, 1, 2... in the order in which keys first appear.

    Distinct keys are range-partitioned and frozen, since bounds of ranges are sampled, then numbered by partition, with one
    count a partition added up in one place.
    """
    first = df.groupBy(key).agg(F.min(F.struct(*order)).alias("_first"))
    placed = durable(first.repartitionByRange("_first", key).sortWithinPartitions("_first", key)).withColumn("_at", F.monotonically_increasing_id()).withColumn("_part", F.shiftright("_at", 33))
    counts = placed.groupBy("_part").agg(F.count("*").alias("_n"))
    before = counts.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    return placed.join(F.broadcast(before), "_part").select((F.col("_before") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))).alias(name), key)


def numbered_in(df: DataFrame, keys: list[str], order: list[Column], name: str) -> DataFrame:
    """Adds the place of each row in its group, from 1."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
