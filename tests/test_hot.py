"""Keys that hold a third of all rows: clusters by segments, pairs by blocks."""

import random
from collections import Counter
from itertools import combinations

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from rolegraph.operators import graph, sequences


def windowed(df, keys, tolerance):
    """One task a group, for comparison."""
    order = Window.partitionBy(*keys).orderBy("ms", "path")
    far = F.coalesce((F.col("ms") - F.lag("ms").over(order) > tolerance).cast("int"), F.lit(0))
    return df.withColumn("f", far).withColumn("cluster", F.sum("f").over(order.rowsBetween(Window.unboundedPreceding, 0)).cast("long")).drop("f")


@pytest.mark.parametrize("step", [1, 40])
def test_clusters_of_a_hot_key(spark, step):
    """A third of the rows are untitled tracks of nobody; chains of close values run over many partitions."""
    r = random.Random(step)
    rows = [("", "", r.randrange(8000 * step), f"p{i}", i) for i in range(8000)] + [(f"a{r.randrange(900)}", "t", r.randrange(900), f"q{i}", i) for i in range(16000)]
    rows += [("", "", None, f"n{i}", i) for i in range(5)] + [(None, "t", r.randrange(50), f"m{i}", i) for i in range(40)] + [("same", "t", 7, f"s{i}", i) for i in range(300)]
    df = spark.createDataFrame(rows, "by string, what string, ms long, path string, size long")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = sequences.tolerance_clusters(df, ["by", "what"], "ms", "path", 3)
        assert got.columns == [*df.columns, "cluster"]
        assert sorted(map(str, got.collect())) == sorted(map(str, windowed(df, ["by", "what"], 3).collect()))
        # what a task sorts is a partition of the range, and ranges are even
        order = ["by", "what", "ms", "path"]
        sizes = sorted(x["count"] for x in df.repartitionByRange(*order).groupBy(F.spark_partition_id()).count().collect())
        assert len(sizes) == 16 and sizes[-1] <= 2 * sizes[8]
        two = sequences.clusters_of_two(df, ["by", "what"], "ms", "path", 3, "size")
        assert two.where("members < 2").count() == 0 and two.where("by = 'same'").first()["members"] == 300
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_clusters_of_nothing(spark):
    df = spark.createDataFrame([], "k string, ms long, path string")
    assert sequences.tolerance_clusters(df, ["k"], "ms", "path", 3).count() == 0


def test_pairs_of_heavy_groups(spark):
    r = random.Random(3)
    rows = [("hot", f"m{i}") for i in range(400)] + [(f"g{r.randrange(300)}", f"m{r.randrange(60)}") for _ in range(1500)] + [(None, "m1"), ("g1", None), ("hot", "m1")]
    want, groups = Counter(), {}
    for g, m in rows:
        if g and m:
            groups.setdefault(g, set()).add(m)
    for members in groups.values():
        for a, b in combinations(sorted(members), 2):
            want[a, b] += 1
            want[b, a] += 1
    edges = spark.createDataFrame(rows, "work string, who string")
    for together in (16, graph.TOGETHER, 10_000):
        assert {(x["source"], x["target"]): x["weight"] for x in graph.cooccurrence(edges, "work", "who", together).collect()} == want


def test_a_large_group_is_spread(spark):
    """The pairs of 3,000 members are made in many places, none of which holds more than two blocks."""
    edges = spark.range(3000).select(F.lit("hot").alias("work"), F.col("id").alias("who"))
    got = graph.cooccurrence(edges, "work", "who").agg(F.count("*").alias("n"), F.min("weight").alias("w")).first()
    assert tuple(got) == (3000 * 2999, 1)
    blocks = -(-3000 // graph.TOGETHER)
    dealt = edges.groupBy(F.pmod(F.xxhash64("who"), F.lit(blocks))).count()
    assert blocks == 12 and dealt.agg(F.max("count")).first()[0] < 1.3 * graph.TOGETHER
