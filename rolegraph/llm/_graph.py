"""Connected components by contraction, for graphs that no single task holds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rolegraph.llm._rows import Stored, durable, loose


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for the nodes of ``edges`` (a long, b long); the root is the smallest node of the component.

    Each round gives every node a hash of its own, points it to the one of least hash among itself and its neighbours, and
    maps both ends of each edge along, until no edge is left.  Hashes differ from round to round, so whatever the shape of
    the graph (a chain of ascending numbers too) at least half of the nodes with an edge are expected to go in two rounds.
    Neighbours are only ever reduced to their minimum, so a node with a third of all edges is no burden.  Rounds are written
    tables: a checkpoint would carry what its plan says of columns and partitions into the next, which grows with each.
    """
    a, b = F.least("a", "b"), F.greatest("a", "b")
    table = Stored(edges.where("a is not null and b is not null").select(a.alias("a"), b.alias("b")).where("a <> b").distinct())
    points = []
    while True:
        left = table.read()
        ranked = left.select(*[F.struct(F.xxhash64(c, F.lit(len(points))).alias("h"), c).alias(c) for c in ("a", "b")])
        low = F.least(F.struct(F.col("a.h"), F.col("a.a").alias("v")), F.struct(F.col("b.h"), F.col("b.b").alias("v")))
        end = F.explode(F.array(F.struct(F.col("a.a").alias("node"), low.alias("to")), F.struct(F.col("b.b").alias("node"), low.alias("to"))))
        point = Stored(ranked.select(end.alias("e")).groupBy("e.node").agg(F.min("e.to").alias("to")).select("node", F.col("to.v").alias("root")))
        points.append(point)
        point = point.read()
        ends = [loose(point.select(F.col("node").alias(c), F.col("root").alias(f"_{c}")), c) for c in ("a", "b")]
        moved = left.join(ends[0], "a").join(ends[1], "b").select(F.least("_a", "_b").alias("a"), F.greatest("_a", "_b").alias("b"))
        shorter = Stored(moved.where("a <> b").distinct())
        table.drop()
        table = shorter
        if not table.read().take(1):
            break
    table.drop()
    roots = points[0].read()
    for point in points[1:]:
        step = loose(point.read().select(F.col("node").alias("root"), F.col("root").alias("_next")), "root")
        roots = roots.join(step, "root", "left").select("node", F.coalesce("_next", "root").alias("root"))
    roots = durable(roots)
    least = loose(roots.groupBy("root").agg(F.min("node").alias("least")), "root")
    out = durable(roots.join(least, "root").select("node", F.col("least").alias("root")))
    for point in points:
        point.drop()
    return out
