"""Names within a few edits of a typed one, by equal pieces and not by comparing with every name.

A name within k edits of a text, cut into k + 1 pieces, has one piece that no edit touched: it stands in the text, at most k
places from where it stands in the name.  The index holds the pieces of every name for each k that a text of fitting length
can have (k is a third of the text's length, one at least); a text asks for its own substrings at those places, an equality
join, and what meets is compared.  So answers are those of the comparison with all names.  A saved index is partitioned by k
and length, and a text reads its one k and 2 k + 1 lengths.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rolegraph.operators.lookups import needle_of

ENTRY = "piece string, at int, key string, name string, k int, length int"


def allowed(text: str) -> int:
    """Edits that a typed text of this length may be off."""
    return max(1, len(text) // 3)


def pieces(length: int, k: int) -> list[tuple[int, int]]:
    """(start, size) of the k + 1 pieces of a name, sizes as even as can be."""
    size, longer = divmod(length, k + 1)
    sizes = [size] * (k + 1 - longer) + [size + 1] * longer
    return [(sum(sizes[:i]), n) for i, n in enumerate(sizes)]


def index(names: DataFrame, key: str = "key", name: str = "name") -> DataFrame:
    """``ENTRY``: pieces of each key for each k that it can be asked with."""
    rows = names.select(F.col(key).alias("key"), F.col(name).alias("name"), F.length(key).alias("length"))
    # texts of n characters ask with k = max(1, n // 3), for lengths from n - k to n + k
    asks = F.transform(F.sequence(F.lit(1), 2 * F.col("length") + 2), lambda n: F.struct(n.alias("n"), F.greatest(F.lit(1), F.floor(n / 3).cast("int")).alias("k")))
    ks = F.array_distinct(F.transform(F.filter(asks, lambda a: F.abs(a["n"] - F.col("length")) <= a["k"]), lambda a: a["k"]))
    rows = rows.withColumn("k", F.explode(ks)).withColumns({"_size": F.floor(F.col("length") / (F.col("k") + 1)).cast("int"), "_even": F.col("k") + 1 - F.col("length") % (F.col("k") + 1)})
    rows = rows.withColumn("at", F.explode(F.sequence(F.lit(0), F.col("k"))))
    start = F.col("at") * F.col("_size") + F.greatest(F.lit(0), F.col("at") - F.col("_even"))
    size = F.col("_size") + (F.col("at") >= F.col("_even")).cast("int")
    return rows.select(F.substring(F.col("key"), start + 1, size).alias("piece"), "at", "key", "name", "k", "length")


def write(names: DataFrame, folder: str) -> None:
    index(names).repartitionByRange("k", "length", "piece").sortWithinPartitions("k", "length", "piece").write.partitionBy("k", "length").parquet(folder)


def read(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(ENTRY).parquet(folder)


def nearest(held: DataFrame, text: str) -> DataFrame:
    """(name, distance): names of an index within ``allowed`` edits of the text's key, nearest first."""
    spark = held.sparkSession
    needle = needle_of(held, text) or ""
    n, k = len(needle), allowed(needle)
    lengths = range(max(0, n - k), n + k + 1)
    asked = {(length, i, needle[s : s + size]) for length in lengths for i, (start, size) in enumerate(pieces(length, k)) for s in range(max(0, start - k), min(n - size, start + k) + 1)}
    probe = spark.createDataFrame([(length, i, piece) for length, i, piece in sorted(asked)], "length int, at int, piece string")
    fitting = held.where((F.col("k") == k) & F.col("length").isin(list(lengths)))
    # Of a typed text: (2 k + 1) ** 2 * (k + 1) pieces at most.
    met = fitting.join(F.broadcast(probe), ["length", "at", "piece"]).select("key", "name").distinct()
    return met.withColumn("distance", F.levenshtein("key", F.lit(needle))).where(F.col("distance") <= k).orderBy("distance", F.length("name"), "name").select("name", "distance")
