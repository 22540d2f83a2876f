"""A saved index of names for searches by part: which names hold a run of one, two or three characters.

Each name stands once for each of its runs, beside its score order, so a search reads one run of the typed text, the rarest,
and nothing else: the table is partitioned by a hash of the run and sorted by it, and runs are counted in a small table of the
same partitions.  What is read is checked against the whole text, so answers are those of a search over all names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rolegraph.functions.text import normalize, search_score
from rolegraph.operators.lookups import needle_of

LONGEST, BUCKETS = 3, 64
ENTRY = "gram string, rank int, kind string, id string, name string, key string, bucket int"
COUNT = "gram string, names bigint, bucket int"


def runs(key: Column) -> Column:
    """The distinct runs of 1 to LONGEST characters in a key."""
    of = lambda n: F.transform(F.sequence(F.lit(1), F.greatest(F.length(key) - n + 1, F.lit(1))), lambda i: F.substring(key, i, F.lit(n)))
    return F.array_distinct(F.filter(F.flatten(F.array(*[of(n) for n in range(1, LONGEST + 1)])), lambda g: g != ""))


def _bucket(gram: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(gram), F.lit(buckets)).cast("int")


def write(tables: list[tuple[str, DataFrame, str, str]], folder: str, buckets: int = BUCKETS) -> None:
    """Indexes (kind, table, id column, name column); kinds rank in the order given."""
    every = None
    for rank, (kind, df, key, name) in enumerate(tables):
        one = df.select(F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), F.col(key).cast("string").alias("id"), F.col(name).alias("name"), normalize(F.col(name)).alias("key"))
        every = one if every is None else every.unionByName(one)
    entries = every.select(F.explode(runs(F.col("key"))).alias("gram"), "*").withColumn("bucket", _bucket(F.col("gram"), buckets))
    entries.repartitionByRange("bucket", "gram", "key", "id").sortWithinPartitions("bucket", "gram").write.partitionBy("bucket").parquet(f"{folder}/entries")
    counted = every.sparkSession.read.schema(ENTRY).parquet(f"{folder}/entries").groupBy("gram", "bucket").agg(F.count("*").alias("names"))
    counted.hint("rebalance", "bucket").sortWithinPartitions("bucket", "gram").write.partitionBy("bucket").parquet(f"{folder}/counts")


def candidates(spark: SparkSession, folder: str, needle: str, buckets: int = BUCKETS) -> DataFrame:
    """Names that hold the rarest run of the needle; none if it has a run that no name holds."""
    entries, counts = spark.read.schema(ENTRY).parquet(f"{folder}/entries"), spark.read.schema(COUNT).parquet(f"{folder}/counts")
    n = min(LONGEST, len(needle))
    asked = sorted({needle[i : i + n] for i in range(len(needle) - n + 1)}) if n else []
    if not asked:
        return entries.where("false")
    at = {r["gram"]: r["bucket"] for r in spark.createDataFrame([(g,) for g in asked], "gram string").select("gram", _bucket(F.col("gram"), buckets).alias("bucket")).collect()}
    held = counts.where(F.col("bucket").isin(sorted(set(at.values()))) & F.col("gram").isin(asked)).orderBy("names", "gram").collect()  # a row for each run of the typed text
    if len(held) < len(asked):
        return entries.where("false")
    rarest = held[0]["gram"]
    return entries.where((F.col("bucket") == at[rarest]) & (F.col("gram") == rarest))


def search(spark: SparkSession, folder: str, text: str, limit: int = 30, offset: int = 0, buckets: int = BUCKETS) -> DataFrame:
    """(score, kind, id, name): the best hits, in the order of ``Library.search``."""
    needle = needle_of(spark.range(1), text) or ""
    hits = candidates(spark, folder, needle, buckets).withColumn("score", search_score(F.col("key"), F.lit(needle))).where("score is not null")
    ordered = hits.orderBy("score", "rank", F.octet_length("name"), "name", "id")
    return (ordered.offset(offset) if offset else ordered).limit(limit).select("score", "kind", "id", "name")
