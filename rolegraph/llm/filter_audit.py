"""Operator 11: what filters do to each other, for every order in which they can be applied.

Each document has a flag for every filter that it fails.  Counts of documents alike in part, flags and labels are added up by
one SQL CUBE over the five flags and the part.  Of its grouping sets, those rows count whose selected flags are all false: the
row for a set S of filters tells how many documents survive S.  Applying filter f after the filters P removes survivors(P) less
survivors(P + f), whatever the order inside P, so the pairs (P, P + f) are joined once, 80 for a part, and each of the 600
steps (120 orders of five) looks its pair up.

Filter E fails a document whose text stands in a row of smaller id anywhere in the table.  Texts are told apart by SHA-256.
Each text's smallest id is joined back by text and id, so a text that a third of all rows hold meets one row and not its group.

Null text is empty.  A null source is the part '' and shares it with sources that are empty.  A null id counts as larger than
all others: such a row fails E if the text has a row with an id, and rows of equal id and text do not fail E for each other.
A document is good (toxic) if any label of its id says so; labels without an id, and their other columns, are not used.  Rows
alike count each.  An empty table gives no rows.
"""

from __future__ import annotations

from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rolegraph.llm._rows import durable, loose

FILTERS = "ABCDE"
WORD = r"[^\x20\x09-\x0D]+"
MISSING = (1 << 63) - 1


def text_flags(text: Column) -> dict[str, Column]:
    """Filters that hang on a text alone, each true where it fails."""
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    capitals = F.length(text) - F.length(F.regexp_replace(text, "[A-Z]", ""))
    return {
        "A": F.size(words) < 200,
        "B": 100 * F.size(F.array_distinct(words)) < 50 * F.size(words),
        "C": 100 * capitals > 2 * F.length(text),
        "D": text.rlike("[#$%&*|]"),
    }


def judged(docs: DataFrame, labels: DataFrame, part: str = "source", key: str = "doc_id") -> DataFrame:
    """(part, A to E, good, toxic, n): the number of documents alike in all of these, by text and id."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(F.coalesce(key, F.lit(MISSING)).alias("id"), F.coalesce(part, F.lit("")).alias("part"), F.sha2(text, 256).alias("digest"), *[c.alias(n) for n, c in text_flags(text).items()])
    flags = ["A", "B", "C", "D"]
    alike = durable(rows.groupBy("digest", "id", "part", *flags).agg(F.count("*").alias("n")))
    earliest = alike.groupBy("digest").agg(F.min("id").alias("id")).select("digest", "id", F.lit(True).alias("first"))
    known = labels.where("doc_id is not null").groupBy("doc_id").agg(F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"))
    known = loose(known.withColumnRenamed("doc_id", "_id"), "_id")
    marked = alike.join(earliest, ["digest", "id"], "left").withColumn("E", F.col("first").isNull())
    # Rows without an id have no label; they are asked for under numbers that spread, and the flag keeps them from meeting one.
    asked = marked.withColumns({"_has": F.col("id") != MISSING, "_ask": F.when(F.col("id") != MISSING, F.col("id")).otherwise(F.xxhash64("digest", "part"))})
    with_labels = asked.join(known, (F.col("_ask") == F.col("_id")) & F.col("_has"), "left")
    lacking = lambda c: F.coalesce(c, F.lit(False)).alias(c)
    return with_labels.groupBy("part", *FILTERS, lacking("good"), lacking("toxic")).agg(F.sum("n").alias("n"))


def survivors(profile: DataFrame) -> DataFrame:
    """(part, subset, n, good, toxic): documents that pass all filters of a subset, given as five bits, A the lowest."""
    flags = ", ".join(FILTERS)
    cube = profile.sparkSession.sql(
        f"SELECT part, {flags}, grouping_id() AS rolled, sum(n) AS n, sum(CASE WHEN good THEN n ELSE 0 END) AS good, sum(CASE WHEN toxic THEN n ELSE 0 END) AS toxic "
        f"FROM {{profile}} GROUP BY CUBE ({flags}, part)",
        profile=profile,
    )
    # A rolled-up flag is null; grouping_id has a bit for each column, the part's lowest, set where it is rolled up.
    none_fails = ~F.coalesce(*[F.when(F.col(f), True) for f in FILTERS], F.lit(False))
    chosen = sum((F.when(F.col("rolled").bitwiseAND(F.lit(1 << (len(FILTERS) - i))) == 0, 1 << i).otherwise(0) for i, _ in enumerate(FILTERS)), F.lit(0))
    return cube.where(none_fails & (F.col("rolled").bitwiseAND(F.lit(1)) == 0)).select("part", chosen.cast("int").alias("subset"), "n", "good", "toxic")


def _pairs() -> list[tuple[str, int, int, int]]:
    """(filter, filters before, and with it, orders in which exactly those stand before)."""
    n = len(FILTERS)
    sizes = lambda before: factorial(bin(before).count("1")) * factorial(n - 1 - bin(before).count("1"))
    return [(f, b, b | 1 << i, sizes(b)) for i, f in enumerate(FILTERS) for b in range(1 << n) if not b >> i & 1]


def _steps() -> list[tuple[str, int, str, int]]:
    """(order, step, filter, filters before) for every order of the filters."""
    out = []
    for order in permutations(FILTERS):
        before = 0
        for step, f in enumerate(order, 1):
            out.append(("".join(order), step, f, before))
            before |= 1 << FILTERS.index(f)
    return out


def audit(docs: DataFrame, labels: DataFrame, part: str = "source", key: str = "doc_id") -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley)."""
    spark = docs.sparkSession
    profile = durable(judged(docs, labels, part, key))
    left = survivors(profile)
    # Subsets that no document survives have no row in the cube.
    every = profile.select("part").distinct().withColumn("subset", F.explode(F.sequence(F.lit(0), F.lit((1 << len(FILTERS)) - 1))))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    left = durable(every.join(left, ["part", "subset"], "left").select("part", "subset", *[zero(c) for c in ("n", "good", "toxic")]))
    pairs = F.broadcast(spark.createDataFrame(_pairs(), "filter string, before int, after int, orders long"))
    after = left.select("part", F.col("subset").alias("after"), *[F.col(c).alias(f"{c}_after") for c in ("n", "good", "toxic")])
    pair = left.join(pairs, F.col("subset") == F.col("before")).join(after, ["part", "after"])
    lost = durable(pair.select("part", "filter", "before", "orders", F.col("n_after").alias("kept"), *[(F.col(c) - F.col(f"{c}_after")).alias(f"{c}_lost") for c in ("n", "good", "toxic")]))
    everything = (1 << len(FILTERS)) - 1
    bit = F.element_at(F.create_map(*[F.lit(x) for i, f in enumerate(FILTERS) for x in (f, 1 << i)]), F.col("filter"))
    at = lambda mask: F.sum(F.when(F.col("before") == mask, F.col("n_lost")))
    whole = lost.groupBy("part", "filter").agg(at(F.lit(0)).alias("failing"), at(F.lit(everything) - bit).alias("unique_fails"), F.sum(F.col("n_lost") * F.col("orders")).alias("shapley"))
    steps = F.broadcast(spark.createDataFrame(_steps(), "filter_order string, step int, filter string, before int"))
    out = lost.join(whole, ["part", "filter"]).join(steps, ["filter", "before"])
    return out.select(
        "part", "filter_order", "step", "kept", F.col("n_lost").alias("removed"), (F.col("failing") - F.col("n_lost")).alias("redundant"), "unique_fails",
        F.col("good_lost"), F.col("toxic_lost"), "shapley",
    )
