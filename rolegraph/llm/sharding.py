"""Operator 8: a reproducible shuffle into shards by a Feistel permutation of global row numbers.

Row numbers come from the order of the rows; the permutation sends each to another number below the row count, and
``number % shards`` and ``number div shards`` of the image are shard and slot.  So counts of shards differ by one at most
(law ``rows``), slots have no gaps, and either can be computed for one row without the others (``shard_of``).

Null text counts as empty (size 1, checksum 0); null keys sort first; rows alike in all columns get numbers next to each
other, so their set of places is defined; an empty table gives no rows.  Extra columns of ``placed`` and ``shard`` stay as
they are, but for those named like a result, which are replaced.
"""

from __future__ import annotations

from math import isqrt

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rolegraph.llm._rows import durable, fresh, numbered

P1, P2 = 2147483647, 2147483629
ROUNDS = 4


def round_keys(seed: int) -> list[int]:
    """A multiplier for each round, from the seed alone."""
    x, out = seed % P1 or 1, []
    for _ in range(ROUNDS):
        x = x * 48271 % P1
        out.append(x)
    return out


def side_of(rows: int) -> int:
    """Side of the square that the permutation works on: the smallest whose square holds all row numbers."""
    return isqrt(max(rows - 1, 0)) + 1


def shard_of(number: int, rows: int, shards: int, seed: int = 7) -> tuple[int, int]:
    """Shard and slot of one row number, without Spark."""
    side, value = side_of(rows), number
    while True:
        left, right = divmod(value, side)
        for key in round_keys(seed):
            t = (right * key + key % 65521) % P1
            t = (t ^ (t >> 13)) * 1103515245 % P2
            left, right = right, (left + t) % side
        value = left * side + right
        if value < rows:
            return value % shards, value // shards


def _step(df: DataFrame, value: str, side: int, seed: int) -> DataFrame:
    """One application of the permutation to the column ``value``."""
    v, (left, right, t) = F.col(value), (fresh(df, n) for n in ("_l", "_r", "_t"))
    df = df.withColumns({left: ((v - v % side) / side).cast("long"), right: (v % side).cast("long")})
    for key in round_keys(seed):
        df = df.withColumn(t, (F.col(right) * key + key % 65521) % P1)
        df = df.withColumn(t, F.col(t).bitwiseXOR(F.shiftright(t, 13)) * 1103515245 % P2)
        df = df.withColumns({left: F.col(right), right: (F.col(left) + F.col(t)) % side})
    return df.withColumn(value, F.col(left) * side + F.col(right)).drop(left, right, t)


#: Points outside that a broadcast may hold (16 bytes each): enough for 10**12 rows; beyond, the table is joined by a shuffle.
MOST_WALKS = 1 << 21


def permuted(df: DataFrame, number: str, image: str, rows: int, seed: int = 7) -> DataFrame:
    """Adds ``image``, the permuted ``number`` in [0, rows).

    At most 2 * side + 1 points of the square lie outside; where a walk from each of them comes back in is a table of that
    many rows (10 MB at 10**11 rows), which is broadcast up to MOST_WALKS rows.
    """
    side = side_of(rows)
    point, walk = fresh(df, "_point"), fresh(df, "_walk")
    walks = df.sparkSession.range(rows, side * side).select(F.col("id").alias(point), F.col("id").alias(walk))
    while True:
        inside = walks.where(F.col(walk) < rows)
        walks = inside.unionByName(_step(walks.where(F.col(walk) >= rows), walk, side, seed)) if inside.take(1) else _step(walks, walk, side, seed)
        walks = durable(walks)
        if not walks.where(F.col(walk) >= rows).take(1):
            break
    out = _step(df.withColumn(image, F.col(number)), image, side, seed)
    table = F.broadcast(walks) if side * side - rows <= MOST_WALKS else walks
    return out.join(table, F.col(image) == F.col(point), "left").withColumn(image, F.coalesce(walk, image)).drop(point, walk)


def _dealt(df: DataFrame, number: str, rows: int, shards: int, seed: int) -> DataFrame:
    """``df`` with ``shard`` and ``slot`` of its row numbers."""
    image = fresh(df, "_image")
    out = permuted(df, number, image, max(rows, 1), seed)
    return out.withColumns({"shard": (F.col(image) % shards).cast("int"), "slot": F.floor(F.col(image) / shards).cast("long")}).drop(image)


def shard(df: DataFrame, order: list[str], shards: int = 16, seed: int = 7) -> DataFrame:
    """``df`` with ``row_number`` (by ``order``), ``shard`` and ``slot``; extra columns stay as they are."""
    df = df.drop("row_number", "shard", "slot")
    return _dealt(numbered(df, order, "row_number"), "row_number", df.count(), shards, seed)


def sized(docs: DataFrame) -> dict[str, Column]:
    """What the law and the report need of a text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return {"size": (F.octet_length(text) + 1).cast("long"), "text_crc32": F.crc32(F.encode(text, "UTF-8")), "law": F.lit("rows"), "grown_shard": F.lit(None).cast("int")}


def placed(docs: DataFrame, shards: int = 16, seed: int = 7) -> DataFrame:
    """All columns of ``docs`` with size, checksum and place of each row, in files that follow shards and slots.

    Row numbers follow the written order of files (by the number in a name of Spark's, then by name) and of rows in them, so
    one count a file is all that is added up, and texts move once, to their place.  Rows that come from no files are numbered
    by doc_id, checksum and size.
    """
    docs = docs.drop("size", "text_crc32", "law", "shard", "slot", "grown_shard", "row_number")
    file, at = fresh(docs, "_file"), fresh(docs, "_at")
    try:
        rows = docs.select("*", F.col("_metadata.file_name").alias(file), F.col("_metadata.row_index").alias(at))
        rows.schema  # noqa: B018  resolves the columns, and nothing else
    except AnalysisException as error:
        if "UNRESOLVED_COLUMN" not in (error.getCondition() or ""):
            raise
        out = shard(docs.withColumns(sized(docs)), ["doc_id", "text_crc32", "size"], shards, seed)
    else:
        counts = durable(rows.groupBy(file).agg(F.count("*").alias("_n")).withColumn("_place", F.regexp_extract(file, r"^part-(\d+)", 1).try_cast("long")))
        total = counts.agg(F.sum("_n")).first()[0] or 0
        before = Window.orderBy(F.col("_place").asc_nulls_last(), file).rowsBetween(Window.unboundedPreceding, -1)  # a row for each file
        starts = counts.select(F.col(file).alias("_of"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
        named = rows.join(F.broadcast(starts), F.col(file) == F.col("_of")).withColumn("row_number", F.col("_before") + F.col(at)).drop(file, at, "_of", "_before")
        out = _dealt(named.withColumns(sized(docs)), "row_number", total, shards, seed)
    return out.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot")


def places(docs: DataFrame, shards: int = 16, seed: int = 7, order: list[str] | None = None) -> DataFrame:
    """Size, checksum and place of every document; only narrow rows are sorted, texts are read once."""
    narrow = docs.select("doc_id", *[c for c in order or []], *[c.alias(n) for n, c in sized(docs).items()])
    out = shard(narrow, order or ["doc_id", "text_crc32", "size"], shards, seed)
    return out.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard", "row_number")
