"""Operator 10: mixing sources to target weights by Pfair scheduling.

Each source is cut into blocks.  In a cycle of W = sum of integer weights slots a source of weight w has w blocks; its k-th
(from 0) is released at slot floor(k * W / w) and due by ceil((k + 1) * W / w).  Earliest deadline first among released
blocks fills every slot in time, so at any slot each source is within one block of its share, and cycles repeat.

When a source runs out, the rest go on from the next cycle with their own weights.  No row is dropped or repeated.  Sources
without a weight, null included, share the weight v of ``None`` equally: each has blocks of its own, and the n of them that
still hold rows take the v slots of a cycle in turn.  That gives each the weight v / n: block k of such a source, counted from
where turns began, is released at floor(k * n * W / v) and due by ceil((k + 1) * n * W / v).  A turn is off by at most
1 - 1 / n blocks and the slots of all n together by less than one, so each of the n is off by less than one block too.  Slots
and windows count from the start of the cycle, so a window of a weight under 1 may begin before 0.

Rows are ordered in a source by hashed key, then key, then text or whatever else the row holds; rows alike in all of that are
each a row, with a place of its own.  A null key is a key like others.  The schedule is a table of at most (named sources + 1) *
W rows, all parameters.  Of the sources themselves the driver sees how many hold how many blocks: the numbers differ, so there
are at most sqrt(2 * blocks) of them; ranks of sources stay a table, which is broadcast only up to a checked number of rows.
An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rolegraph.llm._rows import BROADCAST_ROWS, durable, numbered

BLOCK = 32

def edf_cycle(weights: dict[int, int]) -> list[tuple[int, int]]:
    """(source, block of the cycle) for each slot of a cycle of sum(weights) slots."""
    total, done, out = sum(weights.values()), dict.fromkeys(weights, 0), []
    for slot in range(total):
        ready = [(-(-(done[s] + 1) * total // w), s) for s, w in weights.items() if done[s] < w and done[s] * total // w <= slot]
        _, s = min(ready)
        out.append((s, done[s]))
        done[s] += 1
    return out


def plan(blocks: dict[int, int], weights: dict[int, int]) -> list[tuple[int, int, int, int, int, int]]:
    """(source, first block, last block, weight, first cycle, phase) of each phase: a run of cycles with the same sources."""
    left, done, out, cycle, phase = dict(blocks), dict.fromkeys(blocks, 0), [], 0, 0
    while live := {s: weights[s] for s, n in left.items() if n > 0}:
        runs = max(1, min(left[s] // w for s, w in live.items()))
        for s, w in live.items():
            take = min(left[s], runs * w)
            out.append((s, done[s], done[s] + take - 1, w, cycle, phase))
            left[s] -= take
            done[s] += take
        cycle, phase = cycle + runs, phase + 1
    return out


def turns_of(ends: list[tuple[int, int]], rest: int) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """(rest, first block, last block, place of the first round, sources in a round) of each run of rounds, and all blocks.

    ``ends`` has (blocks, sources that hold so many).  Sources take turns by falling number of blocks, so those that are left
    always have the first ranks, and rounds change only where a source ends.
    """
    turns, live, first, base = [], sum(n for _, n in ends), 0, 0
    for end, sources in sorted(ends):
        turns.append((rest, first, end - 1, base, live))
        base += (end - first) * live
        first, live = end, live - sources
    return turns, base


def _small(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def _scheduled(df: DataFrame, weights: dict[str | None, int], source: str, key: str, block: int, carried: Column | None = None) -> DataFrame:
    """_key, _source, _row (in its source), block and the columns of its slot for every row, with ``carried`` as _whole."""
    spark = df.sparkSession
    if None not in weights:
        weights = {**weights, None: 1}
    known = sorted(n for n in weights if n is not None)
    which = F.coalesce(*[F.when(F.col(source) == n, F.lit(i)) for i, n in enumerate(known)], F.lit(len(known))) if known else F.lit(0)
    rows = df.select(F.col(key).alias("_key"), F.col(source).alias("_source"), which.alias("_which"), F.xxhash64(key).alias("_hash"), F.xxhash64(*df.columns).alias("_alike"), *([] if carried is None else [carried.alias("_whole")]))
    # The last part of the order tells rows apart that are alike in all columns, so that a range can end among them.
    rows = rows.withColumn("_tie", F.monotonically_increasing_id())
    rows = numbered(rows, ["_hash", "_key", "_alike", "_tie"], "_row", within="_source").withColumn("block", F.floor(F.col("_row") / block).cast("long"))
    held = durable(rows.groupBy("_source", "_which").agg(F.ceil(F.count("*") / F.lit(float(block))).cast("long").alias("_blocks")))
    named = {r["_which"]: r["_blocks"] for r in held.where(F.col("_which") < len(known)).collect()}  # a row for each named source
    others = held.where(F.col("_which") == len(known))
    ends = [(r["_blocks"], r["count"]) for r in others.groupBy("_blocks").count().collect()]  # sqrt(2 * blocks) rows at most
    turns, total = turns_of(ends, len(known))
    counts = named | ({len(known): total} if total else {})
    phases = plan(counts, {i: weights[n] for i, n in enumerate([*known, None])})
    slots, totals = [], {}
    for number in sorted({p[5] for p in phases}):
        live = {p[0]: p[3] for p in phases if p[5] == number}
        totals[number] = sum(live.values())
        slots += [(number, s, k, slot) for slot, (s, k) in enumerate(edf_cycle(live))]
    # Ranks: how many hold more blocks, then by name among those that hold as many.
    more, above = 0, []
    for n, count in sorted(ends, reverse=True):
        above.append((n, more))
        more += count
    above_of = F.broadcast(spark.createDataFrame(above, "_n long, _more long"))
    ranked = numbered(others.select("_source", "_blocks"), ["_source"], "_k", within="_blocks").join(above_of, F.col("_blocks") == F.col("_n"))
    rank = ranked.select(F.col("_source").alias("r_source"), (F.col("_more") + F.col("_k")).alias("r_rank"))
    turn = spark.createDataFrame([(w, 0, n - 1, 0, 1) for w, n in named.items()] + turns, "t_which int, t_first long, t_last long, t_base long, t_live long")
    spans = spark.createDataFrame([(*p, totals[p[5]]) for p in phases], "p_which int, p_first long, p_last long, p_weight int, p_cycle long, p_phase int, p_total long")
    table = spark.createDataFrame(slots, "s_phase int, s_which int, s_block int, s_slot int")
    placed = rows.join(_small(rank, more), F.col("_source").eqNullSafe(F.col("r_source")) & (F.col("_which") == len(known)), "left").withColumn("r_rank", F.coalesce("r_rank", F.lit(0)))
    placed = placed.join(F.broadcast(turn), (F.col("_which") == F.col("t_which")) & F.col("block").between(F.col("t_first"), F.col("t_last")))
    placed = placed.withColumn("_place", F.col("t_base") + (F.col("block") - F.col("t_first")) * F.col("t_live") + F.col("r_rank"))
    placed = placed.join(F.broadcast(spans), (F.col("_which") == F.col("p_which")) & F.col("_place").between(F.col("p_first"), F.col("p_last")))
    placed = placed.withColumns({"_in": ((F.col("_place") - F.col("p_first")) % F.col("p_weight")).cast("int"), "cycle": F.col("p_cycle") + F.floor((F.col("_place") - F.col("p_first")) / F.col("p_weight")).cast("long")})
    placed = placed.join(F.broadcast(table), (F.col("p_phase") == F.col("s_phase")) & (F.col("_which") == F.col("s_which")) & (F.col("_in") == F.col("s_block")))
    return placed.withColumn("row_in_block", (F.col("_row") % block).cast("int"))


def mix(df: DataFrame, weights: dict[str | None, int], source: str = "source", key: str = "doc_id", block: int = BLOCK) -> DataFrame:
    """(key, source, block, cycle, slot, release, deadline, row_in_block, mix_order); ``mix_order`` sorts rows as they are to be read."""
    placed = _scheduled(df, weights, source, key, block)
    turn_start = F.col("_in") - F.col("r_rank")
    release = F.floor(turn_start * F.col("p_total") / F.col("p_weight")).cast("int").alias("release")
    deadline = F.ceil((turn_start + F.col("t_live")) * F.col("p_total") / F.col("p_weight")).cast("int").alias("deadline")
    order = F.struct("cycle", F.col("s_slot").alias("slot"), F.col("row_in_block").alias("row"))
    return placed.select(F.col("_key").alias(key), F.col("_source").alias(source), "block", "cycle", F.col("s_slot").alias("slot"), release, deadline, "row_in_block", order.alias("mix_order"))


def mixed(df: DataFrame, weights: dict[str | None, int], source: str = "source", key: str = "doc_id", block: int = BLOCK) -> DataFrame:
    """All rows of ``df``, sorted as they are to be read; written files keep this order in their names and rows.

    Rows take their columns along to their place, so rows without a key, or with the same one, are each placed for themselves.
    """
    whole = F.struct(*[F.col(c).alias(f"c{i}") for i, c in enumerate(df.columns)])
    placed = _scheduled(df, weights, source, key, block, whole).orderBy("cycle", "s_slot", "row_in_block")
    return placed.select(*[F.col("_whole")[f"c{i}"].alias(c) for i, c in enumerate(df.columns)])
