"""Operator 5: secret scans that link the parts of a credential.

Strong kinds (assign, access, hex) are reported always.  Weak kinds are long mixed tokens (``opaque``), shorter hex runs
(``short_hex``), account names (``account``) and service addresses (``endpoint``): an interval join over their places in
one text reports a weak span only where a complementary part (a secret for an identifier or an address, an identifier for
a secret) starts within ``REACH`` characters.  Places are code points, end exclusive.

Null text counts as empty.  Copies give the same spans; rows that share a doc_id are told apart by their text.  An empty
table gives no rows; extra columns, whatever their names, are not returned.  Every text is read once: its spans, a few numbers
each, are frozen before they are linked.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rolegraph.llm._rows import durable

REACH = 200
#: Matches of a text are placed in runs of this many, so that work grows with their number and not with its square.
RUN = 256
#: The kinds in order, their pattern and their part in a credential.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
STRONG = [("assign", ASSIGN), ("access", r"AKIA[A-Z0-9]{16,}"), ("hex", r"[0-9a-f]{24,}")]
WEAK = [
    ("opaque", r"(?<![A-Za-z0-9+/])(?=[A-Za-z0-9+/]*[0-9])(?=[A-Za-z0-9+/]*[A-Z])[A-Za-z0-9+/]{32,}(?![A-Za-z0-9+/])", "secret"),
    ("short_hex", r"(?<![0-9a-zA-Z])(?=[0-9a-f]*[0-9])[0-9a-f]{16,23}(?![0-9a-zA-Z])", "secret"),
    ("account", r"""(?i:user(?:name)?|login|client_?id)["']?\x20*[:=]\x20*["']?[A-Za-z0-9_.@-]{3,}""", "id"),
    ("endpoint", r"https?://[A-Za-z0-9.-]{3,}(?::[0-9]{1,5})?", "endpoint"),
]
PART = {"assign": "secret", "access": "id", "hex": "secret"} | {k: part for k, _, part in WEAK}
ORDER = {k: i for i, k in enumerate([*(k for k, _ in STRONG), *(k for k, _, _ in WEAK)])}


def spans_of(text: Column, pattern: str, kind: str) -> Column:
    """array<struct<start,rank,end,kind>> of the leftmost matches: lengths of what lies between them and of them, added up.

    An array that is added to is copied, so places are added up within runs of RUN matches, and runs are put together.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    none = F.expr("cast(array() as array<struct<start:int,rank:int,end:int,kind:string>>)")
    steps = F.arrays_zip(F.slice(F.split(text, pattern, -1), F.lit(1), F.size(found)).alias("gap"), found.alias("hit"))

    def walk(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["gap"])
        end = start + F.length(x["hit"])
        span = F.struct(start.alias("start"), F.lit(ORDER[kind]).alias("rank"), end.alias("end"), F.lit(kind).alias("kind"))
        if kind == "assign":  # the value has to have six characters
            enough = F.length(F.regexp_extract(x["hit"], ASSIGN, 2)) >= 6
            return F.struct(end.alias("at"), F.when(enough, F.concat(acc["out"], F.array(span))).otherwise(acc["out"]).alias("out"))
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(span)).alias("out"))

    def placed(all_steps: Column) -> Column:
        def walk_run(acc: Column, first: Column) -> Column:
            state = F.struct(acc["at"].alias("at"), none.alias("out"))
            return F.aggregate(F.slice(all_steps, first, F.lit(RUN)), state, walk, lambda run: F.struct(run["at"].alias("at"), F.concat(acc["out"], F.array(run["out"])).alias("out")))

        runs = F.sequence(F.lit(1), F.greatest(F.size(all_steps), F.lit(1)), F.lit(RUN))
        state = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<array<struct<start:int,rank:int,end:int,kind:string>>>)").alias("out"))
        return F.aggregate(runs, state, walk_run, lambda acc: F.flatten(acc["out"]))

    # The steps are an element of an array here, so that they are made once and not for each run.
    return F.when(text.rlike(pattern), F.flatten(F.transform(F.array(steps), placed))).otherwise(none)


def scan(df: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, base, spans): strong spans, and all reported spans, sorted by start, then kind."""
    t = F.coalesce(F.col(text), F.lit(""))
    found = df.select(F.col(key).alias(key), F.xxhash64(t).alias("_text"), F.concat(*[spans_of(t, p, k) for k, p in STRONG]).alias("_strong"), F.concat(*[spans_of(t, p, k) for k, p, _ in WEAK]).alias("_weak"))
    found = durable(found.select(key, "_text", F.array_sort("_strong").alias("base"), "_weak"))
    # Scopes: a text and a stretch of REACH characters in it.  Of each part and stretch only the first and last place count.
    parts = (
        found.where((F.size("_weak") > 0) & (F.size("_weak") + F.size("base") > 1))
        .select(F.col(key).alias("_key"), "_text", F.explode(F.concat("base", "_weak")).alias("s")).dropDuplicates()
        .select("_key", "_text", "s", F.floor(F.col("s.start") / REACH).cast("int").alias("_stretch"), F.element_at(F.create_map(*[F.lit(x) for kv in PART.items() for x in kv]), F.col("s.kind")).alias("_part"))
    )
    reach = (
        parts.groupBy("_key", "_text", "_stretch", "_part").agg(F.min("s.start").alias("_from"), F.max("s.start").alias("_to"))
        .select("_key", "_text", "_part", "_from", "_to", F.explode(F.array(*[F.col("_stretch") + d for d in (-1, 0, 1)])).alias("_stretch"))
    )
    want = F.when(F.col("w._part") == "secret", F.col("r._part") != "secret").otherwise(F.col("r._part") == "secret")
    near = (F.col("r._from") <= F.col("w.s.start") + REACH) & (F.col("r._to") >= F.col("w.s.start") - REACH)
    weak = parts.where(F.col("s.rank") >= len(STRONG)).alias("w")
    linked = (
        weak.join(reach.alias("r"), F.col("w._key").eqNullSafe(F.col("r._key")) & (F.col("w._text") == F.col("r._text")) & (F.col("w._stretch") == F.col("r._stretch")) & want & near)
        .groupBy(F.col("w._key").alias("_key"), F.col("w._text").alias("_hash")).agg(F.collect_set("w.s").alias("_linked"))
    )
    out = found.join(linked, F.col(key).eqNullSafe(F.col("_key")) & (F.col("_text") == F.col("_hash")), "left")
    none = F.expr("cast(array() as array<struct<start:int,rank:int,end:int,kind:string>>)")
    return out.select(key, "base", F.array_sort(F.concat("base", F.coalesce("_linked", none))).alias("spans"))


def written(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def report(df: DataFrame) -> DataFrame:
    """The digest columns of the query."""
    n = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return scan(df).select("doc_id", n("assign"), n("access"), n("hex"), F.sha2(written(F.col("base")), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"))
