"""Operator 7: quality rules, a threshold table compiled into one Spark projection.

``metrics`` adds counts and ratios, built-in expressions over one text; ``RULES`` are rows (name, metric, comparison, threshold).  A text is kept
if it passes the base rules and every row of the table.  Null text has no words and fails the base; copies are judged alike.
Extra columns of any other name stay; columns named like a metric, ``base_failed``, ``failed_rules`` or ``kept`` are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rolegraph.llm._rows import fresh

#: Common short words of the four languages.
STOP_WORDS = "the of and to in that is with for as was on be by de la que el en y los un una le les des et est du der die das und ist von mit den ein eine zu".split()

#: (name, metric, comparison, threshold): a text fails where the comparison holds.
RULES = [
    ("short_words", "mean_word_chars", "<", 2.0),
    ("long_words", "mean_word_chars", ">", 20.0),
    ("symbols", "symbols_per_word", ">", 0.4),
    ("same_lines", "dup_line_share", ">", 0.5),
    ("few_stop_words", "stop_word_share", "<", 0.005),
]
HOLDS = {"<": lambda a, b: a < b, ">": lambda a, b: a > b, "<=": lambda a, b: a <= b, ">=": lambda a, b: a >= b}

GAP = r"[\x20\x09-\x0D]+"


def metrics(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds the counts and ratios.  Arrays that several counts need are columns of their own, so each is made once."""
    t = F.coalesce(F.col(text), F.lit(""))
    words, lines, coded, met, placed, again = (fresh(df, f"_{name}") for name in ("words", "lines", "codes", "windows", "placed", "again"))
    df = df.withColumn(words, F.filter(F.split(t, GAP), lambda w: w != ""))
    df = df.withColumns({
        "n_words": F.size(words).cast("long"),
        "word_chars": F.length(F.array_join(words, "")).cast("long"),
        "n_symbols": (F.length(t) - F.length(F.translate(t, "#*$%&|<>", ""))).cast("long"),
        lines: F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")),
        coded: F.transform(words, lambda w: F.xxhash64(w)),
    })
    codes = F.col(coded)
    windows = F.when(F.size(codes) < 3, F.expr("array(0L)")).otherwise(
        F.transform(F.sequence(F.lit(0), F.greatest(F.size(codes) - 3, F.lit(0))), lambda i: F.xxhash64(F.get(codes, i), F.get(codes, i + 1), F.get(codes, i + 2)))
    )
    df = df.withColumn(met, windows)
    # A long array sorts without boxing; only texts with a repeat pay for sorting windows with their places.
    repeats = (F.size(met) > F.size(F.array_distinct(met))) & (F.size(coded) >= 3)
    df = df.withColumn(placed, F.when(repeats, F.array_sort(F.transform(met, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    p = F.col(placed)
    twice = F.filter(F.transform(p, lambda x, k: F.when((x["h"] == F.get(p, k - 1)["h"]) | (x["h"] == F.get(p, k + 1)["h"]), x["i"])), lambda i: i.isNotNull())
    df = df.withColumn(again, F.array_sort(twice))
    a = F.col(again)
    covered = F.aggregate(F.transform(a, lambda i, k: F.least(F.coalesce(F.get(a, k + 1) - i, F.lit(3)), F.lit(3))), F.lit(0).cast("long"), lambda s, x: s + x)
    n = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    return df.withColumns({
        "n_repeat_words": F.coalesce(covered, F.lit(0)).cast("long"),
        "n_dup_lines": (F.size(lines) - F.size(F.array_distinct(lines))).cast("long"),
        "mean_word_chars": F.col("word_chars") / n,
        "symbols_per_word": F.col("n_symbols") / n,
        "stop_word_share": F.size(F.filter(words, lambda w: F.lower(F.rtrim(w, F.lit(".,!"))).isin(STOP_WORDS))) / n,
        "dup_line_share": (F.size(lines) - F.size(F.array_distinct(lines))) / F.greatest(F.size(lines), F.lit(1)).cast("double"),
    }).drop(words, lines, coded, met, placed, again)


def compiled(rules: list[tuple[str, str, str, float]]) -> Column:
    """Names of the rules that a row fails, as one expression."""
    return F.array_compact(F.array(*[F.when(HOLDS[op](F.col(metric), F.lit(limit)), F.lit(name)) for name, metric, op, limit in rules])) if rules else F.expr("cast(array() as array<string>)")


def judge(df: DataFrame, text: str = "text", rules: list[tuple[str, str, str, float]] = RULES) -> DataFrame:
    """``df`` with the metrics, ``base_failed``, ``failed_rules`` and ``kept``."""
    out = metrics(df, text).withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))
    return out.withColumn("failed_rules", compiled(rules)).withColumn("kept", ~F.col("base_failed") & (F.size("failed_rules") == 0))
