"""Operator 2: URL rules by hashed host-suffix and path-prefix expressions.

Each URL is expanded into the pairs of its host's suffixes and its path's directory prefixes; each rule is filed under the
pair of its host and the directory part of its path.  Pairs meet on the first four bytes of their SHA-256, and a hit counts
only if the full digest agrees and the path starts with the rule's whole path.  The longest rule wins; of equally long ones
block wins, then the smaller rule.

A null url, or one without ``://``, has an empty host and path and no rule.  Repeated rows and extra columns of any name stay.
A rule that lacks its host, path or verdict is none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rolegraph.llm._rows import fresh

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Rules up to this many are broadcast (about 200 bytes each: 20 MB at most); beyond it both sides are shuffled, salted.
BROADCAST_RULES = 100_000
SALTS = 16
#: Keys over which rows without a host are spread.
SPREAD = 4096


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def directory(path: Column) -> Column:
    """Up to the last slash."""
    return F.regexp_extract(path, r"(?s)^(.*/)?", 1)


def rule_table(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    """Rows of (host, path, verdict)."""
    return spark.createDataFrame(rules, "rule_host string, rule_path string, rule_verdict string")


def filter_urls(df: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow") -> DataFrame:
    """``df`` with ``host``, ``path``, ``rule`` and ``verdict``; columns of these names in ``df`` are replaced."""
    keep = [c for c in df.columns if c not in ("host", "path", "rule", "verdict")]
    asking, best_of, key = fresh(df, "_url"), fresh(df, "_best"), fresh(df, "_wanted")
    filed = rules.where("rule_host is not null and rule_path is not null and rule_verdict is not null").select(
        F.translate("rule_host", UPPER, LOWER).alias("rule_host"), "rule_path", "rule_verdict"
    ).dropDuplicates()
    filed = filed.withColumn("_digest", F.sha2(F.concat("rule_host", F.lit("\n"), directory(F.col("rule_path"))), 256)).withColumn("_short", F.substring("_digest", 1, 8))
    bounds = filed.agg(F.count("*"), F.max(F.size(F.split("rule_path", "/")) - 1), F.max(F.size(F.split("rule_host", r"\.")))).first()
    n_rules, depth, labels = bounds[0], bounds[1] or 0, bounds[2] or 0

    # One row for each different url, so that a url copied many times is judged once.
    urls = df.select(F.col(url).alias("_url")).distinct().select("_url", host_of(F.col("_url")).alias("host"), path_of(F.col("_url")).alias("path"))
    parts = F.split("host", r"\.")
    # Suffixes longer than any rule's host and prefixes deeper than any rule's path can meet nothing.
    suffixes = F.transform(F.sequence(F.lit(1), F.least(F.size(parts), F.lit(max(labels, 1)))), lambda k: F.array_join(F.slice(parts, -k, k), "."))
    pieces = F.split("path", "/", -1)
    prefixes = F.transform(
        F.sequence(F.lit(0), F.least(F.size(pieces) - 1, F.lit(depth))),
        lambda k: F.concat(F.array_join(F.slice(pieces, F.lit(1), k), "/"), F.when(k > 0, F.lit("/")).otherwise(F.lit(""))),
    )
    asked = (
        urls.where(F.col("host") != "")
        .withColumn("_suffix", F.explode(suffixes))
        .withColumn("_prefix", F.explode(prefixes))
        .withColumn("_asked", F.sha2(F.concat("_suffix", F.lit("\n"), "_prefix"), 256))
    )
    if n_rules <= BROADCAST_RULES:
        met = asked.join(F.broadcast(filed), F.substring("_asked", 1, 8) == F.col("_short"))
    else:
        salted = filed.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        met = asked.join(salted, (F.substring("_asked", 1, 8) == F.col("_short")) & (F.pmod(F.xxhash64("_url"), F.lit(SALTS)) == F.col("_salt")))
    met = met.where((F.col("_asked") == F.col("_digest")) & F.col("path").startswith(F.col("rule_path")))
    rule = F.concat("rule_host", "rule_path")
    rank = F.struct(F.length(rule).alias("n"), (F.col("rule_verdict") == "block").alias("b"), rule.alias("rule"), F.col("rule_verdict").alias("verdict"))
    best = met.groupBy(F.col("_url").alias(asking)).agg(F.max(rank).alias(best_of))
    # Only urls with a host are asked for; all others, null among them, are spread.  The rules' side is no longer known to be
    # partitioned by url, so both sides are exchanged and adaptive execution can split the partition of a hot url.
    wanted = F.when(host_of(F.col(url)) != "", F.col(url)).otherwise(F.concat(F.lit("\0"), F.pmod(F.monotonically_increasing_id(), F.lit(SPREAD)).cast("string")))
    best = best.withColumn(asking, F.concat(asking, F.lit("")))
    back = df.select(*keep, wanted.alias(key)).join(best, F.col(key) == F.col(asking), "left")
    return back.select(*keep, host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"), F.col(best_of)["rule"].alias("rule"), F.coalesce(F.col(best_of)["verdict"], F.lit(default)).alias("verdict"))
