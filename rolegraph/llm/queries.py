"""Queries of this subpackage, with production parameters, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from rolegraph.llm import classifier, decontamination, filter_audit, jaccard_join, lexical_search, mixing, oracles, quality_rules, secrets, sharding, simhash, substring_dedup, suffix_dedup, urls
from rolegraph.llm._rows import ship

#: (host, path, verdict)
URL_RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]
#: Target weights of sources; None is the share of all others, in equal parts.
WEIGHTS: dict[str | None, int] = {"src0": 10, "src1": 4, "src2": 4, "src3": 4, "src4": 3, "src5": 3, None: 32}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.join(table(spark, sf_dir, "documents"))


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return urls.filter_urls(pages, urls.rule_table(spark, URL_RULES)).drop("url")


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return classifier.score(docs, classifier.fit(docs, table(spark, sf_dir, "labels"), classifier.grade_of()))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.report(table(spark, sf_dir, "documents"))


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.report(table(spark, sf_dir, "documents"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.judge(table(spark, sf_dir, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.places(table(spark, sf_dir, "documents"))


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.report(table(spark, sf_dir, "documents"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"), WEIGHTS).drop("mix_order")


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.join(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_jaccard_join, op2_url_filter, op3_quality_classifier, op4_decontamination, op5_secret_scan, op6_suffix_dedup, op7_quality_rules, op8_sharding, op9_substring_dedup, op10_mixing, op11_filter_audit, op12_lexical_search, op13_simhash)}


def oracle_sql() -> dict[str, str]:
    limits = {name: limit for name, _, _, limit in quality_rules.RULES}
    return {
        "op1_jaccard_join": oracles.JACCARD, "op2_url_filter": oracles.URLS, "op4_decontamination": oracles.CONTAMINATION,
        "op6_suffix_dedup": oracles.REPEATS, "op8_sharding": oracles.shards(sharding.round_keys(7)),
        "op7_quality_rules": oracles.rules(quality_rules.STOP_WORDS, limits), "op9_substring_dedup": oracles.PASSAGES,
        "op11_filter_audit": oracles.AUDIT, "op12_lexical_search": oracles.SEARCH,
    }
