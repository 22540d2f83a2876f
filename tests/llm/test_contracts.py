"""Each query against its plain version, on the small tables."""

import zlib
from collections import Counter

import pytest

from rolegraph.llm import queries
from rolegraph.llm.sharding import shard_of
from tests.llm import brute

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def rows(spark):
    return [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]


def got(df, *columns):
    return {r["doc_id"]: tuple(r[c] for c in columns) for r in df.collect()}


def test_jaccard_join(spark, rows):
    assert got(queries.op1_jaccard_join(spark, SF), "n_shingles", "component_id", "n_links") == brute.jaccard(rows)


def test_decontamination(spark, rows):
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    assert got(queries.op4_decontamination(spark, SF), "n_words", "n_hit", "n_items", "items_sha256", "contaminated") == brute.contamination(rows, items)


def test_secrets(spark, rows):
    assert got(queries.op5_secret_scan(spark, SF), "n_assign", "n_access", "n_hex", "base_sha256") == {d: brute.secrets(t) for d, t in rows}


def test_repeats(spark, rows):
    assert got(queries.op6_suffix_dedup(spark, SF), "n_bytes", "n_removed", "n_spans", "kept_sha256") == {r[0]: r[1:] for r in brute.repeats(rows)}


def test_quality_rules(spark, rows):
    assert got(queries.op7_quality_rules(spark, SF), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed") == {d: brute.rules(t) for d, t in rows}


def test_sharding(spark, rows):
    order = sorted((d, zlib.crc32((t or "").encode()), len((t or "").encode()) + 1) for d, t in rows)
    want = {d: (size, crc, *shard_of(i, len(order), 16), None) for i, (d, crc, size) in enumerate(order)}
    assert got(queries.op8_sharding(spark, SF), "size", "text_crc32", "shard", "slot", "grown_shard") == want
    for n in (1, 2, 3, 5, 17, 1000):
        assert sorted(s * 16 + k for k, s in (shard_of(i, n, 16) for i in range(n))) == list(range(n))


def test_passages(spark, rows):
    assert got(queries.op9_substring_dedup(spark, SF), "n_words", "n_removed", "kept_sha256") == brute.passages(rows)


def test_mixing(spark, rows):
    out = queries.op10_mixing(spark, SF).collect()
    assert Counter(r["doc_id"] for r in out) == Counter(d for d, _ in rows)
    total = sum(queries.WEIGHTS.values())
    blocks = sorted({(r["cycle"], r["slot"], r["source"] if r["source"] in queries.WEIGHTS else None) for r in out})
    # with every source at hand, each is within one block of its share after any number of slots
    seen, full = Counter(), [b for b in blocks if b[0] == 0]
    for t, (_, slot, source) in enumerate(full, 1):
        assert slot == t - 1 or len(full) < total
        seen[source] += 1
        if len(full) == total:
            assert all(abs(seen[s] - t * w / total) < 1 for s, w in queries.WEIGHTS.items())
    assert all(r["release"] <= r["slot"] < r["deadline"] for r in out)


@pytest.mark.parametrize("name", ["op6_suffix_dedup", "op8_sharding"])
def test_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    df = queries.queries()[name](spark, SF)
    want = con.sql(f"SELECT {', '.join(df.columns)} FROM ({queries.oracle_sql()[name]})").fetchall()
    assert sorted(map(tuple, df.collect())) == sorted(want)
