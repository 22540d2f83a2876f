"""Operators 11 to 13 against plain versions, on odd tables and on given ones."""

import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from rolegraph.llm import filter_audit, lexical_search, queries, simhash
from tests.llm import brute

SF = "/root/testdata/sf0.01"
DOCS = "doc_id bigint, text string, source string, part string, fp bigint, n string, query int, term string, id string, digest string"


def word(r):
    return "".join(r.choice("abcdefgXY") for _ in range(r.randint(1, 4)))


def rows():
    r = random.Random(8)
    base = [word(r) for _ in range(300)]
    out = [(1, None, None), (2, "", ""), (3, " \n\t", "s0"), (4, "Zwölf Äpfel é", "s1"), (5, "zwölf Äpfel é", "s1"), (6, "a b c", None), (None, "a b c", "s1"), (None, "a b c", "s1"), (None, "only here $5", None)]
    out += [(7, "a b c", "s0"), (7, "a b c", "s0"), (7, "other words of one id", "s0"), (8, " ".join(word(r) for _ in range(20_000)), "s0"), (9, "x" * 5000, "s2"), (10, "É" * 10 + "ABC", "s2")]
    for i in range(60):
        near = list(base)
        for _ in range(r.randint(0, 3)):
            near[r.randrange(300)] = word(r)
        out.append((20 + i, " ".join(near), f"s{i % 3}"))
    out += [(100 + i, " ".join(word(r) for _ in range(r.randint(1, 250))) + r.choice(["", " # x", " SHOUT " * 9]), r.choice(["s0", "s1", None])) for i in range(40)]
    return out + [(200 + i, "the very same text", "s0") for i in range(40)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*x, "p", 1, "n", 2, "t", "i", "d") for x in rows()], DOCS).repartition(5).cache()


def plain(values):
    return sorted(tuple(-1 if x is None else x for x in r) for r in values)


def test_audit(spark, docs):
    labels = [(20, 1, 0), (21, 1, 1), (21, 0, 0), (22, None, 1), (None, 1, 1), (5, 1, 0), (203, 1, 1), (999, 1, 1), (7, 1, 1), (1, 0, 1)]
    table = spark.createDataFrame([(*x, "q") for x in labels], "doc_id bigint, quality int, toxic int, part string")
    got = filter_audit.audit(docs, table)
    assert sorted(map(tuple, got.collect())) == brute.audit(rows(), labels)
    assert dict(got.dtypes) == {"part": "string", "filter_order": "string", "step": "int"} | dict.fromkeys(("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"), "bigint")
    none = filter_audit.audit(docs, table.where("false")).agg(F.sum("good_lost"), F.sum("toxic_lost")).first()
    assert tuple(none) == (0, 0)
    assert filter_audit.audit(docs.where("false"), table).count() == 0


def test_audit_keeps_its_sums(spark):
    """What is kept, removed and redundant adds up, and shares of removals add up to what all filters remove."""
    out = queries.op11_filter_audit(spark, SF)
    docs = spark.read.parquet(f"{SF}/documents.parquet").groupBy(F.coalesce("source", F.lit("")).alias("part")).count()
    last = out.where("step = 5").groupBy("part").agg(F.min("kept").alias("a"), F.max("kept").alias("b"))
    each = out.groupBy("part", "filter_order").agg(F.sum("removed").alias("gone")).groupBy("part").agg(F.min("gone").alias("c"), F.max("gone").alias("d"))
    share = out.select("part", F.expr("substring(filter_order, step, 1) f"), "shapley").distinct().groupBy("part").agg(F.sum("shapley").alias("s"))
    for r in docs.join(last, "part").join(each, "part").join(share, "part").collect():
        assert r["a"] == r["b"] == r["count"] - r["c"] and r["c"] == r["d"] and r["s"] == 120 * r["c"]


@pytest.mark.parametrize("name", ["op11_filter_audit", "op12_lexical_search"])
def test_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "labels"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = queries.queries()[name](spark, SF)
    assert sorted(map(tuple, df.collect())) == sorted(con.sql(f"SELECT {', '.join(df.columns)} FROM ({queries.oracle_sql()[name]})").fetchall())


ITEMS = [(1, "Zwölf äpfel a b c a a"), (2, None), (3, "..."), (4, "nothing of this stands there"), (None, "the very same text"), (5, "the very same text"), (5, "the very same text"), (6, "x5 $5 only"), (7, "ABC abc")]


def test_search(spark, docs, monkeypatch):
    items = spark.createDataFrame([(i, t, "s", 1) for i, t in ITEMS], "item_id bigint, text string, score string, rank int")
    want = brute.search([(d, t) for d, t, _ in rows()], ITEMS)
    assert plain(lexical_search.search(docs, items).collect()) == want
    assert [r[1] for r in want if r[0] == 5] == sorted(2 * list(range(1, 11)))
    # small windows, several blocks of items, and an index of all terms give the same rows
    monkeypatch.setattr(lexical_search, "WINDOW", 7)
    monkeypatch.setattr(lexical_search, "MOST_ENTRIES", 4)
    monkeypatch.setattr(lexical_search, "MOST_TERMS", 3)
    assert plain(lexical_search.search(docs, items).collect()) == want
    monkeypatch.setattr(lexical_search, "WINDOW_WORDS", 50)
    assert plain(lexical_search.search(docs, items, top=3).collect()) == brute.search([(d, t) for d, t, _ in rows()], ITEMS, 3)
    assert lexical_search.search(docs.where("false"), items).count() == 0
    assert lexical_search.search(docs, items.where("false")).count() == 0


def test_heaps_keep_the_best():
    r = np.random.default_rng(2)
    heap, every = [], []
    for _ in range(40):
        score, ids = r.integers(1, 9, 30), r.integers(0, 50, 30)
        every += zip(score.tolist(), (-ids).tolist(), strict=True)
        lexical_search.harvest(heap, score, ids, 10)
    assert sorted(heap) == sorted(every)[-10:]


def test_masks_cover_every_difference():
    """Any four places or fewer lie outside some mask; each mask keeps about half of the places."""
    masks = [m & (1 << 64) - 1 for m in simhash.masks()]
    r = random.Random(1)
    for _ in range(20_000):
        d = sum(1 << i for i in r.sample(range(64), r.randint(0, 4)))
        assert any(d & m == 0 for m in masks)
    assert len(masks) == 31 and all(30 <= bin(m).count("1") <= 34 for m in masks)


def test_fingerprints(spark, docs):
    got = plain(simhash.join(docs).select("doc_id", "fingerprint", "component_id").collect())
    assert got == brute.simhash_classes([(d, t) for d, t, _ in rows()])
    assert simhash.join(docs.where("false")).count() == 0
    assert simhash.join(docs).where("doc_id = 200").first()["n_alike"] == 40
    piece, simhash.PIECE = simhash.PIECE, 16
    try:
        assert simhash.fingerprint(rows()[20][1].encode()) == brute.simhash(rows()[20][1])
    finally:
        simhash.PIECE = piece


def test_given_documents(spark):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert plain(queries.op13_simhash(spark, SF).select("doc_id", "fingerprint", "component_id").collect()) == brute.simhash_classes(docs)


@pytest.mark.parametrize("most", [2, 1 << 14])
def test_large_groups(spark, most):
    """Groups by pairs and by shared points lead from each fingerprint to the same others."""
    r = random.Random(4)
    centre = [r.getrandbits(64) for _ in range(4)]
    fps = {c ^ sum(1 << i for i in r.sample(range(64), r.randint(0, 7))) for c in centre for _ in range(60)} | {0, 3, (1 << 64) - 1}
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    nodes = spark.createDataFrame([(signed(x),) for x in fps], "fp long")
    edges = [(r["a"], r["b"]) for r in simhash.links(nodes, pairs_most=most).collect()]
    assert all(bin((a ^ b) & (1 << 64) - 1).count("1") <= 4 for a, b in edges)

    def classes(pairs):
        root = {signed(x): signed(x) for x in fps}

        def find(x):
            while root[x] != x:
                x = root[x]
            return x

        for a, b in pairs:
            root[find(a)] = find(b)
        out = {}
        for x in root:
            out.setdefault(find(x), set()).add(x)
        return sorted(map(sorted, out.values()))

    assert classes(edges) == classes([(signed(a), signed(b)) for a in fps for b in fps if bin(a ^ b).count("1") <= 4])
    with pytest.raises(ValueError):
        simhash.links(nodes, radius=3)
