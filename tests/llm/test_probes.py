"""Rows that were made to mislead: words whose polynomial codes are equal, items and rows without an id, hot keys."""

import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from rolegraph.llm import _text, decontamination, jaccard_join, mixing, secrets, substring_dedup, suffix_dedup, urls
from tests.llm import brute


def twins(n):
    """A Thue-Morse word of two letters of n (a power of two) characters, and the same with the letters swapped."""
    x = "a"
    while len(x) < n:
        x += x.translate(str.maketrans("ab", "ba"))
    return x, x.translate(str.maketrans("ab", "ba"))


def test_codes_tell_twins_apart():
    for n in (64, 256, 1024, 4096):
        a, b = twins(n)
        data = np.frombuffer(f"{a} {b}".encode(), np.uint8)
        start, end, _ = _text.words(data, np.array([0, len(data)]))
        assert all(len(set(c.tolist())) == 2 for c in _text.word_codes(data, start, end))
    poly = _text.span_codes(_text.prefix_codes(data), start, end)
    assert poly[0] == poly[1]  # which is why it decides nothing alone
    both = np.frombuffer("".join(twins(256)).encode(), np.uint8)
    codes = _text.block_codes(both, 200)
    assert codes[0] != codes[256] and len(codes) == 313


def test_block_codes_are_codes_of_their_bytes():
    """Equal bytes have one code wherever they stand, and in whatever piece they are hashed."""
    r = np.random.default_rng(5)
    some = r.integers(97, 123, 250, dtype=np.uint8)
    data = np.concatenate([some, r.integers(97, 123, _text.BLOCK - 300, dtype=np.uint8), some, some])
    codes = _text.block_codes(data, 200)
    assert codes[0] == codes[_text.BLOCK - 50] == codes[_text.BLOCK + 200] and len(np.unique(codes)) == len(codes) - 102
    assert len(_text.block_codes(data[:199], 200)) == 0


def test_twins_in_passages_and_shingles(spark):
    a, b = twins(1024)
    same = [f"w{i}" for i in range(49)]
    rows = [(1, " ".join([*same, a])), (2, " ".join([*same, b])), (3, " ".join([*same, a])), (4, " ".join([*same[:4], a, *same[4:9]])), (5, " ".join([*same[:4], b, *same[4:9]])), (6, a + b), (7, b + a), (8, a + b)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in substring_dedup.report(docs).collect()}
    assert got == brute.passages(rows) and got[2][1] == 0 and got[3][1] == 50
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["n_links"]) for r in jaccard_join.join(docs).collect()}
    assert got == brute.jaccard(rows) and got[5][1] == 5
    assert sorted(tuple(r) for r in suffix_dedup.report(docs).collect()) == sorted(brute.repeats(rows))


def test_items_without_an_id_hit_words(spark):
    passage = " ".join(f"p{i}" for i in range(15))
    docs = spark.createDataFrame([(1, f"before {passage} after")], "doc_id long, text string")
    (got,) = decontamination.report(docs, spark.createDataFrame([(None, passage)], "item_id long, text string")).collect()
    assert (got["n_hit"], got["n_items"], got["contaminated"], got["items_sha256"]) == (15, 0, True, brute.sha(""))


@pytest.mark.parametrize("ids", ["none", "one", "alike"])
def test_mixed_places_every_row(spark, ids):
    """Rows without an id, of one id, or alike throughout, take turns by source like others."""
    rows = [({"none": None, "one": 7, "alike": None}[ids], "a" if i % 2 else "b", "same" if ids == "alike" else f"t{i}") for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    out = mixing.mixed(df, {"a": 1, "b": 1}, block=4).coalesce(1).collect()
    assert Counter(map(tuple, out)) == Counter(rows)
    blocks = [out[i]["source"] for i in range(0, 200, 4)]
    assert all(r["source"] == blocks[i // 4] for i, r in enumerate(out)) and all(x != y for x, y in zip(blocks, blocks[1:], strict=False))


def test_many_sources_without_a_weight(spark, monkeypatch):
    """Ranks come from a table; beyond the size of a broadcast it is joined."""
    from rolegraph.llm import _rows

    rows = [(k, f"s{k % 97}") for k in range(1500)]
    df = spark.createDataFrame(rows, "doc_id long, source string")
    want = sorted(map(tuple, mixing.mix(df, {"s3": 2}, block=3).collect()))
    monkeypatch.setattr(_rows, "BROADCAST_ROWS", 3)
    monkeypatch.setattr(mixing, "BROADCAST_ROWS", 3)
    assert sorted(map(tuple, mixing.mix(df, {"s3": 2}, block=3).collect())) == want and len(want) == 1500


def test_whole_prefixes_and_sketches(spark):
    """Both ways of filing sets give the links of a plain comparison."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    want = brute.jaccard([(r["doc_id"], r["text"]) for r in docs.collect()])
    for sketch in (None, jaccard_join.SKETCH):
        assert {r["doc_id"]: (r["n_shingles"], r["component_id"], r["n_links"]) for r in jaccard_join.join(docs, sketch=sketch).collect()} == want


def test_blocks_are_bounded_by_shingles(spark, monkeypatch):
    r = random.Random(9)
    base = [f"w{r.randrange(10**6)}" for _ in range(400)]
    rows = [(i, " ".join([*base[:200], f"own{i}", *base[200:]])) for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(jaccard_join, "BLOCK_SHINGLES", 1000)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["n_links"]) for r in jaccard_join.join(docs).collect()}
    assert got == brute.jaccard(rows)


def test_long_accounts_and_hosts(spark):
    account, host = "user=" + "n" * 150, "https://" + "h." * 300 + "org:8080"
    text = f"{account} password=hunter22 {host}"
    (got,) = secrets.report(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()
    assert got["spans"].split(",")[0] == f"account:0:{len(account)}" and got["spans"].split(",")[-1] == f"endpoint:{len(text) - len(host)}:{len(text)}"


def test_hot_urls(spark):
    """A third of the rows hold one url, a third none."""
    rules = urls.rule_table(spark, [("net", "/", "block"), ("a.net", "/ok/", "allow")])
    rows = [(i, ["http://a.net/ok/x", None, f"http://h{i}.net/{i}"][i % 3]) for i in range(3000)]
    got = Counter((r["rule"], r["verdict"]) for r in urls.filter_urls(spark.createDataFrame(rows, "page_id int, url string"), rules).collect())
    assert got == {("a.net/ok/", "allow"): 1000, (None, "allow"): 1000, ("net/", "block"): 1000}


def test_texts_of_one_key_are_named_anew(spark, monkeypatch):
    """Where a key is shared by different texts, others are used: nothing goes that stands once."""
    from pyspark.sql import functions as F

    plain, seeds = suffix_dedup.key_of, []

    def sharing(text, seed):
        seeds.append(seed)
        return F.lit(5).cast("long") if seed == 1 else F.length(text).cast("long") if seed == 2 else plain(text, seed)

    monkeypatch.setattr(suffix_dedup, "key_of", sharing)
    r = random.Random(2)
    once = lambda n: "".join(r.choice("abcdefgh ") for _ in range(n))
    rows = [(1, once(300)), (2, once(300)), (3, once(400)), (4, "short"), (5, "short"), (6, None)]
    rows.append((7, rows[2][1]))
    assert sorted(map(tuple, suffix_dedup.report(spark.createDataFrame(rows, "doc_id long, text string")).collect())) == sorted(brute.repeats(rows))
    assert seeds == [1, 2, 3]


@pytest.mark.parametrize("block", [1, 7])
def test_pairs_of_blocks(spark, monkeypatch, block):
    """Components cut into many blocks have the links, and the numbers of links, of a comparison of all pairs."""
    r, rows = random.Random(9), []
    for _ in range(3):
        base = [f"w{r.randrange(10**6)}" for _ in range(120)]
        for _ in range(30):
            near = list(base)
            for _ in range(r.randint(0, 6)):
                near[r.randrange(120)] = f"x{r.randrange(10**6)}"
            rows.append((len(rows), " ".join(near)))
    rows += [(len(rows) + i, rows[5][1]) for i in range(10)]
    monkeypatch.setattr(jaccard_join, "BLOCK", block)
    got = {x["doc_id"]: (x["n_shingles"], x["component_id"], x["n_links"]) for x in jaccard_join.join(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute.jaccard(rows)


def test_memory_of_two_blocks(spark, monkeypatch):
    """Two blocks of long sets are compared in about the memory of the sets, with the links that counting one by one gives."""
    import tracemalloc

    caught, r, n = [], np.random.default_rng(3), 40
    monkeypatch.setattr(type(spark.range(1).groupBy("id")), "applyInArrow", lambda self, f, schema: caught.append(f))
    docs = spark.createDataFrame([], "id long, hash long, text string")
    jaccard_join.compare(docs, spark.createDataFrame([], "id long, hash long, code long, copies long, part long, block int, blocks int"))
    base, sets = r.integers(0, 1 << 63, 50_000).astype(np.uint64), []
    for i in range(n):
        s = base.copy()
        s[r.permutation(len(s))[: 600 * i]] = r.integers(0, 1 << 63, 600 * i).astype(np.uint64)
        sets.append(np.unique(s) * np.uint64(2))
    link = lambda a, b: 175 * len(np.intersect1d(a, b)) >= 75 * (len(a) + len(b))
    rows = [(0, 0, 1, i % 2, i, i + 1, s.tobytes()) for i, s in enumerate(sets)]
    kinds = {"part": pa.int64(), "x": pa.int32(), "y": pa.int32(), "block": pa.int32(), "code": pa.int64(), "copies": pa.int64(), "shingles": pa.binary()}
    table = pa.table([pa.array(list(c), k) for c, k in zip(zip(*rows, strict=True), kinds.values(), strict=True)], names=list(kinds))
    tracemalloc.start()
    got = caught[0](table)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    want = {i: sum(j + 1 for j in range(n) if (i + j) % 2 and link(sets[i], sets[j])) for i in range(n)}
    assert {x["a"]: x["links"] for x in got.to_pylist() if x["a"] == x["b"]} == {i: k for i, k in want.items() if k}
    assert 0 < len([k for k in want.values() if k]) and peak < 4 * sum(map(len, sets)) * 8
