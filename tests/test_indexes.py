"""Saved indexes answer as the whole tables do, and read few buckets; pages, selections and hints."""

import random

import pytest
from pyspark.sql import functions as F

from rolegraph.api import Library
from rolegraph.functions.text import normalize
from rolegraph.operators import grams, suggest
from rolegraph.operators.lookups import Page
from rolegraph.plans import catalog
from tests.test_maintained import ROWS, files


@pytest.fixture(scope="module")
def lib(spark, tmp_path_factory):
    rows = [*ROWS, ("/z/Björk/01.flac", "Jóga", "Björk", "Homogenic", "Electronic", 300000), ("/z/x/02.flac", "The Who", "The Who", "Who", "Rock", 9)]
    return Library(catalog.kept(catalog.build(files(spark, rows)), f"{tmp_path_factory.mktemp('kept')}/c"))


def test_search_index(spark, lib, tmp_path):
    c = lib.catalog
    grams.write([("artist", c.artist, "key", "name"), ("release", c.release, "release_key", "title"), ("track", c.file, "path", "title"), ("label", c.label, "key", "name")], f"{tmp_path}/i", 16)
    for text in ("Björk", "song", "so", "a", "artist 1", "who", "THE", "album 11", "nobody here", "zzz", "", "!", "1"):
        want = [tuple(r) for r in lib.search(text, 25).select("score", "kind", "id", "name").collect()]
        assert [tuple(r) for r in grams.search(spark, f"{tmp_path}/i", text, 25, buckets=16).collect()] == want, text
        assert [tuple(r) for r in grams.search(spark, f"{tmp_path}/i", text, 5, 3, 16).collect()] == want[3:8]
    found = grams.candidates(spark, f"{tmp_path}/i", "homogenic", 16)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan and "EqualTo(gram" in plan
    assert len(found.select(F.col("_metadata.file_path").alias("p")).distinct().collect()) <= 1 and found.count() == 1


def test_suggestions(spark, tmp_path):
    r = random.Random(6)
    words = {"".join(r.choice("abcé ") for _ in range(r.randint(1, 14))).strip() for _ in range(400)} | {"metallica", "miles davis", "x"}
    names = spark.createDataFrame([(w,) for w in sorted(words) if w], "name string").withColumn("key", normalize(F.col("name"))).where("key <> ''")
    suggest.write(names, f"{tmp_path}/s")
    held = suggest.read(spark, f"{tmp_path}/s")
    for text in ("metalica", "Miles Davies", "abcab", "b", "caca bb ac", "cc", "nothing like this at all"):
        (needle,) = spark.range(1).select(normalize(F.lit(text))).first()
        far = F.levenshtein("key", F.lit(needle))
        want = names.withColumn("d", far).where(F.col("d") <= suggest.allowed(needle)).distinct().orderBy("d", F.length("name"), "name").collect()
        assert [(x["name"], x["distance"]) for x in suggest.nearest(held, text).collect()] == [(x["name"], x["d"]) for x in want], text
    plan = suggest.nearest(held, "metalica")._jdf.queryExecution().executedPlan().toString()
    assert "k#" in plan.split("PartitionFilters")[1][:120]


def test_hints(lib):
    with pytest.raises(ValueError, match="is it 'Electronic'"):
        lib.albums(genre="Elektronic")
    with pytest.raises(ValueError, match="is it 'Björk'"):
        lib.artist("Bjorkk")
    with pytest.raises(ValueError, match=r"no role 'zzzzzzzz'; in use are"):
        lib.role_key("zzzzzzzz")
    with pytest.raises(ValueError, match="is it 'composer'"):
        lib.role_key("Composr")
    assert [r["name"] for r in lib.nearest("release", "Homogenik").collect()] == ["Homogenic"]


def test_search_pages(lib):
    every = lib.search_page("a", Page(None))["hits"].collect()
    second = lib.search_page("a", Page(5, 5))["hits"].collect()
    assert [r["id"] for r in second] == [r["id"] for r in every][5:10]
    detail = {(r["kind"], r["name"]): r["detail"] for r in lib.search_page("homogenic", comments=True)["hits"].collect()}
    assert detail == {("release", "Homogenic"): "Björk"} and lib.search_page("homogenic", comments=True)["comments"].count() == 0
    assert lib.search_page("joga")["hits"].first()["detail"] == "Homogenic"
    with pytest.raises(ValueError, match="some text"):
        lib.search_page(" - ")


def test_selections(lib):
    chosen = lib.selection("jóga")
    assert [r["line"] for r in lib.playlist(chosen).collect()] == ["#EXTM3U", "#EXTINF:300,Björk - Jóga\n/z/Björk/01.flac"]
    assert [r["album"] for r in lib.track_table(chosen).collect()] == ["Homogenic"]
    for what in (lib.playlist, lib.track_table):
        with pytest.raises(ValueError, match="nothing to put in a"):
            what(lib.selection("no such title"))


def test_artist_and_track_pages(spark, lib):
    page = lib.artist_page("Guest 1")
    totals = {r["kind"]: (r["releases"], r["tracks"]) for r in page["totals"].collect()}
    assert totals == {"performing": (0, 48), "writing": (0, 0)}
    assert page["guest"].count() == 24 and {r["tracks"] for r in page["guest"].collect()} == {2} and page["discography"].count() == 0
    assert [r["name"] for r in page["genres"].collect()] == [f"Genre {i}" for i in range(4)]
    own = lib.artist_page("artist 3")["discography"].collect()
    assert [(r["tracks"], r["copy"], r["artist"]) for r in own] == [(4, "duplicate", "Artist 3")] * 2
    anon = {r["kind"]: (r["releases"], r["tracks"]) for r in lib.artist_page("anon")["totals"].collect()}
    assert anon == {"performing": (0, 0), "writing": (26, 98)}
    said = spark.createDataFrame([("/z/x/02.flac", 100, 1, "meter"), ("/z/x/02.flac", 100, 9, "other"), ("/q", 1, 1, "meter")], "path string, size long, mtime long, source string")
    from dataclasses import replace

    page = Library(replace(lib.catalog, analysis=said)).track_page("/z/x/02.flac")
    assert [(r["source"], r["stale"]) for r in page["analyses"].collect()] == [("meter", False), ("other", True)]


def test_keyed_tables(spark, lib):
    """Saved as bucketed tables, entities and what hangs on them are joined where they stand; a broken catalog is refused."""
    spark.sql("CREATE DATABASE IF NOT EXISTS keyed")
    catalog.save_tables(lib.catalog, "keyed", 4)
    again = catalog.load_tables(spark, "keyed")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joins = [again.file.join(again.release, "release_key"), again.credit.join(again.artist, again.credit["artist_key"] == again.artist["key"]), again.genre_link.join(again.genre, again.genre_link["genre_key"] == again.genre["key"])]
        for df in joins:
            assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString() and df.count() > 0
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert Library(again).artists(page=Page(None)).collect() == lib.artists(page=Page(None)).collect()
    from dataclasses import replace

    for broken in (replace(lib.catalog, artist=lib.catalog.artist.where("key <> 'bjork'")), replace(lib.catalog, credit=lib.catalog.credit.withColumn("role", F.lit("juggler"))), replace(lib.catalog, release_relation=lib.catalog.release_relation.withColumn("kind", F.lit("cousin")))):
        with pytest.raises(ValueError, match="the catalog is broken"):
            catalog.save_tables(broken, "other", 4)
