"""Listings, reports, tag heads and the stream of scans, on small files."""

import json
import struct

import pytest
from pyspark.sql import functions as F

from rolegraph.functions import text as T
from rolegraph.plans.incremental import carry_over, diff, upsert
from rolegraph.sources import listing, tags
from rolegraph.streaming import scan


def flac(comments, rate=44100, depth=16, samples=44100, art=False):
    packed = (rate << 44) | (1 << 41) | ((depth - 1) << 36) | samples
    info = struct.pack(">HH", 4096, 4096) + b"\0" * 6 + struct.pack(">Q", packed) + b"\0" * 16
    body = struct.pack("<I", 3) + b"ref" + struct.pack("<I", len(comments)) + b"".join(struct.pack("<I", len(c.encode())) + c.encode() for c in comments)
    blocks = [(0, info)] + ([(6, b"\0" * 40)] if art else []) + [(4, body)]
    return b"fLaC" + b"".join(bytes([k | (128 if i == len(blocks) - 1 else 0)]) + struct.pack(">I", len(b))[1:] + b for i, (k, b) in enumerate(blocks)) + b"\xff\xf8audio"


def wav(rate=8000, seconds=2):
    data = rate * seconds * 2
    return b"RIFF" + struct.pack("<I", 36 + data) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, rate, rate * 2, 2, 16) + b"data" + struct.pack("<I", data)


def test_tags(spark):
    rows = [("a.flac", 1000, 1, flac(["TITLE=So What", "Album Artist= Miles ", "GENRE=Jazz", "genre=Jazz", "GENRE=Bop"], 96000, 24, 96000, True)), ("b.wav", 32044, 1, wav()), ("c.ogg", 9, 1, b"OggS" + b"\0" * 20), ("d", 3, 1, b"abc"), ("e.flac", 50, 1, flac([]))]
    out = {r["path"]: r for r in tags.read_tags(spark.createDataFrame(rows, "path string, size bigint, mtime bigint, content binary")).collect()}
    assert out["a.flac"]["tags"] == {"title": ["So What"], "albumartist": ["Miles"], "genre": ["Jazz", "Bop"]} and out["a.flac"]["has_embedded_art"]
    p = out["a.flac"]["properties"]
    assert (p["sample_rate"], p["bit_depth"], p["channels"], p["duration_ms"], p["lossless"]) == (96000, 24, 2, 1000, True)
    assert out["b.wav"]["properties"]["duration_ms"] == 2000 and out["b.wav"]["properties"]["channels"] == 1
    assert out["c.ogg"]["problem"] == "no reader for ogg" and out["d"]["problem"] == "no reader for this file"
    assert out["e.flac"]["tags"] == {}


def test_listing(spark, tmp_path):
    for name in ("a/01.flac", "a/Folder.JPG", "a/cover.png", "a/.hidden.flac", "b/x.txt", "b/y.MP3"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(b"x")
    files = listing.listing(spark, [str(tmp_path)])
    assert sorted(r["path"].removeprefix(str(tmp_path)) for r in listing.audio_files(files).collect()) == ["/a/01.flac", "/b/y.MP3"]
    assert [r["folder_cover"].removeprefix(str(tmp_path)) for r in listing.covers(files).collect()] == ["/a/cover.png"]
    assert listing.in_scope(files, [f"{tmp_path}/a"]).count() == 3 and listing.in_scope(files, []).count() == 5


def test_reports(spark, tmp_path):
    good = {"format": "f", "version": 1, "more": 1, "report": {"files": [{"path": "/a.flac", "size_bytes": 5, "modified_unix": 7, "detections": {"upscaling": True}, "flac_md5": {"state": "Mismatch"}}, {"size_bytes": 1}]}}
    (tmp_path / "r.json").write_text(json.dumps(good))
    rows = listing.reports(spark, [str(tmp_path / "r.json")], "f").collect()
    assert [(r["path"], r["file_name"], r["size"], r["upscaling"], r["md5_state"], r["fake_stereo"]) for r in rows] == [("/a.flac", "a.flac", 5, True, "Mismatch", None)]
    with pytest.raises(Exception, match="not a report"):
        listing.reports(spark, [str(tmp_path / "r.json")], "g").collect()


def test_stream(spark, tmp_path):
    schema = "path string, size bigint, mtime bigint"
    spark.createDataFrame([("a", 1, 1), ("b", 1, 1)], schema).write.parquet(f"{tmp_path}/in/1")
    read = lambda: spark.readStream.schema(schema).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
    scan.keep_latest(read(), f"{tmp_path}/log", f"{tmp_path}/cp").awaitTermination()
    spark.createDataFrame([("a", 2, 2)], schema).write.parquet(f"{tmp_path}/in/2")
    scan.keep_latest(read(), f"{tmp_path}/log", f"{tmp_path}/cp").awaitTermination()
    assert sorted((r["path"], r["size"]) for r in scan.current(spark.read.parquet(f"{tmp_path}/log")).collect()) == [("a", 2), ("b", 1)]


def test_incremental(spark):
    schema = "path string, size bigint, mtime bigint"
    before, now = spark.createDataFrame([("a", 1, 1), ("b", 1, 1), ("c", 1, 1)], schema), spark.createDataFrame([("a", 1, 1), ("b", 2, 1), ("d", 1, 1)], schema)
    assert {r["path"]: r["state"] for r in diff(before, now, ["path"], ["size", "mtime"]).collect()} == {"a": "reused", "b": "changed", "c": "removed", "d": "new"}
    kept, to_read = carry_over(before, now, ["path"], ["size", "mtime"])
    assert [r["path"] for r in kept.collect()] == ["a"] and sorted(r["path"] for r in to_read.collect()) == ["b", "d"]
    assert {r["path"]: r["size"] for r in upsert(before, now, ["path"], "mtime").collect()} == {"a": 1, "b": 2, "c": 1, "d": 1}


def test_text(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    n = lambda x: one(T.normalize(F.lit(x)))
    assert [n(x) for x in ("The Beatles", "Beatles, The", "  Björk ", "The", "AC/DC", "Łódź!", "ÆSIR ß", "!!!")] == ["beatles", "beatles", "bjork", "the", "ac dc", "lodz", "aesir ss", ""]
    s = lambda x: one(T.split_names(F.lit(x)))
    assert s("Garou feat. Céline Dion") == ["Garou", "Céline Dion"] and s("AC/DC; Simon & Garfunkel / X, ft Y") == ["AC/DC", "Simon & Garfunkel", "X", "Y"]
    assert s("A featuring Bob with C") == ["A", "Bob with C"] and s(" ; ") == []
    assert [one(T.sort_name(F.lit(x))) for x in ("The Rest", "les Yeux", "Theatre")] == ["Rest, The", "Yeux, les", "Theatre"]
    assert [one(T.extract_year(F.lit(x))) for x in ("05/03/1986", "é1499 2201", "1986.03", "")] == [1986, None, 1986, None]
    assert [one(T.format_duration(F.lit(x))) for x in (260_700, 3_600_000, 499)] == ["4:21", "1:00:00", "0:00"]
    assert [one(T.title_of_path(F.lit(x))) for x in ("/a/01 - So What.flac", "/a/1999.flac", "x")] == ["So What", "1999", "x"]
    assert [one(T.number_of_path(F.lit(x))) for x in ("/a/01 - x.flac", "/a/1999.flac", "/a/000.x")] == [1, None, None]
    assert [one(T.is_under(F.lit(x), F.lit("/m/Rock"))) for x in ("/m/Rock", "/m/Rock/a", "/m/Rockabilly")] == [True, True, False]
    assert one(T.csv_line([F.lit('a"b'), F.lit("c"), F.lit(None)])) == '"a""b",c,'


def test_damaged_heads_keep_their_rows(spark):
    """Bytes that are no UTF-8 are replaced; lengths and counts beyond the file set ``problem``; chunks before the data too."""
    good = flac(["TITLE=abc", "GENRE=Jazz"])
    latin = good.replace(b"TITLE=abc", b"TITLE=\xe9bc")
    vendor = good.replace(struct.pack("<I", 3) + b"ref", b"\xff\xff\xff\xff" + b"ref")
    count = good.replace(struct.pack("<I", 2) + struct.pack("<I", 9), b"\xff\xff\xff\xff" + struct.pack("<I", 9))
    listed = wav().replace(b"data", b"LIST")
    rows = [(name, 100, 1, x) for name, x in (("good", good), ("latin", latin), ("vendor", vendor), ("count", count), ("listed", listed))]
    out = {r["path"]: r for r in tags.read_tags(spark.createDataFrame(rows, "path string, size bigint, mtime bigint, content binary")).collect()}
    assert out["good"]["problem"] is None and out["latin"]["problem"] is None
    assert out["latin"]["tags"] == {"title": ["�bc"], "genre": ["Jazz"]}
    assert out["vendor"]["problem"] and out["count"]["problem"] and out["listed"]["problem"] and out["listed"]["properties"]["duration_ms"] is None
    assert all(out[x]["properties"]["sample_rate"] == 44100 for x in ("vendor", "count"))


def test_places_and_parts(spark):
    """Nested places go, whatever their slashes; the first table that holds a key keeps it."""
    from rolegraph.operators.lookups import append_distinct
    from rolegraph.sources.listing import top_places, watched

    places = lambda *names: spark.createDataFrame([(n,) for n in names], "place string")
    top = lambda df: sorted(r[0] for r in df.collect())
    assert top(top_places(places("/a/b", "/a/b/", "/a/bc", "/a/b/c/d", None))) == ["/a/b", "/a/bc"]
    assert top(top_places(places("/", "/a"))) == ["/"] and top(top_places(places())) == []
    assert top(watched(places("/a", "/b"), places("/b/c", "/c"))) == ["/a", "/b", "/c"]
    assert top(watched(places("/a", "/b"), places("/b/c"), replace=True)) == ["/b/c"]
    parts = [spark.createDataFrame(rows, "path string, title string") for rows in ([("b", "1"), ("b", "1")], [("a", None), ("b", "2")], [("c", "3"), ("a", "4")])]
    assert [tuple(r) for r in append_distinct(parts, "path").collect()] == [("b", "1", 0), ("a", None, 1), ("c", "3", 2)]
