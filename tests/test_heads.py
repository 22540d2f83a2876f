"""Listings that lose nothing, heads by range reads, chunked containers, reports known by their first bytes."""

import json
import os
import struct

import pytest
from pyspark.sql import functions as F

from rolegraph.functions import text as T
from rolegraph.plans import catalog
from rolegraph.sources import files, heads, listing, tags
from tests.test_sources import flac, wav


def chunk(name, body, order):
    return name + struct.pack(f"{order}I", len(body)) + body + b"\0" * (len(body) % 2)


def info(**fields):
    return b"INFO" + b"".join(chunk(k.encode(), v.encode(), "<") for k, v in fields.items())


def wave(chunks):
    body = b"WAVE" + b"".join(chunks)
    return b"RIFF" + struct.pack("<I", len(body)) + body


FMT = chunk(b"fmt ", struct.pack("<HHIIHH", 1, 1, 44100, 88200, 2, 16), "<")
DATA = chunk(b"data", b"\0" * 22050, "<")


def aiff(kind=b"AIFF", extra=b"", more=()):
    rate = struct.pack(">HQ", 16383 + 15, 44100 << 48)
    body = kind + b"".join(more) + chunk(b"COMM", struct.pack(">HIH", 1, 11025, 16) + rate + extra, ">") + chunk(b"SSND", b"\0" * 22050, ">")
    return b"FORM" + struct.pack(">I", len(body)) + body


@pytest.fixture
def shelf(tmp_path):
    def put(name, data, mtime=1000):
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(data)
        os.utime(path, (mtime, mtime))

    good = flac(["TITLE=So What", "ARTIST=Miles Davis"], 44100, 16, 44100, True)
    big = flac(["TITLE=Long"], 96000, 24, 96000)
    at = big.index(b"\x84")  # the comments are the last block; a picture of two megabytes goes before them
    big = big[:at] + bytes([6]) + struct.pack(">I", 2 << 20)[1:] + b"\1" * (2 << 20) + big[at:]
    put("a/01.flac", good + b"audio" * 100_000)
    put("a/_intro.flac", good)
    put("_side/c.flac", big + b"audio" * 100_000, 2000)
    put("a/.hidden.flac", good)
    put(".git/d.flac", good)
    put("a/list.wav", wave([chunk(b"JUNK", b"odd", "<"), FMT, chunk(b"LIST", info(INAM="So What", IART="Miles", IGNR="Jazz", IXXX="no"), "<"), DATA]))
    put("a/late.wav", wave([FMT, DATA, chunk(b"LIST", info(INAM="After"), "<")]))
    put("a/cut.wav", wave([FMT, DATA])[:-5000])
    put("a/float.wav", wave([FMT.replace(struct.pack("<HH", 1, 1), struct.pack("<HH", 3, 1)), DATA]))
    put("b/x.aiff", aiff(more=[chunk(b"NAME", b"So What", ">"), chunk(b"AUTH", b"Miles", ">")]))
    put("b/x.aifc", aiff(b"AIFC", b"fl32" + b"\0\0"))
    put("b/bad.flac", good[:60])
    put("b/empty.flac", b"")
    put("b/y.ogg", b"OggS" + b"\0" * 40)
    return tmp_path


def test_listing_keeps_all_names(spark, shelf):
    found = {r["path"].removeprefix(f"{shelf}/"): r for r in files.listed(spark, [str(shelf)]).collect()}
    assert set(found) == {"a/01.flac", "a/_intro.flac", "_side/c.flac", "a/list.wav", "a/late.wav", "a/cut.wav", "a/float.wav", "b/x.aiff", "b/x.aifc", "b/bad.flac", "b/empty.flac", "b/y.ogg"}
    assert found["_side/c.flac"]["mtime"] == 2000 and found["b/empty.flac"]["size"] == 0
    assert files.listed(spark, [f"file://{shelf}/a", f"{shelf}/missing"]).count() == 6


def test_conditions_reach_the_source(spark, shelf):
    df = files.listed(spark, [str(shelf)]).where(F.col("path").startswith(f"{shelf}/a/") & (F.col("size") > 1000) & (F.col("mtime") < 2000) & F.col("path").endswith(".wav"))
    assert sorted(os.path.basename(r["path"]) for r in df.collect()) == ["cut.wav", "float.wav", "late.wav", "list.wav"]
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Filter" not in plan.split("BatchScan")[0]  # nothing is left for Spark to filter
    reader = files.FileReader([str(shelf)])
    assert list(reader.pushFilters([files.D.StringStartsWith(("path",), f"{shelf}/a/"), other := files.D.Not(files.D.EqualTo(("size",), 1))])) == [other]
    assert {p.path for p in reader.partitions()} == {str(shelf), f"{shelf}/a"}  # other folders are not entered


def test_heads_only(spark, shelf):
    out = {r["path"].removeprefix(f"{shelf}/"): r for r in heads.heads(files.listed(spark, [str(shelf)])).collect()}
    assert all(r["bytes_read"] <= heads.FIRST + 1024 for r in out.values())
    assert out["_side/c.flac"]["size"] > 2 << 20 and [b["id"] for b in out["_side/c.flac"]["blocks"]] == ["0", "6", "4"]
    assert out["b/empty.flac"]["problem"] == "no reader for this file" and out["b/bad.flac"]["problem"]
    gone = spark.createDataFrame([(f"{shelf}/gone.flac", 1, 1)], files.SCHEMA)
    assert [r["problem"] for r in heads.heads(gone).collect()] == ["not readable: FileNotFoundError"]


def test_tags_of_heads(spark, shelf):
    out = {r["path"].removeprefix(f"{shelf}/"): r for r in heads.read_heads(heads.heads(files.listed(spark, [str(shelf)]))).collect()}
    assert len(out) == 12
    p = lambda name: tuple(out[name]["properties"][c] for c in ("codec", "container", "sample_rate", "bit_depth", "channels", "duration_ms", "lossless"))
    assert out["a/01.flac"]["tags"] == {"title": ["So What"], "artist": ["Miles Davis"]} and out["a/01.flac"]["has_embedded_art"] and out["a/01.flac"]["problem"] is None
    assert out["_side/c.flac"]["tags"] == {"title": ["Long"]} and p("_side/c.flac") == ("flac", "flac", 96000, 24, 2, 1000, True)
    assert out["a/list.wav"]["tags"] == {"title": ["So What"], "artist": ["Miles"], "genre": ["Jazz"]}
    for name in ("a/list.wav", "a/late.wav", "b/x.aiff"):
        assert p(name) == ("pcm", name[-4:].strip("."), 44100, 16, 1, 250, True) and out[name]["problem"] is None and out[name]["properties"]["bitrate_kbps"] == 705
    assert out["a/late.wav"]["tags"] == {"title": ["After"]} and p("a/float.wav")[0] == "pcm_float"
    assert out["b/x.aiff"]["tags"] == {"title": ["So What"], "artist": ["Miles"]}
    assert p("b/x.aifc")[0] == "fl32" and not p("b/x.aifc")[-1]
    assert "beyond the file" in out["a/cut.wav"]["problem"] and p("a/cut.wav")[2] == 44100 and p("a/cut.wav")[5] is None
    assert out["b/y.ogg"]["problem"] == "no reader for ogg"


def test_heads_say_what_whole_files_say(spark, shelf):
    """Tags and properties are those of ``read_tags`` on the same files' bytes."""
    rows = [(str(x), x.stat().st_size, 1000, x.read_bytes()) for x in (shelf / "a/01.flac", shelf / "a/_intro.flac")] + [(f"{shelf}/p.wav", len(wav()) + 32000, 1000, wav() + b"\0" * 32000)]
    (shelf / "p.wav").write_bytes(rows[-1][3])
    whole = {r["path"]: r for r in tags.read_tags(spark.createDataFrame(rows, "path string, size bigint, mtime bigint, content binary")).collect()}
    for r in heads.read_heads(heads.heads(spark.createDataFrame([r[:3] for r in rows], files.SCHEMA))).collect():
        same = whole[r["path"]]
        drop = lambda x: {k: v for k, v in x["properties"].asDict().items() if k != "bitrate_kbps"}
        assert (r["tags"], drop(r), r["problem"]) == (same["tags"], drop(same), same["problem"])


def test_one_file(spark, shelf):
    (one,) = heads.inspect(spark, f"{shelf}/b/x.aiff").collect()
    assert one["tags"]["title"] == ["So What"] and one["size"] == os.path.getsize(shelf / "b/x.aiff")
    assert set(catalog.build(heads.inspect(spark, f"{shelf}/a/01.flac").drop("problem").withColumns({"folder_cover": F.lit(None).cast("string"), "integrity": F.lit(None).cast("struct<state:string,method:string,detail:string,checked_at:bigint>")})).artist.select("name").first()) == {"Miles Davis"}


def test_reports_by_their_first_bytes(spark, tmp_path):
    report = {"format": "meter-report", "version": 1, "report": {"files": [{"path": "/a.flac", "size_bytes": 5, "modified_unix": 7}]}}
    late = {"pad": "x" * 600} | report
    for name, what in (("_r.json", report), ("sub/r.JSON", report), ("late.json", late), ("other.json", {"cover": 1}), ("r.txt", report)):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(json.dumps(what))
    got = listing.reports_below(listing.listing(spark, [str(tmp_path)]), "meter-report").collect()
    assert sorted(r["seq"]["_file"].removeprefix(str(tmp_path)) for r in got) == ["/_r.json", "/sub/r.JSON"] and {r["path"] for r in got} == {"/a.flac"}
    with pytest.raises(Exception, match="not a report"):
        (tmp_path / "_r.json").write_text(json.dumps(report | {"version": 99}))
        listing.reports_below(listing.listing(spark, [str(tmp_path)]), "meter-report").collect()


def test_resolved_places(spark):
    one = lambda x: spark.range(1).select(T.resolved(F.lit(x))).first()[0]
    assert [one(x) for x in ("/a/./b//c/", "/a/../b", "/../..", "/a/b/../../c/.", "/")] == ["/a/b/c", "/b", "/", "/c", "/"]
    places = spark.createDataFrame([("/m/rock/../jazz",), ("/m/./jazz/x",), ("/m/rock",)], "place string")
    assert sorted(r[0] for r in listing.top_places(places).collect()) == ["/m/jazz", "/m/rock"]
