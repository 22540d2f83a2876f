"""A catalog that takes in changes equals one built anew, reads touched buckets alone, and outlives a change that broke off."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from rolegraph.operators.frozen import durable
from rolegraph.plans import catalog, maintained
from rolegraph.plans.maintained import Maintained

PLAIN = "struct<codec:string,container:string,sample_rate:int,bit_depth:int,channels:int,duration_ms:bigint,bitrate_kbps:int,lossless:boolean>"


def files(spark, rows):
    """(path, title, artist, album, genre, ms) as scanned files."""
    df = spark.createDataFrame(rows, "path string, title string, artist string, album string, genre string, ms long")
    tags = F.map_filter(F.create_map(*[x for k in ("title", "artist", "album", "genre") for x in (F.lit(k), F.array(k))], F.lit("composer"), F.array(F.lit("Anon"))), lambda _, v: v[0].isNotNull())
    p = F.struct(*[F.lit(x).alias(n) for n, x in (("codec", "flac"), ("container", "flac"), ("sample_rate", 44100), ("bit_depth", 16), ("channels", 2))], F.col("ms").alias("duration_ms"), F.lit(900).alias("bitrate_kbps"), F.lit(True).alias("lossless")).cast(PLAIN)
    none = F.lit(None).cast("struct<state:string,method:string,detail:string,checked_at:bigint>")
    return df.select("path", F.lit(100).cast("long").alias("size"), F.lit(1).cast("long").alias("mtime"), tags.alias("tags"), p.alias("properties"), F.lit(False).alias("has_embedded_art"), F.lit(None).cast("string").alias("folder_cover"), none.alias("integrity"))


ROWS = [(f"/{d}/{a}/{i:02d}.flac", f"Song {i}", f"Artist {a}; Guest {i % 3}", f"Album {a}", f"Genre {a % 4}", 1000 * i) for d in ("m", "n") for a in range(12) for i in range(1, 5)]


def same(got, want):
    for name in catalog.TABLES:
        rows = [sorted(r[0] for r in getattr(c, name).select(F.to_json(F.struct(*sorted(getattr(c, name).columns)))).collect()) for c in (got, want)]
        assert rows[0] == rows[1], name


def written(folder):
    return {str(p.relative_to(folder)): p.stat().st_mtime_ns for p in Path(folder).rglob("part-*.parquet")}


def test_changes(spark, tmp_path):
    held = Maintained.create(files(spark, ROWS), f"{tmp_path}/c", 32)
    same(held.catalog(), catalog.build(files(spark, ROWS)))
    before = written(f"{tmp_path}/c")
    # one album's first file now spells its artist otherwise and is gone from the other copy; a new file comes
    change = [("/m/3/01.flac", "Song 1", "ARTIST 3", "Album 3", None, 1000), ("/x/new.flac", "New", "Artist 5; Somebody", None, "Genre 1", 5)]
    gone = spark.createDataFrame([("/n/3/01.flac",), ("/not/there.flac",)], "path string")
    touched = held.apply(files(spark, change), gone)
    now = [r for r in ROWS if r[0] not in ("/m/3/01.flac", "/n/3/01.flac")] + change
    same(held.catalog(), catalog.build(files(spark, now)))
    # what stands in other buckets are the very same files
    after = written(f"{tmp_path}/c")
    for name, n in touched.items():
        here = {p.split("/")[1] for p in before if p.startswith(f"{name}/")}
        kept = {p.split("/")[1] for p in before if p.startswith(f"{name}/") and after.get(p) == before[p]}
        assert len(kept) >= len(here) - n, name
    assert touched["file"] <= 4 and touched["release"] <= 4 and not (tmp_path / "c/staged").exists()
    # the last file of a title goes, and so does all that hangs on it
    held.apply(files(spark, []), spark.createDataFrame([("/x/new.flac",)], "path string"))
    same(held.catalog(), catalog.build(files(spark, [r for r in now if r[0] != "/x/new.flac"])))
    assert held.catalog().artist.where("key = 'somebody'").count() == 0


def test_only_touched_buckets_are_read(spark, tmp_path):
    held = Maintained.create(files(spark, ROWS), f"{tmp_path}/c", 32)
    some = held.table("artist", [3, 5])
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "bucket" in plan.split("PartitionFilters")[1][:80]
    assert all("bucket=3" in f or "bucket=5" in f for f in some.select("*", "_metadata.file_path").select("file_path").distinct().toPandas()["file_path"])
    sizes = held.table("file").groupBy("bucket").count().collect()
    assert sum(r["count"] for r in sizes) == len(ROWS)


@pytest.mark.parametrize("at", ["staging", "marker", "placing"])
def test_a_change_that_broke_off(spark, tmp_path, monkeypatch, at):
    """Before the marker it is as if it never was; after it, the next to open the catalog finishes it."""
    held = Maintained.create(files(spark, ROWS), f"{tmp_path}/c", 8)
    change, writes, plain, say = [("/m/1/01.flac", "Other", "Nobody", "Album 1", "Genre 9", 7)], [], maintained._write, maintained._say

    def failing(df, path, replace=False):
        writes.append(replace)
        if (at == "staging" and len(writes) == 5) or (at == "placing" and writes.count(True) == 3):
            raise OSError("the power went")
        plain(df, path, replace)

    def unsaid(spark, path, told):
        if at == "marker":
            raise OSError("the power went")
        say(spark, path, told)

    monkeypatch.setattr(maintained, "_write", failing)
    monkeypatch.setattr(maintained, "_say", unsaid)
    with pytest.raises(OSError):
        held.apply(files(spark, change))
    monkeypatch.setattr(maintained, "_write", plain)
    monkeypatch.setattr(maintained, "_say", say)
    again = Maintained(spark, f"{tmp_path}/c")
    now = ROWS if at != "placing" else [r for r in ROWS if r[0] != "/m/1/01.flac"] + change
    same(again.catalog(), catalog.build(files(spark, now)))
    again.apply(files(spark, change))
    same(again.catalog(), catalog.build(files(spark, [r for r in ROWS if r[0] != "/m/1/01.flac"] + change)))


def test_refresh(spark, tmp_path):
    """A listing decides what is read; a new cover changes files without reading them; verdicts of unchanged files stay."""
    sound = F.struct(F.lit("intact").alias("state"), F.lit("frames").alias("method"), F.lit(None).cast("string").alias("detail"), F.lit(0).cast("long").alias("checked_at"))
    held = Maintained.create(files(spark, ROWS).withColumn("integrity", sound), f"{tmp_path}/c", 8)
    listing = files(spark, ROWS).select("path", F.when(F.col("path") == "/m/2/02.flac", 101).otherwise(F.col("size")).cast("long").alias("size"), "mtime").where("path <> '/n/4/04.flac'").unionByName(spark.createDataFrame([("/new/a.flac", 5, 5)], "path string, size long, mtime long"))
    covers = spark.createDataFrame([("/m/5", "/m/5/cover.jpg"), ("/new", "/new/folder.png")], "folder string, folder_cover string")
    read = []

    def reader(df):
        read.extend(r[0] for r in df.select("path").collect())
        return files(spark, [(p, "Read Again", "Reader", "Album 2", None, 9) for p in read]).drop("size", "mtime").join(df.select("path", "size", "mtime"), "path")

    assert held.refresh(listing, covers, reader) == {"found": len(ROWS), "read": 2, "removed": 1, "reused": len(ROWS) - 2}
    assert sorted(read) == ["/m/2/02.flac", "/new/a.flac"]
    rows = {r["path"]: r for r in held.catalog().file.collect()}
    assert len(rows) == len(ROWS) and rows["/m/2/02.flac"]["title"] == "Read Again" and rows["/m/2/02.flac"]["integrity"] is None
    assert rows["/m/5/01.flac"]["folder_cover"] == "/m/5/cover.jpg" and rows["/m/5/01.flac"]["integrity"]["state"] == "intact"
    assert rows["/new/a.flac"]["folder_cover"] == "/new/folder.png" and "/n/4/04.flac" not in rows
    again = held.refresh(listing, covers, lambda df: pytest.fail("nothing is to be read") if df.count() else files(spark, []))
    assert again == {"found": len(ROWS), "read": 0, "removed": 0, "reused": len(ROWS)}
    same(held.catalog(), catalog.build(durable(held.table("file").select(*files(spark, []).columns))))


def test_layouts(spark, tmp_path):
    Maintained.create(files(spark, ROWS[:3]), f"{tmp_path}/c", 2)
    with pytest.raises(ValueError, match="there already"):
        Maintained.create(files(spark, ROWS[:3]), f"{tmp_path}/c")
    empty = Maintained.create(files(spark, []), f"{tmp_path}/empty", 4)
    assert empty.catalog().artist.count() == 0
    empty.apply(files(spark, ROWS[:5]))
    same(empty.catalog(), catalog.build(files(spark, ROWS[:5])))
