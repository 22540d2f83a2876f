"""One call from folders to a catalog, twice; separators and windows."""

import json
import os

import pytest

from rolegraph.operators.lookups import Page
from rolegraph.plans import catalog, export, scan
from tests.test_maintained import same
from tests.test_sources import flac, wav


def test_scan_and_scan_again(spark, tmp_path):
    root = tmp_path / "music"

    def put(name, data, mtime=1000):
        path = root / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(data)
        os.utime(path, (mtime, mtime))

    put("a/01 - One.flac", flac(["TITLE=One", "ARTIST=Alpha feat. Beta", "ALBUM=First", "GENRE=Jazz"]))
    put("a/_02.flac", flac(["TITLE=Two", "ARTIST=Alpha", "ALBUM=First", "TRACKNUMBER=2"]))
    put("a/cover.jpg", b"x")
    put("b/plain.wav", wav(8000, 0) + b"")
    put("b/broken.mp3", b"no audio at all here")
    report = {"format": "meter-report", "version": 1, "report": {"files": [{"path": "/elsewhere/_02.flac", "size_bytes": os.path.getsize(root / "a/_02.flac"), "modified_unix": 1000}]}}
    (root / "_report.json").write_text(json.dumps(report))
    places = [f"{root}/a/../b", str(root)]
    first = scan.scan(spark, places, f"{tmp_path}/c", "meter-report", buckets=4)
    assert first.counts == {"found": 4, "read": 4, "removed": 0, "reused": 0}
    assert [os.path.basename(r["path"]) for r in first.failures.collect()] == ["broken.mp3"]
    assert [r["path"] for r in first.analysis.collect()] == [f"{root}/a/_02.flac"]
    c = first.held.catalog()
    assert {r["name"] for r in c.artist.collect()} == {"Alpha", "Beta"} and {r["folder_cover"] for r in c.release.collect()} == {f"{root}/a/cover.jpg"}

    put("a/01 - One.flac", flac(["TITLE=One", "ARTIST=Gamma", "ALBUM=First"]), 2000)
    (root / "b/plain.wav").unlink()
    put("b/front.png", b"x")
    again = scan.scan(spark, places, f"{tmp_path}/c")
    assert again.counts == {"found": 3, "read": 1, "removed": 1, "reused": 2} and again.failures.count() == 0 and again.analysis is None
    c = again.held.catalog()
    assert {r["name"] for r in c.artist.collect()} == {"Alpha", "Gamma"} and c.genre.count() == 0
    assert {r["folder_cover"] for r in c.file.where("path like '%broken.mp3'").collect()} == {f"{root}/b/front.png"}
    same(c, scan.scan(spark, places, f"{tmp_path}/anew", buckets=2).held.catalog())
    same(c, catalog.build(c.file.select(*[f.name for f in c.file.schema if f.name in scan.read_files(spark.createDataFrame([], "path string, size long, mtime long")).columns])))


def test_csv_separators(spark, tmp_path):
    df = spark.createDataFrame([("a;b", 'say "x"', None), ("c,d", "e", 1)], "x string, y string, z int").coalesce(1)
    assert [r["line"] for r in export.csv(df, ";").collect()] == ['"a;b";"say ""x""";', "c,d;e;1"]
    assert [r["line"] for r in export.csv(df).collect()] == ['a;b,"say ""x""",', '"c,d",e,1']
    export.write_csv(df, f"{tmp_path}/out", "\t")
    (part,) = (tmp_path / "out").glob("part-*")
    assert part.read_bytes() == b'x\ty\tz\r\na;b\t"say ""x"""\t\r\nc,d\te\t1\r\n'


def test_shown_windows():
    assert Page(10, 20).shown(25) == (21, 25) and Page(10, 20).shown(100) == (21, 30) and Page(10, 20).shown(20) is None and Page(None, 3).shown(9) == (4, 9)
    for limit, offset in ((0, 0), (-1, 0), (5, -1)):
        with pytest.raises(ValueError):
            Page(limit, offset)


def test_tables_in_one_pass(spark, tmp_path):
    """Names, credits, labels and genres are each made from one scan of what was scanned."""
    from tests.test_maintained import ROWS, files

    files(spark, ROWS).write.parquet(f"{tmp_path}/scanned")
    c = catalog.build(spark.read.parquet(f"{tmp_path}/scanned"))
    for name in ("file", "artist", "credit", "label", "genre", "genre_link"):
        assert getattr(c, name)._jdf.queryExecution().executedPlan().toString().count("FileScan parquet") == 1, name
