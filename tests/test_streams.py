"""Keyed state of waiting records, and checks that go on where they stopped."""

import pytest
from pyspark.sql import functions as F

from rolegraph.plans import analyses
from rolegraph.streaming import check, scan, waiting

FILES = [("/m/a.flac", 10, 1), ("/m/b.flac", 20, 2), ("/n/b.flac", 20, 2), ("/n/c.flac", 30, 3), ("/z/e.flac", 50, 5)]
#: path, size, mtime, source, seq, payload: at its own path, moved, moved by two routes, another time, taken, unknown
RECORDS = [
    ("/m/a.flac", 10, 1, "meter", 1, "own"), ("/old/b.flac", 20, 2, "meter", 2, "moved"), ("/old/c.flac", 30, 3, "meter", 3, "first route"), ("/link/c.flac", 30, 3, "meter", 4, "second route"),
    ("/old/e.flac", 50, 9, "meter", 5, "other time"), ("/m/b.flac", 20, 2, "other", 6, "there"), ("/q/b.flac", 20, 2, "other", 7, "taken"), ("/w/x.flac", 70, 7, "meter", 8, "unknown"),
]


def frames(spark):
    return spark.createDataFrame(FILES, "path string, size long, mtime long"), spark.createDataFrame(RECORDS, "path string, size long, mtime long, source string, seq long, payload string")


def stream(spark, folder):
    return spark.readStream.schema(waiting.EVENT).option("recursiveFileLookup", True).parquet(folder)


def test_waiting_records(spark, tmp_path):
    """Records first, then files, in two runs of the stream: its last word is that of ``reconcile``."""
    files, records = frames(spark)
    waiting.events(records=records).write.parquet(f"{tmp_path}/in/1")
    step = lambda: waiting.keep_places(stream(spark, f"{tmp_path}/in"), f"{tmp_path}/log", f"{tmp_path}/state").awaitTermination()
    step()
    log = lambda: spark.read.parquet(f"{tmp_path}/log")
    assert {r["outcome"] for r in log().collect()} == {"waiting"} and log().count() == len(RECORDS)
    waiting.events(files=files.where("path < '/n/c'")).write.parquet(f"{tmp_path}/in/2")
    step()  # a new query with the same checkpoint: what waits was kept
    waiting.events(files=files.where("path >= '/n/c'")).write.parquet(f"{tmp_path}/in/3")
    step()
    step()  # nothing new, nothing said
    want = analyses.reconcile(records, files)
    got = waiting.settled(log())
    assert sorted(map(tuple, got.drop("outcome").collect())) == sorted(map(tuple, want.select("path", "source", "size", "mtime", "seq", "payload").collect()))
    outcome = {r["payload"]: r["outcome"] for r in got.collect()}
    assert outcome == {"own": "matched", "moved": "moved", "second route": "moved", "other time": "waiting", "there": "matched", "taken": "waiting", "unknown": "waiting"}
    # a file that goes leaves its record waiting again, and the next of its name and size takes it
    waiting.events(gone=files.where("path = '/m/b.flac'")).write.parquet(f"{tmp_path}/in/4")
    step()
    assert {r["payload"]: r["path"] for r in waiting.settled(log()).collect()}["moved"] == "/n/b.flac"


def test_patience(spark, tmp_path):
    """A record that waits too long is told once as overdue, and is still placed when its file comes, after a restart too."""
    import time

    files, records = frames(spark)
    waiting.events(records=records.where("payload = 'moved'")).write.parquet(f"{tmp_path}/in/1")

    def until(outcome):
        query, end = waiting.keep_places(stream(spark, f"{tmp_path}/in"), f"{tmp_path}/log", f"{tmp_path}/state", 500), time.time() + 90
        said = []
        while outcome not in said and time.time() < end:
            time.sleep(1)
            if (tmp_path / "log/_spark_metadata").exists():
                said = [r["outcome"] for r in spark.read.schema(waiting.PLACED).parquet(f"{tmp_path}/log").orderBy("told").collect()]
        query.stop()
        return said

    assert until("overdue") == ["waiting", "overdue"]
    waiting.events(files=files).write.parquet(f"{tmp_path}/in/2")
    assert until("moved") == ["waiting", "overdue", "moved"]


def test_check_goes_on(spark, tmp_path):
    """Broken after two batches, a check reads no file of them twice; the batch in hand is made again as a whole."""
    none = F.lit(None).cast("struct<state:string,method:string,detail:string,checked_at:bigint>")
    files = spark.range(100).select(F.format_string("/m/%03d.flac", "id").alias("path"), F.lit(5).cast("long").alias("size"), F.lit(1).cast("long").alias("mtime"), none.alias("integrity"))
    folder, read = f"{tmp_path}/check", []

    def verify(batch):
        paths = [r[0] for r in batch.select("path").collect()]
        read.append(paths)
        if len(read) == 3:
            raise OSError("the power went")
        bad = F.col("path").endswith("7.flac")
        return batch.select("*", F.when(~bad, "intact").alias("state"), F.lit("frames").alias("method"), F.lit(None).cast("string").alias("detail"), F.lit(9).cast("long").alias("checked_at"), F.when(bad, "not readable").alias("error"))

    check.enqueue(files, folder, batch=10)
    with pytest.raises(Exception, match="the power went"):
        check.run(spark, folder, verify).awaitTermination()
    assert check.progress(spark, folder).first().asDict() == {"queued": 100, "checked": check.verdicts(spark, folder).where("error is null").count(), "failed": check.verdicts(spark, folder).where("error is not null").count()}
    done, broken = set(read[0]) | set(read[1]), set(read[2])
    check.enqueue(files, folder, batch=7)  # the queue stays
    check.run(spark, folder, verify).awaitTermination()
    later = [p for paths in read[3:] for p in paths]
    assert all(len(p) <= 10 for p in read) and not done & set(later) and broken <= set(later)
    assert sorted(done | set(later)) == [f"/m/{i:03d}.flac" for i in range(100)] and len(later) == len(set(later))
    said = check.verdicts(spark, folder)
    assert said.count() == 100 and said.where("error is not null").count() == 10
    changed = files.withColumn("size", F.when(F.col("path") == "/m/000.flac", 6).otherwise(F.col("size")).cast("long"))
    assert check.applied(changed, said).where("integrity.state = 'intact'").count() == 89
    check.run(spark, folder, lambda batch: pytest.fail("nothing is left")).awaitTermination()


def test_check_of_a_place(spark, tmp_path):
    rows = spark.createDataFrame([("/m/a", 1, 1, "intact"), ("/m/b", 1, 1, None), ("/mm/c", 1, 1, None)], "path string, size long, mtime long, s string")
    files = rows.select("path", "size", "mtime", F.when(F.col("s").isNotNull(), F.struct(F.col("s").alias("state"))).alias("integrity"))
    for name, full, want in (("some", False, ["/m/b"]), ("all", True, ["/m/a", "/m/b"])):
        check.enqueue(files, f"{tmp_path}/{name}", ["/m"], full)
        assert sorted(r[0] for r in spark.read.schema(check.QUEUE).parquet(f"{tmp_path}/{name}/queue").select("path").collect()) == want


def test_late_events(spark, tmp_path):
    """Windows close behind the watermark; what comes later than that is not counted."""
    rows = lambda *times: spark.createDataFrame([("k", t) for t in times], "k string, at string").selectExpr("k", "cast(at as timestamp) at")
    (tmp_path / "in").mkdir()
    read = spark.readStream.schema("k string, at timestamp").option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
    step = lambda: scan.late_events(read, "k", "at", "10 minutes", "5 minutes").writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/cp").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    for k, times in enumerate((["2024-01-01 00:01:00", "2024-01-01 00:09:00"], ["2024-01-01 00:30:00"], ["2024-01-01 00:02:00", "2024-01-01 00:31:00"])):
        rows(*times).write.parquet(f"{tmp_path}/in/{k}")
        step()
    got = spark.read.parquet(f"{tmp_path}/out").selectExpr("cast(window.start as string) s", "events").collect()
    assert [tuple(r) for r in got] == [("2024-01-01 00:00:00", 2)]
