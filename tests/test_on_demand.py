"""Questions make the tables that they need alone; fast ways to keys and names give what the plain ones give."""

import pytest
from pyspark.sql import functions as F

from rolegraph.functions import text as T
from rolegraph.plans import catalog, shelf

SF = "/root/testdata/sf0.001"


def test_a_question_of_files_reads_no_credits(spark):
    for name in ("lib_codecs", "lib_tiers", "lib_rates"):
        files = " ".join(shelf.QUERIES[name](spark, SF).inputFiles())
        assert "/orders.parquet" in files and "/lineitem.parquet" not in files, name


def test_tables_are_made_when_asked_for(spark, tmp_path):
    c = catalog.on_demand(shelf.scanned(spark, SF), str(tmp_path / "c"))
    assert c.genre.count() == 5 and sorted(p.name for p in (tmp_path / "c").iterdir()) == ["file", "genre"]
    other = c.changed(label=c.genre)
    assert other.label.count() == 5 and other.genre is c.genre and not (tmp_path / "c" / "label").exists()
    assert c.changed(file=c.file.limit(0)).label.count() == 5  # of the whole catalog's files


def plain_key(x):
    """As ``normalize`` was first written."""
    out = F.translate(F.lower(F.trim(x)), T.FROM, T.TO)
    for a, b in T.DOUBLE_FOLDS.items():
        out = F.replace(out, F.lit(a), F.lit(b))
    plain = F.trim(F.regexp_replace(out, r"[^\p{IsAlphabetic}\p{N}]+", " "))
    names = "|".join(T.ARTICLES)
    cut = F.regexp_replace(plain, rf"^(.+) (?:{names})$", "$1")
    return F.when(cut != plain, cut).otherwise(F.regexp_replace(plain, rf"^(?:{names}) (.+)$", "$1"))


def test_keys_and_names_as_in_the_plain_way(spark):
    words = ["the", "le", "The", "x", "Ærø", "feat.", "VA", "vàrious", ";", " / ", ",-", " ", "", "a\u0001b", "\u0001", "Multi  interprètes", "with"]
    rows = [([a + s + b, c] if c != "x" else [a + s + b],) for a in words for b in words for c in words for s in ("", " ")] + [([None, "a"],), ([],), (None,), (["the the le"],)]
    df = spark.createDataFrame(rows, "v array<string>").repartition(8)
    one = F.get("v", F.lit(0))
    wanted = F.flatten(F.transform("v", T.split_names))
    got = df.select(
        "v", T.normalize(one).eqNullSafe(plain_key(one)).alias("key"), T.names_of(F.col("v")).eqNullSafe(wanted).alias("names"),
        (T.maybe_placeholder(F.col("v")) | ~F.coalesce(F.exists("v", T.is_placeholder), F.lit(False))).alias("placeholder"),
    )
    assert got.where("not key or not names or not coalesce(placeholder, v is null)").select("v").limit(5).collect() == []


#: Questions of few columns, asked in one pass or two: no catalog is saved for them.
UNREAD = ["lib_album_tracks"]


@pytest.mark.parametrize("name", UNREAD)
def test_nothing_is_saved_for_a_question_of_one_pass(spark, monkeypatch, name):
    monkeypatch.setattr(shelf, "library", None)
    assert shelf.QUERIES[name](spark, SF).columns
