"""Cases that once were cut away: rare words, sources without a name in the weights, rows without an id."""

from collections import Counter

import numpy as np
import pytest
from pyspark.errors import AnalysisException

import corpus_pipeline
from rolegraph.llm import classifier, jaccard_join, mixing, sharding
from rolegraph.llm.queries import WEIGHTS

INSULTS = ["trash", "pathetic", "idiot", "worthless", "disgusting", "stupid", "clown", "scum", "loser", "moron"]


def encoded(texts):
    parts = [t.encode() for t in texts]
    return np.frombuffer(b"".join(parts), np.uint8), np.concatenate([[0], np.cumsum([len(p) for p in parts])])


def test_rare_words_are_learned():
    """A word of twelve rows marks them, whatever the number of other rows."""
    texts = [f"plain words about thing{i % 7} and day{i % 5}" + (" vermin" if i < 12 else "") for i in range(300)]
    row, feature = classifier.features(*encoded(texts))
    model = classifier.fit_ordinal(row, feature, np.array([0] * 12 + [2] * 288), 3)
    row, feature = classifier.features(*encoded(["plain words about thing4 and day4 vermin", "plain words about thing4 and day4"]))
    marked, plain = model.tails(model.scores(row, feature, 2))[:, -1]
    assert marked < 0.5 < plain


def test_fit_is_the_best_of_its_likelihood():
    """Plain likelihood with the ridge penalty: no small step from the fitted weights and thresholds makes it better."""
    rng = np.random.default_rng(3)
    n, grades = 120, 3
    grade = rng.integers(0, grades, n)
    has = rng.random((n, 6)) < 0.2 + 0.25 * grade[:, None] * (np.arange(6) < 3)
    row, feature = np.nonzero(has)
    model = classifier.fit_ordinal(row, feature, grade, grades, steps=4000, rate=0.02)

    def loss(weights, thresholds):
        s = has @ weights
        below = lambda k: 1 / (1 + np.exp(s - thresholds[k]))
        p = [below(0), below(1) - below(0), 1 - below(1)]
        return -np.mean(np.log(np.choose(grade, p))) + 1.0 * (weights**2).sum() / (2 * n)

    w, t = model.weights[:6], model.thresholds
    best = loss(w, t)
    for k in range(8):
        for step in (-1e-2, 1e-2):
            moved = np.concatenate([w, t])
            moved[k] += step
            assert loss(moved[:6], moved[6:]) > best - 1e-7


def test_insults_of_the_small_table_have_weights(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    model = classifier.fit(docs, labels, classifier.grade_of())
    for w in INSULTS:
        row, feature = classifier.features(*encoded([w]))
        assert model.weights[feature[feature < classifier.BUCKETS]].min() < 0


@pytest.mark.parametrize("sf, caught, lost", [("sf0.01", 0.12, 0.10), ("sf0.1", 0.69, 0.01)])
def test_toxic_recall_on_rows_left_out(spark, sf, caught, lost):
    docs, labels = (spark.read.parquet(f"/root/testdata/{sf}/{t}.parquet") for t in ("documents", "labels"))
    model = classifier.fit(docs, labels.where("doc_id % 2 = 0"), classifier.grade_of())
    out = classifier.score(docs, model).join(labels.where("doc_id % 2 = 1"), "doc_id").toPandas()
    toxic, clean = out["toxic"] == 1, (out["quality"] == 1) & (out["toxic"] == 0)
    assert (~out["kept"])[toxic].mean() > caught
    assert (~out["kept"])[clean].mean() < lost


def test_each_source_keeps_its_share(spark):
    """Fourteen sources outside the named six, null and a hot one among them."""
    sizes = {f"src{i}": 150 for i in range(6)} | {f"other{i}": 30 for i in range(12)} | {None: 30, "hot": 700}
    rows = [(k, s) for k, s in enumerate(s for s, n in sizes.items() for _ in range(n))]
    out = mixing.mix(spark.createDataFrame(rows, "doc_id long, source string"), WEIGHTS, block=2).collect()
    assert Counter(r["doc_id"] for r in out) == Counter(k for k, _ in rows)
    assert all(r["release"] <= r["slot"] < r["deadline"] for r in out)
    blocks = {}
    for r in out:
        blocks.setdefault((r["cycle"], r["slot"]), set()).add((r["source"], r["block"]))
    assert all(len(b) == 1 for b in blocks.values())
    total, others = sum(WEIGHTS.values()), len(sizes) - 6
    share = {s: WEIGHTS[s] / total if s in WEIGHTS and s is not None else WEIGHTS[None] / others / total for s in sizes}
    seen = Counter()
    for t in range(1, 5 * total + 1):  # all sources hold rows so far
        ((source, block),) = blocks[divmod(t - 1, total)]
        assert block == seen[source]
        seen[source] += 1
        assert all(abs(seen[s] - t * w) < 1 for s, w in share.items())
    for r in out:
        if r["source"] == "other3" and r["cycle"] < 5:
            start = r["cycle"] * total
            k, n, v = r["block"], others, WEIGHTS[None]
            assert (start + r["release"], start + r["deadline"]) == (k * n * total // v, -(-(k + 1) * n * total // v))


def test_one_row_of_each_component(spark):
    """Null ids, repeated ids and texts without words."""
    a, b, c, d = (" ".join(f"{x}{i}" for i in range(60)) for x in "abcd")
    near = lambda t: t + " more"
    rows = [
        (1, a), (None, near(a)),  # a copy without an id goes
        (None, b), (None, near(b)), (None, b),  # one of a group without ids stays
        (None, "alone with no other at all"), (2, c), (2, near(c)),  # two texts of one id
        (3, None), (3, None), (4, ""), (4, ""), (None, None), (None, None),  # linked with nothing
        (5, d), (5, d), (6, d), (6, "something else entirely here now"),
    ]
    stay = jaccard_join.one_of_each(spark.createDataFrame(rows, "doc_id long, text string"))
    got = Counter((r["doc_id"], r["text"] if not r["text"] else r["text"].split()[0]) for r in stay.collect())
    assert got == {(1, "a0"): 1, (None, "b0"): 1, (None, "alone"): 1, (2, "c0"): 1, (3, None): 2, (4, ""): 2, (None, None): 2, (5, "d0"): 1, (6, "something"): 1}


def test_errors_of_sharding_are_not_hidden(spark, tmp_path, monkeypatch):
    """Only a table from no files is numbered by doc_id; errors inside the numbering come through."""
    def failing(*given, **more):
        raise AnalysisException("from inside")

    plain = spark.createDataFrame([(1, "a"), (2, "b")], "doc_id long, text string")
    plain.write.parquet(f"{tmp_path}/docs")
    monkeypatch.setattr(sharding, "_dealt", failing)
    for docs in (spark.read.parquet(f"{tmp_path}/docs"), plain):
        with pytest.raises(AnalysisException, match="from inside"):
            corpus_pipeline.shard(spark, docs, "")


def test_rows_follow_the_numbers_of_files(spark, tmp_path):
    """part-100000 comes after part-99999, whatever their names sort like; documents keep all their columns."""
    for k, name in enumerate(("part-99998-x", "part-99999-x", "part-100000-x", "part-100001-x")):
        spark.createDataFrame([(10 * k + i, f"text {k} {i}", "extra") for i in range(3)], "doc_id long, text string, _l string").coalesce(1).write.parquet(f"{tmp_path}/one{k}")
        (written,) = (tmp_path / f"one{k}").glob("part-*.parquet")
        (tmp_path / "docs").mkdir(exist_ok=True)
        written.rename(tmp_path / "docs" / f"{name}.parquet")
    out = corpus_pipeline.shard(spark, spark.read.parquet(f"{tmp_path}/docs"), "").collect()
    ids = [10 * k + i for k in range(4) for i in range(3)]
    assert {r["doc_id"]: r["row_number"] for r in out} == {d: n for n, d in enumerate(ids)}
    assert {r["doc_id"]: (r["shard"], r["slot"]) for r in out} == {d: sharding.shard_of(n, 12, 16) for n, d in enumerate(ids)}
    assert all(r["text"] == f"text {r['doc_id'] // 10} {r['doc_id'] % 10}" and r["_l"] == "extra" for r in out)
