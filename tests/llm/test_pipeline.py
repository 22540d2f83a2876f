"""The stages against plain versions, each on its own input."""

import corpus_pipeline
from rolegraph.llm import classifier
from rolegraph.llm.sharding import shard_of
from tests.llm import brute

SF = "/root/testdata/sf0.01"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, kept = docs.columns, []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(f"{tmp_path}/{k}")
        before, docs = docs, spark.read.parquet(f"{tmp_path}/{k}")
        rows = [(r["doc_id"], r["text"]) for r in before.select("doc_id", "text").collect()]
        ids = {d for d, _ in rows}
        kept.append({r["doc_id"] for r in docs.collect()})
        if k < 4:
            assert docs.columns == columns
        if k == 0:
            labels = {r["doc_id"]: (r["quality"], r["toxic"]) for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
            known = [(d in kept[0], labels[d]) for d in ids if d in labels]
            assert sum(keep == (label == (1, 0)) for keep, label in known) > 0.97 * len(known)
        if k == 1:
            assert kept[1] == {d for d, (_, c, _) in brute.jaccard(rows).items() if d == c}
        if k == 2:
            items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
            assert kept[2] == {d for d, x in brute.contamination(rows, items).items() if not x[4]} < ids
        if k == 3:
            assert kept[3] == ids
            order = [r["doc_id"] for r in docs.selectExpr("doc_id", "_metadata.file_name f", "_metadata.row_index i").orderBy("f", "i").collect()]
            assert order != sorted(order)
    assert set(columns) < set(docs.columns) and {r["doc_id"]: r["text"] for r in docs.collect()} == {r["doc_id"]: r["text"] for r in before.collect()}
    want = {d: shard_of(i, len(order), 16) for i, d in enumerate(order)}
    assert {r["doc_id"]: (r["shard"], r["slot"]) for r in docs.collect()} == want


def test_held_out(spark):
    """Fitted on half of the labelled rows, the classifier grades the other half."""
    docs, labels = spark.read.parquet("/root/testdata/sf0.1/documents.parquet"), spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    model = classifier.fit(docs, labels.where("doc_id % 2 = 0"), classifier.grade_of())
    out = classifier.score(docs, model).join(labels.where("doc_id % 2 = 1"), "doc_id").toPandas()
    good = (out["quality"] == 1) & (out["toxic"] == 0)
    # about 2,000 rows to fit on: far better than keeping all
    assert (out["kept"] == good).mean() > good.mean() + 0.6 * (1 - good.mean())
    assert list(model.thresholds) == sorted(model.thresholds)
