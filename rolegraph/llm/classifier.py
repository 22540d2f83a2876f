"""Operator 3: ordinal quality classifier, a cumulative-link regression on graded ratings.

P(grade <= k) = sigmoid(threshold_k - w.x) with one weight vector for hashed words, shared by all grades, and ordered
thresholds.  ``fit`` uses at most ``bound`` labelled rows with ``most`` features in all (those whose hashed key is smallest, so
the choice does not hang on partitions); ``score`` reads every whole text.  Grades in this library: 0 toxic, 1 poor, 2 good.

Null and empty texts have no words and get the prior.  Rows without a rating are not fitted; without any rating there is no
model, scores are null and all rows are kept.  Rows alike get equal scores; extra columns are not returned.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rolegraph.llm._rows import durable
from rolegraph.llm._text import FOLD, lists, prefix_codes, slices, span_codes, words

#: Hash buckets for words; bins of document shares follow them.
BUCKETS, BINS = 1 << 18, 16
N_FEATURES = BUCKETS + 5 * BINS
#: Values of a present word and of a document's share: many words are there by chance, shares are few.
WORD_VALUE, SHARE_VALUE = 1.0, 32.0
#: Most labelled rows that a model is fitted on, and most features (4 bytes each) of these rows in all.
FIT_ROWS, FIT_FEATURES = 12_000, 16_000_000
ALNUM = np.zeros(256, bool)
ALNUM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
UPPER = np.zeros(256, bool)
UPPER[0x41:0x5B] = True
MARK = np.zeros(256, bool)
MARK[[ord(c) for c in "#*$%&|<>!@^~{}[]=\\"]] = True


def _bins(share: np.ndarray) -> np.ndarray:
    """0 for none, then one bin for each halving of the share."""
    with np.errstate(divide="ignore"):
        return np.where(share > 0, np.clip(BINS - 1 + np.ceil(np.log2(np.maximum(share, 1e-9))), 1, BINS - 1), 0).astype(np.int64)


def features(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted (row, feature) pairs of presence: words, first five bytes of longer words, bins of shares."""
    n = len(offs) - 1
    start, end, rows = words(data, offs, ALNUM)
    sums = prefix_codes(FOLD[data])
    code = span_codes(sums, start, end)
    row = np.repeat(np.arange(n), np.diff(rows))
    long = end - start > 5
    stem = span_codes(sums, start[long], start[long] + 5)
    count = np.maximum(np.diff(rows), 1)
    total = lambda flags: np.diff(np.concatenate([[0], np.cumsum(flags)])[offs])
    size = np.maximum(np.diff(offs), 1)
    same = np.zeros(len(code), bool)
    same[1:] = (code[1:] == code[:-1]) & (row[1:] == row[:-1])
    distinct = np.unique((row.astype(np.uint64) << np.uint64(40)) | (code >> np.uint64(24)))
    shares = [total(MARK[data]) / size, total(UPPER[data]) / size, np.bincount(row[same], minlength=n) / count, 1 - np.bincount((distinct >> np.uint64(40)).astype(np.int64), minlength=n) / count, total(data == 10) / size]
    dense = np.concatenate([BUCKETS + k * BINS + _bins(s) for k, s in enumerate(shares)])
    every = np.concatenate([row, row[long], np.tile(np.arange(n), len(shares))])
    which = np.concatenate([(code % np.uint64(BUCKETS)).astype(np.int64), (stem % np.uint64(BUCKETS)).astype(np.int64), dense])
    pair = np.unique(every * N_FEATURES + which)
    return pair // N_FEATURES, pair % N_FEATURES


@dataclass
class Ordinal:
    """Weights of features and ordered thresholds."""

    weights: np.ndarray
    thresholds: np.ndarray

    def scores(self, row: np.ndarray, feature: np.ndarray, n: int) -> np.ndarray:
        return np.bincount(row, self.weights[feature], n)

    def tails(self, score: np.ndarray) -> np.ndarray:
        """P(grade > k) for each threshold k."""
        return 1 / (1 + np.exp(np.clip(self.thresholds[None, :] - score[:, None], -40, 40)))


def fit_ordinal(row: np.ndarray, feature: np.ndarray, grade: np.ndarray, grades: int, steps: int = 200, rate: float = 0.05, ridge: float = 1.0) -> Ordinal:
    """Full-batch Adam on the mean log-likelihood; every feature of the rows is fitted, however rare: ridge alone holds it back."""
    n = len(grade)
    kept = np.flatnonzero(np.bincount(feature, minlength=N_FEATURES))
    feature = np.searchsorted(kept, feature).astype(np.int32)
    value = np.where(kept < BUCKETS, WORD_VALUE, SHARE_VALUE)
    share = np.array([(np.sum(grade <= k) + 1) / (n + 2) for k in range(grades - 1)])
    base = np.log(share / (1 - share))
    # theta_0, then logs of the gaps, so that thresholds stay ordered
    free = np.concatenate([np.zeros(len(kept)), base[:1], np.log(np.maximum(np.diff(base), 1e-2))])
    m, v = np.zeros_like(free), np.zeros_like(free)
    for t in range(1, steps + 1):
        w, theta = free[: len(kept)], np.concatenate([free[len(kept) : len(kept) + 1], np.exp(free[len(kept) + 1 :])]).cumsum()
        s = np.bincount(row, (w * value)[feature], n)
        cut = np.concatenate([[-np.inf], theta, [np.inf]])
        sig = lambda z: 1 / (1 + np.exp(-np.clip(z, -40, 40)))
        hi, lo = sig(cut[grade + 1] - s), sig(cut[grade] - s)
        p = np.maximum(hi - lo, 1e-12)
        dhi, dlo = hi * (1 - hi) / p, lo * (1 - lo) / p
        dhi[grade == grades - 1] = 0
        dlo[grade == 0] = 0
        g_theta = np.array([(dhi[grade == k].sum() - dlo[grade == k + 1].sum()) / n for k in range(grades - 1)])
        g_s = -(dhi - dlo) / n
        after = g_theta[::-1].cumsum()[::-1]
        grad = -np.concatenate([np.bincount(feature, g_s[row], len(kept)) * value, after[:1], after[1:] * np.exp(free[len(kept) + 1 :])])
        grad[: len(kept)] += ridge * w / n
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        free = free - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    weights = np.zeros(N_FEATURES, np.float64)
    weights[kept] = free[: len(kept)] * value
    return Ordinal(weights, np.concatenate([free[len(kept) : len(kept) + 1], np.exp(free[len(kept) + 1 :])]).cumsum())


def fit(docs: DataFrame, ratings: DataFrame, grade: Column, grades: int = 3, bound: int = FIT_ROWS, most: int = FIT_FEATURES) -> Ordinal | None:
    """A model from the rows of ``ratings`` (doc_id and what ``grade`` needs) whose text is in ``docs``; None without any.

    Rows are taken by hashed key as long as their features stay within ``most``; the first one is taken at any length.
    """
    rated = ratings.select(F.col("doc_id").alias("_rated"), grade.cast("int").alias("_grade")).where("_rated is not null and _grade is not null")
    chosen = rated.orderBy(F.xxhash64("_rated"), "_rated", "_grade").limit(bound)  # at most ``bound`` rows are broadcast and collected

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offs in slices(batches):
            row, feature = features(data, offs)
            cut = np.searchsorted(row, np.arange(batch.num_rows + 1))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("_grade"), lists([feature[a:b] for a, b in zip(cut[:-1], cut[1:], strict=True)], pa.int32())], ["doc_id", "grade", "features"])

    kinds = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, grade int, features array<int>"
    rows = durable(docs.select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("_rated")).select("doc_id", "text", "_grade").mapInArrow(extract, kinds))
    # A running sum for each value of the hash: one number for each fitted key, so at most ``bound`` of them.
    sizes = rows.groupBy(F.xxhash64("doc_id").alias("h")).agg(F.sum(F.size("features")).alias("n")).orderBy("h").collect()
    if not sizes:
        return None
    total = np.cumsum([r["n"] for r in sizes])
    last = sizes[max(int(np.searchsorted(total, most, "right")) - 1, 0)]["h"]
    got = rows.where(F.xxhash64("doc_id") <= last).select("grade", "features").toArrow().combine_chunks()
    feats = got.column("features").combine_chunks()
    flat, size, given = feats.flatten().to_numpy(zero_copy_only=False), np.diff(feats.offsets.to_numpy()), got.column("grade").to_numpy()
    del got, feats
    return fit_ordinal(np.repeat(np.arange(len(size), dtype=np.int32), size), flat, given, grades)


def score(docs: DataFrame, model: Ordinal | None, least: float = 0.5) -> DataFrame:
    """(doc_id, expected_grade, tail_probability, kept): kept where P(best grade) is ``least`` or more."""
    if model is None:
        return docs.select("doc_id", F.lit(None).cast("double").alias("expected_grade"), F.lit(None).cast("double").alias("tail_probability"), F.lit(True).alias("kept"))
    return scored(docs.select("doc_id", "text"), model, least).drop("text")


def scored(docs: DataFrame, model: Ordinal, least: float = 0.5) -> DataFrame:
    """``docs`` (with their text) and the scores, in one pass; score columns must not be there yet."""
    shared = docs.sparkSession.sparkContext.broadcast((model.weights.astype(np.float32), model.thresholds))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Ordinal(*shared.value)
        for batch, data, offs in slices(batches):
            row, feature = features(data, offs)
            tails = m.tails(m.scores(row, feature, batch.num_rows))
            more = [pa.array(tails.sum(axis=1)), pa.array(tails[:, -1]), pa.array(tails[:, -1] >= least)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], [*batch.schema.names, "expected_grade", "tail_probability", "kept"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(run, f"{kinds}, expected_grade double, tail_probability double, kept boolean")


def select_good(docs: DataFrame, model: Ordinal | None, least: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that the model keeps, with their columns as they were; without a model, all."""
    if model is None:
        return docs
    plain = {c: f"_{i}" for i, c in enumerate(docs.columns) if c != "text"}
    return scored(docs.withColumnsRenamed(plain), model, least).where("kept").select(*[F.col(plain.get(c, c)).alias(c) for c in docs.columns])


def grade_of() -> Column:
    """The grade that a row of ``labels`` gives."""
    return F.when(F.col("toxic") == 1, 0).when(F.col("quality") == 0, 1).when(F.col("quality") == 1, 2)
