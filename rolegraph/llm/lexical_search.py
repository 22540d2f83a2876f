"""Operator 12: ranked lexical search, every item of a benchmark against all documents.

Index: rows of a task are numbered in the order in which they are read and cut into windows of WINDOW documents.  A window is
one row: its terms (64-bit codes of two hashes each), and for each term its postings, (place in the window, occurrences), by
place.  Only terms that an item asks for are kept, if there are at most MOST_TERMS of them; else all are.  The index is a table
in the shared folder, a fraction of the texts, which are read once.

Search: a task takes one window after the other, and in it one item after the other.  The postings of the item's terms are
scattered into an array of scores that fits a core's cache, with a bit for each place that was touched; what was touched is
harvested into the item's heap of ``top`` documents.  A task sends its heaps on, and heaps are cut to ``top`` twice: first
those of a share of the tasks, then all, so no group grows with the number of tasks alone.

Document frequencies and weights are Spark aggregates and joins; items go to the tasks in blocks of at most MOST_ENTRIES
(item, term) pairs, one pass over the index (not the texts) each.  Scores are whole numbers of 64 bits throughout.

Null text has no terms: such a document is never found, and such an item finds nothing.  Each row of the documents is a
document, so an id that several rows share can be found several times; a null id comes last among equal scores.  Each row of
the benchmark is an item and gets its ranks, rows alike too.  Extra columns are not returned.  Empty tables give no rows.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rolegraph.llm._rows import Stored, durable
from rolegraph.llm._text import FOLD, slices, word_codes, words

TOP = 10
#: Documents of a window, and words that a task holds before it closes one early.
WINDOW, WINDOW_WORDS = 2048, 1 << 21
#: Terms whose codes are told to all tasks (8 bytes each); (item, term) pairs of a block (24 bytes each).
MOST_TERMS, MOST_ENTRIES = 1 << 22, 1 << 20
#: Shares of the tasks whose heaps are cut first.
SHARES = 64
MISSING = (1 << 63) - 1
#: Bytes of terms: digits, letters and all from 0x80 on.
TERM = np.array([48 <= c <= 57 or 65 <= c <= 90 or 97 <= c <= 122 or c >= 128 for c in range(256)])


def terms(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes of all terms in order, and the n + 1 offsets of each row's terms."""
    start, end, rows = words(data, offs, TERM)
    return word_codes(FOLD[data], start, end)[0], rows


def asked_terms(texts: DataFrame) -> DataFrame:
    """(query, term, q): how often each query (query long, text) holds a term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offs in slices(batches):
            code, rows = terms(data, offs)
            each = [np.unique(code[a:b], return_counts=True) for a, b in zip(rows[:-1], rows[1:], strict=True)]
            query = np.repeat(batch.column("query").to_numpy(), [len(t) for t, _ in each])
            columns = [query, *[np.concatenate([x[k] for x in each]) for k in (0, 1)]]
            yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.uint64).view(np.int64)) for c in columns], ["query", "term", "q"])

    return texts.select("query", "text").mapInArrow(run, "query long, term long, q long")


INDEX = "docs long, terms long, term binary, first binary, doc binary, tf binary, n binary, id binary"


def index(docs: DataFrame, vocabulary: np.ndarray | None, key: str = "doc_id") -> DataFrame:
    """A row for each window: documents with a term, terms in all, and the packed postings of terms in ``vocabulary`` (sorted
    codes; None: all)."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def packed(code: list[np.ndarray], doc: list[np.ndarray], n: list[np.ndarray], ids: list[np.ndarray]) -> pa.RecordBatch:
        code, doc, n, ids = (np.concatenate(x) for x in (code, doc, n, ids))
        o = np.lexsort((doc, code))
        code, doc = code[o], doc[o]
        new = np.flatnonzero(np.concatenate([[True], (code[1:] != code[:-1]) | (doc[1:] != doc[:-1])])) if len(code) else np.zeros(0, np.int64)
        tf, code, doc = np.diff(np.append(new, len(code))), code[new], doc[new]
        term, first = np.unique(code, return_index=True)
        blobs = [term, first.astype(np.uint32), doc.astype(np.uint16), tf.astype(np.uint32), n, ids]
        return pa.RecordBatch.from_arrays([pa.array([int((n > 0).sum())]), pa.array([int(n.sum())]), *[pa.array([b.tobytes()], pa.binary()) for b in blobs]], [c.split()[0] for c in INDEX.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        held: tuple[list, list, list, list] = ([], [], [], [])
        rows_held = words_held = 0
        for batch, data, offs in slices(batches):
            code, rows = terms(data, offs)
            row = np.repeat(np.arange(len(rows) - 1), np.diff(rows))
            if known is not None:
                at = np.minimum(np.searchsorted(known, code), max(len(known) - 1, 0))
                keep = known[at] == code if len(known) else np.zeros(len(code), bool)
                code, row = code[keep], row[keep]
            ids, n, at = batch.column("id").to_numpy(), np.diff(rows), 0
            while at < len(n):
                to = min(len(n), at + WINDOW - rows_held)
                a, b = np.searchsorted(row, [at, to])
                for part, x in zip(held, (code[a:b], row[a:b] - at + rows_held, n[at:to].astype(np.int64), ids[at:to]), strict=True):
                    part.append(x)
                rows_held, words_held, at = rows_held + to - at, words_held + b - a, to
                if rows_held == WINDOW or words_held > WINDOW_WORDS:
                    yield packed(*held)
                    held, rows_held, words_held = ([], [], [], []), 0, 0
        if rows_held:
            yield packed(*held)

    return docs.select(F.coalesce(F.col(key), F.lit(MISSING)).alias("id"), "text").mapInArrow(run, INDEX)


def frequencies(windows: DataFrame) -> DataFrame:
    """(term, df): documents that hold each term of the index; counts are added up in a task before they are sent."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            term, count = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
            for t, first, doc in zip(*(batch.column(c).to_pylist() for c in ("term", "first", "doc")), strict=True):
                term.append(np.frombuffer(t, np.uint64))
                count.append(np.diff(np.append(np.frombuffer(first, np.uint32), len(doc) // 2).astype(np.int64)))
            all_terms, at = np.unique(np.concatenate(term), return_inverse=True)
            total = np.bincount(at, np.concatenate(count), len(all_terms)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(all_terms.view(np.int64)), pa.array(total)], ["term", "n"])

    return windows.select("term", "first", "doc").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("df"))


def harvest(heap: list[tuple[int, int]], score: np.ndarray, ids: np.ndarray, top: int) -> None:
    """Puts documents into a heap of the ``top`` best (score, minus id), the worst in front."""
    if len(heap) == top:
        some = score >= heap[0][0]
        score, ids = score[some], ids[some]
    best = np.lexsort((ids, -score))[:top]
    for s, i in zip(score[best].tolist(), ids[best].tolist(), strict=True):
        if len(heap) < top:
            heapq.heappush(heap, (s, -i))
        elif (s, -i) > heap[0]:
            heapq.heapreplace(heap, (s, -i))


def scored(windows: DataFrame, block: tuple[np.ndarray, ...], n_docs: int, n_terms: int, top: int) -> DataFrame:
    """(query, score, id): each task's best documents for the queries of one block: (query, term, q * w), sorted by query."""
    shared = windows.sparkSession.sparkContext.broadcast(block)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        query, term, weight = shared.value
        cut = np.flatnonzero(np.concatenate([[True], query[1:] != query[:-1]])) if len(query) else np.zeros(0, np.int64)
        queries = list(zip(cut.tolist(), np.append(cut[1:], len(query)).tolist(), strict=True))
        heaps: list[list[tuple[int, int]]] = [[] for _ in queries]
        score, touched = np.zeros(WINDOW, np.int64), np.zeros(WINDOW, bool)
        for batch in batches:
            for packed in zip(*(batch.column(c.split()[0]).to_pylist() for c in INDEX.split(", ")[2:]), strict=True):
                own, first, doc, tf, n, ids = (np.frombuffer(x, kind) for x, kind in zip(packed, (np.uint64, np.uint32, np.uint16, np.uint32, np.int64, np.int64), strict=True))
                if not len(own):
                    continue
                m = 100 - 75 + 75 * n * n_docs // n_terms
                tf = tf.astype(np.int64)
                impact = 1_000_000_000 * tf // (1000 * tf + 8 * m[doc])
                last = np.append(first[1:], len(doc))
                at = np.minimum(np.searchsorted(own, term), len(own) - 1)
                met = own[at] == term
                for k, (a, b) in enumerate(queries):
                    here = np.flatnonzero(met[a:b]) + a
                    if not len(here):
                        continue
                    for x, y, w in zip(first[at[here]].tolist(), last[at[here]].tolist(), weight[here].tolist(), strict=True):
                        places = doc[x:y]
                        score[places] += w * impact[x:y]
                        touched[places] = True
                    found = np.flatnonzero(touched)
                    got = score[found]
                    some = got > 0
                    harvest(heaps[k], got[some], ids[found[some]], top)
                    score[found] = 0
                    touched[found] = False
        rows = [(int(query[a]), s, -i) for (a, _), heap in zip(queries, heaps, strict=True) for s, i in heap]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in range(3)], ["query", "score", "id"])

    return windows.mapInArrow(run, "query long, score long, id long")


def best(found: DataFrame, top: int) -> DataFrame:
    """``found`` with the ``top`` rows of each query and their ``rank``."""
    order = [F.col("score").desc(), F.col("id").asc()]
    some = found.withColumn("share", F.pmod(F.spark_partition_id(), F.lit(SHARES)))
    some = some.withColumn("rank", F.row_number().over(Window.partitionBy("query", "share").orderBy(*order))).where(F.col("rank") <= top).drop("rank", "share")
    return some.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(*order))).where(F.col("rank") <= top)


def search(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", item: str = "item_id", top: int = TOP) -> DataFrame:
    """(item, rank, key, score): the ``top`` documents of each item."""
    items = benchmark.select(F.col(item).alias("item"), F.coalesce("text", F.lit("")).alias("text"))
    texts = durable(items.select("text").distinct().withColumn("query", F.monotonically_increasing_id()))
    asked = durable(asked_terms(texts))
    distinct = asked.select("term").distinct()
    vocabulary = np.sort(distinct.toArrow().column("term").to_numpy().view(np.uint64)) if distinct.count() <= MOST_TERMS else None
    table = Stored(index(docs, vocabulary, key))
    windows = table.read()
    n_docs, n_terms = windows.agg(F.coalesce(F.sum("docs"), F.lit(0)), F.coalesce(F.sum("terms"), F.lit(0))).first()
    weight = F.floor(1000 * F.log(F.lit(2.0 * n_docs + 2) / (2 * F.col("df") + 1).cast("double")))
    entries = durable(asked.join(frequencies(windows), "term").select("query", "term", (F.col("q") * weight).alias("w")).where("w > 0"))
    blocks = -(-entries.count() // MOST_ENTRIES)
    parts = []
    for k in range(blocks):
        held = entries.where(F.pmod(F.xxhash64("query"), F.lit(blocks)) == k).toArrow()  # about MOST_ENTRIES rows
        query, term, w = (held.column(c).to_numpy() for c in ("query", "term", "w"))
        o = np.argsort(query, kind="stable")
        parts.append(durable(best(scored(windows, (query[o], term[o].view(np.uint64), w[o]), n_docs, n_terms, top), top)))
    table.drop()
    none = entries.where("false").select("query", F.lit(0).cast("long").alias("score"), F.lit(0).cast("long").alias("id"), F.lit(0).alias("rank"))
    found = none
    for part in parts:
        found = found.unionByName(part)
    named = found.join(texts, "query").withColumn("text", F.concat("text", F.lit("")))
    return items.join(named, "text").select(F.col("item").alias(item), "rank", F.when(F.col("id") != MISSING, F.col("id")).alias(key), "score")
