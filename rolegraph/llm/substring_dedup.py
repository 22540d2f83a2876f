"""Operator 9: passages of many words that stand in an earlier document, found by difference-cover anchors.

Windows of ``ANCHOR`` words are hashed only at places whose number modulo ``PERIOD`` is in a perfect difference set.  Two
equal passages of PERIOD + ANCHOR - 1 = 50 words share an anchor that is in the cover on both sides, whatever their places.
Only documents with a shared anchor are read again: each 50-word window that holds a shared anchor is hashed, and loses its
words if it also starts in a document of smaller id.

Null text has no words; a null id counts as larger than all others; rows that share an id are judged each by its own text,
and never against each other.  Extra columns are not returned.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rolegraph.llm._meet import PACKED, buckets_for, keyed, meet, send, places
from rolegraph.llm._rows import durable
from rolegraph.llm._text import slices, window_codes, word_codes, words

WINDOW = 50
#: A perfect difference set: every difference modulo 31 is one of two of its members.
PERIOD, COVER = 31, (1, 5, 11, 24, 25, 27)
ANCHOR = WINDOW - PERIOD + 1
_IN_COVER = np.zeros(PERIOD, bool)
_IN_COVER[list(COVER)] = True


def _words(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The offsets of each row's words, and two codes of each word."""
    start, end, rows = words(data, offs)
    return rows, *word_codes(data, start, end)


def _columns(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    return batch.column("key").to_numpy().view(np.uint64), batch.column("row").to_numpy()


def anchors(docs: DataFrame, buckets: int) -> DataFrame:
    """(key, hits): places of anchors that stand elsewhere too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offs in slices(batches):
            key, row = _columns(batch)
            rows, code, _ = _words(data, offs)
            anchor, at = window_codes(code, rows, ANCHOR)
            doc = np.searchsorted(rows, at, "right") - 1
            pos = at - rows[doc]
            use = _IN_COVER[pos % PERIOD] & (np.diff(rows)[doc] >= WINDOW)
            yield from send("shared", buckets, anchor[use], key[doc[use]], row[doc[use]], pos[use].astype(np.uint32), short=True)

    return meet(docs.select("text", "key", "row").mapInArrow(run, PACKED), "shared", buckets, short=True)


def windows(docs: DataFrame, anchored: DataFrame, buckets: int) -> DataFrame:
    """(key, hits): places of 50-word windows that start in a document of smaller id too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offs in slices(batches):
            key, row = _columns(batch)
            rows, code, second = _words(data, offs)
            window, at = window_codes(code, rows, WINDOW)
            check, _ = window_codes(second, rows, WINDOW)
            doc = np.searchsorted(rows, at, "right") - 1
            # a window is asked for if an anchor within it is shared
            mark = np.zeros(len(code) + 1, np.int64)
            for i, blob in enumerate(batch.column("hits").to_pylist()):
                shared = places(blob) + rows[i]
                np.add.at(mark, np.maximum(shared - PERIOD + 1, rows[i]), 1)
                np.add.at(mark, shared + 1, -1)
            use = mark.cumsum()[at] > 0
            yield from send("earlier", buckets, window[use], key[doc[use]], row[doc[use]], (at - rows[doc])[use].astype(np.uint32), check=check[use])

    near = docs.select("text", "key", "row").join(anchored, "key").select("text", "key", "row", "hits")
    return meet(near.mapInArrow(run, PACKED), "earlier", buckets, checked=True)


OUT = "doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string"


def remove_passages(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256, kept_text): kept words are joined by one space."""
    docs = keyed(docs)
    buckets = buckets_for(docs)
    anchored = durable(anchors(docs, buckets))
    found = durable(windows(docs, anchored, buckets))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offs in slices(batches):
            out = []
            for i, (doc, blob) in enumerate(zip(batch.column("doc_id").to_pylist(), batch.column("hits").to_pylist(), strict=True)):
                w = data[offs[i] : offs[i + 1]].tobytes().translate(_SPACES).split(b" ")
                w = [x for x in w if x]
                gone = np.zeros(len(w) + 1, np.int64)
                hits = places(blob)
                gone[hits] += 1
                np.add.at(gone, hits + WINDOW, -1)
                gone = gone.cumsum()[:-1] > 0
                text = b" ".join(x for x, g in zip(w, gone, strict=True) if not g) if len(hits) else b" ".join(w)
                out.append((doc, len(w), int(gone.sum()), hashlib.sha256(text).hexdigest(), text.decode()))
            yield pa.RecordBatch.from_pylist([dict(zip(("doc_id", "n_words", "n_removed", "kept_sha256", "kept_text"), o, strict=True)) for o in out], schema=pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()), ("kept_text", pa.string())]))

    # The left side's text is the large one; hits are a few numbers a document.
    return docs.select("doc_id", "text", "key").join(found.withColumnRenamed("key", "_key"), F.col("key") == F.col("_key"), "left").select("doc_id", "text", "hits").mapInArrow(run, OUT)


_SPACES = bytes(32 if c == 32 or 9 <= c <= 13 else c for c in range(256))


def report(docs: DataFrame) -> DataFrame:
    """The digest columns of the query."""
    return remove_passages(docs).drop("kept_text")
