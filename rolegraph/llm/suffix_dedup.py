"""Operator 6: bytes that stand in a repeated 200-byte string, by difference-cover blocks.

1. Cover sample: places whose number modulo ``PERIOD`` is in a perfect difference set are grouped by their first ``ANCHOR``
   bytes.  Two equal strings of PERIOD + ANCHOR - 1 = 200 bytes hold equal samples at one and the same offset, so only
   suffixes with a shared sample within reach can tie for 200 bytes.  Texts that hold such are written once, as ``near``.
2. Suffixes are taken one bucket at a time, a bucket being a share of their leading ``LEAD`` bytes, and are sorted in it by
   128 bits of code of their 200-byte prefixes, which stand in for the comparison of ranks; ties are repeats.  A bucket holds
   about one in ``BLOCK_SHARE`` of all places, so disk and memory stay bounded: a bucket reads ``near`` and nothing else, and
   its shuffle files are dropped when it is frozen.
3. Bytes covered by a repeated string go.

Texts alike are one text: where it stands twice it goes whole if it has 200 bytes.  Null text is empty.  Rows that share an
id are judged each by its own text.  Extra columns are not returned.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rolegraph.llm._meet import PACKED, buckets_for, meet, places, send
from rolegraph.llm._rows import Stored, durable, loose
from rolegraph.llm._text import block_codes, prefix_codes, slices, span_codes

LENGTH = 200
#: A perfect difference set: every difference modulo 133 is one of two of its members.
PERIOD, COVER = 133, (18, 20, 26, 27, 31, 47, 50, 65, 75, 87, 101, 118)
ANCHOR = LENGTH - PERIOD + 1
_IN_COVER = np.zeros(PERIOD, bool)
_IN_COVER[list(COVER)] = True
#: Bytes of text for each suffix that a bucket may hold, and leading bytes that choose the bucket of a suffix.
BLOCK_SHARE = 16
LEAD = 16
#: Bytes of text that a worker has in hand: numpy holds about a hundred times as much beside them.
SLICE = 1 << 19


def key_of(text: Column, seed: int) -> Column:
    return F.xxhash64(text, F.lit(seed))


def texts(docs: DataFrame, seed: int) -> DataFrame:
    """doc_id, text, key (of the text) for every row."""
    text = F.coalesce("text", F.lit(""))
    return docs.select("doc_id", text.alias("text"), key_of(text, seed).alias("key"), F.octet_length(text).alias("n_bytes"))


def named(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows with keys, and (key, copies, row, n_bytes) of each text.  A key has 64 bits; two texts that share one differ in a
    second hash or in length, and then all texts are named anew by another seed."""
    seed = 1
    while True:
        rows = texts(docs, seed)
        told = F.struct(F.xxhash64(F.lit(seed), "text"), "n_bytes")
        alike = rows.select("key", "n_bytes", F.xxhash64("doc_id", F.lit(2)).alias("row"), told.alias("told")).groupBy("key")
        alike = durable(alike.agg(F.count("*").alias("copies"), F.min("row").alias("row"), F.first("n_bytes").alias("n_bytes"), F.min("told").alias("low"), F.max("told").alias("high")))
        if not alike.where("low <> high").take(1):
            return rows, alike.drop("low", "high")
        seed += 1


def _starts(offs: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Places in the slice, and their rows, where ``size`` bytes follow in a row of LENGTH bytes or more."""
    n = np.diff(offs)
    many = np.where(n >= LENGTH, n - size + 1, 0)
    row = np.repeat(np.arange(len(n)), many)
    return np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many) + offs[row], row


def shared_samples(once: DataFrame, buckets: int) -> DataFrame:
    """(key, hits): sample places whose first bytes stand at another sample place too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offs in slices(batches, most=SLICE):
            key = batch.column("key").to_numpy().view(np.uint64)
            at, row = _starts(offs, ANCHOR)
            pos = at - offs[row]
            use = _IN_COVER[pos % PERIOD]
            at, row, pos = at[use], row[use], pos[use]
            code = span_codes(prefix_codes(data), at, at + ANCHOR)
            yield from send("shared", buckets, code, key[row], key[row].view(np.int64), pos.astype(np.uint32), short=True)

    return meet(once.select("text", "key").mapInArrow(run, PACKED), "shared", buckets, short=True)


def _asked(blob: bytes, n: int) -> np.ndarray:
    """Which of the n - LENGTH + 1 suffixes have a shared sample within reach."""
    shared = places(blob)
    mark = np.zeros(n + 1, np.int64)
    np.add.at(mark, np.maximum(shared - PERIOD + 1, 0), 1)
    np.add.at(mark, shared + 1, -1)
    return mark.cumsum()[: n - LENGTH + 1] > 0


def suffixes(near: DataFrame, buckets: int, block: int, blocks: int) -> DataFrame:
    """(key, hits): suffixes of one bucket that tie with another for 200 bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offs in slices(batches, most=SLICE):
            key = batch.column("key").to_numpy().view(np.uint64)
            asked = [np.flatnonzero(_asked(blob, int(n))) for blob, n in zip(batch.column("hits").to_pylist(), np.diff(offs), strict=True)]
            row = np.repeat(np.arange(len(asked)), [len(a) for a in asked])
            pos = np.concatenate(asked)
            sums, at = prefix_codes(data), offs[row] + pos
            use = span_codes(sums, at, at + LEAD) % np.uint64(blocks) == np.uint64(block)
            row, pos, at = row[use], pos[use], at[use]
            check = block_codes(data, LENGTH)[at]
            yield from send("shared", buckets, span_codes(sums, at, at + LENGTH), key[row], key[row].view(np.int64), pos.astype(np.uint32), check=check)

    return meet(near.mapInArrow(run, PACKED), "shared", buckets, checked=True)


def _count_asked(near: DataFrame) -> int:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = sum(int(_asked(blob, size).sum()) for blob, size in zip(batch.column("hits").to_pylist(), batch.column("n_bytes").to_pylist(), strict=True))
            yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], ["n"])

    return near.mapInArrow(run, "n long").agg(F.sum("n")).first()[0] or 0


OUT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"


def remove_repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept): what is left of each text, as bytes."""
    docs, alike = named(docs)
    buckets = buckets_for(docs)
    total = docs.agg(F.sum("n_bytes")).first()[0] or 0
    # One row stands for texts alike; only those that have copies, and one row of each, are named.
    again = alike.where("copies > 1").select(F.col("key").alias("_key"), F.col("row").alias("_row"))
    once = docs.where(F.col("n_bytes") >= LENGTH).join(again, (F.col("key") == F.col("_key")) & (F.xxhash64("doc_id", F.lit(2)) != F.col("_row")), "left_anti").select("text", "key")
    ranks = durable(shared_samples(once, buckets))
    asked = _count_asked(ranks.join(alike, "key").select("hits", "n_bytes"))
    blocks = max(1, -(-asked * BLOCK_SHARE // max(total, 1)))
    near = Stored(once.join(ranks, "key").select("text", "key", "hits"))
    found = durable(suffixes(near.read(), buckets, 0, blocks))
    for block in range(1, blocks):
        found = found.unionByName(durable(suffixes(near.read(), buckets, block, blocks)))
    near.drop()
    hits = found.groupBy("key").agg(F.collect_list("hits").alias("hits"))  # one entry for each bucket at most
    known = loose(alike.join(hits, "key", "left").where("copies > 1 or hits is not null"), "key").select(F.col("key").alias("_key"), "copies", "hits")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offs in slices(batches):
            out = []
            for i, (doc, copies, blobs) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("doc_id", "copies", "hits")), strict=True)):
                text = data[offs[i] : offs[i + 1]]
                n, kept, gone, spans = len(text), text, 0, 0
                if (copies or 1) > 1 and n >= LENGTH:
                    kept, gone, spans = text[:0], n, 1
                elif blobs:
                    mark = np.zeros(n + 1, np.int64)
                    for blob in blobs:
                        at = places(blob)
                        mark[at] += 1
                        mark[at + LENGTH] -= 1
                    cut = mark.cumsum()[:-1] > 0
                    kept, gone = text[~cut], int(cut.sum())
                    spans = int(cut[0]) + int((cut[1:] & ~cut[:-1]).sum())
                kept = kept.tobytes()
                out.append((doc, n, gone, spans, hashlib.sha256(kept).hexdigest(), kept))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], [c.split()[0] for c in OUT.split(", ")])

    return docs.select("doc_id", "text", "key").join(known, F.col("key") == F.col("_key"), "left").select("doc_id", "text", "copies", "hits").mapInArrow(run, OUT)


def report(docs: DataFrame) -> DataFrame:
    """The digest columns of the query."""
    return remove_repeats(docs).drop("kept")
