"""Operator 13: near copies by SimHash fingerprints, found by covering locality-sensitive hashing.

A fingerprint has 64 bits: bit i is set if it is set in over half of the XXH64 hashes of a text's four-word shingles.  Each of
the 64 places is given a vector of RADIUS + 1 bits that is not zero; each vector v of that many bits that is not zero makes
a mask, of the places whose vector has an odd number of bits in common with v, and so a table of masked fingerprints.  Two
fingerprints that differ in at most RADIUS places agree in some table: their places put RADIUS linear conditions on v, which
has one bit more, so some v meets them all.  No link can be lost, and unlike fingerprints rarely share a table's 32 bits.

Fingerprints alike are one node, whatever the number of their documents.  A table's group of up to ``PAIRS_MOST`` fingerprints
is compared in numpy, outwards from one fingerprint to all not reached yet; only the links of that tree leave the task.  A
larger one isn't compared at all: each of its fingerprints files the points that differ from it in at most half the radius, outside the mask, and two of
them share a point exactly if they link.  So work in a large group grows with its size and not with its square, and no task
holds more than PAIRS_MOST of a group.

Null text and text without words have the fingerprint zero and are linked like others.  A null id counts as larger than all
others, and stays null where no document with an id is linked; rows that share an id each have a row.  Extra columns are not
returned.  An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rolegraph.llm._graph import components
from rolegraph.llm._rows import durable, loose
from rolegraph.llm._text import column_bytes

SHINGLE, SEED, BITS = 4, 42, 64
RADIUS = 4
#: A group of one table with more fingerprints than this is joined by shared points, not by pairs.  About 500 points a
#: fingerprint, sorted and joined, cost as much as comparing it with this many others or more.
PAIRS_MOST = 1 << 14
#: Pairs that are compared at a time.
COMPARED = 1 << 20
#: Shingles whose bits are counted at a time.
PIECE = 1 << 15
#: A-Z folded; other bytes as they are.
FOLDED = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
MISSING = (1 << 63) - 1


def fingerprint(text: bytes) -> int:
    """The 64 bits of one text.  ``split`` divides at space and \\t to \\r."""
    words = text.translate(FOLDED).split()
    if not words:
        return 0
    joined = b" ".join(words)
    end = np.append(np.flatnonzero(np.frombuffer(joined, np.uint8) == 32), len(joined))
    start = np.concatenate([[0], end[:-1] + 1])
    n = max(1, len(words) - SHINGLE + 1)
    start, end = start[:n], end[-n:]
    digest, count = xxhash.xxh64_intdigest, np.zeros(BITS, np.int64)
    for at in range(0, n, PIECE):
        h = np.array([digest(joined[a:b], SEED) for a, b in zip(start[at : at + PIECE].tolist(), end[at : at + PIECE].tolist(), strict=True)], "<u8")
        count += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * count > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """(id, fp): the fingerprint of every row as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offs = column_bytes(batch.column("text"))
            fp = np.array([fingerprint(data[a:b].tobytes()) for a, b in zip(offs[:-1], offs[1:], strict=True)], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(fp.view(np.int64))], ["id", "fp"])

    return docs.select(F.coalesce(F.col(key), F.lit(MISSING)).alias("id"), "text").mapInArrow(run, "id long, fp long")


def masks(radius: int = RADIUS) -> list[int]:
    """The covering masks as signed longs: 2 ** (radius + 1) - 1 of them, each of about half of the places."""
    size = 1 << (radius + 1)
    vector = [i % (size - 1) + 1 for i in range(BITS)]
    out = [sum(1 << i for i, u in enumerate(vector) if bin(u & v).count("1") % 2) for v in range(1, size)]
    return [m - (1 << 64) if m >> 63 else m for m in out]


def points(mask: int, radius: int = RADIUS) -> np.ndarray:
    """What up to half the (even) radius of places outside ``mask`` can change: each as bits to flip."""
    free = [i for i in range(BITS) if not mask >> i & 1]
    flips = [sum(1 << i for i in places) for k in range(radius // 2 + 1) for places in combinations(free, k)]
    return np.array(flips, np.uint64).view(np.int64)


def tree_of(fp: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """(parents, children): a breadth-first tree of each set of linked fingerprints; what is reached is compared no more."""
    left, right, rest = [fp[:0]], [fp[:0]], fp
    while len(rest):
        front, rest = rest[:1], rest[1:]
        while len(front) and len(rest):
            step, reached = max(1, COMPARED // len(rest)), []
            for at in range(0, len(front), step):
                some = front[at : at + step]
                near = np.bitwise_count(some[:, None] ^ rest[None, :]) <= radius
                hit = near.any(axis=0)
                left.append(some[near[:, hit].argmax(axis=0)] if hit.any() else fp[:0])
                reached.append(rest[hit])
                rest = rest[~hit]
            front = np.concatenate(reached)
            right.append(front)
    return np.concatenate(left), np.concatenate(right)


def _paired(radius: int, groups: DataFrame) -> DataFrame:
    """(a, b): links that span what is linked inside each group (``fps``, at most PAIRS_MOST of them)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            col = batch.column("fps")
            flat, offs = col.flatten().to_numpy().view(np.uint64), np.concatenate([[0], np.cumsum(col.value_lengths().to_numpy())])
            trees = [tree_of(flat[x:y], radius) for x, y in zip(offs[:-1], offs[1:], strict=True)]
            a, b = (np.concatenate([t[k] for t in trees]).view(np.int64) if trees else np.zeros(0, np.int64) for k in (0, 1))
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return groups.select("fps").mapInArrow(run, "a long, b long")


def links(nodes: DataFrame, radius: int = RADIUS, pairs_most: int | None = None) -> DataFrame:
    """(a, b): links of distinct fingerprints (``fp``) that lead from each to all that it can reach."""
    if radius % 2:
        raise ValueError("the radius has to be even, so that two fingerprints that link meet half way")
    most = PAIRS_MOST if pairs_most is None else pairs_most
    table = F.explode(F.array(*[F.struct(F.lit(i).alias("table"), F.col("fp").bitwiseAND(F.lit(m)).alias("part")) for i, m in enumerate(masks(radius))]))
    filed = nodes.select("fp", table.alias("t")).select("fp", "t.table", "t.part")
    # Most groups are one fingerprint: counts are added up in the map tasks, and what is alone goes no further.
    sizes = durable(filed.groupBy("table", "part").agg(F.count("*").alias("n")).where("n > 1"))
    few = sizes.where(F.col("n") <= most)
    many = sizes.where(F.col("n") > most)
    met = filed.join(loose(few, "part"), ["table", "part"]).groupBy("table", "part").agg(F.collect_list("fp").alias("fps"))
    out = _paired(radius, met)
    if many.take(1):
        flips: Column = F.element_at(F.array(*[F.array(*[F.lit(int(x)) for x in points(m, radius)]) for m in masks(radius)]), F.col("table") + 1)
        wide = filed.join(loose(many, "part"), ["table", "part"]).select("fp", "table", F.explode(flips).alias("flip")).select("fp", "table", F.col("fp").bitwiseXOR(F.col("flip")).alias("point"))
        heads = wide.groupBy("table", "point").agg(F.min("fp").alias("head"), F.max("fp").alias("last")).where("head <> last")
        out = out.unionByName(wide.join(loose(heads, "point"), ["table", "point"]).where("fp <> head").select(F.col("head").alias("a"), F.col("fp").alias("b")))
    return out.distinct()


def join(docs: DataFrame, key: str = "doc_id", radius: int = RADIUS) -> DataFrame:
    """(key, fingerprint, component_id, n_alike): ``n_alike`` is the number of rows with the very same fingerprint."""
    rows = durable(fingerprints(docs, key))
    nodes = durable(rows.groupBy("fp").agg(F.min("id").alias("first"), F.count("*").alias("n_alike")))
    roots = components(links(nodes.select("fp"), radius))
    rooted = durable(nodes.join(loose(roots, "node"), F.col("fp") == F.col("node"), "left").select("fp", "first", "n_alike", F.coalesce("root", "fp").alias("root")))
    least = rooted.groupBy("root").agg(F.min("first").alias("component"))
    named = rooted.join(loose(least, "root"), "root").select("fp", "component", "n_alike")
    given = lambda c: F.when(F.col(c) != MISSING, F.col(c))
    return rows.join(loose(named, "fp"), "fp").select(given("id").alias(key), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), given("component").alias("component_id"), "n_alike")
