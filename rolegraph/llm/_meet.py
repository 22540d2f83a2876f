"""Where do equal codes stand?  Codes with places are packed into byte strings, dealt by buckets of codes, sorted one bucket
at a time, and what was found travels back packed by groups of documents.

A place is (key, pos): ``key`` names the row (a hash of its id and text), ``pos`` is a place in its text.  Rules:
``shared``: a place is a hit if its code stands at another place too; ``earlier``: if its code stands in a row of smaller id.
Codes that meet inside one slice of a task are settled there and sent once, so what a code sends is bounded by slices, not
by the rows that hold it.  Where a meeting decides, a second code of 64 bits travels along (``check``) and has to agree.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PACKED = "bucket int, payload binary"
#: Bytes of text for each bucket of codes and each group of documents.
BUCKET_BYTES = 16 << 20
LEAST_BUCKETS = 64


def buckets_for(docs: DataFrame) -> int:
    """Number of buckets, from all bytes of text."""
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return max(LEAST_BUCKETS, -(-total // BUCKET_BYTES))


def _pack(*columns: np.ndarray) -> bytes:
    """Columns of equal length behind each other; positions as two planes of 16 bits, which compress well."""
    n = len(columns[0])
    out = [np.array([n], np.int64).tobytes()]
    for c in columns:
        if c.dtype == np.uint32:
            out += [(c & 0xFFFF).astype(np.uint16).tobytes(), (c >> 16).astype(np.uint16).tobytes()]
        else:
            out.append(c.tobytes())
    return b"".join(out)


def _unpack(payload: bytes, kinds: list[type]) -> list[np.ndarray]:
    n, at, out = int(np.frombuffer(payload, np.int64, 1)[0]), 8, []
    for k in kinds:
        if k is np.uint32:
            low, high = np.frombuffer(payload, np.uint16, n, at), np.frombuffer(payload, np.uint16, n, at + 2 * n)
            out.append(low.astype(np.uint32) | (high.astype(np.uint32) << 16))
            at += 4 * n
        else:
            out.append(np.frombuffer(payload, k, n, at))
            at += n * np.dtype(k).itemsize
    return out


def _unpack_all(payloads: list[bytes], kinds: list[type]) -> list[np.ndarray]:
    parts = [_unpack(p, kinds) for p in payloads]
    return [np.concatenate(x) for x in zip(*parts, strict=True)] if parts else [np.zeros(0, k) for k in kinds]


def _groups(code: np.ndarray, *order: np.ndarray, check: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorting order by code, starts of runs of equal codes in it, and their lengths."""
    by = np.lexsort((*order, code)) if order else np.argsort(code, kind="stable")
    new = code[by[1:]] != code[by[:-1]]
    if check is not None and ((check[by[1:]] != check[by[:-1]]) & ~new).any():  # one code, two strings
        by = np.lexsort((*order, check, code))
        new = (code[by[1:]] != code[by[:-1]]) | (check[by[1:]] != check[by[:-1]])
    first = np.flatnonzero(np.concatenate([[True], new])) if len(code) else np.zeros(0, np.int64)
    return by, first, np.diff(np.concatenate([first, [len(code)]]))


def settle(rule: str, code: np.ndarray, row: np.ndarray, check: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Which places are hits for sure, and which have to be compared with other slices."""
    hit, ask = np.zeros(len(code), bool), np.zeros(len(code), bool)
    if not len(code):
        return hit, ask
    if rule == "shared":
        by, first, size = _groups(code, check=check)
        hit[by] = np.repeat(size > 1, size)
        ask[by[first]] = True
    else:
        by, first, size = _groups(code, row, check=check)
        hit[by] = row[by] > np.repeat(row[by][first], size)
        ask = ~hit
    return hit, ask


def send(rule: str, buckets: int, code: np.ndarray, key: np.ndarray, row: np.ndarray, pos: np.ndarray, short: bool = False, check: np.ndarray | None = None) -> Iterator[pa.RecordBatch]:
    """Packed rows of one slice.  ``short`` sends 32 bits of a code besides its bucket: for filters, never to decide."""
    hit, ask = settle(rule, code, row, check)
    rows: list[tuple[int, bytes]] = []
    bucket = (code % np.uint64(buckets)).astype(np.int64)
    value = (code >> np.uint64(32)).astype(np.uint32).view(np.int32) if short else code
    by = np.flatnonzero(ask)
    by = by[np.argsort(bucket[by], kind="stable")]
    cut = np.searchsorted(bucket[by], np.arange(buckets + 1))
    for b in np.flatnonzero(np.diff(cut)):
        i = by[cut[b] : cut[b + 1]]
        rows.append((int(b), _pack(value[i], *([] if check is None else [check[i]]), key[i], *([row[i]] if rule == "earlier" else []), pos[i])))
    by = np.flatnonzero(hit)
    group = (key[by] % np.uint64(buckets)).astype(np.int64)
    o = np.argsort(group, kind="stable")
    by, group = by[o], group[o]
    cut = np.searchsorted(group, np.arange(buckets + 1))
    for g in np.flatnonzero(np.diff(cut)):
        i = by[cut[g] : cut[g + 1]]
        rows.append((-1 - int(g), _pack(key[i], pos[i])))
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], ["bucket", "payload"])


def packed_places(pos: np.ndarray) -> bytes:
    """Distinct positions as stretches (start, end), or as bits from the first on, whichever is shorter."""
    pos = np.unique(pos).astype(np.int64)
    cut = np.flatnonzero(np.diff(pos) > 1)
    if 64 * (len(cut) + 1) <= pos[-1] - pos[0] + 40:
        return b"s" + np.stack([pos[np.concatenate([[0], cut + 1])], pos[np.concatenate([cut, [len(pos) - 1]])] + 1], axis=1).astype(np.uint32).tobytes()
    bits = np.zeros(pos[-1] - pos[0] + 1, bool)
    bits[pos - pos[0]] = True
    return b"b" + np.uint32(pos[0]).tobytes() + np.packbits(bits).tobytes()


def places(blob: bytes | None) -> np.ndarray:
    """The positions in what ``packed_places`` made."""
    if not blob:
        return np.zeros(0, np.int64)
    if blob[:1] == b"b":
        return np.flatnonzero(np.unpackbits(np.frombuffer(blob, np.uint8, offset=5))) + int(np.frombuffer(blob, np.uint32, 1, 1)[0])
    pairs = np.frombuffer(blob, np.uint32, offset=1).astype(np.int64).reshape(-1, 2)
    size = pairs[:, 1] - pairs[:, 0]
    return np.repeat(pairs[:, 0] - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())


def meet(packed: DataFrame, rule: str, buckets: int, short: bool = False, checked: bool = False) -> DataFrame:
    """(key long, hits binary): the hits of each row, for rows that have any."""
    kinds = [np.int32 if short else np.uint64, *([np.uint64] if checked else []), np.uint64, *([np.int64] if rule == "earlier" else []), np.uint32]

    def one_bucket(table: pa.Table) -> pa.Table:
        bucket, payloads = table.column("bucket")[0].as_py(), table.column("payload").to_pylist()
        if bucket < 0:
            return pa.table({"grp": pa.array([-1 - bucket] * len(payloads), pa.int32()), "payload": pa.array(payloads, pa.binary())})
        code, *rest = _unpack_all(payloads, kinds)
        check = rest.pop(0) if checked else None
        key, *row, pos = rest
        if rule == "shared":
            by, _, size = _groups(code, check=check)
            by = by[np.repeat(size > 1, size)]
        else:
            by, first, size = _groups(code, row[0], check=check)
            by = by[row[0][by] > np.repeat(row[0][by][first], size)]
        key, pos = key[by], pos[by]
        group = (key % np.uint64(buckets)).astype(np.int64)
        o = np.lexsort((pos, key, group))
        key, pos, group = key[o], pos[o], group[o]
        cut = np.searchsorted(group, np.arange(buckets + 1))
        some = np.flatnonzero(np.diff(cut))
        return pa.table({"grp": pa.array(some, pa.int32()), "payload": pa.array([_pack(key[cut[g] : cut[g + 1]], pos[cut[g] : cut[g + 1]]) for g in some], pa.binary())})

    def one_group(table: pa.Table) -> pa.Table:
        key, pos = _unpack_all(table.column("payload").to_pylist(), [np.uint64, np.uint32])
        o = np.lexsort((pos, key))
        key, pos = key[o], pos[o]
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
        ends = np.concatenate([first[1:], [len(key)]])
        return pa.table({"key": pa.array(key[first].view(np.int64), pa.int64()), "hits": pa.array([packed_places(pos[a:b]) for a, b in zip(first, ends, strict=True)], pa.binary())})

    return packed.groupBy("bucket").applyInArrow(one_bucket, "grp int, payload binary").groupBy("grp").applyInArrow(one_group, "key long, hits binary")


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text (null: empty), ``row`` (doc_id, null last) and ``key``, which is the same for rows alike only."""
    text = F.coalesce("text", F.lit(""))
    return docs.select("doc_id", text.alias("text"), F.coalesce("doc_id", F.lit((1 << 63) - 1)).alias("row"), F.xxhash64("doc_id", text, F.lit(1)).alias("key"))
