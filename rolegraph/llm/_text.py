"""Vectorised words, hashes and slices of Arrow text columns, shared by the operators that run numpy inside tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

U = np.uint64
_rng = np.random.default_rng(20240229)
#: A random 64-bit value for each byte, and odd multipliers for the places of a window.
BYTE_CODE = _rng.integers(0, 2**63, 256, dtype=np.uint64) * U(2) + U(1)
BASE = int(_rng.integers(2**62, 2**63)) | 1
PLACE = _rng.integers(0, 2**63, 64, dtype=np.uint64) * U(2) + U(1)
#: Odd multipliers that bring two hashes of a word or a block together.
JOIN = _rng.integers(0, 2**63, 8, dtype=np.uint64) * U(2) + U(1)
#: Places of a text that are hashed at a time.
BLOCK = 1 << 15
#: Longer words than this are hashed one by one.
LONG_WORD = 256
#: The lowest k bytes of 64 bits.
_LOW = np.array([(1 << 8 * k) - 1 for k in range(8)] + [2**64 - 1], np.uint64)

#: Bytes that divide words: space and \t to \r.  Bytes from 0x80 on belong to words.
SPACED = np.ones(256, bool)
SPACED[[0x20, *range(0x09, 0x0E)]] = False
FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32
SAME = np.arange(256, dtype=np.uint8)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


class _Powers:
    """Powers of BASE and of its inverse modulo 2**64, grown on demand."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            n = max(n, 1 << 20)
            for name, step in (("up", BASE), ("down", pow(BASE, -1, 2**64))):
                x = np.full(n, step, np.uint64)
                x[0] = 1
                setattr(self, name, np.cumprod(x, dtype=np.uint64))
        return self.up, self.down


POWERS = _Powers()


def prefix_codes(data: np.ndarray) -> np.ndarray:
    """Running sums of coded bytes; ``span_codes`` reads the code of any substring from them.

    Such a code is a polynomial modulo 2**64, and texts of a certain make (Thue-Morse words of two letters) share it whatever
    the base.  So it may filter, but never decides alone: see ``word_codes`` and ``block_codes``.
    """
    up, _ = POWERS.get(len(data) + 1)
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(BYTE_CODE[data] * up[: len(data)], out=out[1:])
    return out


def span_codes(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Scrambled 64-bit codes of the substrings [start, end)."""
    _, down = POWERS.get(len(sums))
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64) * PLACE[63])


def eights(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on, as one number; zeros follow the end."""
    held = np.concatenate([data, np.zeros(8, np.uint8)])
    return np.ndarray(len(data) + 1, np.uint64, held, strides=(1,))


def chained(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word: blocks of eight bytes, each scrambled into the hash of those before it."""
    at8, size = eights(data), end - start
    h = mix(size.astype(np.uint64) * JOIN[0])
    left = np.flatnonzero(size <= LONG_WORD)
    for k in range(0, LONG_WORD, 8):
        if not len(left):
            break
        rest = size[left] - k
        h[left] = mix(h[left] ^ (at8[start[left] + k] & _LOW[np.minimum(rest, 8)])) * JOIN[1]
        left = left[rest > 8]
    for i in np.flatnonzero(size > LONG_WORD):
        h[i] = xxhash.xxh3_64_intdigest(data[start[i] : end[i]].tobytes(), 20240229)
    return h


def word_codes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit codes of each word, each from its polynomial code and its chained hash."""
    poly, chain = span_codes(prefix_codes(data), start, end), chained(data, start, end)
    return mix(poly ^ (chain * JOIN[2])), mix(poly * JOIN[3] + (chain ^ (chain >> U(31))))


def block_codes(data: np.ndarray, size: int) -> np.ndarray:
    """A 64-bit hash of the ``size`` (8 or more) bytes from each place on: hashes of 8 bytes are scrambled in pairs into those
    of 16, 32 and so on; the last pair overlaps.  Places with fewer bytes behind them are left out."""
    if len(data) < size:
        return np.zeros(0, np.uint64)
    if len(data) > BLOCK + size:  # pieces that stay in a core's cache
        return np.concatenate([block_codes(data[i : i + BLOCK + size - 1], size) for i in range(0, len(data) - size + 1, BLOCK)])
    h, n = mix(eights(data)[: len(data) - 7]), 8
    while n < size:
        step = min(n, size - n)
        h = h[:-step] * JOIN[4] + (h[step:] ^ (h[step:] >> U(29))) * JOIN[5]
        h ^= h >> U(32)
        h *= JOIN[6]
        h ^= h >> U(29)
        n += step
    return h


def column_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column in a row, and the n + 1 offsets of its values; null counts as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = pc.fill_null(col, "")
    col = col.cast(pa.large_binary())
    if len(col) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offs = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1]
    data = np.frombuffer(col.buffers()[2], np.uint8) if col.buffers()[2] is not None and offs[-1] else np.zeros(0, np.uint8)
    return data[offs[0] : offs[-1]], offs - offs[0]


def slices(batches: Iterator[pa.RecordBatch], text: str = "text", most: int = 1 << 20) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Runs of rows with about ``most`` bytes of text each (one row at least), so that numpy's memory stays bounded."""
    for batch in batches:
        data, offs = column_bytes(batch.column(batch.schema.get_field_index(text)))
        at, n = 0, batch.num_rows
        while at < n:
            to = max(at + 1, int(np.searchsorted(offs, offs[at] + most, "right")) - 1)
            yield batch.slice(at, to - at), data[offs[at] : offs[to]], offs[at : to + 1] - offs[at]
            at = to


def words(data: np.ndarray, offs: np.ndarray, inside: np.ndarray = SPACED) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words in byte order, and the n + 1 offsets of each row's words.  Words never cross rows."""
    n = len(offs) - 1
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(n + 1, np.int64)
    w = inside[data]
    first, last = w.copy(), w.copy()
    first[1:] &= ~w[:-1]
    last[:-1] &= ~w[1:]
    cut = offs[:-1][offs[:-1] < offs[1:]]
    first[cut] = w[cut]
    last[cut[1:] - 1] = w[cut[1:] - 1]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, offs)


def window_codes(codes: np.ndarray, rows: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Codes of all windows of ``size`` words and the index of each one's first word, for windows that stay in one row."""
    if len(codes) < size:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    total = codes[: len(codes) - size + 1] * PLACE[0]
    for k in range(1, size):
        total = total + codes[k : len(codes) - size + 1 + k] * PLACE[k]
    start = np.arange(len(total))
    row = np.searchsorted(rows, start, "right") - 1
    good = start + size <= rows[row + 1]
    return mix(total[good]), start[good]


def lists(parts: list[np.ndarray], kind: pa.DataType) -> pa.ListArray:
    """A list column from one array a row."""
    offs = np.zeros(len(parts) + 1, np.int32)
    np.cumsum([len(p) for p in parts], out=offs[1:])
    flat = np.concatenate(parts) if parts else np.zeros(0)
    return pa.ListArray.from_arrays(pa.array(offs), pa.array(flat, kind))
