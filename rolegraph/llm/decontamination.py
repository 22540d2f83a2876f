"""Operator 4: benchmark decontamination with one Aho-Corasick automaton.

Benchmark texts are normalised (A-Z folded, words of digits, letters and non-ASCII characters, one space between) and cut
into windows of 13 words; an item of fewer words, but not none, is one window.  One automaton of all windows scans each
normalised text once; hits are mapped back to words, and on demand to offsets in the original.

Null text has no words.  Equal items and windows share a pattern that carries all their item ids; windows of items without an
id hit words like others and add no id.  Repeated documents get a row each.  The automaton is built once in a Python worker, from a broadcast of at most
``MOST_PATTERN_BYTES``.  A larger benchmark takes as many rounds as it needs, one automaton and one step of the plan each, so
neither the driver nor a worker holds more than one round's windows; texts are written once and read in each round.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rolegraph.llm._rows import Stored, durable, fresh
from rolegraph.llm._text import column_bytes

WINDOW = 13
MOST_PATTERN_BYTES = 8 << 20
#: Bytes of words keep their (folded) value, all others become a space.
TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
#: The last automaton of this worker, by a digest of its patterns.
_built: dict[str, ahocorasick.Automaton] = {}


def normal(text: bytes) -> list[bytes]:
    return text.translate(TABLE).split()


def windows(items: list[tuple[object, str | None]], size: int = WINDOW) -> dict[str, tuple[int, list[str]]]:
    """Pattern, with a space on either side, to (its number of words, its item ids)."""
    out: dict[str, tuple[int, set[str]]] = {}
    for item, text in items:
        w = normal((text or "").encode())
        for k in range(max(1, len(w) - size + 1) if w else 0):
            part = w[k : k + size]
            out.setdefault((b" " + b" ".join(part) + b" ").decode("latin-1"), (len(part), set()))[1].update([] if item is None else [str(item)])
    return {p: (n, sorted(ids)) for p, (n, ids) in out.items()}


def _automaton(name: str, patterns: list[tuple[str, int, list[str]]]) -> ahocorasick.Automaton:
    if name not in _built:
        _built.clear()
        a = ahocorasick.Automaton()
        for p, n, ids in patterns:
            a.add_word(p, (n, ids))
        a.make_automaton()
        _built[name] = a
    return _built[name]


def _rounds(benchmark: DataFrame) -> Iterator[list[tuple[str, int, list[str]]]]:
    """Patterns for the rounds of scanning, each of MOST_PATTERN_BYTES and one item at most; rows arrive one partition at a time."""
    held, any_yet = 0, False
    table: dict[str, tuple[int, set[str]]] = {}
    for r in benchmark.select("item_id", "text").orderBy("item_id").toLocalIterator():
        for p, (n, ids) in windows([(r[0], r[1])]).items():
            if p not in table:
                held += len(p)
            table.setdefault(p, (n, set()))[1].update(ids)
        if held > MOST_PATTERN_BYTES:
            yield [(p, n, sorted(i)) for p, (n, i) in table.items()]
            table, held, any_yet = {}, 0, True
    if table or not any_yet:
        yield [(p, n, sorted(i)) for p, (n, i) in table.items()]


FOUND = "n_words long, hit_words array<int>, items array<string>"


def _round(docs: DataFrame, patterns: list[tuple[str, int, list[str]]]) -> DataFrame:
    """``docs`` with n_words, hit_words and items of one automaton; hit_words and items are null where nothing is hit."""
    shared, name = docs.sparkSession.sparkContext.broadcast(patterns), hashlib.sha256(repr(patterns).encode()).hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = _automaton(name, shared.value)
        for batch in batches:
            data, offs = column_bytes(batch.column("text"))
            counts, hits, items = [], [], []
            for i in range(batch.num_rows):
                w = normal(data[offs[i] : offs[i + 1]].tobytes())
                counts.append(len(w))
                found = []
                text = ""
                if w and len(a):
                    text = (b" " + b" ".join(w) + b" ").decode("latin-1")
                    found = list(a.iter(text))
                if not found:
                    hits.append(None)
                    items.append(None)
                    continue
                gaps = np.flatnonzero(np.frombuffer(text.encode("latin-1"), np.uint8) == 32)
                last = np.searchsorted(gaps, [e for e, _ in found])  # the window's closing space, so its last word is one before
                mark = np.zeros(len(w) + 1, np.int64)
                for e, (_, (n, _)) in zip(last, found, strict=True):
                    mark[e - n] += 1
                    mark[e] -= 1
                hits.append(np.flatnonzero(mark.cumsum()[:-1] > 0).astype(np.int32))
                items.append(sorted({x for _, (_, ids) in found for x in ids}))
            more = [pa.array(counts, pa.int64()), pa.array(hits, pa.list_(pa.int32())), pa.array(items, pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], [*batch.schema.names, "n_words", "hit_words", "items"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(run, f"{kinds}, {FOUND}")


def scan(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` (all columns) with n_words, hit_words (places of hit words, from 0) and items (sorted ids)."""
    rounds = _rounds(benchmark)
    first, second = next(rounds), next(rounds, None)
    some = lambda c, kind: F.array_sort(F.array_distinct(F.coalesce(c, F.expr(f"cast(array() as array<{kind}>)"))))
    if second is None:
        out = _round(docs, first)
    else:
        at = fresh(docs, "_at")
        table = Stored(_round(docs.withColumn(at, F.monotonically_increasing_id()), first)).read()
        # Each later round writes the few documents that it hits: no row grows with the number of rounds.
        later: list[Stored] = []
        parts = [table.where("hit_words is not null").select(at, "hit_words", "items")]
        for patterns in chain([second], rounds):
            later.append(Stored(_round(table.select(at, "text"), patterns).where("hit_words is not null").select(at, "hit_words", "items")))
            parts.append(later[-1].read())
        hits = parts[0]
        for part in parts[1:]:
            hits = hits.unionAll(part)
        hits = durable(hits.groupBy(F.col(at).alias("_hit")).agg(*[F.flatten(F.collect_list(c)).alias(c) for c in ("hit_words", "items")]))
        for part in later:
            part.drop()
        out = table.drop("hit_words", "items").join(hits, F.col(at) == F.col("_hit"), "left")
    return out.select(*docs.columns, "n_words", some("hit_words", "int").alias("hit_words"), some("items", "string").alias("items"))


def contaminated() -> Column:
    """The rule: some word is hit, and hits are a twentieth of the words or more."""
    return (F.size("hit_words") > 0) & (20 * F.size("hit_words") >= F.col("n_words"))


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are not contaminated, with their columns as they were."""
    plain = {c: f"_{i}" for i, c in enumerate(docs.columns) if c != "text"}
    found = scan(docs.withColumnsRenamed(plain), benchmark).where(~contaminated())
    return found.select(*[F.col(plain.get(c, c)).alias(c) for c in docs.columns])


def report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The digest columns of the query."""
    found = scan(docs.select("doc_id", "text"), benchmark)
    return found.select(
        "doc_id", "n_words", F.size("hit_words").cast("long").alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), contaminated().alias("contaminated"),
    )


def original_spans(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, start, end): code points of each run of hit words in the original text."""
    found = scan(docs.select("doc_id", "text"), benchmark).where(F.size("hit_words") > 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import re

        word = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
        for batch in batches:
            rows = []
            for doc, text, hit in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "hit_words")), strict=True):
                at = [m.span() for m in word.finditer(text)]
                runs = np.split(np.array(hit), np.flatnonzero(np.diff(hit) > 1) + 1)
                rows += [(doc, at[r[0]][0], at[r[-1]][1]) for r in runs]
            cols = list(zip(*rows, strict=True)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int32()), strict=True)], ["doc_id", "start", "end"])

    return found.select("doc_id", "text", "hit_words").mapInArrow(run, "doc_id long, start int, end int")
