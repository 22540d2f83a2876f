"""Heads of audio files: the blocks that describe them, fetched by range reads, and never the audio.

A task opens a file, reads FIRST bytes, and from then on only what the walk asks for: the header of each block or chunk, and
the bodies of those that describe something, up to MOST_BODY.  Pictures and samples are stepped over.  So what is read of a
file follows its descriptions and not its length; ``bytes_read`` says how much it was.  What the blocks mean is told by column
functions on them (``read_heads``), as in ``tags``.

Files that can't be opened, have no reader or are damaged keep their row, with ``problem``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rolegraph.operators.frozen import ship
from rolegraph.sources import tags as T
from rolegraph.sources.files import opened

#: Bytes of the first read, of the largest body that is fetched, and blocks of a file that are walked.
FIRST, MOST_BODY, MOST_BLOCKS = 4096, 16 << 20, 10_000
#: Bytes by which a report is known.
SNIFF = 512
HEADS = "path string, size bigint, mtime bigint, kind string, blocks array<struct<id:string,size:bigint,body:binary>>, bytes_read bigint, problem string"
#: Fields of a WAV file's INFO list, and text chunks of AIFF.
INFO = {
    "INAM": "title", "IART": "artist", "IPRD": "album", "ICRD": "date", "IGNR": "genre", "ITRK": "tracknumber", "ICMT": "comment", "IPUB": "label", "ICOP": "copyright", "IENG": "engineer",
    "ISFT": "encodedby",
}
AIFF_TEXT = {"NAME": "title", "AUTH": "artist", "ANNO": "comment", "(c) ": "copyright"}
#: Bytes of a body that are of use, by kind of file and block; blocks that are not named are stepped over.
WANTED = {"flac": {"0": 34, "4": MOST_BODY}, "wav": {"fmt ": 40, "LIST": MOST_BODY}, "aiff": {"COMM": 64} | dict.fromkeys(AIFF_TEXT, 4096)}


class Ranges:
    """Bytes of an open file by place; the first FIRST are read once."""

    def __init__(self, handle: pa.NativeFile, size: int) -> None:
        self.handle, self.size, self.read = handle, size, 0
        self.first = b""
        self.first = self._fetch(0, min(FIRST, size))

    def _fetch(self, at: int, n: int) -> bytes:
        got = self.handle.read_at(n, at) if n > 0 else b""
        self.read += len(got)
        return got

    def at(self, at: int, n: int) -> bytes:
        n = max(0, min(n, self.size - at))
        return self.first[at : at + n] if at + n <= len(self.first) else self._fetch(at, n)


def kind_of(head: bytes) -> str | None:
    """What a file is by its first bytes."""
    if len(head) < 12:
        return None
    if head[:4] == b"fLaC":
        return "flac"
    if head[:4] == b"OggS":
        return "ogg"
    if head[4:8] == b"ftyp":
        return "mp4"
    if head[:4] == b"RIFF" and head[8:12] == b"WAVE":
        return "wav"
    if head[:4] == b"FORM" and head[8:12] in (b"AIFF", b"AIFC"):
        return "aiff"
    if head[:3] == b"ID3" or (head[0] == 0xFF and head[1] & 0xE0 == 0xE0 and head[1] & 6):
        return "mp3"
    return None


def _flac_header(h: bytes) -> tuple[str, int, int, bool]:
    return str(h[0] & 127), int.from_bytes(h[1:4], "big"), 0, bool(h[0] & 128)


def _chunk_header(order: str) -> Callable[[bytes], tuple[str, int, int, bool]]:
    def header(h: bytes) -> tuple[str, int, int, bool]:
        size = int.from_bytes(h[4:8], order)
        return h[:4].decode("latin-1"), size, size % 2, False  # chunks are padded to even lengths

    return header


WALKS = {"flac": (4, 4, _flac_header), "wav": (12, 8, _chunk_header("little")), "aiff": (12, 8, _chunk_header("big"))}


def blocks_of(file: Ranges, kind: str) -> tuple[list[dict], str | None]:
    """Blocks or chunks in order, with the bodies that are of use, and what is wrong with them."""
    at, width, header = WALKS[kind]
    out = []
    while at + width <= file.size:
        name, size, padding, last = header(file.at(at, width))
        if at + width + size > file.size + 1:
            return out, f"block {name!r} ends beyond the file"
        if len(out) == MOST_BLOCKS:
            return out, f"more than {MOST_BLOCKS} blocks"
        want = WANTED[kind].get(name, 0)
        out.append({"id": name, "size": size, "body": file.at(at + width, min(size, want)) if want else None})
        at += width + size + padding
        if last:
            return out, None
    return out, "no block is the last" if kind == "flac" else None


def heads(files: DataFrame, partitions: int | None = None) -> DataFrame:
    """(path, size, mtime) to ``HEADS``; conditions belong on ``files``, before anything is opened."""
    ship(files.sparkSession)

    def one(path: str, size: int, mtime: int) -> dict:
        row = {"path": path, "size": size, "mtime": mtime, "kind": None, "blocks": [], "bytes_read": 0, "problem": None}
        try:
            system, inside, _ = opened(path)
            with system.open_input_file(inside) as handle:
                file = Ranges(handle, handle.size())
                row["kind"] = kind_of(file.first[:16])
                if row["kind"] in WALKS:
                    row["blocks"], row["problem"] = blocks_of(file, row["kind"])
                else:
                    row["problem"] = f"no reader for {row['kind'] or 'this file'}"
                row["bytes_read"] = file.read
        except OSError as error:
            row["problem"] = f"not readable: {type(error).__name__}"
        return row

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("path", pa.string()), ("size", pa.int64()), ("mtime", pa.int64()), ("kind", pa.string()), ("blocks", pa.list_(pa.struct([("id", pa.string()), ("size", pa.int64()), ("body", pa.binary())]))), ("bytes_read", pa.int64()), ("problem", pa.string())])
        for batch in batches:
            rows, held = [], 0
            for given in batch.to_pylist():
                rows.append(one(given["path"], given["size"], given["mtime"]))
                held += rows[-1]["bytes_read"]
                if held > MOST_BODY:
                    yield pa.RecordBatch.from_pylist(rows, schema=schema)
                    rows, held = [], 0
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema=schema)

    n = partitions or 4 * files.sparkSession.sparkContext.defaultParallelism
    return files.select("path", "size", "mtime").repartition(n).mapInArrow(run, HEADS)


def _body(name: str) -> Column:
    return F.get(F.filter("blocks", lambda b: b["id"] == name), F.lit(0))["body"]


def _flac(df: DataFrame) -> DataFrame:
    df = df.withColumns({"_info": _body("0"), "_said": _body("4")})
    packed = T.number(F.col("_info"), 10, 8)
    df = df.withColumns({
        "rate": F.shiftrightunsigned(packed, 44).cast("int"), "ch": (F.shiftrightunsigned(packed, 41).bitwiseAND(F.lit(7)) + 1).cast("int"), "depth": (F.shiftrightunsigned(packed, 36).bitwiseAND(F.lit(31)) + 1).cast("int"),
        "samples": packed.bitwiseAND(F.lit((1 << 36) - 1)),
    })
    df, lines, short = T.comment_lines(df, F.col("_said"), F.lit(0))
    pairs = F.transform(lines, lambda t: F.struct(F.split(t, "=", 2)[0].alias("key"), F.coalesce(F.get(F.split(t, "=", 2), F.lit(1)), F.lit("")).alias("value")))
    ms = F.when(F.col("rate") > 0, F.floor(F.col("samples") * 1000 / F.col("rate"))).cast("long")
    wrong = F.coalesce("problem", F.when(F.col("_info").isNull(), "no stream is described"), F.when(F.col("_said").isNotNull() & short, "comments end before their count says"))
    return df.select("path", "size", "mtime", T.canonical(pairs).alias("tags"), T._properties("flac", ms, F.col("rate"), F.col("depth"), F.col("ch")), F.exists("blocks", lambda b: b["id"] == "6").alias("has_embedded_art"), wrong.alias("problem"))


def info_fields(body: Column) -> Column:
    """array<struct<key,value>> of the entries of an INFO list; an entry that ends beyond the list ends the walk."""
    known = F.create_map(*[F.lit(x) for kv in INFO.items() for x in kv])
    length = F.octet_length(body)

    def step(s: Column, _: Column) -> Column:
        at = s["at"]
        size = T.number(body, at + 4, 4, True)
        whole = (at >= 0) & (at + 8 <= length) & (at + 8 + size <= length)
        pair = F.struct(F.try_element_at(known, F.decode(F.substring(body, at + 1, 4), "ISO-8859-1")).alias("key"), F.make_valid_utf8(F.substring(body, at + 9, size.cast("int")).cast("string")).alias("value"))
        return F.when(~F.coalesce(whole, F.lit(False)), F.struct(F.lit(-1).alias("at"), s["out"].alias("out"))).otherwise(F.struct((at + 8 + size + size % 2).cast("int").alias("at"), F.concat(s["out"], F.array(pair)).alias("out")))

    none = F.expr("cast(array() as array<struct<key:string,value:string>>)")
    found = F.aggregate(F.sequence(F.lit(1), F.floor(length / 8).cast("int") + 1), F.struct(F.lit(4).alias("at"), none.alias("out")), step, lambda s: s["out"])
    return F.when(F.substring(body, 1, 4) == F.lit(b"INFO"), F.filter(found, lambda x: x["key"].isNotNull())).otherwise(none)


def _described(codec: Column, box: str, rate: Column, depth: Column, channels: Column, ms: Column, kbps: Column, lossless: Column) -> Column:
    some = lambda x: F.when(x > 0, x)
    return F.struct(codec.alias("codec"), F.lit(box).alias("container"), some(rate).cast("int").alias("sample_rate"), some(depth).cast("int").alias("bit_depth"), some(channels).cast("int").alias("channels"), ms.cast("long").alias("duration_ms"), kbps.cast("int").alias("bitrate_kbps"), lossless.alias("lossless")).alias("properties")


def _wav(df: DataFrame) -> DataFrame:
    df = df.withColumn("_fmt", _body("fmt "))
    at = lambda i, n: T.number(F.col("_fmt"), i, n, True)
    code, speed = F.coalesce(at(0, 2), F.lit(1)), at(8, 4)
    codec = F.when(code.isin(1, 0xFFFE), "pcm").when(code == 3, "pcm_float").otherwise(F.concat(F.lit("wav_0x"), F.lower(F.hex(code))))
    samples = F.get(F.filter("blocks", lambda b: b["id"] == "data"), F.lit(0))["size"]
    ms = F.when(speed > 0, F.floor(samples * 1000 / speed))
    kbps = F.coalesce(F.when(speed > 0, F.floor(speed * 8 / 1000)), F.when(ms > 0, F.floor(F.col("size") * 8 / ms)))
    lists = F.flatten(F.transform(F.filter("blocks", lambda b: b["id"] == "LIST"), lambda b: info_fields(b["body"])))
    wrong = F.coalesce("problem", F.when(F.col("_fmt").isNull(), "no format is described"), F.when(samples.isNull(), "no data chunk"))
    return df.select("path", "size", "mtime", T.canonical(lists).alias("tags"), _described(codec, "wav", at(4, 4), at(14, 2), at(2, 2), ms, kbps, code.isin(1, 3, 0xFFFE)), F.lit(False).alias("has_embedded_art"), wrong.alias("problem"))


def extended(x: Column, at: int) -> Column:
    """The 80-bit floating number at a place: 15 bits of exponent, 64 of mantissa."""
    power = T.number(x, at, 2).bitwiseAND(F.lit(0x7FFF))
    mantissa = T.number(x, at + 2, 4).cast("double") * float(1 << 32) + T.number(x, at + 6, 4).cast("double")
    return mantissa * F.pow(F.lit(2.0), (power - 16383 - 63).cast("double"))


def _aiff(df: DataFrame) -> DataFrame:
    df = df.withColumn("_comm", _body("COMM"))
    x = F.col("_comm")
    channels, frames, depth, rate = T.number(x, 0, 2), T.number(x, 2, 4), T.number(x, 6, 2), extended(x, 8)
    named = F.lower(F.trim(F.decode(F.substring(x, 19, 4), "ISO-8859-1")))
    packed = (F.octet_length(x) >= 22) & ~named.isin("", "none", "sowt")
    ms, kbps = F.when(rate > 0, F.floor(frames * 1000 / rate)), F.when(rate > 0, F.floor(rate * channels * depth / 1000))
    known = F.create_map(*[F.lit(v) for kv in AIFF_TEXT.items() for v in kv])
    said = F.transform(F.filter("blocks", lambda b: b["id"].isin(*AIFF_TEXT)), lambda b: F.struct(F.try_element_at(known, b["id"]).alias("key"), F.make_valid_utf8(b["body"].cast("string")).alias("value")))
    wrong = F.coalesce("problem", F.when(x.isNull(), "no sound is described"))
    return df.select("path", "size", "mtime", T.canonical(said).alias("tags"), _described(F.when(packed, named).otherwise("pcm"), "aiff", F.round(rate), depth, channels, ms, kbps, ~F.coalesce(packed, F.lit(False))), F.lit(False).alias("has_embedded_art"), wrong.alias("problem"))


def read_heads(found: DataFrame) -> DataFrame:
    """Tags and properties (columns of ``catalog.SCANNED``, and ``problem``) from heads."""
    parts = [read(found.where(F.col("kind") == kind)) for kind, read in (("flac", _flac), ("wav", _wav), ("aiff", _aiff))]
    other = found.where(~F.coalesce(F.col("kind").isin(*WALKS), F.lit(False)))
    kind = F.coalesce("kind", F.lit(""))
    missing = [F.lit(None).cast(t) for t in ("int", "int", "int", "long", "int")]
    rest = other.select("path", "size", "mtime", F.expr("cast(map() as map<string,array<string>>)").alias("tags"), F.struct(kind.alias("codec"), kind.alias("container"), *[c.alias(n) for c, n in zip(missing, ("sample_rate", "bit_depth", "channels", "duration_ms", "bitrate_kbps"), strict=True)], F.lit(False).alias("lossless")).alias("properties"), F.lit(False).alias("has_embedded_art"), "problem")
    out = parts[0]
    for part in [*parts[1:], rest]:
        out = out.unionByName(part)
    return out


def inspect(spark: SparkSession, path: str) -> DataFrame:
    """One file, in no catalog: its tags and properties."""
    system, inside, _ = opened(path)
    info = system.get_file_info(inside)
    return read_heads(heads(spark.createDataFrame([(path, info.size or 0, (info.mtime_ns or 0) // 10**9)], "path string, size bigint, mtime bigint"), 1))


def report_texts(files: DataFrame, marker: str) -> DataFrame:
    """(path, text) of those JSON files whose first SNIFF bytes hold ``marker``; of the others no more is read."""
    ship(files.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column("path").to_pylist():
                try:
                    system, inside, _ = opened(path)
                    with system.open_input_file(inside) as handle:
                        if marker.encode() not in handle.read_at(min(SNIFF, handle.size()), 0):
                            continue
                        text = handle.read_at(handle.size(), 0).decode(errors="replace")
                except OSError:
                    continue
                yield pa.RecordBatch.from_arrays([pa.array([path], pa.string()), pa.array([text], pa.string())], ["path", "text"])

    named = files.where(F.lower("path").endswith(".json")).select("path")
    return named.repartition(files.sparkSession.sparkContext.defaultParallelism).mapInArrow(run, "path string, text string")
