"""Properties and tags from the heads of FLAC and WAV files, by binary column functions; no Python in the tasks.

Other formats (MP3, MP4, Ogg and what third-party readers know) have no reader here: their rows come with ``problem``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Other names of canonical fields.
SYNONYMS = {
    "album artist": "albumartist", "album_artist": "albumartist", "track": "tracknumber", "tracknum": "tracknumber", "disc": "discnumber", "disk": "discnumber", "disknumber": "discnumber",
    "year": "date", "organization": "label", "publisher": "label", "labelno": "catalognumber", "catalog": "catalognumber", "description": "comment", "mixer": "remixer", "ensemble": "performer",
}


def number(x: Column, at: int | Column, n: int, little: bool = False) -> Column:
    """The unsigned number in ``n`` bytes of a binary column, counted from 0."""
    place = F.lit(at) if isinstance(at, int) else at
    digits = F.hex(F.substring(x, place + 1, n))
    if little:
        digits = F.array_join(F.transform(F.sequence(F.lit(n - 1), F.lit(0)), lambda i: F.substring(digits, i * 2 + 1, 2)), "")
    return F.conv(F.nullif(digits, F.lit("")), 16, 10).cast("long")


def container(head: Column) -> Column:
    """What a file is by its first twelve bytes, whatever its name says."""
    at = lambda i, n: F.hex(F.substring(head, i + 1, n))
    is_ = lambda i, text: at(i, len(text)) == text.encode().hex().upper()
    sync = (number(head, 0, 2).bitwiseAND(F.lit(0xFFE0)) == 0xFFE0) & (number(head, 1, 1).bitwiseAND(F.lit(6)) != 0)
    return (
        F.when(F.octet_length(head) < 12, None).when(is_(0, "fLaC"), "flac").when(is_(0, "OggS"), "ogg").when(is_(4, "ftyp"), "mp4").when(is_(0, "RIFF") & is_(8, "WAVE"), "wav")
        .when(is_(0, "FORM") & (is_(8, "AIFF") | is_(8, "AIFC")), "aiff").when(is_(0, "ID3") | sync, "mp3")
    )


def canonical(tags: Column) -> Column:
    """array<struct<key,value>> as a map of canonical lower-case fields to distinct values without blanks around."""
    known = F.create_map(*[F.lit(x) for kv in SYNONYMS.items() for x in kv])
    clean = F.filter(F.transform(tags, lambda t: F.struct(F.coalesce(F.try_element_at(known, F.lower(t["key"])), F.lower(t["key"])).alias("key"), F.trim(F.replace(t["value"], F.lit("\0"), F.lit(""))).alias("value"))), lambda t: t["value"] != "")
    keys = F.array_distinct(F.transform(clean, lambda t: t["key"]))
    return F.map_from_arrays(keys, F.transform(keys, lambda k: F.array_distinct(F.transform(F.filter(clean, lambda t: t["key"] == k), lambda t: t["value"]))))


def _flac(df: DataFrame) -> DataFrame:
    """STREAMINFO, and the comments of the block that holds them."""
    x = F.col("content")
    packed = number(x, 18, 8)
    df = df.withColumns({"rate": F.shiftrightunsigned(packed, 44).cast("int"), "ch": (F.shiftrightunsigned(packed, 41).bitwiseAND(F.lit(7)) + 1).cast("int"), "depth": (F.shiftrightunsigned(packed, 36).bitwiseAND(F.lit(31)) + 1).cast("int"), "samples": packed.bitwiseAND(F.lit((1 << 36) - 1))})
    blocks = F.aggregate(
        F.sequence(F.lit(0), F.lit(127)), F.struct(F.lit(4).cast("long").alias("at"), F.lit(-1).cast("long").alias("comment"), F.lit(False).alias("art")),
        lambda s, _: F.when(s["at"] < 0, s).otherwise(F.struct(
            F.when((number(x, s["at"].cast("int"), 1) >= 128) | (s["at"] + 4 >= F.octet_length(x)), F.lit(-1)).otherwise(s["at"] + 4 + number(x, s["at"].cast("int") + 1, 3)).cast("long").alias("at"),
            F.when(number(x, s["at"].cast("int"), 1).bitwiseAND(F.lit(127)) == 4, s["at"] + 4).otherwise(s["comment"]).cast("long").alias("comment"),
            (s["art"] | (number(x, s["at"].cast("int"), 1).bitwiseAND(F.lit(127)) == 6)).alias("art"),
        )),
    )
    df = df.withColumn("_b", blocks)
    df, lines, short = comment_lines(df, x, F.col("_b.comment").cast("int"))
    tags = F.transform(lines, lambda t: F.struct(F.split(t, "=", 2)[0].alias("key"), F.coalesce(F.get(F.split(t, "=", 2), F.lit(1)), F.lit("")).alias("value")))
    ms = F.when(F.col("rate") > 0, F.floor(F.col("samples") * 1000 / F.col("rate"))).cast("long")
    return df.select("path", "size", "mtime", canonical(tags).alias("tags"), _properties("flac", ms, F.col("rate"), F.col("depth"), F.col("ch")), F.col("_b.art").alias("has_embedded_art"), F.when((F.col("_b.comment") >= 0) & short, "comments end before their count says").alias("problem"))


def comment_lines(df: DataFrame, x: Column, c: Column) -> tuple[DataFrame, Column, Column]:
    """``df`` with helper columns, the comments that begin at place ``c`` of ``x``, and whether there are fewer than counted."""
    # Lengths are taken at their word only as far as the bytes at hand reach.
    room = F.octet_length(x).cast("long")
    within = lambda n: F.when(n <= room, n).cast("int")
    vendor = within(number(x, c, 4, True))
    df = df.withColumns({"_first": c + vendor + 8, "_given": number(x, c + vendor + 4, 4, True)})
    df = df.withColumn("_n", F.least(F.coalesce("_given", F.lit(0)), F.floor(room / 4)).cast("int"))
    none = F.expr("cast(array() as array<string>)")
    lines = F.aggregate(
        F.sequence(F.lit(1), F.col("_n")), F.struct(F.col("_first").alias("at"), none.alias("out")),
        lambda s, _: F.struct(
            (s["at"] + 4 + within(number(x, s["at"], 4, True))).alias("at"),
            F.when(s["at"].isNull(), s["out"]).otherwise(F.concat(s["out"], F.array(F.make_valid_utf8(F.substring(x, s["at"] + 5, within(number(x, s["at"], 4, True))).cast("string"))))).alias("out"),
        ),
        lambda s: s["out"],
    )
    df = df.withColumn("_lines", F.filter(F.when((c >= 0) & (F.col("_n") > 0), lines).otherwise(none), lambda t: t.isNotNull()))
    return df, F.col("_lines"), vendor.isNull() | F.col("_given").isNull() | (F.col("_given") > F.size("_lines"))


def _properties(codec: str, ms: Column, rate: Column, depth: Column, channels: Column) -> Column:
    kbps = F.when(ms > 0, F.floor(F.col("size") * 8 / ms)).cast("int")
    return F.struct(F.lit(codec).alias("codec"), F.lit("wav" if codec == "pcm" else codec).alias("container"), rate.alias("sample_rate"), depth.alias("bit_depth"), channels.alias("channels"), ms.alias("duration_ms"), kbps.alias("bitrate_kbps"), F.lit(True).alias("lossless")).alias("properties")


def _wav(df: DataFrame) -> DataFrame:
    """The format and data chunks, where they stand first, as in plain files; other files keep their row with ``problem``."""
    x = F.col("content")
    rate, channels, depth, speed = number(x, 24, 4, True).cast("int"), number(x, 22, 2, True).cast("int"), number(x, 34, 2, True).cast("int"), number(x, 28, 4, True)
    data = number(x, 40, 4, True)
    plain = F.coalesce(F.hex(F.substring(x, 37, 4)) == b"data".hex().upper(), F.lit(False))
    ms = F.when(plain & (speed > 0), F.floor(data * 1000 / speed)).cast("long")
    return df.select("path", "size", "mtime", F.expr("cast(map() as map<string,array<string>>)").alias("tags"), _properties("pcm", ms, rate, depth, channels), F.lit(False).alias("has_embedded_art"), F.when(~plain, "chunks stand before the data").alias("problem"))


def read_tags(content: DataFrame) -> DataFrame:
    """(path, size, mtime, content) to tags and properties; what has no reader keeps its row, with ``problem``."""
    kind = content.withColumn("_kind", container(F.substring("content", 1, 16)))
    flac, wav = _flac(kind.where("_kind = 'flac'")), _wav(kind.where("_kind = 'wav'"))
    other = kind.where("coalesce(_kind, '') not in ('flac', 'wav')")
    empty = F.struct(F.coalesce("_kind", F.lit("")).alias("codec"), F.coalesce("_kind", F.lit("")).alias("container"), *[F.lit(None).cast(t).alias(n) for n, t in (("sample_rate", "int"), ("bit_depth", "int"), ("channels", "int"), ("duration_ms", "long"), ("bitrate_kbps", "int"))], F.lit(False).alias("lossless")).alias("properties")
    rest = other.select("path", "size", "mtime", F.expr("cast(map() as map<string,array<string>>)").alias("tags"), empty, F.lit(False).alias("has_embedded_art"), F.concat(F.lit("no reader for "), F.coalesce("_kind", F.lit("this file"))).alias("problem"))
    return flac.unionByName(wav).unionByName(rest)
