"""Folders as tables: audio files, folder covers, and reports of external measurements."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rolegraph.functions.text import file_name, folder, is_under, resolved
from rolegraph.sources.files import listed
from rolegraph.sources.heads import report_texts

#: Extensions of audio files and images, and names of covers, best first.
AUDIO = ("flac", "mp3", "m4a", "m4b", "mp4", "aac", "ogg", "oga", "opus", "spx", "wav", "wave", "aif", "aiff", "aifc", "ape", "wv", "mpc", "mp+", "mpp", "alac")
IMAGES = ("jpg", "jpeg", "png", "webp", "gif", "bmp")
COVERS = ("cover", "folder", "front", "album", "artwork", "albumart")
REPORT = "format string, version int, report struct<root:string,files:array<struct<path:string,file_name:string,size_bytes:bigint,modified_unix:bigint,ext_mismatch:boolean,detections:struct<upscaling:boolean,upsampling:boolean,transcoding:string,summary:string,detail:string>,cutoff_hz:double,cutoff_ratio:double,real_bit_depth:int,requant_rate:double,fake_stereo:boolean,clipping:struct<clipped_samples:bigint,clip_events:bigint,peak_dbfs:double,true_peak_dbtp:double,clipped:boolean>,dr_db:double,flac_md5:struct<state:string,detail:string>,error:string>>>"
REPORT_VERSION = 1


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))


def is_audio(path: Column) -> Column:
    return extension(path).isin(*AUDIO)


def cover_rank(path: Column) -> Column:
    """0 to 5 for images named like a cover, 6 for other images, else null."""
    stem = F.lower(F.regexp_replace(file_name(path), r"\.[^.]*$", ""))
    rank = F.lit(len(COVERS))
    for i, name in reversed(list(enumerate(COVERS))):
        rank = F.when(stem.startswith(name), i).otherwise(rank)
    return F.when(extension(path).isin(*IMAGES), rank)


def listing(spark: SparkSession, roots: list[str]) -> DataFrame:
    """(path, size, mtime) of all files below the roots but those with a dot before their or a folder's name; contents are not
    read."""
    return listed(spark, roots)


def audio_files(files: DataFrame) -> DataFrame:
    return files.where(is_audio(F.col("path")))


def covers(files: DataFrame) -> DataFrame:
    """(folder, folder_cover): the best image of each folder, of equals the smallest path."""
    ranked = files.withColumn("_rank", cover_rank(F.col("path"))).where("_rank is not null")
    return ranked.groupBy(folder(F.col("path")).alias("folder")).agg(F.min_by("path", F.struct("_rank", "path")).alias("folder_cover"))


def top_places(places: DataFrame, place: str = "place") -> DataFrame:
    """Distinct places without those that lie inside another one; ``.`` and ``..`` are resolved, and a slash more or less makes
    no difference."""
    clean = places.where(F.col(place).isNotNull()).select(resolved(F.col(place)).alias(place)).distinct()
    # Each place asks for its own parents, so the join is on equal paths and grows with depth, not with pairs of places.
    parts = F.split(place, "/")
    parents = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda k: F.coalesce(F.nullif(F.array_join(F.slice(parts, F.lit(1), k), "/"), F.lit("")), F.lit("/")))
    asked = clean.where(F.col(place) != "/").select(place, F.explode(parents).alias("_parent"))
    inside = asked.join(clean.select(F.col(place).alias("_parent")), "_parent", "left_semi").select(place)
    return clean.join(inside, place, "left_anti")


def watched(known: DataFrame, given: DataFrame, replace: bool = False, place: str = "place") -> DataFrame:
    """The places to scan from now on: ``given`` beside those known, or, with ``replace``, alone; nested ones are dropped."""
    return top_places(given.select(place) if replace else known.select(place).unionByName(given.select(place)), place)


def in_scope(files: DataFrame, places: list[str]) -> DataFrame:
    """Files under any of the places; without places, all."""
    if not places:
        return files
    any_of = F.lit(False)
    for place in places:
        any_of = any_of | is_under(F.col("path"), F.lit(place))
    return files.where(any_of)


def reports(spark: SparkSession, paths: list[str], report_format: str, source: str = "report") -> DataFrame:
    """Records of measurement reports that announce ``report_format``, flat, later files last in ``seq``; a foreign or newer
    report is an error."""
    texts = spark.read.option("wholetext", True).text(paths).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
    return records_of(texts, report_format, source)


def reports_below(files: DataFrame, report_format: str, source: str = "report") -> DataFrame:
    """Records of all reports among listed files, known by their first bytes; other JSON files are passed over."""
    return records_of(report_texts(files, report_format), report_format, source)


def records_of(texts: DataFrame, report_format: str, source: str = "report") -> DataFrame:
    """Records of whole reports (path, text)."""
    read = texts.select(F.col("path").alias("_file"), F.from_json("text", REPORT).alias("r")).select("_file", "r.*")
    wrong = F.coalesce(F.col("format") != report_format, F.lit(True)) | F.coalesce(F.col("version") > REPORT_VERSION, F.lit(True))
    checked = read.withColumn("report", F.when(wrong, F.raise_error(F.concat(F.col("_file"), F.lit(" is not a report this version reads")))).otherwise(F.col("report")))
    f = checked.select("_file", F.posexplode("report.files").alias("_at", "f")).where("f.path is not null")
    return f.select(
        "f.path", F.coalesce("f.file_name", file_name(F.col("f.path"))).alias("file_name"), F.col("f.size_bytes").alias("size"), F.col("f.modified_unix").alias("mtime"), F.lit(source).alias("source"),
        "f.detections.upscaling", "f.detections.upsampling", "f.detections.transcoding", "f.detections.summary", "f.detections.detail", "f.cutoff_hz", "f.cutoff_ratio", "f.real_bit_depth", "f.requant_rate", "f.fake_stereo",
        "f.clipping.clipped_samples", "f.clipping.clip_events", "f.clipping.peak_dbfs", "f.clipping.true_peak_dbtp", "f.clipping.clipped", "f.dr_db", F.col("f.flac_md5.state").alias("md5_state"), F.col("f.flac_md5.detail").alias("md5_detail"), "f.error",
        F.struct("_file", "_at").alias("seq"),
    )
