"""Counts, buckets and completeness of a catalog."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rolegraph.functions.quality import quality_tier
from rolegraph.functions.text import format_rate
from rolegraph.operators import graph, measures
from rolegraph.plans.catalog import Catalog, first


def counts(c: Catalog) -> DataFrame:
    """One row of library counts; orphans are tracks without a release."""
    n = lambda df, name: df.agg(F.count("*").alias(name))
    of_files = c.file.agg(F.count("*").alias("files"), F.count_if(F.col("release_key").isNull()).alias("orphans"), F.coalesce(F.sum("duration_ms"), F.lit(0)).alias("duration_ms"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"))
    of_releases = c.release.agg(F.count("*").alias("releases"), F.count_if("is_compilation").alias("compilations"), F.countDistinct("owner_key").alias("album_artists"))
    return measures.one_row(of_files, of_releases, n(c.artist, "artists"), n(c.label, "labels"), n(c.genre, "genres"))


def codecs(c: Catalog) -> DataFrame:
    codec = F.col("properties.codec")
    return measures.buckets(c.file, F.when(F.coalesce(codec, F.lit("")) == "", "unknown").otherwise(F.upper(codec)), "size")


def tiers(c: Catalog) -> DataFrame:
    p = F.col("properties")
    return measures.buckets(c.file, quality_tier(F.coalesce(p["codec"], F.lit("")), p["lossless"], p["bit_depth"], p["sample_rate"], p["bitrate_kbps"]), "size")


def rates(c: Catalog) -> DataFrame:
    hz = F.col("properties.sample_rate")
    per = c.file.where(hz.isNotNull()).groupBy(hz.alias("hz")).agg(F.count("*").alias("count"), F.sum("size").alias("bytes"))
    return per.orderBy("hz").select(format_rate(F.col("hz")).alias("label"), "count", "bytes")


def decades(c: Catalog) -> DataFrame:
    sizes = c.file.where("release_key is not null").groupBy("release_key").agg(F.sum("size").alias("bytes_of"))
    return measures.buckets(c.release.join(sizes, "release_key", "left"), measures.decade(F.col("year")), "bytes_of").orderBy("label")


#: Each is made from the tables that it needs alone.
BUCKETS = {"codec": codecs, "quality": tiers, "rate": rates, "decade": decades}


def buckets(c: Catalog) -> dict[str, DataFrame]:
    return {name: of(c) for name, of in BUCKETS.items()}


def completeness(c: Catalog) -> DataFrame:
    """Shares of releases with a cover and of tracks with a genre, a recording id and a release that has a year."""
    art = c.file.where("release_key is not null").groupBy("release_key").agg(F.bool_or("has_embedded_art").alias("art"))
    covers = c.release.join(art, "release_key").agg(F.count_if(F.col("folder_cover").isNotNull() | F.col("art")).alias("covers"), F.count("*").alias("releases"))
    with_genre = c.genre_link.where("entity_kind = 'track'").agg(F.countDistinct("entity_key").alias("genres"))
    dated = c.release.where("year is not null").select("release_key", F.lit(True).alias("dated"))
    tracks = c.file.join(dated, "release_key", "left").agg(F.count("*").alias("tracks"), F.count_if("dated").alias("years"), F.count_if(first("musicbrainz_recordingid").isNotNull()).alias("ids"))
    r = lambda a, b: measures.ratio(F.col(a), F.col(b))
    return measures.one_row(covers, with_genre, tracks).select(r("covers", "releases").alias("cover"), r("years", "tracks").alias("year"), r("genres", "tracks").alias("genre"), r("ids", "tracks").alias("mbid"))


def top(c: Catalog, what: str, limit: int = 10) -> DataFrame:
    """(name, count) of artists, writers, genres or labels."""
    if what in ("artists", "writers"):
        plays = F.col("role").isin(*graph.PERFORMING)
        on_tracks = c.credit.where("entity_kind = 'track'").where(plays if what == "artists" else ~plays)
        ranked, table, key = on_tracks.groupBy("artist_key").agg(F.countDistinct("entity_key").alias("count")), c.artist, "artist_key"
    elif what == "genres":
        ranked, table, key = c.genre_link.where("entity_kind = 'track'").groupBy("genre_key").agg(F.countDistinct("entity_key").alias("count")), c.genre, "genre_key"
    elif what == "labels":
        ranked, table, key = c.release.select(F.explode("label_keys").alias("label_key")).groupBy("label_key").agg(F.count("*").alias("count")), c.label, "label_key"
    else:
        raise ValueError(f"no top list of {what!r}")
    return ranked.join(table, F.col(key) == F.col("key")).orderBy(F.desc("count"), "seen").select("name", "count").limit(limit)
