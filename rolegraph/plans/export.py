"""Listings as lines of CSV and playlists; each line is a column expression, so writing stays with Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rolegraph.functions.text import csv_line
from rolegraph.operators.measures import worst_of
from rolegraph.plans.catalog import Catalog, first


def separator(name: str | None) -> str:
    """``,`` by default, ``tab`` or one character."""
    sep = {None: ",", "tab": "\t"}.get(name, name)
    if len(sep) != 1:
        raise ValueError("a separator is one character, or tab")
    return sep


def track_rows(c: Catalog) -> DataFrame:
    """Raw columns of every track; artists in the order of their credits, an album artist only where there is one."""
    names = c.artist.select(F.col("key").alias("artist_key"), "name")
    main = c.credit.where("entity_kind = 'track' and role = 'main'").join(names, "artist_key")
    artists = main.groupBy(F.col("entity_key").alias("path")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seen", "name"))), lambda x: x["name"]), " / ").alias("artist"))
    release = c.release.select("release_key", F.col("title").alias("album"), "year", "owner_key").join(names.select(F.col("artist_key").alias("owner_key"), F.col("name").alias("album_artist")), "owner_key", "left").drop("owner_key")
    p, state = F.col("properties"), F.coalesce("integrity.state", F.lit("not_verified"))
    files = c.file.select(
        "path", "release_key", "title", "disc_no", "track_no", "duration_ms", F.col("size").alias("size_bytes"), p["codec"].alias("codec"), p["container"].alias("container"), p["sample_rate"].alias("sample_rate_hz"),
        p["bit_depth"].alias("bit_depth"), p["channels"].alias("channels"), p["bitrate_kbps"].alias("bitrate_kbps"), p["lossless"].alias("lossless"), state.alias("integrity"), first("isrc").alias("isrc"), first("musicbrainz_recordingid").alias("musicbrainz_recordingid"),
    )
    return files.join(artists, "path", "left").join(release, "release_key", "left").select(
        "artist", "album_artist", "album", "year", "disc_no", "track_no", "title", "duration_ms", "size_bytes", "codec", "container", "sample_rate_hz", "bit_depth", "channels", "bitrate_kbps", "lossless", "integrity", "isrc", "musicbrainz_recordingid", "path",
    )


def album_rows(c: Catalog) -> DataFrame:
    """One row a release; many values are joined by `` / ``, labels and genres in the order in which they first stand."""
    p = F.col("properties")
    many = lambda x: F.array_join(F.sort_array(F.collect_set(x)).cast("array<string>"), " / ")
    per = c.file.where("release_key is not null").groupBy("release_key").agg(
        F.count("*").alias("tracks"), F.countDistinct(F.coalesce("disc_no", F.lit(1))).alias("discs"), F.coalesce(F.sum("duration_ms"), F.lit(0)).alias("duration_ms"), F.sum("size").alias("size_bytes"),
        many(p["codec"]).alias("formats"), many(p["sample_rate"]).alias("sample_rates_hz"), many(p["bit_depth"]).alias("bit_depths"), F.every(p["lossless"]).alias("lossless"), worst_of(F.col("integrity.state")).alias("integrity"),
    )
    owner = c.artist.select(F.col("key").alias("owner_key"), F.col("name").alias("album_artist"))
    listed = lambda df, name: df.groupBy("release_key").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "name"))), lambda x: x["name"]), " / ").alias(name))
    labels = c.release.select("release_key", F.posexplode("label_keys").alias("at", "key")).join(c.label.select("key", "name"), "key")
    genres = c.genre_link.where("entity_kind = 'release'").select(F.col("entity_key").alias("release_key"), F.col("genre_key").alias("key"), F.col("seen").alias("at")).join(c.genre.select("key", "name"), "key")
    rows = c.release.join(per, "release_key").join(owner, "owner_key", "left").join(listed(labels, "label"), "release_key", "left").join(listed(genres, "genres"), "release_key", "left")
    return rows.select(
        F.coalesce("album_artist", F.lit("Various Artists")).alias("album_artist"), F.col("title").alias("album"), "year", "date", "tracks", "discs", "duration_ms", "size_bytes", "formats", "sample_rates_hz", "bit_depths", "lossless",
        F.col("is_compilation").alias("compilation"), "label", "catalog_number", "barcode", "media", "genres", "integrity", F.col("mbid").alias("musicbrainz_albumid"), "folder",
    )


def csv(df: DataFrame, sep: str = ",") -> DataFrame:
    """(line) without a header; write with ``lineSep`` of CR LF."""
    return df.select(csv_line([F.col(c) for c in df.columns], sep).alias("line"))


def write_csv(df: DataFrame, folder: str, sep: str = ",") -> None:
    """Parts with CR LF line ends, each with its header, as Spark's writer does it."""
    head = sep.join(df.columns)
    first = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)) == 0
    lines = csv(df, sep).withColumn("line", F.when(first, F.concat(F.lit(head + "\r\n"), F.col("line"))).otherwise(F.col("line")))
    lines.write.option("lineSep", "\r\n").text(folder)


def playlist(rows: DataFrame, order: list[str]) -> DataFrame:
    """(line): ``#EXTM3U``, then for each track its seconds, artist and title, and its path, in the given order."""
    seconds = F.coalesce(F.floor((F.col("duration_ms") + 500) / 1000), F.lit(-1)).cast("string")
    named = F.concat_ws(" - ", F.nullif(F.get(F.split(F.coalesce("artist", F.lit("")), " / "), F.lit(0)), F.lit("")), F.col("title"))
    tracks = rows.select(F.lit(1).alias("_at"), *[F.col(c).alias(f"_{i}") for i, c in enumerate(order)], F.concat(F.lit("#EXTINF:"), seconds, F.lit(","), named, F.lit("\n"), F.col("path")).alias("line"))
    head = rows.sparkSession.range(1).select(F.lit(0).alias("_at"), F.lit("#EXTM3U").alias("line"))
    return tracks.unionByName(head, allowMissingColumns=True).orderBy("_at", *[f"_{i}" for i in range(len(order))]).select("line")
