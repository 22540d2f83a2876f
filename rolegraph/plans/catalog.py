"""A catalog of entities, credits and relations, as DataFrames made from scanned files.

Entities are joined on natural keys (path, matching key, release key); dense ids in order of first appearance are added by
``with_ids`` for export.  Every "first" is by an explicit order: path, then the field, then the place in it.
"""

from __future__ import annotations

from collections.abc import Callable
from copy import copy
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rolegraph.functions import text as T
from rolegraph.functions.quality import quality_label
from rolegraph.operators import graph, sequences

#: Fields that name people with a role, in the order in which they are read.
ROLE_FIELDS = ("composer", "conductor", "remixer", "lyricist", "performer", "producer", "engineer")
#: Tracks of two releases are the same if they differ by this at most.
TOLERANCE_MS = 3000

SCANNED = (
    "path string, size bigint, mtime bigint, tags map<string,array<string>>, "
    "properties struct<codec:string,container:string,sample_rate:int,bit_depth:int,channels:int,duration_ms:bigint,bitrate_kbps:int,lossless:boolean>, "
    "has_embedded_art boolean, folder_cover string, integrity struct<state:string,method:string,detail:string,checked_at:bigint>"
)


def values(tag: str) -> Column:
    """All values of a field, none if it is missing."""
    return F.coalesce(F.try_element_at("tags", F.lit(tag)), F.expr("cast(array() as array<string>)"))


def first(tag: str) -> Column:
    return F.get(F.try_element_at("tags", F.lit(tag)), F.lit(0))


def names_in(tag: str) -> Column:
    """The names in all values of a field."""
    return T.names_of(values(tag))


@dataclass
class Catalog:
    """Tables: ``file`` (one row a file, which is also its track), ``artist``, ``release``, ``label``, ``genre``, ``credit``,
    ``genre_link``, ``collaboration`` and ``release_relation``."""

    file: DataFrame
    artist: DataFrame
    release: DataFrame
    label: DataFrame
    genre: DataFrame
    credit: DataFrame
    genre_link: DataFrame
    collaboration: DataFrame
    release_relation: DataFrame
    analysis: DataFrame | None = field(default=None)

    def changed(self, **tables: DataFrame | None) -> Catalog:
        """This catalog with other tables in place of some; the rest are not touched."""
        out = copy(self)
        vars(out).update(tables)
        return out


def build(scanned: DataFrame) -> Catalog:
    """Entities and their links from scanned files (schema ``SCANNED``), paths being unique.

    Nothing is frozen: each table reads ``scanned`` once or twice.  A catalog that is asked more than one question is better
    saved first and loaded (``kept``), or held by ``maintained``, which takes changes in.
    """
    files = derived(scanned)
    mention, label, genre = mentions(files), label_mentions(files), genre_mentions(files)
    release, credit = releases(files), credits(mention)
    return Catalog(
        files, artists(mention), release, first_spelling(label), first_spelling(genre), credit, genre_links(genre),
        graph.cooccurrence(plays(credit), "entity_key", "artist_key"), relations(release_lists(files, release)).select("source", "target", "kind"),
    )


def derived(scanned: DataFrame) -> DataFrame:
    """Scanned files with what follows from each one alone: names, places, title, release."""
    files = (
        scanned.withColumns({"artists": names_in("artist"), "album_artists": names_in("albumartist")})
        .withColumn("folder", T.folder(F.col("path")))
        .withColumn("_odd", T.maybe_placeholder(F.col("album_artists")))
        .withColumn("is_compilation", first("compilation").isNotNull() | (F.col("_odd") & F.exists("album_artists", T.is_placeholder)))
        .withColumn("album_artists", F.when(F.col("_odd"), F.filter("album_artists", lambda n: ~T.is_placeholder(n))).otherwise(F.col("album_artists")))
        .drop("_odd")
    )
    owner = T.normalize(F.coalesce(F.get("album_artists", F.lit(0)), F.get("artists", F.lit(0)), F.lit("")))
    number, disc = (T.number_of_total(first(t))[0] for t in ("tracknumber", "discnumber"))
    p = F.col("properties")
    files = files.withColumns({
        "title": F.coalesce(F.trim(first("title")), T.title_of_path(F.col("path"))),
        "track_no": F.coalesce(number, T.number_of_path(F.col("path"))),
        "disc_no": disc,
        "owner_key": F.when(~F.col("is_compilation") & (F.size("album_artists") + F.size("artists") > 0), owner),
        "release_title": F.trim(first("album")),
        "duration_ms": p["duration_ms"],
        "quality": quality_label(p["codec"], p["lossless"], p["bit_depth"], p["sample_rate"], p["bitrate_kbps"]),
    })
    key = F.concat_ws("|", T.normalize(F.col("release_title")), F.when(F.col("is_compilation"), "__va__").otherwise(F.coalesce("owner_key", F.lit(""))), F.col("folder"))
    return files.withColumn("release_key", F.when(F.col("release_title").isNotNull(), key))


def mentions(files: DataFrame) -> DataFrame:
    """A row for each name in a field that names people, of all fields at once, so that files are read once."""
    fields = ("artist", "albumartist", *ROLE_FIELDS)
    tag = F.col("tag")
    of = ("path", "release_key", "is_compilation")
    held = files.select(*of, first("musicbrainz_artistid").alias("given"), "artists", "album_artists", F.explode("tags").alias("tag", "values")).where(tag.isin(*fields))
    names = F.when(tag == "artist", F.col("artists")).when(tag == "albumartist", F.col("album_artists")).otherwise(T.names_of(F.col("values")))
    rank = (F.array_position(F.array(*[F.lit(x) for x in fields]), tag) - 1).cast("int").alias("rank")
    named = held.select(*of, "given", rank, "tag", F.posexplode(names).alias("place", "name"))
    return named.select("*", T.normalize(F.col("name")).alias("key"))


_SEEN = ("path", "rank", "place")


def artists(mention: DataFrame) -> DataFrame:
    """One row a key: the first spelling, where it stands, and the first id that the tags give a leading artist."""
    order = F.struct(*_SEEN)
    mbid = F.when((F.col("rank") == 0) & (F.col("place") == 0), F.col("given"))
    return mention.groupBy("key").agg(F.min_by(F.trim("name"), order).alias("name"), F.min(order).alias("seen"), F.min_by(mbid, F.when(mbid.isNotNull(), order)).alias("mbid")).withColumn("sort_name", T.sort_name(F.col("name")))


def credits(mention: DataFrame) -> DataFrame:
    """(artist_key, entity_kind, entity_key, role, seen): who holds which role on which track or release."""
    order = F.struct(*_SEEN)
    on_album = F.col("tag") == "albumartist"
    role = F.when(on_album, "album").when(F.col("tag") == "artist", "main").otherwise(F.col("tag"))
    held = mention.where(~on_album | (F.col("release_key").isNotNull() & ~F.col("is_compilation")))
    keys = (F.col("key").alias("artist_key"), F.when(on_album, "release").otherwise("track").alias("entity_kind"), F.when(on_album, F.col("release_key")).otherwise(F.col("path")).alias("entity_key"), role.alias("role"))
    return held.groupBy(*keys).agg(F.min(order).alias("seen"))


def plays(credit: DataFrame) -> DataFrame:
    """Credits of those who play on a track."""
    return credit.where((F.col("entity_kind") == "track") & F.col("role").isin(*graph.PERFORMING))


def label_mentions(files: DataFrame) -> DataFrame:
    return links(files.where("release_key is not null"), F.transform(values("label"), lambda name: F.trim(name)))


def genre_mentions(files: DataFrame) -> DataFrame:
    return links(files, F.filter(F.flatten(F.transform(values("genre"), lambda g: F.transform(F.split(g, ";"), lambda name: F.trim(name)))), lambda g: g != ""))


def genre_links(genre: DataFrame) -> DataFrame:
    """(entity_kind, entity_key, genre_key, seen) of tracks and of releases."""
    both = F.array(F.struct(F.lit("track").alias("entity_kind"), F.col("path").alias("entity_key")), F.struct(F.lit("release").alias("entity_kind"), F.col("release_key").alias("entity_key")))
    on = genre.select(F.col("key").alias("genre_key"), "seen", F.explode(both).alias("e")).where("e.entity_key is not null")
    return on.groupBy("e.entity_kind", "e.entity_key", "genre_key").agg(F.min("seen").alias("seen"))


def links(files: DataFrame, column: Column) -> DataFrame:
    one = files.select("path", "release_key", F.posexplode(column).alias("place", "name"))
    return one.select("path", "release_key", "name", T.normalize(F.col("name")).alias("key"), F.struct("path", "place").alias("seen"))


def first_spelling(linked: DataFrame) -> DataFrame:
    return linked.groupBy("key").agg(F.min_by("name", "seen").alias("name"), F.min("seen").alias("seen"))


def releases(files: DataFrame) -> DataFrame:
    """One row a release key: first values, tracks in order, the year, and the keys of its labels as they first appear."""
    raw = F.coalesce(first("originaldate"), first("date"))
    dated = files.where("release_key is not null").withColumns({"raw": F.nullif(raw, F.lit("")), "mb": first("musicbrainz_albumid"), "number": first("catalognumber")}).withColumn("year", T.extract_year(F.col("raw")))
    keep = lambda c: F.min_by(F.col(c), F.when(F.col(c).isNotNull(), F.col("path"))).alias(c)
    order = F.struct(F.coalesce("disc_no", F.lit(1)).alias("disc"), F.coalesce("track_no", F.lit((1 << 31) - 1)).alias("no"), F.col("title").alias("title"), F.col("path").alias("path"))
    # a release has few tracks: nothing is saved by a count before the exchange
    of_first = F.struct("release_title", "owner_key", "is_compilation", "folder", *[first(tag).alias(name) for tag, name in (("barcode", "barcode"), ("media", "media"), ("musicbrainz_releasegroupid", "release_group_mbid"))])
    given = dated.select("release_key", "path", "folder_cover", "number", "mb", "raw", "year", of_first.alias("of"), order.alias("order")).repartition("release_key")
    out = given.groupBy("release_key").agg(
        F.min_by("of", "path").alias("of"), keep("folder_cover"), F.min_by("number", F.when(F.col("number").isNotNull(), F.col("path"))).alias("catalog_number"), F.min_by("mb", F.when(F.col("mb").isNotNull(), F.col("path"))).alias("mbid"),
        F.min("year").alias("year"), F.min_by("raw", F.when(F.col("year").isNotNull(), F.struct("year", "path"))).alias("_dated"), F.max_by("raw", F.when(F.col("raw").isNotNull(), F.col("path"))).alias("_last"),
        F.transform(F.array_sort(F.collect_list("order")), lambda x: x["path"]).alias("track_paths"), F.min("path").alias("seen"),
    )
    out = out.select(
        "release_key", F.col("of.release_title").alias("title"), *[F.col(f"of.{c}").alias(c) for c in ("owner_key", "is_compilation", "folder", "barcode", "media", "release_group_mbid")],
        "folder_cover", "catalog_number", "mbid", "year", "track_paths", "seen", F.coalesce("_dated", "_last").alias("date"), T.normalize(F.col("of.release_title")).alias("key"),
    )
    label_of = label_mentions(files).groupBy("release_key", "key").agg(F.min("seen").alias("seen")).groupBy("release_key").agg(F.transform(F.array_sort(F.collect_list(F.struct("seen", "key"))), lambda x: x["key"]).alias("label_keys"))
    return out.join(label_of, "release_key", "left")


def release_lists(files: DataFrame, release: DataFrame) -> DataFrame:
    """What is compared of each release: its owner and title, and numbers, titles and lengths of its tracks."""
    entry = F.struct(F.coalesce("track_no", F.lit(0)).alias("no"), T.normalize(F.col("title")).alias("title"), F.coalesce("duration_ms", F.lit(0)).alias("ms"))
    lists = files.where("release_key is not null").groupBy("release_key").agg(F.array_sort(F.collect_list(entry)).alias("list"), F.sort_array(F.collect_set("quality")).alias("qualities"))
    rows = release.select("release_key", "owner_key", "key").join(lists, "release_key").withColumn("what", F.to_json(F.transform("list", lambda x: F.struct(x["no"], x["title"]))))
    return rows.withColumn("title_key", F.concat_ws("|", "key", F.coalesce("owner_key", F.lit("__va__"))))


def relations(lists: DataFrame) -> DataFrame:
    """(source, target, kind, title_key): releases of one owner and title whose track lists agree, in both directions.

    Track lists meet on owner, title, length and the list of numbers and titles, so only copies of an album meet.
    """
    a = lists.select(*[F.col(c).alias(f"a_{c}") for c in lists.columns])
    b = lists.select(*[F.col(c).alias(f"b_{c}") for c in lists.columns])
    near = F.forall(F.zip_with("a_list", "b_list", lambda x, y: F.abs(x["ms"] - y["ms"]) <= TOLERANCE_MS), lambda ok: ok)
    pairs = a.join(b, (F.col("a_key") == F.col("b_key")) & (F.col("a_what") == F.col("b_what")) & F.col("a_owner_key").eqNullSafe(F.col("b_owner_key")) & (F.col("a_release_key") < F.col("b_release_key"))).where(near)
    kind = F.when(F.col("a_qualities") == F.col("b_qualities"), "duplicate").otherwise("other_edition")
    ends = F.array(F.struct(F.col("a_release_key").alias("source"), F.col("b_release_key").alias("target")), F.struct(F.col("b_release_key").alias("source"), F.col("a_release_key").alias("target")))
    return pairs.select(F.explode(ends).alias("e"), kind.alias("kind"), F.col("a_title_key").alias("title_key")).select("e.source", "e.target", "kind", "title_key")


TABLES = ("file", "artist", "release", "label", "genre", "credit", "genre_link", "collaboration", "release_relation")
#: Version of the layout that ``save`` writes; ``load`` reads this one alone.
VERSION = 1


def save(c: Catalog, folder: str) -> None:
    """The tables of a catalog as Parquet below ``folder``, which has to be new, and the version of their layout."""
    for name in (*TABLES, *(["analysis"] if c.analysis is not None else [])):
        getattr(c, name).write.parquet(f"{folder}/{name}")
    c.file.sparkSession.createDataFrame([(VERSION, c.analysis is not None)], "version int, analysis boolean").coalesce(1).write.parquet(f"{folder}/version")


def load(spark: SparkSession, folder: str) -> Catalog:
    """A saved catalog; another version of the layout is an error."""
    given = spark.read.parquet(f"{folder}/version").first()
    if given["version"] != VERSION:
        raise ValueError(f"the catalog has version {given['version']}, this library reads {VERSION}: build it again")
    return Catalog(*[spark.read.parquet(f"{folder}/{name}") for name in TABLES], spark.read.parquet(f"{folder}/analysis") if given["analysis"] else None)


def kept(c: Catalog, folder: str) -> Catalog:
    """``c`` saved below ``folder`` and read back: questions then read tables and not what the catalog was built from."""
    save(c, folder)
    return load(c.file.sparkSession, folder)


class OnDemand(Catalog):
    """A catalog whose tables are made when they are asked for first, and saved below ``folder`` from then on."""

    def __init__(self, make: Callable[[OnDemand, str], DataFrame], folder: str) -> None:
        # a changed copy makes what it lacks from this one's tables, not from those put in their place
        self._whole, self._make, self._folder, self._made = self, make, folder, {}

    def __getattr__(self, name: str) -> DataFrame:
        """A table that no one has put in place."""
        if name not in TABLES:
            raise AttributeError(name)
        if name not in self._made:
            df = self._make(self._whole, name)
            df.write.parquet(f"{self._folder}/{name}")
            self._made[name] = df.sparkSession.read.schema(df.schema).parquet(f"{self._folder}/{name}")
        return self._made[name]


def on_demand(scanned: DataFrame, folder: str) -> Catalog:
    """The catalog of ``build``, table by table: the source is read once, for files, and the others are made from saved ones."""
    makers: dict[str, Callable[[Catalog], DataFrame]] = {
        "file": lambda c: derived(scanned),
        "artist": lambda c: artists(mentions(c.file)),
        "release": lambda c: releases(c.file),
        "label": lambda c: first_spelling(label_mentions(c.file)),
        "genre": lambda c: first_spelling(genre_mentions(c.file)),
        "credit": lambda c: credits(mentions(c.file)),
        "genre_link": lambda c: genre_links(genre_mentions(c.file)),
        "collaboration": lambda c: graph.cooccurrence(plays(c.credit), "entity_key", "artist_key"),
        "release_relation": lambda c: relations(release_lists(c.file, c.release)).select("source", "target", "kind"),
    }
    return OnDemand(lambda c, name: makers[name](c), folder)


#: The key by which a keyed table is dealt: joins on it need no exchange.
KEYED = {"file": "release_key", "artist": "key", "release": "release_key", "label": "key", "genre": "key", "credit": "artist_key", "genre_link": "genre_key", "collaboration": "source", "release_relation": "source"}
#: What columns of few values may hold.
ENUMERATED = {
    "credit": {"role": ("main", "album", "featured", *ROLE_FIELDS), "entity_kind": ("track", "release")}, "genre_link": {"entity_kind": ("track", "release")},
    "release_relation": {"kind": ("duplicate", "other_edition")}, "file": {"integrity.state": ("intact", "damaged", "nothing_to_check")},
}


def unsound(c: Catalog) -> DataFrame:
    """(what, key): broken links, and values that a column of few values may not hold."""
    odd = [
        getattr(c, name).where(F.col(column).isNotNull() & ~F.col(column).isin(*allowed)).select(F.lit(f"{column} of {name}").alias("what"), F.col(column).alias("key")).distinct()
        for name, columns in ENUMERATED.items() for column, allowed in columns.items()
    ]
    return reduce(DataFrame.unionByName, [broken_links(c), *odd])


def save_tables(c: Catalog, database: str, buckets: int = 64) -> None:
    """The catalog as tables of ``database``, each bucketed and sorted by its key (``KEYED``); a broken one is refused."""
    wrong = unsound(c).limit(5).collect()
    if wrong:
        raise ValueError("the catalog is broken: " + "; ".join(f"{r['what']}: {r['key']}" for r in wrong))
    for name, key in KEYED.items():
        getattr(c, name).write.bucketBy(buckets, key).sortBy(key).mode("overwrite").saveAsTable(f"{database}.{name}")
    if c.analysis is not None:
        c.analysis.write.bucketBy(buckets, "path").sortBy("path").mode("overwrite").saveAsTable(f"{database}.analysis")


def load_tables(spark: SparkSession, database: str) -> Catalog:
    """A catalog saved by ``save_tables``."""
    analysis = spark.table(f"{database}.analysis") if spark.catalog.tableExists(f"{database}.analysis") else None
    return Catalog(*[spark.table(f"{database}.{name}") for name in TABLES], analysis)


def broken_links(c: Catalog) -> DataFrame:
    """(what, key): keys that stand twice and links to what is not there; none in a sound catalog."""
    twice = [df.groupBy(F.col(key).alias("key")).count().where("count > 1").select(F.lit(f"{name} twice").alias("what"), "key") for name, df, key in (("file", c.file, "path"), ("artist", c.artist, "key"), ("release", c.release, "release_key"))]
    lost = [
        ("file without its release", c.file.select(F.col("release_key").alias("key")), c.release.select(F.col("release_key").alias("key"))),
        ("credit without its artist", c.credit.select(F.col("artist_key").alias("key")), c.artist.select("key")),
        ("credit without its track", c.credit.where("entity_kind = 'track'").select(F.col("entity_key").alias("key")), c.file.select(F.col("path").alias("key"))),
        ("genre link without its genre", c.genre_link.select(F.col("genre_key").alias("key")), c.genre.select("key")),
    ]
    gone = [a.where("key is not null").distinct().join(b, "key", "left_anti").select(F.lit(what).alias("what"), "key") for what, a, b in lost]
    return reduce(DataFrame.unionByName, [*twice, *gone]).orderBy("what", "key")


def with_ids(table: DataFrame, key: str) -> DataFrame:
    """``table`` with a dense ``id`` in order of first appearance."""
    return table.join(sequences.dense_ids(table, key, ["seen"]), key)
