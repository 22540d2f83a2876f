"""The star schema as a shelf of scanned files: orders are tracks, customers own the albums, suppliers play, write and perform.

``scanned`` makes a table of schema ``catalog.SCANNED``; each query builds the catalog from it and asks the shipped facade and
plans.  Beside each stands SQL on the tables themselves.  Albums of nation 1 stand twice, those of nation 2 are kept as MP3 too.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rolegraph.api import Library
from rolegraph.functions import text as T
from rolegraph.operators.frozen import durable, shared_folder
from rolegraph.operators import grams, suggest
from rolegraph.operators.lookups import Page
from rolegraph.functions.quality import is_hi_res
from rolegraph.plans import analyses, catalog, doctor, export, incremental, stats
from rolegraph.plans.maintained import Maintained
from rolegraph.sources.listing import top_places, watched
from rolegraph.streaming import check, waiting

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
ALL = Page(None)

BASE = """lines AS (SELECT DISTINCT l_orderkey AS k, l_returnflag AS flag, s_name AS name FROM lineitem JOIN supplier ON l_suppkey = s_suppkey),
o AS (SELECT o_orderkey AS k, o_orderstatus AS st, o_orderpriority AS genre, c_mktsegment AS label, c_name AS owner, c_nationkey AS nation, o_custkey AS cust, CAST(floor(o_totalprice) AS BIGINT) AS size,
  CAST(floor(o_totalprice) AS BIGINT) % 600000 AS ms, year(o_orderdate) AS yr, CAST(month(o_orderdate) AS INTEGER) AS no, strftime(o_orderdate, '%Y-%m-%d') AS date, CASE WHEN o_totalprice > 100000 THEN 320 ELSE 128 END AS kbps FROM orders JOIN customer ON o_custkey = c_custkey),
shelves AS (SELECT 'm' AS shelf, * FROM o UNION ALL SELECT 'b', * FROM o WHERE nation = 1 UNION ALL SELECT 'e', * FROM o WHERE nation = 2),
d AS (SELECT *, '/' || shelf || '/n' || nation || '/c' || cust AS folder, shelf = 'e' OR st = 'O' AS lossy, genre = '1-URGENT' AS urgent FROM shelves),
f AS (SELECT *, folder || '/' || k || '.flac' AS path, CASE WHEN lossy THEN 'mp3' WHEN st = 'F' THEN 'flac' ELSE 'alac' END AS codec, CASE WHEN urgent AND NOT lossy THEN 96000 ELSE 44100 END AS rate,
  CASE WHEN lossy THEN NULL WHEN urgent THEN 24 ELSE 16 END AS depth, nation = 0 AS comp, 'Album of ' || label || ' ' || cust AS album, CASE WHEN st = 'P' THEN CAST(k AS VARCHAR) ELSE 'Song ' || k END AS title,
  CASE WHEN st = 'F' THEN 'intact' WHEN st = 'O' AND urgent THEN 'damaged' WHEN st = 'O' THEN 'nothing_to_check' END AS state FROM d),
g AS (SELECT *, CASE WHEN lossy THEN 'MP3 ' || kbps || ' kbps' ELSE upper(codec) || ' ' || depth || '/' || CASE WHEN rate = 96000 THEN '96' ELSE '44.1' END END AS quality FROM f),
r AS (SELECT folder, any_value(album) AS album, any_value(owner) AS owner, any_value(label) AS label, any_value(comp) AS comp, any_value(nation) AS nation, min(yr) AS yr, count(*) AS tracks, CAST(sum(ms) AS BIGINT) AS ms, CAST(sum(size) AS BIGINT) AS bytes,
  array_to_string(list_sort(list(DISTINCT quality)), ', ') AS quality, bool_or(st = 'O') AS art FROM g GROUP BY 1),
cr AS (SELECT DISTINCT path, folder, ms, size, genre, label, name, CASE flag WHEN 'N' THEN 'main' WHEN 'R' THEN 'composer' ELSE 'performer' END AS role FROM g JOIN lines USING (k))"""


def query(sql: str):
    def keep(f):
        QUERIES[f.__name__] = f
        SQL[f.__name__] = f"WITH {BASE} {sql}"
        return f

    return keep


def scanned(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    # Lines of an order are few: nothing is saved by a count before the exchange, and no side is sorted for its join.
    who = t("lineitem").join(t("supplier").hint("shuffle_hash"), F.col("l_suppkey") == F.col("s_suppkey")).where("s_name is not null").repartition("l_orderkey")
    who = who.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sort_array(F.collect_set(F.struct("l_returnflag", "s_name"))).alias("who"))
    named = lambda flag: F.transform(F.filter("who", lambda x: x["l_returnflag"] == flag), lambda x: x["s_name"])
    people = who.select("o_orderkey", named("N").alias("artist"), named("R").alias("composer"), named("A").alias("performer"))
    rows = t("orders").join(t("customer").hint("shuffle_hash"), F.col("o_custkey") == F.col("c_custkey")).join(people, "o_orderkey", "left")
    nation, status, size = F.col("c_nationkey"), F.col("o_orderstatus"), F.floor("o_totalprice").cast("long")
    rows = rows.withColumn("shelf", F.explode(F.array_compact(F.array(F.lit("m"), F.when(nation == 1, "b"), F.when(nation == 2, "e")))))
    folder = F.concat(F.lit("/"), F.col("shelf"), F.lit("/n"), nation.cast("string"), F.lit("/c"), F.col("o_custkey").cast("string"))
    lossy, urgent = (F.col("shelf") == "e") | (status == "O"), F.col("o_orderpriority") == "1-URGENT"
    one = lambda x: F.array(x)
    tags = {
        "title": F.when(status != "P", one(F.concat(F.lit("Song "), F.col("o_orderkey").cast("string")))), "artist": F.col("artist"), "composer": F.col("composer"), "performer": F.col("performer"),
        "albumartist": one(F.col("c_name")), "album": one(F.concat(F.lit("Album of "), F.col("c_mktsegment"), F.lit(" "), F.col("o_custkey").cast("string"))), "compilation": F.when(nation == 0, one(F.lit("1"))),
        "date": one(F.date_format("o_orderdate", "yyyy-MM-dd")), "tracknumber": one(F.month("o_orderdate").cast("string")), "genre": one(F.col("o_orderpriority")), "label": one(F.col("c_mktsegment")),
        "comment": F.when(status == "F", one(F.concat(F.lit("Ripped: "), F.col("c_mktsegment")))), "musicbrainz_recordingid": F.when(status == "F", one(F.col("o_orderkey").cast("string"))),
    }
    given = F.map_filter(F.create_map(*[x for k, v in tags.items() for x in (F.lit(k), v)]), lambda _, v: F.size(v) > 0)
    codec = F.when(lossy, "mp3").when(status == "F", "flac").otherwise("alac")
    properties = F.struct(
        codec.alias("codec"), codec.alias("container"), F.when(urgent & ~lossy, 96000).otherwise(44100).alias("sample_rate"), F.when(lossy, None).when(urgent, 24).otherwise(16).cast("int").alias("bit_depth"), F.lit(2).alias("channels"),
        (size % 600000).alias("duration_ms"), F.when(F.col("o_totalprice") > 100000, 320).otherwise(128).alias("bitrate_kbps"), (~lossy).alias("lossless"),
    )
    state = F.when(status == "F", "intact").when((status == "O") & urgent, "damaged").when(status == "O", "nothing_to_check")
    integrity = F.when(state.isNotNull(), F.struct(state.alias("state"), F.lit("frames").alias("method"), F.lit(None).cast("string").alias("detail"), F.lit(0).cast("long").alias("checked_at")))
    return rows.select(
        F.concat(folder, F.lit("/"), F.col("o_orderkey").cast("string"), F.lit(".flac")).alias("path"), size.alias("size"), F.col("o_orderkey").cast("long").alias("mtime"), given.alias("tags"), properties.alias("properties"),
        (status == "O").alias("has_embedded_art"), F.when(nation < 12, F.concat(folder, F.lit("/cover.jpg"))).alias("folder_cover"), integrity.alias("integrity"),
    )


_KEPT: dict[tuple[str, str], Library] = {}


def library(spark: SparkSession, sf_dir: str) -> Library:
    """The catalog of these tables, held for a session: a table is made and saved when a question asks for it first."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _KEPT:
        _KEPT[key] = Library(catalog.on_demand(scanned(spark, sf_dir), f"{shared_folder(spark)}/shelf-{uuid.uuid4().hex}"))
    return _KEPT[key]


def unread(spark: SparkSession, sf_dir: str) -> Library:
    """The catalog of these tables with nothing saved: for a question of a few columns of one table, asked in one pass."""
    return Library(catalog.build(scanned(spark, sf_dir)))


@query("""SELECT (SELECT count(*) FROM f) AS files, CAST(0 AS BIGINT) AS orphans, (SELECT CAST(sum(ms) AS BIGINT) FROM f) AS duration_ms, (SELECT CAST(sum(size) AS BIGINT) FROM f) AS bytes, (SELECT count(*) FROM r) AS releases,
  (SELECT count(*) FROM r WHERE comp) AS compilations, (SELECT count(DISTINCT owner) FROM r WHERE NOT comp) AS album_artists, (SELECT count(*) FROM (SELECT name FROM cr UNION SELECT owner FROM r)) AS artists,
  (SELECT count(DISTINCT label) FROM r) AS labels, (SELECT count(DISTINCT genre) FROM f) AS genres""")
def lib_counts(spark, sf_dir):
    return stats.counts(library(spark, sf_dir).catalog)


@query("""SELECT (SELECT count(*) FILTER (nation < 12 OR art) / CAST(count(*) AS DOUBLE) FROM r) AS cover, CAST(1 AS DOUBLE) AS year, CAST(1 AS DOUBLE) AS genre, (SELECT count(*) FILTER (st = 'F') / CAST(count(*) AS DOUBLE) FROM f) AS mbid""")
def lib_completeness(spark, sf_dir):
    return stats.completeness(unread(spark, sf_dir).catalog)


@query("SELECT upper(codec) AS label, count(*) AS count, CAST(sum(size) AS BIGINT) AS bytes FROM f GROUP BY 1")
def lib_codecs(spark, sf_dir):
    return stats.BUCKETS["codec"](unread(spark, sf_dir).catalog)


@query("""SELECT CASE WHEN lossy THEN CASE WHEN kbps >= 256 THEN 'high' ELSE 'low' END WHEN rate > 48000 OR depth > 16 THEN 'hi-res' ELSE 'lossless' END AS label, count(*) AS count, CAST(sum(size) AS BIGINT) AS bytes FROM f GROUP BY 1""")
def lib_tiers(spark, sf_dir):
    return stats.BUCKETS["quality"](unread(spark, sf_dir).catalog)


@query("SELECT CASE WHEN rate = 96000 THEN '96 kHz' ELSE '44.1 kHz' END AS label, count(*) AS count, CAST(sum(size) AS BIGINT) AS bytes FROM f GROUP BY 1")
def lib_rates(spark, sf_dir):
    return stats.BUCKETS["rate"](unread(spark, sf_dir).catalog)


@query("SELECT CAST(yr // 10 * 10 AS VARCHAR) AS label, count(*) AS count, CAST(sum(bytes) AS BIGINT) AS bytes FROM r GROUP BY 1")
def lib_decades(spark, sf_dir):
    return stats.BUCKETS["decade"](unread(spark, sf_dir).catalog)


WHOLE = (1 << 31) - 1


@query("SELECT name, count(DISTINCT path) AS count FROM cr WHERE role <> 'composer' GROUP BY 1")
def lib_top_artists(spark, sf_dir):
    return library(spark, sf_dir).top("artists", WHOLE)


@query("SELECT name, count(DISTINCT path) AS count FROM cr WHERE role = 'composer' GROUP BY 1")
def lib_top_writers(spark, sf_dir):
    return library(spark, sf_dir).top("writers", WHOLE)


@query("SELECT genre AS name, count(*) AS count FROM f GROUP BY 1")
def lib_top_genres(spark, sf_dir):
    return unread(spark, sf_dir).top("genres", WHOLE)


@query("SELECT label AS name, count(*) AS count FROM r GROUP BY 1")
def lib_top_labels(spark, sf_dir):
    return unread(spark, sf_dir).top("labels", WHOLE)


@query("""SELECT name, CAST(sum(tracks) AS BIGINT) AS tracks, CAST(sum(releases) AS BIGINT) AS releases, CAST(sum(ms) AS BIGINT) AS duration_ms, CAST(sum(size) AS BIGINT) AS bytes FROM (
  SELECT name, count(*) AS tracks, count(DISTINCT folder) AS releases, sum(ms) AS ms, sum(size) AS size FROM (SELECT DISTINCT name, path, folder, ms, size FROM cr) GROUP BY 1
  UNION ALL SELECT owner, 0, count(*) FILTER (NOT comp), 0, 0 FROM r GROUP BY 1) GROUP BY 1""")
def lib_artists(spark, sf_dir):
    return library(spark, sf_dir).artists(page=ALL)


@query("SELECT name, count(*) AS tracks, count(DISTINCT folder) AS releases, CAST(sum(ms) AS BIGINT) AS duration_ms, CAST(sum(size) AS BIGINT) AS bytes FROM cr WHERE role = 'composer' GROUP BY 1")
def lib_artists_in_role(spark, sf_dir):
    return library(spark, sf_dir).artists(role="Composer", by="name", page=ALL)


@query("""SELECT * FROM (SELECT 'composer' AS role, 'composer' AS label, count(DISTINCT name) AS artists FROM cr WHERE role = 'composer' UNION ALL SELECT 'main', 'main artist', count(DISTINCT name) FROM cr WHERE role = 'main'
  UNION ALL SELECT 'performer', 'performer', count(DISTINCT name) FROM cr WHERE role = 'performer' UNION ALL SELECT 'album', 'album artist', count(DISTINCT owner) FROM r WHERE NOT comp)""")
def lib_roles(spark, sf_dir):
    return unread(spark, sf_dir).roles()


ALBUM = "album AS title, CASE WHEN comp THEN 'Various Artists' ELSE owner END AS artist, CAST(yr AS INTEGER) AS year, tracks, ms AS duration_ms, bytes, quality, folder"


@query(f"SELECT {ALBUM} FROM r")
def lib_albums(spark, sf_dir):
    return library(spark, sf_dir).albums(page=ALL).withColumn("folder", F.element_at(F.split("release_key", r"\|"), -1)).drop("release_key")


@query(f"""SELECT {ALBUM} FROM r WHERE NOT comp AND yr = 1995 AND label = 'BUILDING' AND folder IN (SELECT folder FROM f WHERE urgent) AND folder IN (SELECT folder FROM f WHERE st = 'F')""")
def lib_albums_filtered(spark, sf_dir):
    found = library(spark, sf_dir).albums(artist="customer", year=1995, genre="urgent", label="building", compilations=False, comment="ripped building", page=ALL)
    return found.withColumn("folder", F.element_at(F.split("release_key", r"\|"), -1)).drop("release_key")


@query("SELECT genre, count(*) AS tracks, CAST(sum(ms) AS BIGINT) AS duration_ms, CAST(sum(size) AS BIGINT) AS size_bytes FROM f GROUP BY 1")
def lib_genres(spark, sf_dir):
    return unread(spark, sf_dir).genres(ALL)


@query("SELECT label, count(*) AS albums, CAST(sum(tracks) AS BIGINT) AS tracks, CAST(sum(ms) AS BIGINT) AS duration_ms, CAST(sum(bytes) AS BIGINT) AS size_bytes FROM r GROUP BY 1")
def lib_labels(spark, sf_dir):
    return unread(spark, sf_dir).labels(ALL)


@query("SELECT CAST(yr AS INTEGER) AS year, count(*) AS albums, CAST(sum(tracks) AS BIGINT) AS tracks, CAST(sum(ms) AS BIGINT) AS duration_ms, CAST(sum(bytes) AS BIGINT) AS bytes FROM r GROUP BY 1")
def lib_years(spark, sf_dir):
    return unread(spark, sf_dir).years()


@query("""SELECT CASE WHEN starts_with(path, '/m/n3/') THEN '/m/n3' WHEN starts_with(path, '/b/') THEN '/b' END AS root, count(*) AS files, CAST(sum(ms) AS BIGINT) AS duration_ms, CAST(sum(size) AS BIGINT) AS bytes FROM f GROUP BY 1
  UNION ALL SELECT '/nowhere', 0, 0, 0""")
def lib_roots(spark, sf_dir):
    return unread(spark, sf_dir).roots(["/m/n3", "/b", "/nowhere"])


@query("SELECT coalesce(state, 'not_verified') AS state, count(*) AS files FROM f WHERE starts_with(path, '/m/n3/') OR starts_with(path, '/b/') GROUP BY 1")
def lib_integrity(spark, sf_dir):
    return unread(spark, sf_dir).integrity(["/m/n3", "/b"])


@query("SELECT path FROM f WHERE state IS NULL")
def lib_unverified(spark, sf_dir):
    return unread(spark, sf_dir).unverified()


@query("""SELECT 'error' AS severity, 'missing_title' AS kind, 'the file name stands in for a title: "' || k || '"' AS detail, path FROM f WHERE st = 'P'
  UNION ALL SELECT 'error', 'missing_artist', 'nobody is named as artist', path FROM f WHERE path NOT IN (SELECT path FROM cr WHERE role = 'main')
  UNION ALL SELECT 'error', 'missing_duration', 'no length could be read; the file may be broken', path FROM f WHERE ms = 0
  UNION ALL SELECT 'error', 'damaged_audio', 'replace it by a good copy', path FROM f WHERE state = 'damaged'""")
def lib_errors(spark, sf_dir):
    return library(spark, sf_dir).doctor("error").select("severity", "kind", "detail", F.col("files")[0].alias("path"))


def _issues(spark, sf_dir, *kinds: str) -> DataFrame:
    return library(spark, sf_dir).doctor().where(F.col("kind").isin(*kinds)).select("severity", "kind", "detail", F.element_at("files", 1).alias("first"), F.size("files").cast("long").alias("files"))


@query("""SELECT 'warning' AS severity, 'mixed_quality' AS kind, '"' || album || '" — ' || concat_ws('; ', CASE WHEN count(DISTINCT codec) > 1 THEN 'codecs: ' || array_to_string(list_sort(list(DISTINCT codec)), ', ') END,
  CASE WHEN count(DISTINCT rate) > 1 THEN 'sample rates: ' || array_to_string(list_sort(list(DISTINCT rate)), ', ') END) AS detail, arg_min(path, (no, title, path)) AS first, count(*) AS files
  FROM f GROUP BY folder, album HAVING count(DISTINCT codec) > 1 OR count(DISTINCT rate) > 1""")
def lib_mixed_quality(spark, sf_dir):
    return _issues(spark, sf_dir, "mixed_quality")


@query("""SELECT 'info' AS severity, 'missing_cover' AS kind, '"' || album || '" comes without a cover' AS detail, folder AS first, CAST(1 AS BIGINT) AS files FROM r WHERE nation >= 12 AND NOT art""")
def lib_missing_covers(spark, sf_dir):
    return _issues(spark, sf_dir, "missing_cover")


@query("""SELECT 'warning' AS severity, 'incomplete_album' AS kind, '"' || album || '" disc 1: lacks ' || array_to_string(missing, ', ') AS detail, first, files FROM (
  SELECT album, arg_min(path, (no, title, path)) AS first, count(*) AS files, list_filter(range(1, max(no) + 1), lambda x: NOT list_contains(list(DISTINCT no), x)) AS missing FROM f GROUP BY folder, album) WHERE len(missing) > 0""")
def lib_incomplete_albums(spark, sf_dir):
    return _issues(spark, sf_dir, "incomplete_album")


PAIRS = """pairs AS (SELECT a.folder AS a, b.folder AS b, a.album, a.bytes AS ab, b.bytes AS bb, a.quality AS aq, b.quality AS bq, CASE WHEN a.quality = b.quality THEN 'duplicate' ELSE 'other_edition' END AS kind
  FROM r a JOIN r b ON a.owner = b.owner AND a.album = b.album AND a.folder < b.folder)"""


@query(f""", {PAIRS} SELECT a AS source, b AS target, kind FROM pairs UNION ALL SELECT b, a, kind FROM pairs""")
def lib_relations(spark, sf_dir):
    place = lambda c: F.element_at(F.split(c, r"\|"), -1).alias(c)
    return library(spark, sf_dir).catalog.release_relation.select(place("source"), place("target"), "kind")


@query(f""", {PAIRS} SELECT CASE WHEN kind = 'duplicate' THEN 'warning' ELSE 'info' END AS severity, CASE WHEN kind = 'duplicate' THEN 'duplicate_album' ELSE 'other_edition' END AS kind,
  CASE WHEN kind = 'duplicate' THEN '"' || album || '" has two copies of one quality; the smaller takes ' || least(ab, bb) || ' bytes' ELSE '"' || album || '" has copies as ' || aq || ' and as ' || bq END AS detail, a AS first, CAST(2 AS BIGINT) AS files FROM pairs""")
def lib_copies(spark, sf_dir):
    return _issues(spark, sf_dir, "duplicate_album", "other_edition")


SUPPLIER = "Supplier#00000000"


@query(f"""SELECT score, kind, name, id FROM (SELECT CASE WHEN starts_with(lower(replace(name, '#', ' ')), 'supplier 00000000') THEN 1 ELSE 2 END AS score, 'artist' AS kind, name, lower(replace(name, '#', ' ')) AS id
  FROM (SELECT DISTINCT name FROM cr) WHERE contains(lower(replace(name, '#', ' ')), 'supplier 00000000')) ORDER BY score, octet_length(encode(name)), name, id LIMIT 30""")
def lib_search(spark, sf_dir):
    return library(spark, sf_dir).search(SUPPLIER, 30)


@query(f"""SELECT score, kind, name, id FROM (SELECT CASE WHEN starts_with(lower(replace(name, '#', ' ')), 'supplier 00000000') THEN 1 ELSE 2 END AS score, 'artist' AS kind, name, lower(replace(name, '#', ' ')) AS id
  FROM (SELECT DISTINCT name FROM cr) WHERE contains(lower(replace(name, '#', ' ')), 'supplier 00000000')) ORDER BY score, octet_length(encode(name)), name, id LIMIT 30""")
def lib_search_index(spark, sf_dir):
    """The same question, answered from a saved index of runs of characters."""
    c, folder = library(spark, sf_dir).catalog, f"{shared_folder(spark)}/names-{uuid.uuid4().hex}"
    grams.write([("artist", c.artist, "key", "name"), ("release", c.release, "release_key", "title"), ("track", c.file, "path", "title"), ("label", c.label, "key", "name")], folder)
    return grams.search(spark, folder, SUPPLIER, 30)


@query("""SELECT name, CAST(least(levenshtein(key, 'suplier 000000013'), 99) AS INTEGER) AS distance FROM (SELECT DISTINCT name, lower(replace(name, '#', ' ')) AS key FROM (SELECT name FROM cr UNION SELECT owner FROM r)) WHERE levenshtein(key, 'suplier 000000013') <= 5""")
def lib_suggestions(spark, sf_dir):
    """Names within five edits of a mistyped one, from a saved index of pieces."""
    folder = f"{shared_folder(spark)}/pieces-{uuid.uuid4().hex}"
    suggest.write(library(spark, sf_dir).catalog.artist, folder)
    return suggest.nearest(suggest.read(spark, folder), "Suplier#000000013")


@query("""SELECT 'performing' AS kind, (SELECT count(*) FROM r WHERE owner = 'none') AS releases, count(*) AS tracks, CAST(sum(ms) AS BIGINT) AS duration_ms, CAST(sum(size) AS BIGINT) AS bytes FROM (SELECT DISTINCT path, ms, size FROM cr WHERE name = 'Supplier#000000001' AND role <> 'composer')
  UNION ALL SELECT 'writing', count(DISTINCT folder), count(*), CAST(sum(ms) AS BIGINT), CAST(sum(size) AS BIGINT) FROM (SELECT DISTINCT path, folder, ms, size FROM cr WHERE name = 'Supplier#000000001' AND role = 'composer')""")
def lib_artist_totals(spark, sf_dir):
    return library(spark, sf_dir).artist_page("supplier#000000001")["totals"]


@query("""SELECT folder, count(*) AS tracks, CAST(sum(ms) AS BIGINT) AS duration_ms, CAST(sum(size) AS BIGINT) AS bytes FROM (SELECT DISTINCT path, folder, ms, size FROM cr WHERE name = 'Supplier#000000001' AND role <> 'composer') GROUP BY 1""")
def lib_artist_guest(spark, sf_dir):
    """Guest appearances count the artist's own tracks, not whole albums."""
    out = library(spark, sf_dir).artist_page("supplier#000000001")["guest"]
    return out.select(F.element_at(F.split("release_key", r"\|"), -1).alias("folder"), "tracks", "duration_ms", "bytes")


@query("SELECT DISTINCT genre AS name FROM cr WHERE name = 'Supplier#000000001'")
def lib_artist_genres(spark, sf_dir):
    return library(spark, sf_dir).artist_page("supplier#000000001")["genres"]


@query("""SELECT kind, name, detail FROM (SELECT 2 AS score, 'release' AS kind, album AS name, CASE WHEN comp THEN 'Various Artists' ELSE owner END AS detail, folder AS id FROM r WHERE contains(lower(album), 'building 1')
  UNION ALL SELECT 2, 'track', title, album, path FROM g WHERE contains(lower(title), 'building 1'))""")
def lib_search_detail(spark, sf_dir):
    return library(spark, sf_dir).search_page("building 1", ALL)["hits"].select("kind", "name", "detail")


@query("""SELECT array_to_string(list_sort(list(DISTINCT name) FILTER (role = 'main')), ' / ') AS artist, CASE WHEN NOT any_value(g.comp) THEN any_value(g.owner) END AS album_artist, any_value(g.album) AS album, CAST(any_value(r.yr) AS INTEGER) AS year, CAST(NULL AS VARCHAR) AS disc_no,
  any_value(no) AS track_no, any_value(title) AS title, any_value(g.ms) AS duration_ms, any_value(g.size) AS size_bytes, any_value(codec) AS codec, any_value(codec) AS container, CAST(any_value(rate) AS INTEGER) AS sample_rate_hz, CAST(any_value(depth) AS VARCHAR) AS bit_depth, 2 AS channels,
  CAST(any_value(kbps) AS INTEGER) AS bitrate_kbps, NOT any_value(lossy) AS lossless, coalesce(any_value(state), 'not_verified') AS integrity, CAST(NULL AS VARCHAR) AS isrc, CASE WHEN any_value(st) = 'F' THEN CAST(any_value(k) AS VARCHAR) END AS musicbrainz_recordingid, path
  FROM g JOIN r USING (folder) LEFT JOIN (SELECT path, name, role FROM cr) c USING (path) GROUP BY path""")
def lib_export_tracks(spark, sf_dir):
    rows = library(spark, sf_dir).export("tracks")
    return rows.withColumns({c: F.col(c).cast("string") for c in ("disc_no", "bit_depth")})


@query("""SELECT CASE WHEN any_value(comp) THEN 'Various Artists' ELSE any_value(owner) END AS album_artist, any_value(album) AS album, CAST(min(yr) AS INTEGER) AS year, arg_min(date, (yr, path)) AS date, count(*) AS tracks, CAST(1 AS BIGINT) AS discs, CAST(sum(ms) AS BIGINT) AS duration_ms, CAST(sum(size) AS BIGINT) AS size_bytes,
  array_to_string(list_sort(list(DISTINCT codec)), ' / ') AS formats, array_to_string(list_sort(list(DISTINCT rate)), ' / ') AS sample_rates_hz, coalesce(array_to_string(list_sort(list(DISTINCT depth) FILTER (depth IS NOT NULL)), ' / '), '') AS bit_depths, NOT bool_or(lossy) AS lossless, any_value(comp) AS compilation,
  any_value(label) AS label, CAST(NULL AS VARCHAR) AS catalog_number, CAST(NULL AS VARCHAR) AS barcode, CAST(NULL AS VARCHAR) AS media, any_value(gs) AS genres,
  CASE WHEN coalesce(bool_or(state = 'damaged'), false) THEN 'damaged' WHEN bool_or(state IS NULL) THEN 'not_verified' WHEN bool_and(state = 'nothing_to_check') THEN 'nothing_to_check' ELSE 'intact' END AS integrity, CAST(NULL AS VARCHAR) AS musicbrainz_albumid, folder
  FROM f JOIN (SELECT folder, string_agg(genre, ' / ' ORDER BY p) AS gs FROM (SELECT folder, genre, min(path) AS p FROM f GROUP BY 1, 2) GROUP BY 1) USING (folder) GROUP BY folder""")
def lib_export_albums(spark, sf_dir):
    return library(spark, sf_dir).export("albums")


@query("""SELECT '#EXTM3U' AS line UNION ALL SELECT '#EXTINF:' || (ms + 500) // 1000 || ',' || coalesce(min(name) FILTER (role = 'main') || ' - ', '') || title || chr(10) || path FROM f LEFT JOIN (SELECT path, name, role FROM cr) c USING (path) GROUP BY path, ms, title""")
def lib_playlist(spark, sf_dir):
    return export.playlist(library(spark, sf_dir).export("tracks"), ["path"])


@query("SELECT path FROM f WHERE (path IN (SELECT path FROM cr WHERE name LIKE 'Supplier#00000001%') OR (NOT comp AND owner LIKE '%Supplier#00000001%')) AND label = 'BUILDING' AND st = 'F'")
def lib_tracks_filtered(spark, sf_dir):
    return library(spark, sf_dir).tracks(artist="supplier 00000001", album="album of building", comment="ripped").select("path")


@query("SELECT name, count(DISTINCT path) AS tracks FROM cr WHERE role = 'main' AND label = 'BUILDING' GROUP BY 1")
def lib_label_artists(spark, sf_dir):
    return library(spark, sf_dir).facet_artists("label", "building")


@query("SELECT name, count(DISTINCT path) AS tracks FROM cr WHERE role = 'main' AND genre = '1-URGENT' GROUP BY 1")
def lib_genre_artists(spark, sf_dir):
    return library(spark, sf_dir).facet_artists("genre", "urgent")


@query("""SELECT a.name AS source, b.name AS target, count(DISTINCT a.path) AS weight FROM cr a JOIN cr b ON a.path = b.path AND a.name <> b.name WHERE a.role <> 'composer' AND b.role <> 'composer' GROUP BY 1, 2""")
def lib_collaborations(spark, sf_dir):
    named = lambda c: F.concat(F.lit("Supplier#"), F.element_at(F.split(c, " "), -1)).alias(c)
    return library(spark, sf_dir).catalog.collaboration.select(named("source"), named("target"), "weight")


@query("""SELECT role, role_label AS label, name, count(*) AS tracks FROM (SELECT path, name, role, CASE role WHEN 'main' THEN 'main artist' ELSE role END AS role_label FROM cr WHERE folder LIKE '%/c1') GROUP BY 1, 2, 3""")
def lib_album_credits(spark, sf_dir):
    lib = library(spark, sf_dir)
    return lib.credits(lib.catalog.file.where(F.col("folder").endswith("/c1")).select("path"))


@query("""SELECT path, 'track ' || no AS position, title, ms AS duration_ms, quality FROM g WHERE cust = 1""")
def lib_album_tracks(spark, sf_dir):
    lib = unread(spark, sf_dir)
    owned = lib.catalog.file.where(F.col("folder").endswith("/c1"))
    return owned.select("path", T.position(F.col("disc_no"), F.col("track_no")).alias("position"), "title", "duration_ms", "quality")


@query("""SELECT folder, path, CAST(row_number() OVER (PARTITION BY folder ORDER BY no, title, path) - 1 AS INTEGER) AS place FROM f""")
def lib_track_order(spark, sf_dir):
    return unread(spark, sf_dir).catalog.release.select("folder", F.posexplode("track_paths").alias("place", "path"))


@query("""SELECT name, CAST(count(*) FILTER (path IS NOT NULL) AS BIGINT) AS tracks, role FROM cr GROUP BY name, role UNION ALL SELECT owner, count(*), 'album' FROM r WHERE NOT comp GROUP BY 1""")
def lib_credits(spark, sf_dir):
    c = library(spark, sf_dir).catalog
    per = c.credit.groupBy("artist_key", "role").agg(F.count("*").alias("tracks"))
    return per.join(c.artist.select(F.col("key").alias("artist_key"), "name"), "artist_key").select("name", "tracks", "role")


@query("SELECT 'track' AS entity_kind, path AS entity, genre FROM f UNION ALL SELECT DISTINCT 'release', folder, genre FROM f")
def lib_genre_links(spark, sf_dir):
    c = unread(spark, sf_dir).catalog
    entity = F.when(F.col("entity_kind") == "track", F.col("entity_key")).otherwise(F.element_at(F.split("entity_key", r"\|"), -1))
    return c.genre_link.join(c.genre.select(F.col("key").alias("genre_key"), F.col("name").alias("genre")), "genre_key").select("entity_kind", entity.alias("entity"), "genre")


@query("""SELECT 'credit without its artist' AS what, lower(replace(name, '#', ' ')) AS key FROM (SELECT name FROM cr UNION SELECT owner FROM r WHERE NOT comp) WHERE ends_with(name, '7')
  UNION ALL SELECT 'file without its release', folder FROM r WHERE label = 'BUILDING' UNION ALL SELECT 'credit without its track', path FROM cr WHERE genre = '2-HIGH' GROUP BY path
  UNION ALL SELECT 'genre link without its genre', '5 low' FROM f WHERE genre = '5-LOW' GROUP BY 1 UNION ALL SELECT 'file twice', path FROM f WHERE cust % 10 = 0 AND genre <> '2-HIGH'""")
def lib_broken_links(spark, sf_dir):
    """A sound catalog has no row here, so this one has lost some of its rows and holds others twice."""
    c = library(spark, sf_dir).catalog
    lost = c.changed(
        artist=c.artist.where(~F.col("key").endswith("7")), release=c.release.where(~F.col("title").contains("BUILDING")), genre=c.genre.where("name <> '5-LOW'"),
        file=c.file.where("tags['genre'][0] <> '2-HIGH'").unionByName(c.file.where("tags['genre'][0] <> '2-HIGH' and folder rlike '0$'")),
    )
    key = F.when(F.col("what") == "file without its release", F.element_at(F.split("key", r"\|"), -1)).otherwise(F.col("key"))
    return catalog.broken_links(lost).select("what", key.alias("key"))


@query("""SELECT kind, path FROM (
  SELECT 'missing_artist' AS kind, CASE WHEN k % 10 = 5 THEN folder || '/x' || k || '.flac' ELSE path END AS path FROM f WHERE k % 10 = 3 OR path NOT IN (SELECT path FROM cr WHERE role = 'main') UNION ALL SELECT 'missing_album', path FROM f WHERE k % 10 IN (4, 6)
  UNION ALL SELECT 'missing_date', path FROM f WHERE k % 10 = 2 UNION ALL SELECT 'suspicious_year', path FROM f WHERE k % 10 = 1 UNION ALL SELECT 'missing_track_number', folder || '/x' || k || '.flac' FROM f WHERE k % 10 = 5
  UNION ALL SELECT 'missing_album', '/z' || path FROM f WHERE k % 10 = 6 UNION ALL SELECT 'missing_artist', '/z' || path FROM f WHERE k % 10 = 6 AND path NOT IN (SELECT path FROM cr WHERE role = 'main')
  UNION ALL SELECT 'duplicate_track', min(path) FROM f WHERE k % 10 IN (4, 6) GROUP BY k HAVING count(*) > 1 OR k % 10 = 6)""")
def lib_odd_files(spark, sf_dir):
    """The shelf with faults: by order key, years of 1850 and none, no artist, no album, no track number in tags or name, and
    tracks without album that stand again below ``/z``."""
    rows = scanned(spark, sf_dir)
    kind = F.col("mtime") % 10
    without = lambda when, *names: F.when(when, F.map_filter("tags", lambda k, _: ~k.isin(*names))).otherwise(F.col("tags"))
    for when, names in ((kind == 2, ("date",)), (kind == 3, ("artist",)), (kind.isin(4, 6), ("album",)), (kind == 5, ("tracknumber",))):
        rows = rows.withColumn("tags", without(when, *names))
    rows = rows.withColumn("tags", F.when(kind == 1, F.map_concat(without(kind == 1, "date"), F.create_map(F.lit("date"), F.array(F.lit("1850"))))).otherwise(F.col("tags")))
    rows = rows.withColumn("path", F.when(kind == 5, F.regexp_replace("path", "/([0-9]+)[.]flac$", "/x$1.flac")).otherwise(F.col("path")))
    again = rows.where(kind == 6).withColumn("path", F.concat(F.lit("/z"), F.col("path")))
    found = doctor.diagnose(catalog.build(durable(rows.unionByName(again))))
    kinds = ("missing_artist", "missing_album", "missing_date", "suspicious_year", "missing_track_number", "duplicate_track")
    return found.where(F.col("kind").isin(*kinds)).select("kind", F.array_min("files").alias("path"))


@query(f""", {PAIRS}, named AS (SELECT name, path FROM cr UNION SELECT owner, NULL FROM r), pl AS (SELECT DISTINCT name, path FROM cr WHERE role <> 'composer')
  SELECT 'artist' AS kind, name, '' AS other, count(path) AS n FROM named GROUP BY 2 UNION ALL SELECT 'album', folder, quality, tracks FROM r UNION ALL SELECT 'label', label, '', count(*) FROM r GROUP BY 2
  UNION ALL SELECT 'genre', genre, '', count(*) FROM f GROUP BY 2 UNION ALL SELECT 'together', a.name, b.name, count(*) FROM pl a JOIN pl b ON a.path = b.path AND a.name <> b.name GROUP BY 2, 3
  UNION ALL SELECT kind, a, b, 1 FROM pairs UNION ALL SELECT kind, b, a, 1 FROM pairs""")
def lib_maintained(spark, sf_dir):
    """A catalog that took in a change of some files in a hundred is that of a full build: files that were not there, that had
    other tags and stood on another album, and that are gone."""
    rows, turn = durable(scanned(spark, sf_dir)), F.col("mtime") % 97
    other = F.map_concat(F.map_filter("tags", lambda k, _: ~k.isin("artist", "genre", "label", "album")), F.create_map(*[x for k, v in (("artist", F.array(F.lit("Somebody Else"), F.col("path"))), ("album", F.array(F.lit("Another Album")))) for x in (F.lit(k), v)]))
    moved = F.concat(F.lit("/gone"), F.col("path"))
    before = rows.where(turn != 7).withColumn("tags", F.when(turn == 3, other).otherwise(F.col("tags"))).unionByName(rows.where(turn == 9).withColumn("path", moved))
    held = Maintained.create(before, f"{shared_folder(spark)}/maintained-{uuid.uuid4().hex}", 16)
    held.apply(rows.where(turn.isin(3, 7)), rows.where(turn == 9).select(moved.alias("path")))
    c = held.catalog()
    lib, last = Library(c), lambda x: F.element_at(F.split(x, r"\|"), -1)
    name = c.artist.select("key", "name")
    out = lib.artists(page=ALL).select(F.lit("artist").alias("kind"), "name", F.lit("").alias("other"), F.col("tracks").alias("n"))
    out = out.unionAll(lib.albums(page=ALL).select(F.lit("album"), last("release_key"), "quality", "tracks"))
    out = out.unionAll(lib.labels(ALL).select(F.lit("label"), "label", F.lit(""), "albums")).unionAll(lib.genres(ALL).select(F.lit("genre"), "genre", F.lit(""), "tracks"))
    ends = c.collaboration.join(name.toDF("source", "a"), "source").join(name.toDF("target", "b"), "target")
    return out.unionAll(ends.select(F.lit("together"), "a", "b", "weight")).unionAll(c.release_relation.select("kind", last("source"), last("target"), F.lit(1).cast("long")))


RECORDS = """rec AS (SELECT *, CASE nation WHEN 3 THEN replace(path, '/m/', '/old/') WHEN 4 THEN path || '.gone' ELSE path END AS place, CASE WHEN nation = 5 THEN k + 1 ELSE k END AS mtime FROM f WHERE shelf = 'm'),
out AS (SELECT *, CASE nation WHEN 3 THEN 'moved' WHEN 4 THEN 'waiting' WHEN 5 THEN 'stale' ELSE 'matched' END AS outcome FROM rec)"""


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measurements of the main shelf: some made at another place, some of files that are gone, some of files since changed."""
    rows = scanned(spark, sf_dir).where(F.col("path").startswith("/m/"))
    of = lambda n: F.col("path").startswith(f"/m/n{n}/")
    at = F.when(of(3), F.replace("path", F.lit("/m/"), F.lit("/old/"))).when(of(4), F.concat("path", F.lit(".gone"))).otherwise(F.col("path"))
    codec = F.col("properties.codec")
    return rows.select(
        at.alias("path"), "size", F.when(of(5), F.col("mtime") + 1).otherwise(F.col("mtime")).alias("mtime"), F.lit("meter").alias("source"), F.lit(1).cast("long").alias("seq"),
        F.when(codec == "alac", "mismatch").otherwise("match").alias("md5_state"), F.when(codec == "mp3", "detected").alias("transcoding"), (F.col("properties.sample_rate") == 96000).alias("upscaling"), F.lit(False).alias("upsampling"),
        F.lit(None).cast("string").alias("summary"), F.lit(None).cast("string").alias("detail"),
    )


@query(f""", {RECORDS} SELECT place AS path, outcome, CASE WHEN outcome = 'moved' THEN path ELSE place END AS "at" FROM out""")
def lib_outcomes(spark, sf_dir):
    return analyses.outcomes(records(spark, sf_dir), scanned(spark, sf_dir).where(F.col("path").startswith("/m/"))).select("path", "outcome", "at")


@query(f", {RECORDS} SELECT CASE WHEN outcome = 'moved' THEN path ELSE place END AS path, 'meter' AS source FROM out WHERE outcome <> 'stale'")
def lib_merged(spark, sf_dir):
    return unread(spark, sf_dir).imported(records(spark, sf_dir)).catalog.analysis.select("path", "source")


@query(f", {RECORDS} SELECT (SELECT count(*) FROM f WHERE state IS NULL) AS unverified, (SELECT count(*) FROM out WHERE outcome = 'waiting') AS waiting")
def lib_notices(spark, sf_dir):
    return unread(spark, sf_dir).imported(records(spark, sf_dir)).notices()


@query(f""", {RECORDS}, ok AS (SELECT * FROM out WHERE outcome IN ('matched', 'moved'))
  SELECT 'error' AS severity, 'md5_mismatch' AS kind, path FROM ok WHERE codec = 'alac' UNION ALL SELECT 'warning', 'suspect_encoding', path FROM ok WHERE codec = 'mp3' OR rate = 96000""")
def lib_suspects(spark, sf_dir):
    found = library(spark, sf_dir).imported(records(spark, sf_dir)).doctor()
    return found.where(F.col("kind").isin("md5_mismatch", "suspect_encoding")).select("severity", "kind", F.col("files")[0].alias("path"))


@query("""SELECT path, CASE WHEN shelf = 'b' THEN 'new' WHEN nation = 6 THEN 'changed' ELSE 'kept' END AS how FROM f WHERE shelf <> 'e'""")
def lib_rescan(spark, sf_dir):
    """Shelf ``e`` is gone, shelf ``b`` is new, files of nation 6 changed."""
    now = scanned(spark, sf_dir)
    before = now.where(~F.col("path").startswith("/b/")).withColumn("mtime", F.when(F.col("path").startswith("/m/n6/"), F.col("mtime") - 1).otherwise(F.col("mtime"))).withColumn("how", F.lit("kept"))
    listing = now.where(~F.col("path").startswith("/e/")).select("path", "size", "mtime")
    read = lambda df: now.join(df, ["path", "size", "mtime"], "left_semi").withColumn("how", F.when(F.col("path").startswith("/b/"), "new").otherwise("changed"))
    return incremental.rescan(before, listing, read).select("path", "how")


@query("SELECT path, CASE WHEN size < 1000 THEN size || ' B' WHEN size < 1000000 THEN (size + 50) // 100 // 10 || '.' || (size + 50) // 100 % 10 || ' kB' ELSE (size + 50000) // 100000 // 10 || '.' || (size + 50000) // 100000 % 10 || ' MB' END AS size, CASE WHEN s >= 60 THEN (s // 60) || ' min ' || (s % 60) || ' s' ELSE s || ' s' END AS duration FROM (SELECT path, size, (ms + 500) // 1000 AS s FROM f)")
def lib_shown(spark, sf_dir):
    c = unread(spark, sf_dir).catalog
    return c.file.select("path", T.format_size(F.col("size")).alias("size"), T.long_duration(F.col("duration_ms")).alias("duration"))


@query("""SELECT path, 'track ' || no AS position, quality, 'Album of ' || label || ' ' || cust AS album, CASE WHEN st <> 'P' THEN 'Song ' || k END AS tagged,
  coalesce((SELECT string_agg(role || ': ' || name, ', ' ORDER BY role, name) FROM cr WHERE cr.path = g.path), '') AS credits FROM g""")
def lib_track_records(spark, sf_dir):
    who = F.array_join(F.transform("credits", lambda c: F.concat_ws(": ", c["role"], c["name"])), ", ").alias("credits")
    return library(spark, sf_dir).track_records().select("path", "position", "quality", "album", F.try_element_at("tags", F.lit("title")).alias("tagged"), who)


@query("SELECT path, title, CASE WHEN contains(lower(title), 'o') THEN 0 ELSE 1 END AS part FROM f WHERE contains(lower(title), 'o') OR (st = 'F' AND contains(lower(label), 'o'))")
def lib_selection(spark, sf_dir):
    return unread(spark, sf_dir).selection("O")


@query("SELECT path, title, 1 AS part FROM f WHERE st = 'F' AND label = 'BUILDING'")
def lib_selection_by_comment(spark, sf_dir):
    return unread(spark, sf_dir).selection("building")


@query("SELECT coalesce(state, 'not_verified') AS state, count(*) AS files FROM f WHERE shelf = 'b' OR (shelf = 'm' AND nation = 1) GROUP BY 1")
def lib_scope(spark, sf_dir):
    """Places at the border of a name: ``/m/n1`` is not the parent of ``/m/n10``."""
    return unread(spark, sf_dir).integrity(["/b", "/m/n1/"])


@query("SELECT path, quality, urgent AND NOT lossy AS hi_res, 'track ' || no AS position, CASE WHEN rate = 96000 THEN '96 kHz' ELSE '44.1 kHz' END AS rate FROM g")
def lib_qualities(spark, sf_dir):
    p = lambda name: F.col(f"properties.{name}")
    shown = [is_hi_res(p("lossless"), p("sample_rate"), p("bit_depth")).alias("hi_res"), T.position(F.col("disc_no"), F.col("track_no")).alias("position"), T.format_rate(p("sample_rate")).alias("rate")]
    return unread(spark, sf_dir).catalog.file.select("path", "quality", *shown)


@query("SELECT path, no AS number, title FROM f")
def lib_names_of_paths(spark, sf_dir):
    """Titles and numbers read back from paths that hold them."""
    named = F.concat(T.folder(F.col("path")), F.lit("/"), F.lpad(F.col("track_no").cast("string"), 2, "0"), F.lit(" - "), F.col("title"), F.lit(".flac"))
    return unread(spark, sf_dir).catalog.file.select("path", T.number_of_path(named).alias("number"), T.title_of_path(named).alias("title"))


PLAYED = "SELECT DISTINCT folder FROM cr WHERE name = 'Supplier#000000001' AND role IN ('main', 'performer')"


@query(f"SELECT folder, album AS title, yr AS year FROM r WHERE folder IN ({PLAYED})")
def lib_guest(spark, sf_dir):
    c = library(spark, sf_dir)
    return c.artist("supplier#000000001")["guest"].join(c.catalog.release.select("release_key", "folder"), "release_key").drop("release_key")


@query(f"SELECT folder, album AS title, yr AS year FROM r WHERE folder IN (SELECT folder FROM cr WHERE name = 'Supplier#000000001' AND role = 'composer') AND folder NOT IN ({PLAYED})")
def lib_written(spark, sf_dir):
    c = library(spark, sf_dir)
    return c.artist("supplier#000000001")["written"].join(c.catalog.release.select("release_key", "folder"), "release_key").drop("release_key")


@query(f", {RECORDS} SELECT place AS path FROM out WHERE outcome = 'waiting'")
def lib_pending(spark, sf_dir):
    c = unread(spark, sf_dir).imported(records(spark, sf_dir)).catalog
    return analyses.pending(c.analysis, c.file).select("path")


@query(f", {RECORDS} SELECT 'other' AS forgotten, count(*) AS kept FROM out WHERE outcome <> 'stale' UNION ALL SELECT 'meter', 0 UNION ALL SELECT 'all', 0")
def lib_forgotten(spark, sf_dir):
    c = unread(spark, sf_dir).imported(records(spark, sf_dir))
    kept = lambda name, source: c.forget(source).catalog.analysis.agg(F.lit(name).alias("forgotten"), F.count("*").alias("kept"))
    return kept("other", "other").unionAll(kept("meter", "meter")).unionAll(kept("all", None))


@query("SELECT DISTINCT folder AS place FROM f WHERE NOT (shelf = 'm' AND nation = 1) AND shelf <> 'b' UNION ALL SELECT '/m/n1' UNION ALL SELECT '/b'")
def lib_places(spark, sf_dir):
    folders = scanned(spark, sf_dir).select(T.folder(F.col("path")).alias("place"))
    return top_places(folders.unionByName(spark.createDataFrame([("/m/n1/",), ("/b",), ("/b/n1",)], "place string")))


@query("SELECT '/m' AS place UNION ALL SELECT DISTINCT folder FROM f WHERE shelf <> 'm'")
def lib_watched(spark, sf_dir):
    return watched(scanned(spark, sf_dir).select(T.folder(F.col("path")).alias("place")), spark.createDataFrame([("/m",)], "place string"))


@query(f""", {RECORDS} SELECT CASE WHEN outcome = 'moved' THEN path ELSE place END AS path, outcome FROM out""")
def lib_waiting(spark, sf_dir):
    """Records and files as streams: records come first and wait, files come later; the last word on each is that of
    ``analyses.reconcile``."""
    at = f"{shared_folder(spark)}/waiting-{uuid.uuid4().hex}"
    files = scanned(spark, sf_dir).where(F.col("path").startswith("/m/")).select("path", "size", "mtime")
    for number, events in enumerate((waiting.events(records=records(spark, sf_dir).withColumn("payload", F.lit("read"))), waiting.events(files=files))):
        events.write.parquet(f"{at}/in/{number}")
        stream = spark.readStream.schema(waiting.EVENT).option("recursiveFileLookup", True).parquet(f"{at}/in")
        waiting.keep_places(stream, f"{at}/log", f"{at}/state").awaitTermination()
    return waiting.settled(spark.read.schema(waiting.PLACED).parquet(f"{at}/log")).select("path", "outcome")


@query("""SELECT coalesce(CASE WHEN state IS NOT NULL THEN state WHEN k % 10 <> 7 THEN CASE WHEN ms = 0 THEN 'damaged' ELSE 'intact' END END, 'not_verified') AS state, count(*) AS files FROM f GROUP BY 1""")
def lib_checked(spark, sf_dir):
    """A check in batches of all files without a verdict; a file in ten can't be read and stays without one."""
    at, files = f"{shared_folder(spark)}/check-{uuid.uuid4().hex}", unread(spark, sf_dir).catalog.file

    def verify(batch: DataFrame) -> DataFrame:
        lost = F.col("mtime") % 10 == 7
        state = F.when(F.col("size") % 600000 == 0, "damaged").otherwise("intact")
        return batch.select("path", "size", "mtime", F.when(~lost, state).alias("state"), F.lit("length").alias("method"), F.lit(None).cast("string").alias("detail"), F.lit(0).cast("long").alias("checked_at"), F.when(lost, "not readable").alias("error"))

    check.enqueue(files.select("path", "size", "mtime", "integrity"), at, batch=2000)
    check.run(spark, at, verify, 4).awaitTermination()
    state = F.coalesce("integrity.state", F.lit("not_verified")).alias("state")
    return check.applied(files, check.verdicts(spark, at)).groupBy(state).agg(F.count("*").alias("files"))
