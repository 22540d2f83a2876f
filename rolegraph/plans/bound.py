"""The catalog's questions on a star schema: suppliers hold roles in orders, customers own them, lines are their files.

artist: supplier; track: order; release: the order's customer; credit: (supplier, order, role) with the role of the line's
return flag; file: line; genre: part type; label: market segment.  Each query stands beside its SQL.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rolegraph.functions import text as T
from rolegraph.functions.quality import quality_tier
from rolegraph.operators import graph, lookups, measures, sequences

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str):
    def keep(f):
        QUERIES[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def credits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(artist_id, track_id, role), each once."""
    role = F.when(F.col("l_returnflag") == "N", "main").when(F.col("l_returnflag") == "A", "performer").otherwise("composer")
    return table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("artist_id"), F.col("l_orderkey").alias("track_id"), role.alias("role")).distinct()


CREDITS = """credits AS (SELECT DISTINCT l_suppkey AS artist_id, l_orderkey AS track_id,
  CASE l_returnflag WHEN 'N' THEN 'main' WHEN 'A' THEN 'performer' ELSE 'composer' END AS role FROM lineitem)"""
#: Conditions on a credit, as text: columns can't be made before a session is there.
PLAYS = "role in ({})".format(", ".join(f"'{r}'" for r in graph.PERFORMING))
WRITES = f"not ({PLAYS})"


def tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("track_id"), F.col("o_custkey").alias("release_id"), F.year("o_orderdate").alias("year"))


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as files: whole cents as bytes, quantity as milliseconds."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("track_id"), F.col("l_linenumber").alias("line"), F.col("l_suppkey").alias("artist_id"), F.col("l_partkey").alias("part_id"),
        F.col("l_returnflag").alias("codec"), F.col("l_linestatus").alias("rate"), F.round(F.col("l_extendedprice") * 100).cast("long").alias("size"), F.col("l_quantity").cast("long").alias("duration_ms"),
    )


FILES = """files AS (SELECT l_orderkey AS track_id, l_linenumber AS line, l_suppkey AS artist_id, l_partkey AS part_id, l_returnflag AS codec,
  l_linestatus AS rate, CAST(round(l_extendedprice * 100) AS BIGINT) AS size, CAST(l_quantity AS BIGINT) AS duration_ms FROM lineitem)"""
PAIRS = f"""{CREDITS}, players AS (SELECT DISTINCT artist_id, track_id FROM credits WHERE role IN ('main', 'performer')),
once AS (SELECT a.artist_id AS source, b.artist_id AS target, count(*) AS weight FROM players a JOIN players b ON a.track_id = b.track_id AND a.artist_id < b.artist_id GROUP BY 1, 2),
pairs AS (SELECT * FROM once UNION ALL SELECT target, source, weight FROM once)"""


def pairs_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.cooccurrence(credits(spark, sf_dir).where(PLAYS), "track_id", "artist_id")


@query(f"WITH {PAIRS} SELECT * FROM pairs")
def collaboration_pairs(spark, sf_dir):
    return pairs_of(spark, sf_dir)


@query(f"WITH {PAIRS} SELECT target, s_name AS name, weight FROM pairs JOIN supplier ON s_suppkey = target WHERE source = 1 ORDER BY weight DESC, name, target LIMIT 20")
def neighbours_top(spark, sf_dir):
    return graph.neighbours(pairs_of(spark, sf_dir), table(spark, sf_dir, "supplier"), "s_suppkey", "s_name", 1).limit(20)


@query(f"WITH {CREDITS} SELECT track_id FROM credits WHERE artist_id = 1 AND role <> 'composer' INTERSECT SELECT track_id FROM credits WHERE artist_id = 2 AND role <> 'composer'")
def tracks_in_common(spark, sf_dir):
    return graph.common_groups(credits(spark, sf_dir).where(PLAYS), "track_id", "artist_id", 1, 2)


@query(f"WITH {CREDITS} SELECT artist_id, s_name AS name, count(*) AS credits FROM credits JOIN supplier ON s_suppkey = artist_id WHERE role = 'composer' GROUP BY 1, 2")
def artists_in_role(spark, sf_dir):
    counts = graph.role_counts(credits(spark, sf_dir).where("role = 'composer'"), ["artist_id"])
    return counts.join(table(spark, sf_dir, "supplier"), F.col("artist_id") == F.col("s_suppkey")).select("artist_id", F.col("s_name").alias("name"), "credits").orderBy(F.desc("credits"), "name", "artist_id")


@query(f"WITH {CREDITS} SELECT artist_id, role, count(*) AS credits FROM credits GROUP BY 1, 2")
def roles_of_artist(spark, sf_dir):
    return graph.role_counts(credits(spark, sf_dir), ["artist_id", "role"])


@query(f"WITH {CREDITS} SELECT role, count(*) AS credits, count(DISTINCT artist_id) AS artists FROM credits GROUP BY 1")
def role_vocabulary(spark, sf_dir):
    return graph.role_counts(credits(spark, sf_dir), ["role"], artists="artist_id").orderBy(F.desc("credits"), "role")


def _top(spark, sf_dir, which):
    return credits(spark, sf_dir).where(which).groupBy("artist_id").agg(F.countDistinct("track_id").alias("tracks")).orderBy(F.desc("tracks"), "artist_id").limit(10)


@query(f"WITH {CREDITS} SELECT artist_id, count(DISTINCT track_id) AS tracks FROM credits WHERE role IN ('main', 'performer') GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
def top_performers(spark, sf_dir):
    return _top(spark, sf_dir, PLAYS)


@query(f"WITH {CREDITS} SELECT artist_id, count(DISTINCT track_id) AS tracks FROM credits WHERE role = 'composer' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
def top_writers(spark, sf_dir):
    return _top(spark, sf_dir, WRITES)


@query("SELECT p_type AS genre, count(DISTINCT l_orderkey) AS tracks FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
def top_genres(spark, sf_dir):
    joined = files(spark, sf_dir).join(table(spark, sf_dir, "part").select("p_partkey", F.col("p_type").alias("genre")), F.col("part_id") == F.col("p_partkey"))
    return joined.groupBy("genre").agg(F.countDistinct("track_id").alias("tracks")).orderBy(F.desc("tracks"), "genre").limit(10)


@query("SELECT c_mktsegment AS label, count(*) AS releases FROM customer GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
def top_labels(spark, sf_dir):
    return table(spark, sf_dir, "customer").groupBy(F.col("c_mktsegment").alias("label")).agg(F.count("*").alias("releases")).orderBy(F.desc("releases"), "label").limit(10)


OWNED = "owned AS (SELECT DISTINCT o_custkey AS release_id, o_custkey % (SELECT count(*) FROM supplier) AS artist_id FROM orders)"


def owned(spark, sf_dir):
    suppliers = table(spark, sf_dir, "supplier").agg(F.count("*").alias("n"))
    return tracks(spark, sf_dir).select("release_id").distinct().join(F.broadcast(suppliers)).select("release_id", F.pmod("release_id", "n").alias("artist_id"))


def appearances(spark, sf_dir):
    return credits(spark, sf_dir).join(tracks(spark, sf_dir), "track_id").select("artist_id", "release_id", "role").distinct()


SEEN = f"{CREDITS}, seen AS (SELECT DISTINCT artist_id, o_custkey AS release_id, role FROM credits JOIN orders ON o_orderkey = track_id), {OWNED}"


@query(f"WITH {OWNED} SELECT artist_id, count(*) AS releases FROM owned GROUP BY 1")
def discography(spark, sf_dir):
    return owned(spark, sf_dir).groupBy("artist_id").agg(F.count("*").alias("releases"))


@query(f"WITH {SEEN} SELECT DISTINCT artist_id, release_id FROM seen WHERE role <> 'composer' AND NOT EXISTS (SELECT 1 FROM owned WHERE owned.artist_id = seen.artist_id AND owned.release_id = seen.release_id)")
def guest_appearances(spark, sf_dir):
    return graph.without(appearances(spark, sf_dir).where(PLAYS), owned(spark, sf_dir), ["artist_id", "release_id"])


@query(f"""WITH {SEEN} SELECT DISTINCT artist_id, release_id FROM seen s WHERE role = 'composer'
  AND NOT EXISTS (SELECT 1 FROM owned WHERE owned.artist_id = s.artist_id AND owned.release_id = s.release_id)
  AND NOT EXISTS (SELECT 1 FROM seen t WHERE t.artist_id = s.artist_id AND t.release_id = s.release_id AND t.role <> 'composer')""")
def releases_written_not_performed(spark, sf_dir):
    seen, pair = appearances(spark, sf_dir), ["artist_id", "release_id"]
    return graph.without(seen.where(WRITES), seen.where(PLAYS).select(*pair).unionByName(owned(spark, sf_dir).select(*pair)), pair)


@query(f"WITH {CREDITS} SELECT artist_id, track_id FROM credits WHERE role = 'composer' EXCEPT SELECT artist_id, track_id FROM credits WHERE role <> 'composer'")
def tracks_written_not_performed(spark, sf_dir):
    c = credits(spark, sf_dir)
    return graph.without(c.where(WRITES), c.where(PLAYS), ["artist_id", "track_id"])


@query(f"WITH {SEEN} SELECT artist_id, release_id, role FROM seen")
def artist_appearances(spark, sf_dir):
    return appearances(spark, sf_dir)


@query(f"""WITH {FILES}, per AS (SELECT o_custkey, count(DISTINCT track_id) AS tracks, CAST(sum(duration_ms) AS BIGINT) AS duration_ms, CAST(sum(size) AS BIGINT) AS bytes
  FROM files JOIN orders ON o_orderkey = track_id GROUP BY 1)
  SELECT c_custkey AS release_id, c_name AS title, coalesce(s_name, 'Various Artists') AS artist, coalesce(tracks, 0) AS tracks, duration_ms, bytes
  FROM customer LEFT JOIN supplier ON s_suppkey = c_nationkey LEFT JOIN per ON o_custkey = c_custkey""")
def release_summary(spark, sf_dir):
    per = files(spark, sf_dir).join(tracks(spark, sf_dir), "track_id").groupBy("release_id").agg(F.countDistinct("track_id").alias("tracks"), F.sum("duration_ms").alias("duration_ms"), F.sum("size").alias("bytes"))
    c, s = table(spark, sf_dir, "customer"), table(spark, sf_dir, "supplier")
    joined = c.join(s, F.col("c_nationkey") == F.col("s_suppkey"), "left").join(per, F.col("c_custkey") == F.col("release_id"), "left")
    return joined.select(F.col("c_custkey").alias("release_id"), F.col("c_name").alias("title"), F.coalesce("s_name", F.lit("Various Artists")).alias("artist"), F.coalesce("tracks", F.lit(0)).alias("tracks"), "duration_ms", "bytes")


@query("SELECT l.doc_id, d.n_chars, l.quality, l.toxic FROM labels l JOIN documents d ON d.doc_id = l.doc_id AND d.n_chars > 500")
def fresh_analysis(spark, sf_dir):
    return table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").where("n_chars > 500").select("doc_id", "n_chars"), "doc_id").select("doc_id", "n_chars", "quality", "toxic")


@query("SELECT count(*) AS pending FROM labels l WHERE NOT EXISTS (SELECT 1 FROM documents d WHERE d.doc_id = l.doc_id AND d.n_chars > 500)")
def pending_analysis(spark, sf_dir):
    return table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").where("n_chars > 500"), "doc_id", "left_anti").agg(F.count("*").alias("pending"))


@query(f"""WITH {FILES}, {CREDITS} SELECT (SELECT count(*) FROM files) AS files, (SELECT count(*) FROM orders) AS tracks, (SELECT count(*) FROM customer) AS releases,
  (SELECT count(*) FROM supplier) AS artists, (SELECT count(DISTINCT artist_id) FROM credits WHERE role = 'main') AS main_artists, (SELECT count(DISTINCT p_type) FROM part) AS genres,
  (SELECT count(DISTINCT c_mktsegment) FROM customer) AS labels, (SELECT CAST(sum(size) AS BIGINT) FROM files) AS bytes, (SELECT CAST(sum(duration_ms) AS BIGINT) FROM files) AS duration_ms""")
def library_counts(spark, sf_dir):
    n = lambda name, alias: table(spark, sf_dir, name).agg(F.count("*").alias(alias))
    return measures.one_row(
        files(spark, sf_dir).agg(F.count("*").alias("files"), F.sum("size").alias("bytes"), F.sum("duration_ms").alias("duration_ms")), n("orders", "tracks"), n("customer", "releases"), n("supplier", "artists"),
        credits(spark, sf_dir).where("role = 'main'").agg(F.countDistinct("artist_id").alias("main_artists")), table(spark, sf_dir, "part").agg(F.countDistinct("p_type").alias("genres")),
        table(spark, sf_dir, "customer").agg(F.countDistinct("c_mktsegment").alias("labels")),
    )


@query("""SELECT coalesce(CAST((SELECT count(DISTINCT o_custkey) FROM orders) AS DOUBLE) / nullif((SELECT count(*) FROM customer), 0), 0.0) AS with_tracks,
  coalesce(CAST((SELECT count(DISTINCT l_orderkey) FROM lineitem WHERE l_returnflag = 'R') AS DOUBLE) / nullif((SELECT count(*) FROM orders), 0), 0.0) AS with_writer""")
def completeness(spark, sf_dir):
    one = measures.one_row(
        table(spark, sf_dir, "orders").agg(F.count("*").alias("t"), F.countDistinct("o_custkey").alias("r")), table(spark, sf_dir, "customer").agg(F.count("*").alias("c")),
        table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").agg(F.countDistinct("l_orderkey").alias("w")),
    )
    return one.select(measures.ratio(F.col("r"), F.col("c")).alias("with_tracks"), measures.ratio(F.col("w"), F.col("t")).alias("with_writer"))


@query(f"WITH {FILES} SELECT upper(codec) AS label, count(*) AS count, CAST(sum(size) AS BIGINT) AS bytes FROM files GROUP BY 1")
def codec_buckets(spark, sf_dir):
    return measures.buckets(files(spark, sf_dir), F.upper("codec"), "size")


@query(f"""WITH {FILES} SELECT CASE WHEN codec = 'N' THEN CASE WHEN rate = 'O' THEN 'hi-res' ELSE 'lossless' END WHEN duration_ms >= 26 THEN 'high' ELSE 'low' END AS label,
  count(*) AS count, CAST(sum(size) AS BIGINT) AS bytes FROM files GROUP BY 1""")
def quality_buckets(spark, sf_dir):
    f = files(spark, sf_dir)
    tier = quality_tier(F.col("codec"), F.col("codec") == "N", F.lit(16), F.when(F.col("rate") == "O", 96000).otherwise(44100), F.col("duration_ms") * 10)
    return measures.buckets(f, tier, "size")


@query(f"WITH {FILES} SELECT rate AS label, count(*) AS count, CAST(sum(size) AS BIGINT) AS bytes FROM files WHERE rate IS NOT NULL GROUP BY 1")
def rate_buckets(spark, sf_dir):
    return measures.buckets(files(spark, sf_dir).where("rate is not null"), F.col("rate"), "size").orderBy("label")


@query("SELECT CAST(year(o_orderdate) // 10 * 10 AS VARCHAR) AS label, count(*) AS count, CAST(0 AS BIGINT) AS bytes FROM orders GROUP BY 1")
def decades(spark, sf_dir):
    return measures.buckets(tracks(spark, sf_dir), measures.decade(F.col("year"))).orderBy("label")


@query(f"""WITH {CREDITS}, {FILES}, t AS (SELECT artist_id, count(DISTINCT track_id) AS tracks, count(DISTINCT o_custkey) AS releases FROM credits JOIN orders ON o_orderkey = track_id GROUP BY 1),
  m AS (SELECT artist_id, CAST(sum(duration_ms) AS BIGINT) AS duration_ms, CAST(sum(size) AS BIGINT) AS bytes FROM files GROUP BY 1)
  SELECT s_suppkey AS artist_id, s_name AS name, coalesce(tracks, 0) AS tracks, coalesce(releases, 0) AS releases, coalesce(duration_ms, 0) AS duration_ms, coalesce(bytes, 0) AS bytes
  FROM supplier LEFT JOIN t ON t.artist_id = s_suppkey LEFT JOIN m ON m.artist_id = s_suppkey""")
def artists_listing(spark, sf_dir):
    t = credits(spark, sf_dir).join(tracks(spark, sf_dir), "track_id").groupBy("artist_id").agg(F.countDistinct("track_id").alias("tracks"), F.countDistinct("release_id").alias("releases"))
    m = files(spark, sf_dir).groupBy("artist_id").agg(F.sum("duration_ms").alias("duration_ms"), F.sum("size").alias("bytes"))
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("artist_id"), F.col("s_name").alias("name"))
    return s.join(t, "artist_id", "left").join(m, "artist_id", "left").na.fill(0, ["tracks", "releases", "duration_ms", "bytes"]).orderBy(F.desc("tracks"), "name", "artist_id")


@query(f"""WITH {FILES} SELECT o_custkey AS release_id, min(year(o_orderdate)) AS year, count(DISTINCT track_id) AS tracks, CAST(sum(duration_ms) AS BIGINT) AS duration_ms, CAST(sum(size) AS BIGINT) AS bytes,
  array_to_string(list_sort(list(DISTINCT codec || '/' || rate)), ' ') AS qualities FROM files JOIN orders ON o_orderkey = track_id GROUP BY 1""")
def albums_listing(spark, sf_dir):
    joined = files(spark, sf_dir).join(tracks(spark, sf_dir), "track_id")
    qualities = F.array_join(F.sort_array(F.collect_set(F.concat_ws("/", "codec", "rate"))), " ")
    return joined.groupBy("release_id").agg(F.min("year").alias("year"), F.countDistinct("track_id").alias("tracks"), F.sum("duration_ms").alias("duration_ms"), F.sum("size").alias("bytes"), qualities.alias("qualities"))


@query(f"WITH {FILES} SELECT p_type AS genre, count(DISTINCT track_id) AS tracks, count(DISTINCT o_custkey) AS releases, CAST(sum(size) AS BIGINT) AS bytes FROM files JOIN part ON p_partkey = part_id JOIN orders ON o_orderkey = track_id GROUP BY 1")
def genres_listing(spark, sf_dir):
    joined = files(spark, sf_dir).join(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("part_id"), F.col("p_type").alias("genre")), "part_id").join(tracks(spark, sf_dir), "track_id")
    return joined.groupBy("genre").agg(F.countDistinct("track_id").alias("tracks"), F.countDistinct("release_id").alias("releases"), F.sum("size").alias("bytes")).orderBy(F.desc("tracks"), "genre")


@query("SELECT c_mktsegment AS label, count(DISTINCT c_custkey) AS releases, count(o_orderkey) AS tracks FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1")
def labels_listing(spark, sf_dir):
    per = tracks(spark, sf_dir).groupBy("release_id").agg(F.count("*").alias("n"))
    return table(spark, sf_dir, "customer").join(per, F.col("c_custkey") == F.col("release_id"), "left").groupBy(F.col("c_mktsegment").alias("label")).agg(F.count("*").alias("releases"), F.coalesce(F.sum("n"), F.lit(0)).alias("tracks")).orderBy(F.desc("releases"), "label")


@query("SELECT year(o_orderdate) AS year, count(DISTINCT o_custkey) AS albums, count(*) AS tracks FROM orders GROUP BY 1")
def years_listing(spark, sf_dir):
    return tracks(spark, sf_dir).where("year is not null").groupBy("year").agg(F.countDistinct("release_id").alias("albums"), F.count("*").alias("tracks")).orderBy("year")


@query(f"""WITH {CREDITS}, picked AS (SELECT DISTINCT l_orderkey AS track_id FROM lineitem JOIN part ON p_partkey = l_partkey WHERE p_type = (SELECT min(p_type) FROM part))
  SELECT artist_id, count(DISTINCT track_id) AS tracks FROM credits JOIN picked USING (track_id) WHERE role <> 'composer' GROUP BY 1""")
def facet_page(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    first = part.join(F.broadcast(part.agg(F.min("p_type").alias("p_type"))), "p_type").select(F.col("p_partkey").alias("part_id"))
    picked = files(spark, sf_dir).join(first, "part_id", "left_semi").select("track_id").distinct()
    return credits(spark, sf_dir).where(PLAYS).join(picked, "track_id", "left_semi").groupBy("artist_id").agg(F.countDistinct("track_id").alias("tracks")).orderBy(F.desc("tracks"), "artist_id")


@query("""SELECT c_custkey AS release_id, c_name AS title FROM customer WHERE c_mktsegment = 'BUILDING' AND EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND year(o_orderdate) = 1995)
  AND EXISTS (SELECT 1 FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey WHERE o_custkey = c_custkey AND p_type = (SELECT min(p_type) FROM part))""")
def albums_filtered(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    genre = part.join(F.broadcast(part.agg(F.min("p_type").alias("p_type"))), "p_type").select(F.col("p_partkey").alias("part_id"))
    with_genre = files(spark, sf_dir).join(genre, "part_id", "left_semi").join(tracks(spark, sf_dir), "track_id").select(F.col("release_id").alias("c_custkey"))
    in_year = tracks(spark, sf_dir).where("year = 1995").select(F.col("release_id").alias("c_custkey"))
    return table(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'").join(in_year, "c_custkey", "left_semi").join(with_genre, "c_custkey", "left_semi").select(F.col("c_custkey").alias("release_id"), F.col("c_name").alias("title"))


def _norm_sql(x: str) -> str:
    """The matching key in SQL."""
    folded = f"translate(lower(trim({x})), '{T.FROM}', '{T.TO}')"
    for a, b in T.DOUBLE_FOLDS.items():
        folded = f"replace({folded}, '{a}', '{b}')"
    plain = f"trim(regexp_replace({folded}, '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))"
    names = "|".join(T.ARTICLES)
    return f"CASE WHEN regexp_matches({plain}, '^.+ ({names})$') THEN regexp_replace({plain}, '^(.+) ({names})$', '\\1') ELSE regexp_replace({plain}, '^({names}) (.+)$', '\\2') END"


@query(f"SELECT doc_id, {_norm_sql('text')} AS key FROM documents")
def normalize_text(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.normalize(F.col("text")).alias("key"))


_SEARCH = " UNION ALL ".join(
    f"SELECT {r} AS r, '{kind}' AS kind, CAST({key} AS BIGINT) AS id, {name} AS name, {_norm_sql(name)} AS k FROM {t}"
    for r, (kind, t, key, name) in enumerate([("artist", "supplier", "s_suppkey", "s_name"), ("release", "customer", "c_custkey", "c_name"), ("track", "part", "p_partkey", "p_name"), ("label", "nation", "n_nationkey", "n_name")])
)


@query(f"""WITH s AS (SELECT *, CASE WHEN k = 'an' THEN 0 WHEN starts_with(k, 'an') THEN 1 WHEN contains(k, 'an') THEN 2 END AS score FROM ({_SEARCH}))
  SELECT kind, id, name, CAST(score AS INTEGER) AS score FROM s WHERE score IS NOT NULL ORDER BY score, r, strlen(name), name, id LIMIT 30""")
def search_ranked(spark, sf_dir):
    t = lambda name: table(spark, sf_dir, name)
    return lookups.ranked_search([("artist", t("supplier"), "s_suppkey", "s_name"), ("release", t("customer"), "c_custkey", "c_name"), ("track", t("part"), "p_partkey", "p_name"), ("label", t("nation"), "n_nationkey", "n_name")], "An", 30)


@query(f"""WITH k AS (SELECT p_partkey, p_name, {_norm_sql('p_name')} AS key FROM part), n AS (SELECT min(split_part(p_name, ' ', 1)) AS needle FROM part),
  h AS (SELECT *, CASE WHEN key = needle THEN 'exact' ELSE 'partial' END AS match FROM k, n WHERE contains(key, needle))
  SELECT p_partkey, p_name, key, match FROM h WHERE match = 'exact' OR NOT EXISTS (SELECT 1 FROM h WHERE match = 'exact')""")
def exact_or_partial(spark, sf_dir):
    part = table(spark, sf_dir, "part").select("p_partkey", "p_name", T.normalize(F.col("p_name")).alias("key"))
    needle = part.agg(F.min(F.split("p_name", " ")[0])).first()[0]
    return lookups.exact_or_partial(part, "key", needle)


@query(f"SELECT doc_id, source FROM documents WHERE contains({_norm_sql('text')}, 'license')")
def comment_search(spark, sf_dir):
    return table(spark, sf_dir, "documents").where(T.normalize(F.col("text")).contains("license")).select("doc_id", "source")


_GAPS = """g AS (SELECT l_orderkey AS track_id, list_sort(list(DISTINCT l_linenumber)) AS present, max(l_linenumber) AS most FROM lineitem GROUP BY 1),
  m AS (SELECT track_id, present, list_filter(range(1, most + 1), lambda x: NOT list_contains(present, x)) AS missing FROM g)"""


@query(f"WITH {_GAPS} SELECT track_id, array_to_string(present, ',') AS present, array_to_string(missing, ',') AS missing FROM m WHERE len(missing) > 0")
def sequence_gaps(spark, sf_dir):
    gaps = sequences.sequence_gaps(files(spark, sf_dir), ["track_id"], "line")
    return gaps.select("track_id", *[F.array_join(F.col(c).cast("array<string>"), ",").alias(c) for c in ("present", "missing")])


_CLUSTERS = f"""k AS (SELECT p_partkey, p_name, {_norm_sql('p_name')} AS key, p_retailprice, CAST(round(p_retailprice * 100) AS BIGINT) AS size FROM part),
  f AS (SELECT *, coalesce(CASE WHEN p_retailprice - lag(p_retailprice) OVER w > 3 THEN 1 ELSE 0 END, 0) AS far FROM k WINDOW w AS (PARTITION BY key ORDER BY p_retailprice, p_partkey)),
  c AS (SELECT *, CAST(sum(far) OVER (PARTITION BY key ORDER BY p_retailprice, p_partkey ROWS UNBOUNDED PRECEDING) AS BIGINT) AS cluster FROM f)"""


def _keyed_parts(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", T.normalize(F.col("p_name")).alias("key"), "p_retailprice", F.round(F.col("p_retailprice") * 100).cast("long").alias("size"))


@query(f"WITH {_CLUSTERS} SELECT p_partkey, key, cluster FROM c")
def tolerance_clusters(spark, sf_dir):
    return sequences.tolerance_clusters(_keyed_parts(spark, sf_dir), ["key"], "p_retailprice", "p_partkey", 3).select("p_partkey", "key", "cluster")


@query(f"WITH {_CLUSTERS} SELECT key, cluster, count(*) AS members, CAST(sum(size) - arg_min(size, (p_retailprice, p_partkey)) AS BIGINT) AS wasted FROM c GROUP BY 1, 2 HAVING count(*) > 1")
def wasted_bytes(spark, sf_dir):
    return sequences.clusters_of_two(_keyed_parts(spark, sf_dir), ["key"], "p_retailprice", "p_partkey", 3, "size")


@query(f"WITH {FILES} SELECT track_id, count(DISTINCT codec) AS codecs, count(DISTINCT rate) AS rates, array_to_string(list_sort(list(DISTINCT codec)), ', ') AS which FROM files GROUP BY 1 HAVING count(DISTINCT codec) > 1 OR count(DISTINCT rate) > 1")
def mixed_quality(spark, sf_dir):
    g = files(spark, sf_dir).groupBy("track_id").agg(F.countDistinct("codec").alias("codecs"), F.countDistinct("rate").alias("rates"), F.array_join(F.sort_array(F.collect_set("codec")), ", ").alias("which"))
    return g.where("codecs > 1 or rates > 1")


@query(f"""WITH {FILES}, p AS (SELECT o_custkey AS release_id, track_id, array_to_string(list_sort(list(DISTINCT codec)), ',') AS print FROM files JOIN orders ON o_orderkey = track_id GROUP BY 1, 2)
  SELECT a.release_id, a.track_id AS source, b.track_id AS target, CASE WHEN a.print = b.print THEN 'duplicate' ELSE 'other_edition' END AS kind
  FROM p a JOIN p b ON a.release_id = b.release_id AND a.track_id < b.track_id""")
def duplicate_groups(spark, sf_dir):
    prints = files(spark, sf_dir).join(tracks(spark, sf_dir), "track_id").groupBy("release_id", "track_id").agg(F.array_join(F.sort_array(F.collect_set("codec")), ",").alias("print"))
    a, b = prints.select("release_id", F.col("track_id").alias("source"), F.col("print").alias("pa")), prints.select("release_id", F.col("track_id").alias("target"), F.col("print").alias("pb"))
    return a.join(b, "release_id").where("source < target").select("release_id", "source", "target", F.when(F.col("pa") == F.col("pb"), "duplicate").otherwise("other_edition").alias("kind"))


@query("SELECT o_custkey AS release_id, arg_min(o_orderpriority, (o_orderdate, o_orderkey)) AS o_orderpriority, arg_min(o_orderstatus, (o_orderdate, o_orderkey)) AS o_orderstatus FROM orders GROUP BY 1")
def first_wins(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "release_id")
    return sequences.first_wins(orders, ["release_id"], ["o_orderpriority", "o_orderstatus"], F.struct("o_orderdate", "o_orderkey"))


@query("SELECT o_custkey AS release_id, min(year(o_orderdate)) AS year, arg_min(CAST(o_orderkey AS VARCHAR), (year(o_orderdate), o_orderkey)) AS raw FROM orders GROUP BY 1")
def release_year(spark, sf_dir):
    t = tracks(spark, sf_dir)
    return t.groupBy("release_id").agg(F.min("year").alias("year"), F.min_by(F.col("track_id").cast("string"), F.struct("year", "track_id")).alias("raw"))


@query("SELECT o_custkey AS release_id, o_orderkey AS track_id, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS INTEGER) AS place FROM orders")
def track_order(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("release_id"), F.col("o_orderkey").alias("track_id"), "o_orderdate")
    return sequences.numbered_in(orders, ["release_id"], [F.col("o_orderdate"), F.col("track_id")], "place").drop("o_orderdate")


@query("SELECT p_name, row_number() OVER (ORDER BY min(p_partkey)) - 1 AS id FROM part GROUP BY 1")
def dense_ids(spark, sf_dir):
    return sequences.dense_ids(table(spark, sf_dir, "part"), "p_name", ["p_partkey"])


@query("SELECT user_id, event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1")
def upsert_latest(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("user_id", "event_type", "ts", "event_id", "value")
    return sequences.latest_by(events, ["user_id", "event_type"], ["ts", "event_id"]).drop("ts")


@query("""WITH before AS (SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN n_chars + 1 ELSE n_chars END AS n_chars FROM documents WHERE doc_id % 5 <> 0 UNION ALL SELECT -doc_id - 1, n_chars FROM documents WHERE doc_id % 11 = 0)
  SELECT d.doc_id, CASE WHEN b.n_chars = d.n_chars THEN 'reused' WHEN b.doc_id IS NULL THEN 'new' ELSE 'changed' END AS state FROM documents d LEFT JOIN before b USING (doc_id)
  UNION ALL SELECT doc_id, 'removed' FROM before WHERE doc_id < 0""")
def incremental_diff(spark, sf_dir):
    from rolegraph.plans.incremental import diff

    now = table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    before = now.where("doc_id % 5 <> 0").withColumn("n_chars", F.when(F.col("doc_id") % 7 == 0, F.col("n_chars") + 1).otherwise(F.col("n_chars")))
    before = before.unionByName(now.where("doc_id % 11 = 0").withColumn("doc_id", -F.col("doc_id") - 1))
    return diff(before, now, ["doc_id"], ["n_chars"])


@query("""SELECT l.doc_id, CASE WHEN d.doc_id IS NULL THEN 'waiting' WHEN d.n_chars % 3 = 0 THEN 'stale' ELSE 'matched' END AS outcome FROM labels l LEFT JOIN (SELECT * FROM documents WHERE doc_id % 4 <> 0) d USING (doc_id)""")
def merge_outcomes(spark, sf_dir):
    known = table(spark, sf_dir, "documents").where("doc_id % 4 <> 0").select("doc_id", (F.col("n_chars") % 3 == 0).alias("old"))
    joined = table(spark, sf_dir, "labels").join(known, "doc_id", "left")
    return joined.select("doc_id", F.when(F.col("old").isNull(), "waiting").when(F.col("old"), "stale").otherwise("matched").alias("outcome"))


@query("""WITH s AS (SELECT l_orderkey AS track_id, CASE l_returnflag WHEN 'A' THEN 'nothing_to_check' WHEN 'N' THEN 'intact' ELSE CASE WHEN l_linenumber > 5 THEN 'damaged' END END AS state FROM lineitem)
  SELECT track_id, CASE WHEN bool_or(coalesce(state, '') = 'damaged') THEN 'damaged' WHEN bool_or(state IS NULL) THEN 'not_verified' WHEN bool_and(state = 'nothing_to_check') THEN 'nothing_to_check' ELSE 'intact' END AS worst FROM s GROUP BY 1""")
def worst_of(spark, sf_dir):
    state = F.when(F.col("codec") == "A", "nothing_to_check").when(F.col("codec") == "N", "intact").when(F.col("line") > 5, "damaged")
    return files(spark, sf_dir).select("track_id", state.alias("state")).groupBy("track_id").agg(measures.worst_of(F.col("state")).alias("worst"))


@query(r"""SELECT p_partkey, regexp_replace(n, '(?is)^(the|le|la|les|der|die) \s*(.*?)\s*$', '\2, \1') AS sort_name FROM (SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'The ' WHEN 1 THEN 'Les ' ELSE '' END || p_name AS n FROM part)""")
def sort_name(spark, sf_dir):
    name = F.concat(F.when(F.col("p_partkey") % 3 == 0, "The ").when(F.col("p_partkey") % 3 == 1, "Les ").otherwise(""), "p_name")
    return table(spark, sf_dir, "part").select("p_partkey", T.sort_name(name).alias("sort_name"))


@query("""SELECT p_partkey, array_to_string(list_distinct_keep(x), '|') AS names FROM (SELECT p_partkey, [split_part(p_name, ' ', 1), split_part(p_name, ' ', 2), p_brand] AS x FROM part)""".replace("list_distinct_keep(x)", "list_filter(x, lambda e, i: list_position(x, e) = i)"))
def split_names(spark, sf_dir):
    words = F.split("p_name", " ")
    joined = F.concat(words[0], F.lit("; "), words[1], F.lit(" feat. "), F.col("p_brand"))
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(T.split_names(joined), "|").alias("names"))


@query(r"SELECT page_id, TRY_CAST(nullif(regexp_extract(url, '(1[5-9]\d\d|2[01]\d\d|2200)', 1), '') AS INTEGER) AS year FROM pages")
def extract_year(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", T.extract_year(F.col("url")).alias("year"))


@query("SELECT l_orderkey AS track_id, l_linenumber AS line, CAST(l_linenumber AS INTEGER) AS number, CAST(l_quantity AS INTEGER) AS total FROM lineitem")
def number_of_total(spark, sf_dir):
    both = F.concat_ws("/", F.col("l_linenumber").cast("string"), F.concat(F.lit(" "), F.col("l_quantity").cast("int").cast("string")))
    n, total = T.number_of_total(both)
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("track_id"), F.col("l_linenumber").alias("line"), n.alias("number"), total.alias("total"))


@query("""SELECT o_orderkey AS track_id, CASE WHEN s >= 3600 THEN concat(s // 3600, ':', lpad(CAST(s % 3600 // 60 AS VARCHAR), 2, '0'), ':', lpad(CAST(s % 60 AS VARCHAR), 2, '0')) ELSE concat(s // 60, ':', lpad(CAST(s % 60 AS VARCHAR), 2, '0')) END AS shown
  FROM (SELECT o_orderkey, (CAST(round(o_totalprice) AS BIGINT) * 10 + 500) // 1000 AS s FROM orders)""")
def format_duration(spark, sf_dir):
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("track_id"), T.format_duration(F.round("o_totalprice").cast("long") * 10).alias("shown"))


@query(r"SELECT page_id, regexp_extract(url, '(?s)^(.*)/[^/]*$', 1) AS folder, regexp_extract(url, '([^/]*)$', 1) AS name FROM pages")
def path_parts(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", T.folder(F.col("url")).alias("folder"), T.file_name(F.col("url")).alias("name"))


@query("WITH f AS (SELECT min(regexp_extract(url, '(?s)^(.*)/[^/]*$', 1)) AS place FROM pages) SELECT page_id FROM pages, f WHERE url = place OR starts_with(url, place || '/')")
def path_scope(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    place = pages.agg(F.min(T.folder(F.col("url"))).alias("place"))
    return pages.join(F.broadcast(place)).where(T.is_under(F.col("url"), F.col("place"))).select("page_id")


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def json_props(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.from_json("props", "k long")["k"].alias("k"))


@query("""SELECT doc_id, concat_ws(',', CAST(doc_id AS VARCHAR), lang, CASE WHEN contains(text, ',') OR contains(text, '"') OR contains(text, chr(10)) OR contains(text, chr(13)) THEN '"' || replace(text, '"', '""') || '"' ELSE text END) AS line FROM documents""")
def csv_line(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.csv_line([F.col("doc_id"), F.col("lang"), F.col("text")]).alias("line"))


@query("SELECT o_orderkey AS track_id, o_totalprice AS total FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 50 OFFSET 50")
def page_two(spark, sf_dir):
    ordered = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("track_id"), F.col("o_totalprice").alias("total")).orderBy(F.desc("total"), "track_id")
    return lookups.Page(50, 50).of(ordered)


@query(f"""WITH {_GAPS}, x AS (SELECT 0 AS rank, 'incomplete' AS kind, track_id AS entity, array_to_string(missing[1:12], ',') AS detail FROM m WHERE len(missing) > 0
  UNION ALL SELECT 1, 'mixed quality', l_orderkey, array_to_string(list_sort(list(DISTINCT l_returnflag)), ', ') FROM lineitem GROUP BY l_orderkey HAVING count(DISTINCT l_returnflag) > 1)
  SELECT kind, entity, detail FROM x""")
def issues_union(spark, sf_dir):
    gaps = sequences.sequence_gaps(files(spark, sf_dir), ["track_id"], "line").select(F.lit(0).alias("rank"), F.lit("incomplete").alias("kind"), F.col("track_id").alias("entity"), F.array_join(F.slice("missing", 1, 12).cast("array<string>"), ",").alias("detail"))
    mixed = mixed_quality(spark, sf_dir).where("codecs > 1").select(F.lit(1).alias("rank"), F.lit("mixed quality").alias("kind"), F.col("track_id").alias("entity"), F.col("which").alias("detail"))
    return gaps.unionByName(mixed).orderBy("rank", "entity").drop("rank")


@query(f"WITH {CREDITS}, {FILES}, t AS (SELECT DISTINCT track_id FROM credits WHERE role = 'main' AND artist_id <= 3) SELECT count(*) AS files, CAST(sum(size) AS BIGINT) AS bytes, CAST(sum(duration_ms) AS BIGINT) AS duration_ms FROM files JOIN t USING (track_id)")
def selection_totals(spark, sf_dir):
    picked = credits(spark, sf_dir).where("role = 'main' and artist_id <= 3").select("track_id").distinct()
    return files(spark, sf_dir).join(picked, "track_id", "left_semi").agg(F.count("*").alias("files"), F.sum("size").alias("bytes"), F.sum("duration_ms").alias("duration_ms"))


@query(f"WITH {CREDITS} SELECT track_id, role, array_to_string(list_sort(list(DISTINCT s_name)), ', ') AS names FROM credits JOIN supplier ON s_suppkey = artist_id GROUP BY 1, 2")
def credits_by_role(spark, sf_dir):
    names = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("artist_id"), "s_name")
    return credits(spark, sf_dir).join(names, "artist_id").groupBy("track_id", "role").agg(F.array_join(F.sort_array(F.collect_set("s_name")), ", ").alias("names"))


@query("""WITH s AS (SELECT CASE l_returnflag WHEN 'A' THEN 'nothing_to_check' WHEN 'N' THEN 'intact' ELSE CASE WHEN l_linenumber > 5 THEN 'damaged' ELSE 'not_verified' END END AS state FROM lineitem) SELECT state, count(*) AS files FROM s GROUP BY 1""")
def integrity_counts(spark, sf_dir):
    state = F.when(F.col("codec") == "A", "nothing_to_check").when(F.col("codec") == "N", "intact").when(F.col("line") > 5, "damaged").otherwise("not_verified")
    return files(spark, sf_dir).groupBy(state.alias("state")).agg(F.count("*").alias("files"))


@query(r"""WITH r AS (SELECT DISTINCT regexp_extract(url, '^(https?://[^/]*)', 1) AS root FROM pages WHERE page_id % 3 <> 0), p AS (SELECT page_id, length(html) AS size, regexp_extract(url, '^(https?://[^/]*)', 1) AS root FROM pages)
  SELECT coalesce(r.root, '(no longer watched)') AS root, count(*) AS pages, CAST(sum(size) AS BIGINT) AS bytes FROM p LEFT JOIN r USING (root) GROUP BY 1""")
def roots_listing(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", F.length("html").alias("size"), F.regexp_extract("url", "^(https?://[^/]*)", 1).alias("root"))
    watched = pages.where("page_id % 3 <> 0").select(F.col("root").alias("watched")).distinct()
    return pages.join(watched, F.col("root") == F.col("watched"), "left").groupBy(F.coalesce("watched", F.lit("(no longer watched)")).alias("root")).agg(F.count("*").alias("pages"), F.sum("size").alias("bytes"))


@query(f"WITH {CREDITS} SELECT o_custkey AS release_id, array_to_string(list_sort(list(DISTINCT p_type)), ', ') AS genres, count(DISTINCT p_type) AS n FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey GROUP BY 1")
def genres_of_release(spark, sf_dir):
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("part_id"), F.col("p_type").alias("genre"))
    joined = files(spark, sf_dir).join(part, "part_id").join(tracks(spark, sf_dir), "track_id").select("release_id", "genre").distinct()
    return joined.groupBy("release_id").agg(F.array_join(F.sort_array(F.collect_list("genre")), ", ").alias("genres"), F.count("*").alias("n"))


@query(f"WITH {CREDITS}, {FILES}, k AS (SELECT artist_id, track_id, bool_or(role <> 'composer') AS plays FROM credits GROUP BY 1, 2) SELECT artist_id, CAST(count_if(plays) AS BIGINT) AS performed, CAST(count_if(NOT plays) AS BIGINT) AS only_written FROM k GROUP BY 1")
def page_measures(spark, sf_dir):
    each = credits(spark, sf_dir).groupBy("artist_id", "track_id").agg(F.bool_or(F.expr(PLAYS)).alias("plays"))
    return each.groupBy("artist_id").agg(F.count_if("plays").alias("performed"), F.count_if(~F.col("plays")).alias("only_written"))


@query("SELECT count(*) AS files, count(DISTINCT page_id) AS ids, min(page_id) AS least, max(page_id) AS most, CAST(min(page_id) = 0 AND max(page_id) = count(*) - 1 AND count(DISTINCT page_id) = count(*) AS BOOLEAN) AS whole FROM pages")
def invariants(spark, sf_dir):
    n = F.count("*")
    return table(spark, sf_dir, "pages").agg(n.alias("files"), F.countDistinct("page_id").alias("ids"), F.min("page_id").alias("least"), F.max("page_id").alias("most"), ((F.min("page_id") == 0) & (F.max("page_id") == n - 1) & (F.countDistinct("page_id") == n)).alias("whole"))


@query(f"WITH {_GAPS}, x AS (SELECT 'warning' AS severity, 'incomplete' AS kind FROM m WHERE len(missing) > 0 UNION ALL SELECT 'warning', 'mixed quality' FROM lineitem GROUP BY l_orderkey HAVING count(DISTINCT l_returnflag) > 1) SELECT severity, kind, count(*) AS count FROM x GROUP BY 1, 2")
def issue_counts(spark, sf_dir):
    issues = issues_union(spark, sf_dir)
    return issues.groupBy(F.lit("warning").alias("severity"), "kind").agg(F.count("*").alias("count"))
