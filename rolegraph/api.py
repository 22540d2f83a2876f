"""One object for the questions a user asks of a catalog."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rolegraph.functions import roles
from rolegraph.functions.text import is_under, normalize, position, search_score
from rolegraph.operators import graph, lookups, measures, suggest
from rolegraph.operators.lookups import Page
from rolegraph.plans import analyses, doctor, export, stats
from rolegraph.plans.catalog import Catalog, first
from rolegraph.sources.listing import in_scope


class Library:
    """Questions about a ``Catalog``; every answer is a DataFrame in a total order."""

    def __init__(self, catalog: Catalog) -> None:
        self.catalog = catalog

    def stats(self) -> dict[str, DataFrame]:
        return {"counts": stats.counts(self.catalog), "completeness": stats.completeness(self.catalog), **stats.buckets(self.catalog)}

    def top(self, what: str, limit: int = 10) -> DataFrame:
        return stats.top(self.catalog, what, limit)

    def doctor(self, severity: str | None = None) -> DataFrame:
        return doctor.diagnose(self.catalog, severity)

    def role_key(self, typed: str) -> str:
        """The key of a role by its key or its shown name; a name of no role is an error that lists those in use."""
        used = [r[0] for r in self.catalog.credit.select("role").distinct().orderBy("role").collect()]  # roles are few
        known = self.catalog.file.sparkSession.createDataFrame([(i, k) for i, k in enumerate(dict.fromkeys([*used, *roles.NAMES]))], "at int, role string")
        wanted = normalize(F.lit(typed))
        hit = known.where((normalize(F.col("role")) == wanted) | (normalize(roles.role_label(F.col("role"))) == wanted)).orderBy("at").select("role").first()
        if hit is None:
            raise ValueError(f"no role {typed!r}{self._hint('role', typed)}; in use are {', '.join(roles.NAMES.get(r, r) for r in used)}")
        return hit[0]

    def roles(self) -> DataFrame:
        """(role, label, artists): the roles that the catalog holds."""
        per = self.catalog.credit.groupBy("role").agg(F.countDistinct("artist_key").alias("artists"))
        return per.select("role", roles.role_label(F.col("role")).alias("label"), "artists").orderBy("role")

    def artists(self, role: str | None = None, contains: str = "", by: str = "tracks", page: Page = Page()) -> DataFrame:  # noqa: B008
        """Artists with their tracks, releases, duration and bytes, most tracks first, or by name."""
        if by not in ("tracks", "name"):
            raise ValueError("artists are sorted by tracks or by name")
        c = self.catalog
        credit = c.credit if role is None else c.credit.where(F.col("role") == self.role_key(role))
        files = c.file.select(F.col("path").alias("entity_key"), F.col("release_key").alias("_of"), "duration_ms", "size")
        on = credit.select("artist_key", "entity_kind", "entity_key").distinct().join(files, "entity_key", "left")
        release = F.when(F.col("entity_kind") == "release", F.col("entity_key")).otherwise(F.col("_of"))
        track = F.col("entity_kind") == "track"
        # one row an artist and release first, so that no row is multiplied for its distinct count
        per = on.groupBy("artist_key", release.alias("_release")).agg(F.count_if(track).alias("n"), F.sum(F.when(track, F.col("duration_ms"))).alias("ms"), F.sum(F.when(track, F.col("size"))).alias("b"))
        per = per.groupBy("artist_key").agg(F.sum("n").alias("tracks"), F.count("_release").alias("releases"), F.sum("ms").alias("duration_ms"), F.sum("b").alias("bytes"))
        rows = c.artist.join(per, F.col("key") == F.col("artist_key"), "inner" if role else "left").na.fill(0, ["tracks", "releases", "duration_ms", "bytes"])
        order = [F.desc("tracks"), "sort_name", "key"] if by == "tracks" else ["sort_name", "key"]
        return page.of(rows.where(F.col("key").contains(normalize(F.lit(contains)))).orderBy(*order).select("name", "tracks", "releases", "duration_ms", "bytes"))

    def _per_release(self) -> DataFrame:
        return self.catalog.file.groupBy("release_key").agg(F.count("*").alias("tracks"), F.sum("duration_ms").alias("duration_ms"), F.sum("size").alias("bytes"))

    def genres(self, page: Page = Page()) -> DataFrame:  # noqa: B008
        """Genres with their tracks, duration and bytes, most tracks first."""
        c = self.catalog
        on = c.genre_link.where("entity_kind = 'track'").select(F.col("entity_key").alias("path"), F.col("genre_key").alias("key")).distinct().join(c.file.select("path", "duration_ms", "size"), "path")
        per = on.groupBy("key").agg(F.count("*").alias("tracks"), F.coalesce(F.sum("duration_ms"), F.lit(0)).alias("duration_ms"), F.sum("size").alias("size_bytes"))
        return page.of(per.join(c.genre, "key").orderBy(F.desc("tracks"), "seen").select(F.col("name").alias("genre"), "tracks", "duration_ms", "size_bytes"))

    def labels(self, page: Page = Page()) -> DataFrame:  # noqa: B008
        """Labels with their albums, tracks, duration and bytes, most albums first."""
        c = self.catalog
        on = c.release.select("release_key", F.explode("label_keys").alias("key")).join(self._per_release(), "release_key")
        per = on.groupBy("key").agg(F.count("*").alias("albums"), F.sum("tracks").alias("tracks"), F.coalesce(F.sum("duration_ms"), F.lit(0)).alias("duration_ms"), F.sum("bytes").alias("size_bytes"))
        return page.of(per.join(c.label, "key").orderBy(F.desc("albums"), "seen").select(F.col("name").alias("label"), "albums", "tracks", "duration_ms", "size_bytes"))

    def roots(self, places: list[str]) -> DataFrame:
        """(root, files, duration_ms, bytes) of each watched place, and a row without a root for files outside all of them."""
        inside = F.array_compact(F.array(*[F.when(is_under(F.col("path"), F.lit(p)), F.lit(p)) for p in places]))
        found = self.catalog.file.select(F.explode_outer(inside).alias("root"), "duration_ms", "size")
        per = found.groupBy("root").agg(F.count("*").alias("files"), F.coalesce(F.sum("duration_ms"), F.lit(0)).alias("duration_ms"), F.sum("size").alias("bytes"))
        named = self.catalog.file.sparkSession.createDataFrame([(p,) for p in places], "root string")
        return per.join(named, "root", "full").na.fill(0, ["files", "duration_ms", "bytes"]).orderBy(F.asc_nulls_last("root"))

    def notices(self) -> DataFrame:
        """One row: files that no check has read, and analyses that wait for their file."""
        c = self.catalog
        unread = c.file.agg(F.count_if(F.col("integrity").isNull()).alias("unverified"))
        if c.analysis is None:
            return unread.withColumn("waiting", F.lit(0).cast("long"))
        return measures.one_row(unread, analyses.pending(c.analysis, c.file).agg(F.count("*").alias("waiting")))

    def nearest(self, kind: str, typed: str) -> DataFrame:
        """Names of a kind that are a few letters from a typed one, nearest first."""
        c = self.catalog
        if kind == "role":
            shown = roles.role_label(F.col("role"))
            names = c.credit.select("role").distinct().select(normalize(shown).alias("key"), shown.alias("name"))
        else:
            names = {"artist": c.artist, "label": c.label, "genre": c.genre, "release": c.release.withColumnRenamed("title", "name")}[kind]
        return suggest.nearest(suggest.index(names), typed)

    def _hint(self, kind: str, typed: str) -> str:
        """What a user may have meant, for an error."""
        near = self.nearest(kind, typed).first()
        return f" (is it {near['name']!r}?)" if near else ""

    def albums(self, artist: str = "", year: int | None = None, genre: str | None = None, label: str | None = None, compilations: bool | None = None, comment: str = "", page: Page = Page()) -> DataFrame:  # noqa: B008
        """Releases that meet all conditions, by year, title; an unknown genre or label is an error."""
        c, rows = self.catalog, self.catalog.release
        if artist:
            rows = rows.where(F.col("owner_key").contains(normalize(F.lit(artist))))
        if year is not None:
            rows = rows.where(F.col("year") == year)
        if compilations is not None:
            rows = rows.where(F.col("is_compilation") == compilations)
        if comment:
            said = c.file.where(normalize(first("comment")).contains(normalize(F.lit(comment)))).select("release_key")
            rows = rows.join(said, "release_key", "left_semi")
        for name, table in (("genre", c.genre), ("label", c.label)):
            asked = {"genre": genre, "label": label}[name]
            if asked is None:
                continue
            keys = table.where(F.col("key").contains(normalize(F.lit(asked)))).select(F.col("key").alias("_wanted"))
            if keys.isEmpty():
                raise ValueError(f"no {name} like {asked!r}{self._hint(name, asked)}")
            if name == "genre":
                linked = c.genre_link.where("entity_kind = 'release'").join(keys, F.col("genre_key") == F.col("_wanted"), "left_semi").select(F.col("entity_key").alias("release_key"))
            else:
                linked = rows.select("release_key", F.explode("label_keys").alias("_label")).join(keys, F.col("_label") == F.col("_wanted"), "left_semi").select("release_key")
            rows = rows.join(linked, "release_key", "left_semi")
        per = c.file.groupBy("release_key").agg(F.count("*").alias("tracks"), F.sum("duration_ms").alias("duration_ms"), F.sum("size").alias("bytes"), F.array_join(F.sort_array(F.collect_set("quality")), ", ").alias("quality"))
        owner = c.artist.select(F.col("key").alias("owner_key"), F.col("name").alias("artist"))
        out = rows.join(per, "release_key").join(owner, "owner_key", "left").withColumn("artist", F.coalesce("artist", F.lit("Various Artists")))
        return page.of(out.orderBy(F.asc_nulls_last("year"), "title", "release_key").select("title", "artist", "year", "tracks", "duration_ms", "bytes", "quality", "release_key"))

    def album(self, title: str) -> DataFrame:
        """Releases of that title, else those that hold it, else the best release of a search."""
        found = lookups.exact_or_partial(self.catalog.release, "key", title)
        if found.isEmpty():
            best = self.search(title, 1).where("kind = 'release'").select(F.col("id").alias("release_key"))
            found = self.catalog.release.join(F.broadcast(best), "release_key", "left_semi").withColumn("match", F.lit("search"))  # one row at most
        return found

    def album_page(self, title: str) -> dict[str, DataFrame]:
        """What is known of the releases of a title: totals, tracks in order, credits by role, genres, and related releases."""
        c, found = self.catalog, self.album(title).select("release_key")
        files = c.file.join(found, "release_key", "left_semi")
        per = self._per_release().join(files.groupBy("release_key").agg(measures.worst_of(F.col("integrity.state")).alias("integrity"), F.array_join(F.sort_array(F.collect_set("quality")), ", ").alias("quality")), "release_key")
        owner = c.artist.select(F.col("key").alias("owner_key"), F.col("name").alias("artist"))
        head = c.release.join(per, "release_key").join(owner, "owner_key", "left").select("release_key", "title", F.coalesce("artist", F.lit("Various Artists")).alias("artist"), "year", "tracks", "duration_ms", "bytes", "quality", "integrity", "folder")
        disc = F.coalesce("disc_no", F.lit(1))
        related = c.release_relation.join(found, F.col("source") == F.col("release_key"), "left_semi").join(c.release.select(F.col("release_key").alias("target"), "title", "folder"), "target")
        return {
            "albums": head.orderBy("release_key"),
            "tracks": files.select("release_key", position(F.col("disc_no"), F.col("track_no")).alias("position"), "title", "duration_ms", "quality", "path", disc.alias("_disc"), "track_no").orderBy("release_key", "_disc", F.asc_nulls_last("track_no"), "title", "path").drop("_disc", "track_no"),
            "credits": self.credits(files.select("path")),
            "genres": c.genre_link.where("entity_kind = 'release'").join(found, F.col("entity_key") == F.col("release_key"), "left_semi").join(c.genre.select(F.col("key").alias("genre_key"), "name"), "genre_key").select(F.col("entity_key").alias("release_key"), "name").orderBy("release_key", "name"),
            "related": related.select("source", "kind", "target", "title", "folder").orderBy("source", "kind", "target"),
        }

    def credits(self, paths: DataFrame) -> DataFrame:
        """(role, label, name, tracks): who holds which role on tracks (path)."""
        c = self.catalog
        on = c.credit.where("entity_kind = 'track'").join(paths, F.col("entity_key") == F.col("path"), "left_semi")
        per = on.groupBy("role", "artist_key").agg(F.count("*").alias("tracks")).join(c.artist.select(F.col("key").alias("artist_key"), "name"), "artist_key")
        return per.select("role", roles.role_label(F.col("role")).alias("label"), "name", "tracks").orderBy("role", F.desc("tracks"), "name")

    def tracks(self, title: str = "", artist: str = "", album: str = "", comment: str = "", page: Page = Page(None)) -> DataFrame:  # noqa: B008
        """Tracks that meet all conditions: exact titles, or else titles that hold it; any credited or album artist; album; comment."""
        c, rows = self.catalog, self.catalog.file.withColumn("key", normalize(F.col("title")))
        if artist:
            like = c.artist.where(F.col("key").contains(normalize(F.lit(artist)))).select(F.col("key").alias("artist_key"))
            credited = c.credit.where("entity_kind = 'track'").join(like, "artist_key", "left_semi").select(F.col("entity_key").alias("path"))
            owned = c.release.join(like, F.col("owner_key") == F.col("artist_key"), "left_semi").select("release_key").join(c.file.select("path", "release_key"), "release_key").select("path")
            rows = rows.join(credited.unionByName(owned).distinct(), "path", "left_semi")
        if album:
            rows = rows.join(c.release.where(F.col("key").contains(normalize(F.lit(album)))).select("release_key"), "release_key", "left_semi")
        if comment:
            rows = rows.where(normalize(first("comment")).contains(normalize(F.lit(comment))))
        if title:
            rows = lookups.exact_or_partial(rows, "key", title)
        return page.of(rows.orderBy("path"))

    def selection(self, text: str) -> DataFrame:
        """(path, title, part): tracks whose title holds the text (part 0), then those whose comment alone does (part 1)."""
        rows, holds = self.catalog.file, lambda c: normalize(c).contains(normalize(F.lit(text)))
        return lookups.append_distinct([rows.where(holds(c)).select("path", "title") for c in (F.col("title"), first("comment"))], "path")

    def track_records(self) -> DataFrame:
        """One nested row a track: its place, quality, all its tags with their values joined, and its credits by role and name."""
        c = self.catalog
        named = c.artist.select(F.col("key").alias("artist_key"), "name")
        held = c.credit.where("entity_kind = 'track'").select(F.col("entity_key").alias("path"), "role", "artist_key").join(named, "artist_key")
        credits_of = held.groupBy("path").agg(F.sort_array(F.collect_set(F.struct("role", "name"))).alias("credits"))
        album = c.release.select("release_key", F.col("title").alias("album"), "year")
        rows = c.file.join(album, "release_key", "left").join(credits_of, "path", "left")
        tags = F.transform_values("tags", lambda k, v: F.array_join(v, " / ")).alias("tags")
        none = F.expr("cast(array() as array<struct<role:string,name:string>>)")
        return rows.select("path", "title", "album", "year", position(F.col("disc_no"), F.col("track_no")).alias("position"), "duration_ms", "quality", tags, F.coalesce("credits", none).alias("credits"))

    def track_page(self, path: str) -> dict[str, DataFrame]:
        """What is known of one track: its file, its place, who holds which role, and other files of its title and artist."""
        c = self.catalog
        one = c.file.where(F.col("path") == path)
        head = one.join(c.release.select("release_key", F.col("title").alias("album"), "year"), "release_key", "left").select("path", "title", position(F.col("disc_no"), F.col("track_no")).alias("position"), "album", "year", "duration_ms", "size", "quality", first("comment").alias("comment"), F.coalesce("integrity.state", F.lit("not_verified")).alias("integrity"))
        who = lambda df: df.select("path", normalize(F.col("title")).alias("what"), normalize(F.coalesce(first("artist"), F.lit(""))).alias("by"), "release_key", "duration_ms", "quality")
        mine = who(one).select(F.col("path").alias("_path"), "what", "by")
        said = {}
        if c.analysis is not None:
            stale = (F.col("size") != F.col("_size")) | (F.col("mtime") != F.col("_mtime"))
            at = F.broadcast(one.select(F.col("path").alias("_path"), F.col("size").alias("_size"), F.col("mtime").alias("_mtime")))  # one row
            said["analyses"] = c.analysis.join(at, F.col("path") == F.col("_path")).withColumn("stale", stale).drop("_path", "_size", "_mtime").orderBy("source")
        return said | {"track": head, "credits": self.credits(one.select("path")), "others": who(c.file).join(F.broadcast(mine), ["what", "by"]).where("path <> _path").select("path", "release_key", "duration_ms", "quality").orderBy("path")}

    def played_with(self, artist: str, limit: int = 20) -> DataFrame:
        """Those who play on tracks of the artist, by the number of tracks."""
        named = self.catalog.artist.select(F.col("key").alias("target"), "name", "sort_name")
        mine = self.catalog.collaboration.where(F.col("source") == normalize(F.lit(artist)))
        return mine.join(named, "target").orderBy(F.desc("weight"), "name", "target").select("name", "weight").limit(limit)

    def in_common(self, a: str, b: str) -> DataFrame:
        """Paths of tracks on which both play."""
        plays = self.catalog.credit.where((F.col("entity_kind") == "track") & F.col("role").isin(*graph.PERFORMING)).withColumnRenamed("entity_key", "path")
        of = lambda x: plays.where(F.col("artist_key") == normalize(F.lit(x))).select("path")
        return of(a).intersect(of(b))

    def artist(self, name: str) -> dict[str, DataFrame]:
        """Releases of an artist: own, as a guest, and written without playing; roles and neighbours.  A name that no artist
        has is looked up by search, if the best hit is an artist."""
        c = self.catalog
        found = c.artist.where(F.col("key") == normalize(F.lit(name))).select("key")
        if found.isEmpty():
            best = self.search(name, 1).where("kind = 'artist'").select(F.col("id").alias("key"))
            if best.isEmpty():
                raise ValueError(f"no artist like {name!r}{self._hint('artist', name)}")
            found = best
        mine = c.credit.join(F.broadcast(found), F.col("artist_key") == F.col("key"), "left_semi")
        of = c.file.select(F.col("path").alias("entity_key"), "release_key")
        seen = mine.join(of, "entity_key", "left").select("role", F.when(F.col("entity_kind") == "release", F.col("entity_key")).otherwise(F.col("release_key")).alias("release_key")).where("release_key is not null")
        own = c.release.join(F.broadcast(found), F.col("owner_key") == found["key"], "left_semi").select("release_key")
        plays = seen.where(F.col("role").isin(*graph.PERFORMING)).select("release_key")
        writes = seen.where(~F.col("role").isin(*graph.PERFORMING))
        titled = lambda df: df.distinct().join(c.release.select("release_key", "title", "year"), "release_key").orderBy(F.asc_nulls_last("year"), "title", "release_key")
        return {
            "own": titled(own), "guest": titled(graph.without(plays, own, ["release_key"])), "written": titled(graph.without(writes, plays.unionByName(own), ["release_key"])),
            "roles": graph.role_counts(mine, ["role"]).orderBy(F.desc("credits"), "role"), "played_with": self.played_with(name),
        }

    def artist_page(self, name: str) -> dict[str, DataFrame]:
        """What is known of an artist: totals of playing and of writing, genres, and releases, each with measures: own ones and
        those written without playing with all their tracks, guest appearances with the artist's own tracks alone."""
        c, known = self.catalog, self.artist(name)
        # of several found by search, ``artist`` has taken one
        found = c.artist.where(F.col("key") == normalize(F.lit(name))).select("key")
        if found.isEmpty():
            found = self.search(name, 1).select(F.col("id").alias("key"))
        files = c.file.select("path", "release_key", "duration_ms", "size", "quality")
        mine = c.credit.where("entity_kind = 'track'").join(F.broadcast(found), F.col("artist_key") == F.col("key"), "left_semi").select(F.col("entity_key").alias("path"), F.col("role").isin(*graph.PERFORMING).alias("plays")).distinct()
        tracks = mine.join(files, "path")
        playing, writing = tracks.where("plays"), tracks.where("not plays")
        measured = lambda kind, of, releases: measures.one_row(
            of.agg(F.lit(kind).alias("kind"), F.count("*").alias("tracks"), F.coalesce(F.sum("duration_ms"), F.lit(0)).alias("duration_ms"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes")),
            releases.agg(F.count("*").alias("releases")),
        )
        totals = measured("performing", playing, known["own"]).unionByName(measured("writing", writing, writing.select("release_key").where("release_key is not null").distinct()))
        genres = c.genre_link.where("entity_kind = 'track'").join(mine.select(F.col("path").alias("entity_key")).distinct(), "entity_key", "left_semi").select(F.col("genre_key").alias("key")).distinct().join(c.genre.select("key", "name"), "key").select("name").orderBy("name")
        owner = c.artist.select(F.col("key").alias("owner_key"), F.col("name").alias("artist"))
        copies = c.release_relation.groupBy(F.col("source").alias("release_key")).agg(F.min("kind").alias("copy"))  # a duplicate before another edition

        def listed(which: DataFrame, of: DataFrame) -> DataFrame:
            per = of.groupBy("release_key").agg(F.count("*").alias("tracks"), F.coalesce(F.sum("duration_ms"), F.lit(0)).alias("duration_ms"), F.sum("size").alias("bytes"), F.array_join(F.sort_array(F.collect_set("quality")), ", ").alias("quality"))
            rows = which.join(c.release.select("release_key", "owner_key"), "release_key").join(per, "release_key").join(owner, "owner_key", "left").join(copies, "release_key", "left")
            return rows.orderBy(F.asc_nulls_last("year"), "title", "release_key").select("year", "title", "copy", F.coalesce("artist", F.lit("Various Artists")).alias("artist"), "tracks", "duration_ms", "bytes", "quality", "release_key")

        return {
            "totals": totals.select("kind", "releases", "tracks", "duration_ms", "bytes"), "genres": genres, "discography": listed(known["own"], files), "guest": listed(known["guest"], playing),
            "written": listed(known["written"], files), "roles": known["roles"], "played_with": known["played_with"],
        }

    def facet(self, kind: str, name: str) -> DataFrame:
        """Releases of all genres or labels like ``name``."""
        return self.albums(**{kind: name}, page=Page(None))

    def facet_artists(self, kind: str, name: str) -> DataFrame:
        """(name, tracks): main artists on the tracks of all genres or labels like ``name``."""
        c = self.catalog
        table = {"genre": c.genre, "label": c.label}[kind]
        keys = table.where(F.col("key").contains(normalize(F.lit(name)))).select(F.col("key").alias("_wanted"))
        if kind == "genre":
            paths = c.genre_link.where("entity_kind = 'track'").join(keys, F.col("genre_key") == F.col("_wanted"), "left_semi").select(F.col("entity_key").alias("path")).distinct()
        else:
            of = c.release.select("release_key", F.explode("label_keys").alias("_label")).join(keys, F.col("_label") == F.col("_wanted"), "left_semi").select("release_key").distinct()
            paths = c.file.join(of, "release_key", "left_semi").select("path")
        return self.credits(paths).where("role = 'main'").select("name", "tracks").orderBy(F.desc("tracks"), "name")

    def years(self) -> DataFrame:
        per = self._per_release()
        dated = self.catalog.release.where("year is not null").select("release_key", "year").join(per, "release_key")
        return dated.groupBy("year").agg(F.count("*").alias("albums"), F.sum("tracks").alias("tracks"), F.sum("duration_ms").alias("duration_ms"), F.sum("bytes").alias("bytes")).orderBy("year")

    def integrity(self, places: list[str] | None = None) -> DataFrame:
        """Files in each state under the places."""
        state = F.coalesce("integrity.state", F.lit("not_verified"))
        return in_scope(self.catalog.file, places or []).groupBy(state.alias("state")).agg(F.count("*").alias("files")).orderBy("state")

    def unverified(self, places: list[str] | None = None, full: bool = False) -> DataFrame:
        """Paths that an integrity check has to read."""
        files = in_scope(self.catalog.file, places or [])
        return (files if full else files.where("integrity is null")).select("path").orderBy("path")

    def search(self, text: str, limit: int = 30) -> DataFrame:
        c, out = self.catalog, None
        tables = [("artist", c.artist, "key"), ("release", c.release, "release_key"), ("track", c.file, "path"), ("label", c.label, "key")]
        for rank, (kind, df, key) in enumerate(tables):
            name = F.col("title") if kind in ("release", "track") else F.col("name")
            one = df.select(F.lit(rank).alias("_rank"), F.lit(kind).alias("kind"), F.col(key).alias("id"), name.alias("name"))
            out = one if out is None else out.unionByName(one)
        hits = out.withColumn("score", search_score(normalize(F.col("name")), normalize(F.lit(text)))).where("score is not null")
        return hits.orderBy("score", "_rank", F.octet_length("name"), "name", "id").limit(limit).drop("_rank")

    def search_page(self, text: str, page: Page = Page(30), comments: bool = False, commented: Page = Page(30)) -> dict[str, DataFrame]:  # noqa: B008
        """Hits with what tells them apart (an album's artist, a track's album), and, apart from them, tracks whose comment holds
        the text: each a window of its own.  A text without a letter or digit is an error."""
        c = self.catalog
        if not lookups.needle_of(c.file, text):
            raise ValueError("give some text to search for")
        hits = page.of(self.search(text, (1 << 31) - 1))
        owner = c.artist.select(F.col("key").alias("owner_key"), F.col("name").alias("_artist"))
        of_release = c.release.join(owner, "owner_key", "left").select(F.lit("release").alias("kind"), F.col("release_key").alias("id"), F.coalesce("_artist", F.lit("Various Artists")).alias("detail"))
        of_track = c.file.join(c.release.select("release_key", F.col("title").alias("_album")), "release_key").select(F.lit("track").alias("kind"), F.col("path").alias("id"), F.col("_album").alias("detail"))
        rank = F.array_position(F.array(*[F.lit(k) for k in ("artist", "release", "track", "label")]), F.col("kind"))
        told = hits.join(of_release.unionByName(of_track), ["kind", "id"], "left").withColumn("detail", F.coalesce("detail", F.lit("")))
        out = {"hits": told.orderBy("score", rank, F.octet_length("name"), "name", "id").select("score", "kind", "name", "detail", "id")}
        if comments:
            said = c.file.where(normalize(first("comment")).contains(normalize(F.lit(text))))
            out["comments"] = commented.of(said.select("path", "title", first("comment").alias("comment")).orderBy("path"))
        return out

    def playlist(self, selection: DataFrame) -> DataFrame:
        """(line): the tracks of a selection (path, in its order by ``part`` if it has one) for a player; an empty one is an error."""
        return export.playlist(self._selected(selection, "playlist"), ["_part", "path"])

    def track_table(self, selection: DataFrame) -> DataFrame:
        """The export's columns for the tracks of a selection; an empty one is an error."""
        return self._selected(selection, "table").orderBy("_part", "path").drop("_part")

    def _selected(self, selection: DataFrame, what: str) -> DataFrame:
        if selection.isEmpty():
            raise ValueError(f"nothing to put in a {what}")
        part = F.col("part") if "part" in selection.columns else F.lit(0)
        wanted = selection.groupBy("path").agg(F.min(part).alias("_part"))
        return export.track_rows(self.catalog).join(wanted, "path").select(*export.track_rows(self.catalog).columns, "_part")

    def imported(self, records: DataFrame) -> "Library":
        """The library with analyses merged in, whatever waited and now has its file included."""
        c = self.catalog
        old = records.where(F.lit(False)) if c.analysis is None else c.analysis
        merged = analyses.merge(old, records, c.file.select("path", "size", "mtime"))
        return Library(c.changed(analysis=analyses.reconcile(merged, c.file.select("path", "size", "mtime"))))

    def forget(self, source: str | None = None) -> "Library":
        """The library without the analyses of a source, or of all."""
        c = self.catalog
        return self if c.analysis is None else Library(c.changed(analysis=analyses.forget(c.analysis, source)))

    def export(self, what: str = "albums") -> DataFrame:
        rows = {"albums": export.album_rows, "tracks": export.track_rows}
        if what not in rows:
            raise ValueError(f"export is one of {', '.join(rows)}")
        return rows[what](self.catalog)
