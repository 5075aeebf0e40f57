"""Answers of online catalogues, as captured JSON. Rows without what is required are dropped, empty text is no text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelsleuth.functions.naming import title_case


def _text(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def tv_results(rows: DataFrame, column: str = "value") -> DataFrame:
    """(rank, id, name, first_air_date, overview) of a search for series."""
    schema = "results array<struct<id: bigint, name: string, first_air_date: string, overview: string>>"
    found = rows.select(F.posexplode(F.from_json(column, schema)["results"]).alias("rank", "r")).where("r.id IS NOT NULL AND r.name IS NOT NULL")
    return found.select("rank", "r.id", "r.name", _text(F.col("r.first_air_date")).alias("first_air_date"), _text(F.col("r.overview")).alias("overview"))


def movie_results(rows: DataFrame, column: str = "value") -> DataFrame:
    """(rank, id, title, release_date, runtime_mins) of a search for films; a runtime of 0 is unknown."""
    schema = "results array<struct<id: bigint, title: string, release_date: string, runtime: bigint>>"
    found = rows.select(F.posexplode(F.from_json(column, schema)["results"]).alias("rank", "r")).where("r.id IS NOT NULL AND r.title IS NOT NULL")
    return found.select("rank", "r.id", "r.title", _text(F.col("r.release_date")).alias("release_date"), F.when(F.col("r.runtime") > 0, F.col("r.runtime")).alias("runtime_mins"))


def episodes(rows: DataFrame, season: int, column: str = "value") -> DataFrame:
    """(season, number, name, runtime_mins, air_date, overview) of a season; a runtime of 0 stays."""
    schema = "episodes array<struct<season_number: int, episode_number: int, name: string, runtime: int, air_date: string, overview: string>>"
    found = rows.select(F.explode(F.from_json(column, schema)["episodes"]).alias("e")).where("e.episode_number IS NOT NULL")
    blank = F.when(F.trim("e.overview") != "", F.col("e.overview"))
    return found.select(
        F.coalesce("e.season_number", F.lit(season)).alias("season"), F.col("e.episode_number").alias("number"), F.coalesce("e.name", F.lit("")).alias("name"), F.col("e.runtime").alias("runtime_mins"), _text(F.col("e.air_date")).alias("air_date"), blank.alias("overview"),
    )


_CREDIT = "array<struct<name: string, joinphrase: string, artist: struct<name: string, `sort-name`: string, aliases: array<struct<name: string, locale: string, primary: boolean>>>>>"
_GENRES = "array<struct<name: string, count: bigint>>"
RELEASE = (
    f"id string, title string, date string, country string, status string, barcode string, `artist-credit` {_CREDIT}, genres {_GENRES}, "
    f"`release-group` struct<id: string, `primary-type`: string, `first-release-date`: string, genres: {_GENRES}>, `label-info` array<struct<`catalog-number`: string, label: struct<name: string>>>, "
    f"media array<struct<position: int, format: string, discs: array<struct<id: string>>, tracks: array<struct<id: string, position: int, title: string, length: bigint, `artist-credit`: {_CREDIT}, recording: struct<id: string, length: bigint, isrcs: array<string>, `artist-credit`: {_CREDIT}>>>>>"
)


def credit(names: Column) -> Column:
    """Names joined by their phrases."""
    return F.aggregate(names, F.lit(""), lambda a, n: F.concat(a, F.coalesce(n["name"], F.lit("")), F.coalesce(n["joinphrase"], F.lit(""))))


def top_genre(genres: Column) -> Column:
    """The genre with most votes, the first of equals, in title case."""
    best = F.array_min(F.transform(genres, lambda g, i: F.struct((-F.coalesce(g["count"], F.lit(0))).alias("votes"), i.alias("i"), g["name"].alias("name"))))
    return title_case(_text(best["name"]))


def english_name(artist: Column, credited: Column) -> Column:
    """A primary English alias, or any, or the sort name put in order if it is in Latin letters; else as credited."""
    english = F.filter(artist["aliases"], lambda a: a["locale"] == "en")
    first = F.coalesce(F.get(F.filter(english, lambda a: F.coalesce(a["primary"], F.lit(False))), 0)["name"], F.get(english, 0)["name"])
    latin = lambda c: ~c.rlike(r"[\p{IsAlphabetic}&&[^\x{0000}-\x{024F}]]")
    sort = F.regexp_replace(artist["sort-name"], "^(.*?), (.*)$", "$2 $1")
    return F.when(latin(credited), credited).otherwise(F.coalesce(first, F.when(latin(sort), sort), credited))


def releases(rows: DataFrame, column: str = "value") -> DataFrame:
    """One row a release: id, title, artist, date, year, country, status, label, catalog_number, release_type, genre, media."""
    schema = f"releases array<struct<{_struct(RELEASE)}>>"
    found = rows.select(F.explode(F.from_json(column, schema)["releases"]).alias("r"))
    found = found.select("r.*").where((F.col("id") != "") & (F.col("title") != ""))
    info = F.get("label-info", 0)
    return found.select(
        "id", "title", credit(F.col("`artist-credit`")).alias("artist"), _text(F.col("date")).alias("date"), F.nullif(F.substring("date", 1, 4), F.lit("")).alias("year"), _text(F.col("country")).alias("country"), F.lower(_text(F.col("status"))).alias("status"),
        _text(info["label"]["name"]).alias("label"), _text(info["catalog-number"]).alias("catalog_number"), F.lower(_text(F.col("`release-group`.primary-type"))).alias("release_type"),
        F.coalesce(top_genre(F.col("genres")), top_genre(F.col("`release-group`.genres"))).alias("genre"), "media",
    )


def _struct(ddl: str) -> str:
    """Top-level fields of a DDL string in the form that a struct wants."""
    out, depth, start = [], 0, 0
    for i, ch in enumerate(ddl + ","):
        depth += (ch == "<") - (ch == ">")
        if ch == "," and depth == 0:
            name, kind = ddl[start:i].strip().split(" ", 1)
            out.append(f"{name}: {kind}")
            start = i + 1
    return ", ".join(out)


def media(found: DataFrame) -> DataFrame:
    """(release, position, format, disc_ids, tracks) of releases(): tracks as (position, title, length_ms, artist, isrc)."""
    rows = found.select(F.col("id").alias("release"), F.explode("media").alias("m"))
    length = lambda t: F.coalesce(t["length"], t["recording"]["length"])
    named = lambda t: F.coalesce(credit(t["artist-credit"]), credit(t["recording"]["artist-credit"]))
    tracks = F.transform(
        F.filter("m.tracks", lambda t: (t["id"] != "") & t["position"].isNotNull() & (t["title"] != "")),
        lambda t: F.struct(t["position"].alias("position"), t["title"].alias("title"), length(t).alias("length_ms"), named(t).alias("artist"), F.get(t["recording"]["isrcs"], 0).alias("isrc")),
    )
    return rows.select("release", F.coalesce("m.position", F.lit(1)).alias("position"), _text(F.col("m.format")).alias("format"), F.transform("m.discs", lambda d: d["id"]).alias("disc_ids"), tracks.alias("tracks"))


def medium_for_disc(rows: DataFrame, disc_id: str) -> DataFrame:
    """(release, position): the first medium of each release with a disc id."""
    hits = rows.where(F.array_contains("disc_ids", disc_id))
    return hits.groupBy("release").agg(F.min("position").alias("position"))


def medium_by_lengths(rows: DataFrame, lengths_ms: list[int], tolerance_ms: int) -> DataFrame:
    """(release, position): the only medium of a release with as many tracks, each within the tolerance; none if several fit."""
    wanted = F.array(*[F.lit(x) for x in lengths_ms]).cast("array<bigint>")
    near = F.forall(F.zip_with("tracks", wanted, lambda t, w: F.coalesce(F.abs(t["length_ms"] - w) <= tolerance_ms, F.lit(False))), lambda x: x)
    fits = rows.where((F.size("tracks") == len(lengths_ms)) & near)
    return fits.groupBy("release").agg(F.count(F.lit(1)).alias("n"), F.min("position").alias("position")).where("n = 1").drop("n")


def subtitle_files(rows: DataFrame, column: str = "value") -> DataFrame:
    """(file_id, downloads, trusted, translated, season, episode): entries of one file; several are an old rip in pieces."""
    schema = "data array<struct<attributes: struct<download_count: bigint, from_trusted: boolean, machine_translated: boolean, ai_translated: boolean, feature_details: struct<season_number: int, episode_number: int>, files: array<struct<file_id: bigint>>>>>"
    found = rows.select(F.posexplode(F.from_json(column, schema)["data"]).alias("rank", "d")).select("rank", "d.attributes").where(F.size("attributes.files") == 1)
    a = "attributes"
    off = lambda k: F.coalesce(F.col(f"{a}.{k}"), F.lit(False))
    out = found.select("rank", F.col(f"{a}.files")[0]["file_id"].alias("file_id"), F.coalesce(f"{a}.download_count", F.lit(0)).alias("downloads"), off("from_trusted").alias("trusted"), (off("machine_translated") | off("ai_translated")).alias("translated"), F.col(f"{a}.feature_details.season_number").alias("season"), F.col(f"{a}.feature_details.episode_number").alias("episode"))
    return out.where("file_id IS NOT NULL")


def best_subtitle(found: DataFrame) -> DataFrame:
    """(season, episode, file_id): not translated, trusted, most downloads; the last of equals."""
    best = found.where("NOT translated").groupBy("season", "episode").agg(F.max(F.struct("trusted", "downloads", "rank", "file_id")).alias("b"))
    return best.select("season", "episode", "b.file_id")


def media_features(rows: DataFrame, column: str = "value") -> DataFrame:
    """(duration_secs, size_bytes, title, chapters, width, height, display_aspect, audio, subtitles) of a probed file."""
    schema = "format struct<duration: string, size: string, tags: struct<title: string>>, chapters array<struct<start_time: string, end_time: string>>, streams array<struct<codec_type: string, codec_name: string, width: int, height: int, display_aspect_ratio: string>>"
    r = rows.select(F.from_json(column, schema).alias("r")).select("r.*")
    kind = lambda k: F.filter("streams", lambda s: s["codec_type"] == k)
    video = F.get(kind("video"), 0)
    part = lambda i: F.get(F.split(video["display_aspect_ratio"], ":"), i).try_cast("double")
    return r.select(
        F.coalesce(F.col("format.duration").try_cast("double"), F.lit(0.0)).alias("duration_secs"), F.coalesce(F.col("format.size").try_cast("long"), F.lit(0)).alias("size_bytes"), F.col("format.tags.title").alias("title"), F.coalesce(F.size("chapters"), F.lit(0)).alias("chapters"),
        video["width"].alias("width"), video["height"].alias("height"), F.when((part(0) > 0) & (part(1) > 0), part(0) / part(1)).alias("display_aspect"), F.size(kind("audio")).alias("audio"), F.size(kind("subtitle")).alias("subtitles"),
    )


def container_tracks(rows: DataFrame, column: str = "value") -> DataFrame:
    """(id, kind, language, codec) of a container's tracks."""
    schema = "tracks array<struct<id: int, type: string, codec: string, properties: struct<language: string>>>"
    t = rows.select(F.explode(F.from_json(column, schema)["tracks"]).alias("t")).where("t.id IS NOT NULL AND t.type IS NOT NULL")
    return t.select("t.id", F.when(F.col("t.type").isin("video", "audio", "subtitles"), F.col("t.type")).otherwise("other").alias("kind"), F.coalesce("t.properties.language", F.lit("")).alias("language"), F.coalesce("t.codec", F.lit("")).alias("codec"))
