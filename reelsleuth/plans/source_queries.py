"""Queries over sources: answers of catalogues and output of programs, written from columns of the tables and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from reelsleuth.sources import catalogues as K
from reelsleuth.sources import text_formats as X

from .base import query, table

c = F.col


def _json(rows, key: str, field: str, entry) -> object:
    """One JSON answer for each value of `key`: its rows, in order of their own key, as an array in `field`."""
    # Answers hold a few entries, as those of a catalogue do: parts of a brand and size, suppliers of a nation's tens.
    g = rows.withColumn("entry", entry).groupBy(key).agg(F.array_sort(F.collect_list(F.struct("k", "entry"))).alias("all"))
    return g.select(key, F.to_json(F.struct(F.transform("all", lambda x: x["entry"]).alias(field))).alias("value"))


def _parts(spark, sf_dir):
    return table(spark, sf_dir, "part").withColumn("k", c("p_partkey")).withColumn("page", F.expr("p_partkey div 5"))


@query("S22_tv_results", "SELECT p_partkey AS id, p_name AS name, CASE WHEN p_size % 3 <> 0 THEN '20' || lpad(p_size::VARCHAR, 2, '0') || '-01-01' END AS first_air_date, CASE WHEN p_size % 2 = 0 THEN p_type END AS overview FROM part WHERE p_size % 11 <> 0")
def tv_results(spark, sf_dir):
    entry = F.struct(
        c("p_partkey").alias("id"), F.when(c("p_size") % 11 != 0, c("p_name")).alias("name"), F.when(c("p_size") % 3 != 0, F.format_string("20%02d-01-01", "p_size")).otherwise("").alias("first_air_date"),
        F.when(c("p_size") % 2 == 0, c("p_type")).otherwise("").alias("overview"), F.lit(1.5).alias("popularity"),
    )
    return K.tv_results(_json(_parts(spark, sf_dir), "page", "results", entry)).drop("rank")


@query("S23_film_results", "SELECT p_partkey AS id, p_name AS title, CASE WHEN p_size % 3 <> 0 THEN p_size::VARCHAR END AS release_date, CASE WHEN p_size % 4 <> 0 THEN p_size END::BIGINT AS runtime_mins, p_partkey % 5 - CASE WHEN p_partkey < 5 THEN (SELECT min(p_partkey) FROM part) ELSE 0 END AS rank FROM part")
def film_results(spark, sf_dir):
    """A runtime of 0 is unknown."""
    entry = F.struct(c("p_partkey").alias("id"), c("p_name").alias("title"), F.when(c("p_size") % 3 != 0, c("p_size").cast("string")).otherwise("").alias("release_date"), F.when(c("p_size") % 4 != 0, c("p_size")).otherwise(0).alias("runtime"))
    return K.movie_results(_json(_parts(spark, sf_dir), "page", "results", entry))


@query("S25_season_episodes", "SELECT CASE WHEN p_size % 2 = 0 THEN p_size ELSE 7 END AS season, (p_partkey % 5)::INT AS number, p_name AS name, CASE WHEN p_size % 3 <> 0 THEN p_size END AS runtime_mins, NULL::VARCHAR AS air_date, CASE WHEN p_size % 4 <> 0 THEN p_type END AS overview FROM part")
def season_episodes(spark, sf_dir):
    entry = F.struct(F.when(c("p_size") % 2 == 0, c("p_size")).alias("season_number"), (c("p_partkey") % 5).alias("episode_number"), c("p_name").alias("name"), F.when(c("p_size") % 3 != 0, c("p_size")).alias("runtime"), F.lit("").alias("air_date"), F.when(c("p_size") % 4 != 0, c("p_type")).otherwise("  ").alias("overview"))
    return K.episodes(_json(_parts(spark, sf_dir), "page", "episodes", entry), 7)


_SUBTITLES = (
    "f AS (SELECT l_orderkey // 2 AS page, l_orderkey * 1000000000 + l_partkey * 10000 + l_suppkey * 8 + l_linenumber AS k, l_partkey AS file_id, l_quantity::BIGINT AS downloads, l_returnflag = 'R' AS trusted, l_linestatus = 'F' AND l_discount > 0.05 AS translated, "
    "(l_orderkey % 50)::INT AS season, l_linenumber AS episode FROM lineitem WHERE l_tax > 0.01), r AS (SELECT *, row_number() OVER (PARTITION BY page ORDER BY k) AS rank FROM f)"
)


def _subtitles(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").withColumn("page", F.expr("l_orderkey div 2")).withColumn("k", c("l_orderkey") * 1000000000 + c("l_partkey") * 10000 + c("l_suppkey") * 8 + c("l_linenumber"))
    one = F.struct(c("l_partkey").alias("file_id"))
    entry = F.struct(F.struct(
        c("l_quantity").cast("long").alias("download_count"), (c("l_returnflag") == "R").alias("from_trusted"), (c("l_linestatus") == "F").alias("x"), F.when(c("l_discount") > 0.05, c("l_linestatus") == "F").alias("machine_translated"),
        F.struct((c("l_orderkey") % 50).alias("season_number"), c("l_linenumber").alias("episode_number")).alias("feature_details"), F.when(c("l_tax") > 0.01, F.array(one)).otherwise(F.array(one, one)).alias("files"),
    ).alias("attributes"))
    return K.subtitle_files(_json(rows, "page", "data", entry))


@query("S32_subtitle_files", f"WITH {_SUBTITLES} SELECT file_id, downloads, trusted, translated, season, episode FROM f")
def subtitle_files(spark, sf_dir):
    """Entries of one file; those of several are left out."""
    return _subtitles(spark, sf_dir).select("file_id", "downloads", "trusted", "translated", "season", "episode")


@query("O14_best_subtitle", f"WITH {_SUBTITLES} SELECT season, episode, bool_or(trusted) AS trusted, max(downloads) FILTER (trusted = t) AS downloads FROM (SELECT *, bool_or(trusted) OVER (PARTITION BY season, episode) AS t FROM f WHERE NOT translated) GROUP BY ALL")
def best_subtitle(spark, sf_dir):
    """What the best subtitle of an episode is; which of equals is open."""
    found = _subtitles(spark, sf_dir)
    best = found.where("NOT translated").groupBy("season", "episode").agg(F.max(F.struct("trusted", "downloads", "rank", "file_id")).alias("b"))
    return best.select("season", "episode", "b.trusted", "b.downloads")


@query("S46_media_features", "SELECT p_partkey::DOUBLE AS duration_secs, p_size::BIGINT AS size_bytes, p_name AS title, 0 AS chapters, 720 AS width, 480 AS height, CASE WHEN p_size % 5 <> 0 THEN 16 / p_size::DOUBLE END AS display_aspect, p_size % 3 AS audio, 1 AS subtitles FROM part")
def media_features(spark, sf_dir):
    video = F.struct(F.lit("video").alias("codec_type"), F.lit("mpeg2video").alias("codec_name"), F.lit(720).alias("width"), F.lit(480).alias("height"), F.concat(F.lit("16:"), F.when(c("p_size") % 5 != 0, c("p_size")).otherwise(0).cast("string")).alias("display_aspect_ratio"))
    plain = lambda k: F.struct(F.lit(k).alias("codec_type"), F.lit("x").alias("codec_name"), F.lit(None).cast("int").alias("width"), F.lit(None).cast("int").alias("height"), F.lit(None).cast("string").alias("display_aspect_ratio"))
    streams = F.concat(F.array(video, plain("subtitle")), F.slice(F.array(plain("audio"), plain("audio")), 1, c("p_size") % 3))
    form = F.struct(c("p_partkey").cast("string").alias("duration"), c("p_size").cast("string").alias("size"), F.struct(c("p_name").alias("title")).alias("tags"))
    rows = table(spark, sf_dir, "part").select(F.to_json(F.struct(form.alias("format"), F.array().cast("array<struct<start_time: string, end_time: string>>").alias("chapters"), streams.alias("streams"))).alias("value"))
    return K.media_features(rows)


@query("S49_container_tracks", "SELECT (p_partkey % 5)::INT AS id, CASE p_size % 4 WHEN 0 THEN 'video' WHEN 1 THEN 'audio' WHEN 2 THEN 'subtitles' ELSE 'other' END AS kind, CASE WHEN p_size % 3 = 0 THEN '' ELSE p_brand END AS language, p_type AS codec FROM part")
def container_tracks(spark, sf_dir):
    kinds = F.element_at(F.array(*[F.lit(x) for x in ("video", "audio", "subtitles", "buttons")]), (c("p_size") % 4 + 1).cast("int"))
    entry = F.struct((c("p_partkey") % 5).alias("id"), kinds.alias("type"), c("p_type").alias("codec"), F.struct(F.when(c("p_size") % 3 != 0, c("p_brand")).alias("language")).alias("properties"))
    return K.container_tracks(_json(_parts(spark, sf_dir), "page", "tracks", entry))


@query("S38_progress_rows", "SELECT l_orderkey * 1000 + l_linenumber AS line_no, (l_quantity::BIGINT) AS percent, l_partkey AS lba, l_orderkey AS last_lba, l_suppkey AS scsi, l_linenumber::BIGINT AS c2, 0::BIGINT AS q FROM lineitem WHERE l_returnflag <> 'N'")
def progress_rows(spark, sf_dir):
    line = F.format_string("/ [%3d%%] LBA: %6d/%d, errors: { SCSI: %d, C2: %d, Q: 0 }", c("l_quantity").cast("long"), "l_partkey", "l_orderkey", "l_suppkey", "l_linenumber")
    rows = table(spark, sf_dir, "lineitem").select((c("l_orderkey") * 1000 + c("l_linenumber")).alias("line_no"), F.when(c("l_returnflag") == "N", "dump started").otherwise(line).alias("value"))
    return X.progress(rows)


@query("S39_rom_rows", "SELECT p_partkey AS line_no, replace(p_name, '#', '&') || '.bin' AS name, p_size::BIGINT AS size, 'abc' || p_size AS crc32, md5(p_name) AS md5, sha1(p_name) AS sha1 FROM part WHERE p_size % 3 <> 0")
def rom_rows(spark, sf_dir):
    line = F.concat(F.lit('  <rom name="'), F.replace(F.col("p_name"), F.lit("#"), F.lit("&amp;")), F.lit('.bin" size="'), c("p_size").cast("string"), F.lit('" crc="ABC'), c("p_size").cast("string"), F.lit('" md5="'), F.upper(F.md5("p_name")), F.lit('" sha1="'), F.sha1("p_name"), F.lit('" />'))
    return X.rom_hashes(table(spark, sf_dir, "part").select(c("p_partkey").alias("line_no"), F.when(c("p_size") % 3 != 0, line).otherwise("rom:").alias("value")))


@query("S44_metadata_rows", "SELECT l_orderkey AS path, 'key ' || l_linenumber % 3 AS key, arg_max(l_partkey::VARCHAR, l_linenumber * 100000000 + l_partkey * 1000 + l_suppkey) AS value FROM lineitem WHERE l_returnflag <> 'N' GROUP BY ALL")
def metadata_rows(spark, sf_dir):
    line = F.concat(F.lit("key "), (c("l_linenumber") % 3).cast("string"), F.lit(":  "), c("l_partkey").cast("string"))
    rows = table(spark, sf_dir, "lineitem").select(c("l_orderkey").alias("path"), (c("l_linenumber").cast("long") * 100000000 + c("l_partkey") * 1000 + c("l_suppkey")).alias("line_no"), F.when(c("l_returnflag") == "N", "no colon here").otherwise(line).alias("value"))
    return X.metadata(rows)


@query("S51_chosen_stream", "SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN 2 ELSE 1 END AS pos, CASE WHEN p_size % 3 = 0 THEN 'subrip' ELSE 'dvd_subtitle' END AS codec FROM part WHERE p_size % 3 = 0 OR p_size % 2 = 0")
def chosen_stream(spark, sf_dir):
    """The first text stream, else the first picture stream that isn't forced."""
    csv = F.concat(F.lit("eia_608,0\r\ndvd_subtitle,"), (c("p_size") % 2).cast("string"), F.when(c("p_size") % 3 == 0, "\nsubrip,0\n").otherwise("\n"))
    return X.chosen_stream(X.streams(table(spark, sf_dir, "part").select("p_partkey", csv.alias("csv")), "p_partkey", "csv"), "p_partkey")


@query("S27_releases", "SELECT p_partkey::VARCHAR AS id, p_name AS title, p_brand || ' feat. ' || p_type AS artist, p_size::VARCHAR || '00-05' AS date, substr(p_size::VARCHAR || '00-05', 1, 4) AS year, 'official' AS status, p_type AS label, CASE WHEN p_size % 2 = 0 THEN 'Rock' ELSE 'Jazz' END AS genre FROM part WHERE p_size % 7 <> 0")
def releases(spark, sf_dir):
    """S27, S28, S31 and A24."""
    credit = F.array(F.struct(c("p_brand").alias("name"), F.lit(" feat. ").alias("joinphrase")), F.struct(c("p_type").alias("name"), F.lit("").alias("joinphrase")))
    genres = F.array(F.struct(F.lit("jazz").alias("name"), F.lit(3).alias("count")), F.struct(F.lit("rock").alias("name"), F.when(c("p_size") % 2 == 0, 4).otherwise(3).alias("count")))
    entry = F.struct(c("p_partkey").cast("string").alias("id"), F.when(c("p_size") % 7 != 0, c("p_name")).otherwise("").alias("title"), F.concat(c("p_size").cast("string"), F.lit("00-05")).alias("date"), F.lit("Official").alias("status"), credit.alias("artist-credit"), genres.alias("genres"), F.array(F.struct(F.struct(c("p_type").alias("name")).alias("label"))).alias("label-info"))
    return K.releases(_json(_parts(spark, sf_dir), "page", "releases", entry)).select("id", "title", "artist", "date", "year", "status", "label", "genre")
