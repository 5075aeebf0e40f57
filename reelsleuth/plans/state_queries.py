"""Queries of state reconciliation. Orders stand for jobs, their lines for files."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from reelsleuth.functions import naming as N
from reelsleuth.functions import text as X
from reelsleuth.operators import state as T

from .base import query, table

c = F.col
_CATEGORY = "CASE l_linenumber % 4 WHEN 0 THEN 'games' WHEN 1 THEN 'movies' WHEN 2 THEN 'shows' ELSE 'music' END"
_FILES = f"files AS (SELECT l_orderkey AS job, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS ix, {_CATEGORY} AS category, floor(l_extendedprice)::BIGINT AS bytes, sha256(l_partkey::VARCHAR) AS sha256, l_partkey AS part FROM lineitem)"
#: name, root, categories (none: all), free bytes (null: unknown).
DESTINATIONS = [(0, "/mnt/roms", ["games"], 900_000_000), (1, "/mnt/video", ["movies", "shows"], 10_000), (2, "/mnt/more", ["shows"], 5), (3, "/mnt/any", ["games", "music"], None)]


def files(spark, sf_dir):
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    kind = F.element_at(F.array(*[F.lit(x) for x in ("games", "movies", "shows", "music")]), (c("l_linenumber") % 4 + 1).cast("int"))
    return table(spark, sf_dir, "lineitem").select(
        c("l_orderkey").alias("job"), F.row_number().over(w).cast("long").alias("ix"), kind.alias("category"), F.floor("l_extendedprice").cast("long").alias("bytes"), F.sha2(c("l_partkey").cast("string"), 256).alias("sha256"), c("l_partkey").alias("part"),
    )


_ROUTE = "CASE category WHEN 'games' THEN '/mnt/roms' WHEN 'music' THEN '/mnt/any' ELSE '/mnt/video' END"


@query("J21_route", f"WITH {_FILES} SELECT job, ix, category, {_ROUTE} AS root FROM files")
def route(spark, sf_dir):
    dest = spark.createDataFrame(DESTINATIONS, "at int, root string, media array<string>, free long")
    return T.route(files(spark, sf_dir), dest, "category").select("job", "ix", "category", "root")


@query("A09_space_needed", f"WITH {_FILES} SELECT root, needed, free, CASE WHEN free IS NULL THEN 'unknown' WHEN free < needed THEN 'short' ELSE 'ok' END AS verdict FROM (SELECT {_ROUTE} AS root, sum(bytes)::BIGINT AS needed, max(CASE category WHEN 'games' THEN 900000000 WHEN 'music' THEN NULL ELSE 10000 END)::BIGINT AS free FROM files GROUP BY 1)")
def space(spark, sf_dir):
    dest = spark.createDataFrame(DESTINATIONS, "at int, root string, media array<string>, free long")
    return T.space(T.route(files(spark, sf_dir), dest, "category"))


@query(
    "C58_migrate_plan",
    f"WITH {_FILES} SELECT job, ix, CASE WHEN o_orderstatus <> 'F' THEN 'not identified' WHEN category = 'music' AND bytes < 20000 THEN 'exists' ELSE 'move' END AS action, {_ROUTE} || '/' || ix || '.iso' AS target FROM files JOIN orders ON o_orderkey = job",
)
def migrate_plan(spark, sf_dir):
    """P26, J21 and F35 in one plan: what moves where, and what stays and why."""
    dest = spark.createDataFrame(DESTINATIONS, "at int, root string, media array<string>, free long")
    routed = T.route(files(spark, sf_dir), dest, "category")
    rows = routed.join(table(spark, sf_dir, "orders").select(c("o_orderkey").alias("job"), "o_orderstatus"), "job")
    path = F.concat(F.lit("ready/"), c("category"), F.lit("/"), c("ix").cast("string"), F.lit(".iso"))
    action = F.when(c("o_orderstatus") != "F", "not identified").when((c("category") == "music") & (c("bytes") < 20000), "exists").otherwise("move")
    return rows.select("job", "ix", action.alias("action"), N.destination_path(c("root"), path).alias("target"))


_DISK = "disk AS (SELECT job, ix, bytes + CASE WHEN part % 13 = 0 THEN 1 ELSE 0 END AS bytes, CASE WHEN part % 17 = 0 THEN 'x' ELSE sha256 END AS sha256 FROM files WHERE part % 11 <> 0)"


def disk(rows):
    return rows.where("part % 11 <> 0").select("job", "ix", (c("bytes") + F.when(c("part") % 13 == 0, 1).otherwise(0)).alias("bytes"), F.when(c("part") % 17 == 0, "x").otherwise(c("sha256")).alias("sha256"))


_VERDICT = "CASE WHEN d.job IS NULL THEN 'missing' WHEN f.bytes <> d.bytes THEN 'size' WHEN f.sha256 <> d.sha256 THEN 'hash' ELSE 'ok' END"


@query("J23_verify_reconcile", f"WITH {_FILES}, {_DISK} SELECT f.job, f.ix, {_VERDICT} AS verdict FROM files f LEFT JOIN disk d ON f.job = d.job AND f.ix = d.ix")
def verify(spark, sf_dir):
    rows = files(spark, sf_dir)
    return T.reconcile(rows, disk(rows), ["job", "ix"]).select("job", "ix", "verdict")


@query("C60_verified_jobs", f"WITH {_FILES}, {_DISK} SELECT f.job, count(*) AS files, bool_and({_VERDICT} = 'ok') AS sound FROM files f LEFT JOIN disk d ON f.job = d.job AND f.ix = d.ix GROUP BY f.job")
def verified_jobs(spark, sf_dir):
    rows = files(spark, sf_dir)
    return T.reconcile(rows, disk(rows), ["job", "ix"]).groupBy("job").agg(F.count(F.lit(1)).alias("files"), F.bool_and(c("verdict") == "ok").alias("sound"))


@query("J24_located", f"WITH {_FILES} SELECT job, ix, CASE WHEN part % 3 = 0 THEN 'staging' WHEN part % 5 <> 0 THEN 'destination' ELSE 'missing' END AS place FROM files")
def located(spark, sf_dir):
    rows = files(spark, sf_dir).withColumn("key", F.concat_ws(":", "job", "ix"))
    return T.located(rows, rows.where("part % 3 = 0"), rows.where("part % 5 <> 0"), "key").select("job", "ix", "place")


_TIER = "CASE ix % 3 WHEN 0 THEN 'redundant' WHEN 1 THEN 'provenance' ELSE 'audit' END"


@query("J25_clean_plan", f"WITH {_FILES} SELECT job, ix, CASE WHEN ix % 3 <> 0 THEN 'keep' WHEN part % 7 <> 0 AND part % 5 <> 0 THEN 'drop' ELSE 'keep: not proven' END AS action FROM files")
def clean_plan(spark, sf_dir):
    """J25 and C61."""
    rows = files(spark, sf_dir).withColumn("key", F.concat_ws(":", "job", "ix")).withColumn("tier", F.element_at(F.array(*[F.lit(x) for x in ("redundant", "provenance", "audit")]), (c("ix") % 3 + 1).cast("int")))
    stored = rows.where("part % 7 <> 0").select("key", F.when(c("part") % 5 == 0, "other").otherwise(c("sha256")).alias("sha256"))
    return T.reclaimable(rows, stored, "key").select("job", "ix", "action")


@query("A30_retained_by_tier", f"WITH {_FILES} SELECT {_TIER} AS tier, count(*) AS files, sum(bytes)::BIGINT AS bytes FROM files GROUP BY 1")
def retained(spark, sf_dir):
    rows = files(spark, sf_dir).withColumn("tier", F.element_at(F.array(*[F.lit(x) for x in ("redundant", "provenance", "audit")]), (c("ix") % 3 + 1).cast("int")))
    return rows.groupBy("tier").agg(F.count(F.lit(1)).alias("files"), F.sum("bytes").alias("bytes"))


@query("C59_retire_plan", f"WITH {_FILES} SELECT DISTINCT job, part FROM files WHERE ix = 1 AND (job, part) NOT IN (SELECT job, part FROM files WHERE ix > 1)")
def retire_plan(spark, sf_dir):
    rows = files(spark, sf_dir).withColumn("path", F.concat_ws("/", "job", "part"))
    return T.retired(rows.where("ix = 1"), rows.where("ix > 1"), "path").select("job", "part").distinct()


@query("U08_except", f"WITH {_FILES} SELECT job, count(*) AS kept FROM files WHERE part % 4 <> 0 GROUP BY job")
def moved_except(spark, sf_dir):
    rows = files(spark, sf_dir).select("job", "ix", "part")
    moved = rows.where("part % 4 = 0").select("job", "ix")
    return rows.join(moved, ["job", "ix"], "left_anti").groupBy("job").agg(F.count(F.lit(1)).alias("kept"))


@query("J19_unknown_candidates", "SELECT p_partkey FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_linenumber = 7)")
def unknown(spark, sf_dir):
    known = table(spark, sf_dir, "lineitem").where("l_linenumber = 7").select("l_partkey")
    return table(spark, sf_dir, "part").join(known, c("p_partkey") == c("l_partkey"), "left_anti").select("p_partkey")


@query("J20_missing_episodes", "SELECT o_custkey AS season, o_orderkey AS episode FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
def missing(spark, sf_dir):
    return table(spark, sf_dir, "orders").join(table(spark, sf_dir, "lineitem"), c("o_orderkey") == c("l_orderkey"), "left_anti").select(c("o_custkey").alias("season"), c("o_orderkey").alias("episode"))


@query("A26_merged_identification", "SELECT l_orderkey AS job, coalesce(min(l_partkey) FILTER (l_returnflag = 'N'), min(l_partkey)) AS path, min(l_linenumber) AS confidence, array_to_string(list_sort(list(DISTINCT CASE WHEN l_returnflag = 'N' THEN 'b' ELSE 'a' END)), '; ') AS matched_on FROM lineitem GROUP BY l_orderkey")
def merged_identification(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem")
    made = lambda flag, name: rows.where(flag).select(c("l_orderkey").alias("job"), c("l_partkey").alias("path"), c("l_linenumber").alias("confidence"), F.lit(name).alias("matched_on"))
    return T.merged_identification(made("l_returnflag <> 'N'", "a"), made("l_returnflag = 'N'", "b"), "job")


@query("K07_case_variants", "SELECT DISTINCT p_name AS name, upper(p_name) AS variant FROM part")
def case_variants(spark, sf_dir):
    names = table(spark, sf_dir, "part").select(c("p_name").alias("name")).distinct()
    return T.case_variants(names, names.select(F.upper("name").alias("name")), "name")


@query("J27_language_tracks", "SELECT doc_id, kind, language, CASE WHEN bool_or(language IN ('fr', 'en')) OVER (PARTITION BY source, kind) THEN language IN ('fr', 'en') ELSE true END AS keep FROM (SELECT doc_id, source, doc_id % 2 AS kind, lang AS language FROM documents)")
def language_tracks(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", "source", (c("doc_id") % 2).alias("kind"), c("lang").alias("language"))
    return T.choose_tracks(rows, ["source"], ["FR", "en"]).select("doc_id", "kind", "language", "keep")


@query("J31_ripped_names", f"WITH {_FILES}, t AS (SELECT job, ix AS name, bytes // 10000 AS bytes, part FROM files), g AS (SELECT job, bytes, min(name) AS name FROM t WHERE part % 3 = 0 GROUP BY job, bytes HAVING count(*) = 1) SELECT t.job, t.part AS path, g.name FROM t JOIN g USING (job, bytes) WHERE t.part % 3 = 1")
def ripped_names(spark, sf_dir):
    titles = files(spark, sf_dir).select("job", c("ix").alias("name"), F.floor(c("bytes") / 10000).alias("bytes"), "part")
    return T.recovered_names(titles.where("part % 3 = 1").select("job", "bytes", c("part").alias("path")), titles.select("job", "name", "bytes"), titles.where("part % 3 <> 0").select("job", "name"), "job")


@query("S07_job_listing", "SELECT o_orderkey AS job, count(l_orderkey) AS artifacts, coalesce(sum(floor(l_extendedprice)::BIGINT), 0)::BIGINT AS bytes FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey")
def job_listing(spark, sf_dir):
    """S07 and A11."""
    sums = files(spark, sf_dir).groupBy("job").agg(F.count(F.lit(1)).alias("artifacts"), F.sum("bytes").alias("bytes"))
    return table(spark, sf_dir, "orders").select(c("o_orderkey").alias("job")).join(sums, "job", "left").fillna(0)


@query("S19_filed_episodes", "SELECT DISTINCT l_orderkey AS season, l_linenumber AS number FROM lineitem WHERE l_tax > 0.04")
def filed_episodes(spark, sf_dir):
    names = table(spark, sf_dir, "lineitem").select("l_orderkey", F.when(c("l_tax") > 0.04, F.concat(F.lit("Show - "), N.episode_code(F.lit(5), c("l_linenumber")), F.lit(".mkv"))).otherwise("note.txt").alias("name"))
    found = names.select(c("l_orderkey").alias("season"), F.nullif(F.regexp_extract("name", r"S05E(\d+)", 1), F.lit("")).try_cast("int").alias("number"))
    return found.where("number IS NOT NULL").distinct()


@query("A06_titles_by_episode", "SELECT l_partkey % 50 AS episode, count(*) AS titles, array_to_string(list_sort(list(DISTINCT l_suppkey % 10)), ',') AS discs FROM lineitem GROUP BY 1")
def titles_by_episode(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").groupBy((c("l_partkey") % 50).alias("episode"))
    return rows.agg(F.count(F.lit(1)).alias("titles"), F.array_join(F.array_sort(F.collect_set(c("l_suppkey") % 10)), ",").alias("discs"))


@query("J17_range_parts", "WITH p AS (SELECT l_orderkey AS program, ix, sum(size) OVER w - size AS base, sum(size) OVER w AS stop FROM (SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS ix, l_quantity::BIGINT AS size FROM lineitem) WINDOW w AS (PARTITION BY l_orderkey ORDER BY ix)) SELECT program, ix, (greatest(base, 20) - base)::BIGINT AS start, (least(stop, 60) - greatest(base, 20))::BIGINT AS length FROM p WHERE greatest(base, 20) < least(stop, 60)")
def range_parts(spark, sf_dir):
    """Bytes 20 to 60 of each program, as places in its parts."""
    w = Window.partitionBy("program").orderBy("ix")
    ix = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")).cast("long")
    rows = table(spark, sf_dir, "lineitem").select(c("l_orderkey").alias("program"), ix.alias("ix"), c("l_quantity").cast("long").alias("size"))
    rows = rows.withColumn("stop", F.sum("size").over(w)).withColumn("base", c("stop") - c("size"))
    start, stop = F.greatest("base", F.lit(20)), F.least("stop", F.lit(60))
    return rows.where(start < stop).select("program", "ix", (start - c("base")).alias("start"), (stop - start).alias("length"))


_LINES = ['CINFO:1,0,"A"', 'TINFO:0,8,0,"5"', 'TINFO:0,9,0,"1:02:03"', 'TINFO:0,11,0,"4000"', 'TINFO:1,8,0,"2"', 'TINFO:1,9,0,"0:45:00"', 'TINFO:0,8,0,"6"', 'MSG:5011,0,"done"', 'TINFO:1,27,0,"B_t01.mkv"']


@query("S36_robot_titles", "SELECT * FROM (VALUES (0, 6, 3723, 4000, NULL, true), (1, 2, 2700, NULL, 'B_t01.mkv', true)) AS t(title, chapters, seconds, bytes, output, success)")
def robot_titles(spark, sf_dir):
    from reelsleuth.sources.text_formats import robot_scan

    return robot_scan(spark.createDataFrame(list(enumerate(_LINES)), "line_no int, value string"))


@query("S26_reference_text", "SELECT item_id, 'Item ' || item_id || ' ' || text AS reference FROM benchmark")
def reference_text(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select("item_id", F.concat_ws(" ", F.concat(F.lit("Item "), "item_id"), "text").alias("reference"))


@query("W21_srt_halves", "SELECT * FROM (VALUES (1, 'one two three', 'four five'), (2, '', 'alone')) AS t(id, first, second)")
def srt_halves(spark, sf_dir):
    from reelsleuth.sources.text_formats import split_srt

    cue = lambda n, s, t: f"{n}\n00:{s:02d}:00,000 --> 00:{s:02d}:05,000\n{t}\n"
    rows = [(1, "\n".join([cue(1, 1, "one two"), cue(2, 2, "three"), cue(3, 20, "four"), cue(4, 30, "five")])), (2, cue(1, 0, "alone"))]
    halves = split_srt(spark.createDataFrame(rows, "id int, srt string"), "id", "srt")
    return halves.select("id", X.dialogue_text(c("first")).alias("first"), X.dialogue_text(c("second")).alias("second"))
