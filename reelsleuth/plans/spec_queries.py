"""Queries of notes, paths, specifications, log rows and small files, built from columns of the tables and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from reelsleuth.functions import specs as P
from reelsleuth.functions.labels import title_name
from reelsleuth.sources import dump_logs as L

from .base import query, sql_query, table

c = F.col


def part(spark, sf_dir):
    return table(spark, sf_dir, "part")


@query("F06_glued_number", "SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN p_size WHEN 1 THEN p_size END::INT AS number FROM part")
def glued_number(spark, sf_dir):
    token = F.when(c("p_size") % 3 == 0, F.concat(F.lit("Season"), "p_size")).when(c("p_size") % 3 == 1, F.concat(F.lit("DISC"), "p_size")).otherwise(F.concat(F.lit("XDISC"), "p_size"))
    return part(spark, sf_dir).select("p_partkey", P.glued_number(token, ["season", "disc"]).alias("number"))


@query("F22_search_query", "SELECT p_partkey, 'languages=en&query=' || replace(replace(lower(p_name || ' ' || p_brand), ' ', '%20'), '#', '%23') || '&season_number=' || p_size AS query FROM part")
def search_query(spark, sf_dir):
    params = F.create_map(F.lit("season_number"), c("p_size").cast("string"), F.lit("query"), F.concat_ws(" ", "p_name", "p_brand"), F.lit("languages"), F.lit("EN"))
    return part(spark, sf_dir).select("p_partkey", P.search_query(params).alias("query"))


@query("F27_hex", "SELECT doc_id, lower(hex(encode(substr(coalesce(lang, ''), 1, 2) || source))) AS hex FROM documents")
def hex_of(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", P.hex_of(F.encode(F.concat(F.substring(F.coalesce("lang", F.lit("")), 1, 2), "source"), "UTF-8")).alias("hex"))


@query("F34_delta_note", "SELECT p_partkey, CASE WHEN p_size % 7 = 0 THEN 'no runtime published' ELSE 'delta ' || round_even(p_size / 2.0, 0)::BIGINT || ' min' END AS note FROM part")
def delta_note(spark, sf_dir):
    return part(spark, sf_dir).select("p_partkey", P.delta_note(F.when(c("p_size") % 7 != 0, c("p_size") / 2)).alias("note"))


@query("F38_film_paths", "SELECT p_partkey, 'ready/movies/' || f || '/' || f || '.mkv' AS feature, 'ready/movies/' || f || '/Trailers/' || p_brand || '.mkv' AS extra FROM (SELECT *, CASE WHEN p_size % 5 = 0 THEN p_name ELSE p_name || ' (' || (1950 + p_size) || ')' END AS f FROM part)")
def film_paths(spark, sf_dir):
    folder = P.film_folder(c("p_name"), F.when(c("p_size") % 5 != 0, 1950 + c("p_size")))
    return part(spark, sf_dir).select("p_partkey", P.feature_path(folder, F.lit("mkv")).alias("feature"), P.extra_path(folder, F.lit("Trailers"), c("p_brand"), F.lit("mkv")).alias("extra"))


@query(
    "F40_extra_spec",
    "SELECT p_partkey, CASE WHEN p_size % 5 > 2 THEN 't' || p_size END AS title, CASE WHEN p_size % 5 = 3 THEN 'Trailers' WHEN p_size % 5 = 4 THEN 'Featurettes' END AS category, CASE WHEN p_size % 5 > 2 THEN p_name || '=/x' END AS name, "
    "CASE p_size % 5 WHEN 0 THEN 'expected TITLE=Category/Name' WHEN 1 THEN 'expected a category and a name' WHEN 2 THEN 'not an extras folder' END AS error FROM part",
)
def extra_spec(spark, sf_dir):
    n = c("p_size") % 5
    rest = F.when(n == 1, "=Trailers").when(n == 2, "=Nonsense/x").when(n == 3, F.concat(F.lit("= trailer/ "), "p_name", F.lit("=/x"))).when(n == 4, F.concat(F.lit("=FEATURETTES/"), "p_name", F.lit("=/x "))).otherwise("")
    spec = F.concat(F.lit(" t"), c("p_size").cast("string"), F.lit(" "), rest)
    return part(spark, sf_dir).select("p_partkey", P.extra_spec(spec).alias("s")).select("p_partkey", "s.*")


@query("F41_track_drop", "SELECT p_partkey, CASE WHEN p_size % 4 > 1 THEN 't' || p_size || '.mkv' END AS title, CASE p_size % 4 WHEN 2 THEN p_size::VARCHAR WHEN 3 THEN p_size || '+7' END AS tracks, CASE p_size % 4 WHEN 0 THEN 'expected TITLE=TRACK' WHEN 1 THEN 'tracks are numbers' END AS error FROM part")
def track_drop(spark, sf_dir):
    n, size = c("p_size") % 4, c("p_size").cast("string")
    spec = F.concat(F.lit("raw/t"), size, F.lit(".mkv "), F.when(n == 1, "=2,x").when(n == 2, F.concat(F.lit("= "), size)).when(n == 3, F.concat(F.lit("="), size, F.lit(", 7 "))).otherwise(""))
    return part(spark, sf_dir).select("p_partkey", P.track_drop(spec).alias("s")).select("p_partkey", "s.title", F.array_join("s.tracks", "+").alias("tracks"), "s.error")


@query("F43_game_serial", "SELECT p_partkey, CASE WHEN p_size % 4 <> 0 THEN 'SLUS-' || lpad((p_partkey % 1000)::VARCHAR, 3, '0') || lpad(p_size::VARCHAR, 2, '0') END AS serial, CASE WHEN p_size % 4 <> 0 THEN CASE WHEN p_size % 2 = 0 THEN 'ps2' ELSE 'psx' END END AS platform FROM part")
def game_serial(spark, sf_dir):
    key = F.when(c("p_size") % 4 == 0, "HDDUNITPOWER").when(c("p_size") % 2 == 0, "boot2 ").otherwise("BOOT")
    text = F.concat(F.lit("VER = 1.00\r\nBOOT = none\r\n"), key, F.lit("= cdrom0:\\slus_"), F.lpad((c("p_partkey") % 1000).cast("string"), 3, "0"), F.lit("."), F.lpad(c("p_size").cast("string"), 2, "0"), F.lit(";1\r\nVMODE = NTSC"))
    return part(spark, sf_dir).select("p_partkey", P.game_serial(text).alias("s")).select("p_partkey", "s.*")


@query("F53_cue_retargeted", "SELECT p_partkey, 'FILE \"' || CASE WHEN p_size % 2 = 0 THEN p_brand || '.bin' ELSE p_name || ' \"x\".bin' END || '\" BINARY' || chr(13) || chr(10) || '  TRACK 01 AUDIO' || chr(13) || chr(10) AS cue FROM part")
def cue_retargeted(spark, sf_dir):
    """files that a map names get their archival name, lines end with CR LF."""
    old = F.concat("p_name", F.lit(' "x".bin'))
    cue = F.concat(F.lit('FILE "'), old, F.lit('" BINARY\n  TRACK 01 AUDIO\r\n'))
    renames = F.create_map(F.when(c("p_size") % 2 == 0, old).otherwise("other"), F.concat("p_brand", F.lit(".bin")))
    return part(spark, sf_dir).select("p_partkey", P.retarget(cue, renames).alias("cue"))


@query("F55_shifted_sector", "SELECT p_partkey, CASE WHEN p_partkey - p_size >= 32 THEN p_partkey - p_size END AS sector FROM part")
def shifted_sector(spark, sf_dir):
    return part(spark, sf_dir).select("p_partkey", P.shifted(c("p_partkey"), c("p_size")).alias("sector"))


@query("F59_assigned_codes", "SELECT season, episode, count(*) AS titles, count(*) > 1 AS twice FROM (SELECT p_size % 9 AS season, p_partkey % 30 AS episode FROM part WHERE p_size % 3 <> 0) GROUP BY ALL")
def assigned_codes(spark, sf_dir):
    """Assignments by hand, and those that name an episode twice."""
    spec = F.concat(F.lit("t"), c("p_partkey").cast("string"), F.when(c("p_size") % 3 == 0, "=S1").otherwise(F.format_string("=s%02dE%02d", c("p_size") % 9, c("p_partkey") % 30)))
    rows = part(spark, sf_dir).select(P.assigned_code(spec).alias("a")).where("a IS NOT NULL")
    return rows.groupBy("a.season", "a.episode").agg(F.count(F.lit(1)).alias("titles")).withColumn("twice", c("titles") > 1)


@query("O15_track_bins", "SELECT l_orderkey AS disc, array_to_string(list(n ORDER BY n, l_partkey), ',') AS numbers FROM (SELECT l_orderkey, l_partkey, CASE WHEN l_linenumber % 3 = 0 THEN 0 ELSE l_linenumber END AS n FROM lineitem WHERE l_returnflag <> 'A') GROUP BY 1")
def track_bins(spark, sf_dir):
    """A disc's .bin files by track number, those without one first."""
    name = F.concat(F.lit("raw/d"), F.when(c("l_linenumber") % 3 == 0, "").otherwise(F.format_string(" (Track %02d)", c("l_linenumber"))), F.when(c("l_returnflag") == "A", ".log").otherwise(".BIN"))
    rows = table(spark, sf_dir, "lineitem").select(c("l_orderkey").alias("disc"), "l_partkey", name.alias("path")).where(P.is_image(c("path"))).withColumn("n", P.bin_number(c("path")))
    # A disc's files, a few dozen.
    return rows.groupBy("disc").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "l_partkey"))), lambda x: x["n"].cast("string")), ",").alias("numbers"))


@query("A08_rips_by_disc", "SELECT 'Disc ' || l_suppkey % 50 AS label, array_to_string(list(l_linenumber ORDER BY l_linenumber), ',') AS titles FROM lineitem WHERE l_returnflag <> 'A' GROUP BY 1")
def rips_by_disc(spark, sf_dir):
    """Rips by disc, titles in index order; files with other names are left out."""
    name = F.when(c("l_returnflag") == "A", "x.m2ts").otherwise(F.format_string("Disc %d_t%02d.mkv", c("l_suppkey") % 50, c("l_linenumber")))
    label, index = title_name(name)
    rows = table(spark, sf_dir, "lineitem").select(label.alias("label"), index.alias("ix")).where("ix IS NOT NULL")
    counted = rows.groupBy("label", "ix").agg(F.count(F.lit(1)).alias("n"))  # equal indexes count once before they are gathered
    return counted.groupBy("label").agg(F.array_join(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct(c("ix").cast("int").alias("ix"), "n"))), lambda x: F.array_repeat(x["ix"].cast("string"), x["n"].cast("int")))), ",").alias("titles"))


@query("C80_card_text", "SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN 'preview of the next episode' WHEN p_size % 2 = 0 THEN 'preview of episode ' || p_size ELSE 'title card for episode ' || p_size END AS note FROM part")
def card_text(spark, sf_dir):
    return part(spark, sf_dir).select("p_partkey", P.card_text(F.when(c("p_size") % 3 != 0, c("p_size")), c("p_size") % 2 == 0).alias("note"))


@query(
    "K13_tag_frames",
    "SELECT p_partkey, 'TIT2=' || p_name || ';TPE1=' || p_brand || ';TRCK=' || p_size || '/50;TALB=' || p_type || ';TPOS=1/2' || CASE WHEN p_size % 2 = 0 THEN ';TDRC=' || (1950 + p_size) ELSE '' END || ';TPE2=' || p_brand || ';TSO2=' || p_brand || ';TSOP=' || p_brand || ';TLEN=' || p_partkey * 1000 "
    "|| CASE WHEN p_size % 7 = 0 THEN ';TCMP=1' ELSE '' END || ';TSSE=enc' AS frames FROM part",
)
def tag_frames(spark, sf_dir):
    """The text frames; absent values leave no frame."""
    none = F.lit(None).cast("string")
    release = {"title": c("p_type"), "artist": c("p_brand"), "artist_sort": c("p_brand"), "artist_id": F.when(c("p_size") % 7 == 0, P.VARIOUS_ARTISTS), "date": F.when(c("p_size") % 2 == 0, (1950 + c("p_size")).cast("string")), "genre": none, "label": none, "original": none, "media": F.lit(2)}
    medium = {"position": F.lit(1), "format": none, "tracks": F.lit(50)}
    track = {"title": c("p_name"), "artist": c("p_brand"), "artist_sort": c("p_brand"), "position": c("p_size"), "length_ms": c("p_partkey") * 1000, "isrc": none}
    return part(spark, sf_dir).select("p_partkey", F.array_join(F.transform(P.tag_frames(release, medium, track, "enc"), lambda f: F.concat(f["id"], F.lit("="), f["text"])), ";").alias("frames"))


# --- Log rows of a dump: lines are written from columns and read back.


def _log(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem")
    line = (
        F.when(c("l_returnflag") == "R", F.format_string("  errors detected, track: %d, sectors: 1, samples: { SKIP: %d, C2: %d, Q: 0 }", c("l_linenumber"), c("l_quantity").cast("long"), F.when(c("l_tax") > 0.06, 3).otherwise(0)))
        .when(c("l_returnflag") == "A", F.format_string("  track %d { audio }", c("l_linenumber"))).otherwise(F.format_string("sectors count (READ_CAPACITY): %d", c("l_partkey")))
    )
    return rows.select(c("l_orderkey").alias("disc"), c("l_linenumber").alias("at"), line.alias("line"))


@query("S40_log_rows", "SELECT l_orderkey AS disc, l_linenumber AS at, CASE l_returnflag WHEN 'R' THEN l_linenumber END::BIGINT AS track, CASE l_returnflag WHEN 'R' THEN l_quantity END::BIGINT AS skip_samples, CASE l_returnflag WHEN 'R' THEN CASE WHEN l_tax > 0.06 THEN 3 ELSE 0 END END::BIGINT AS c2_samples, CASE l_returnflag WHEN 'A' THEN l_linenumber END AS listed, CASE WHEN l_returnflag NOT IN ('R', 'A') THEN l_partkey END AS sectors FROM lineitem")
def log_rows(spark, sf_dir):
    """S40, S41 and S42."""
    rows = _log(spark, sf_dir).select("disc", "at", L.track_errors(c("line")).alias("e"), L.toc_track(c("line")).alias("listed"), L.sector_count(c("line")).alias("sectors"))
    return rows.select("disc", "at", "e.*", "listed", "sectors")


@query("P17_overread_only", "SELECT l_orderkey AS disc, bool_and(l_linenumber = 4 AND l_tax <= 0.06 AND l_quantity <= 30) AS excused FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1")
def overread_only(spark, sf_dir):
    errors = _log(spark, sf_dir).select("disc", L.track_errors(c("line")).alias("e")).where("e IS NOT NULL").select("disc", "e.*").withColumn("last", F.lit(4)).withColumn("offset", F.lit(30))
    return L.leadout_overread_only(errors, "disc", "last", "offset")


@query(
    "S43_drive_config",
    "WITH x AS (SELECT l_orderkey AS disc, l_linenumber * 100000000 + l_partkey * 1000 + l_suppkey % 1000 AS nth, l_shipdate, l_returnflag AS f, l_quantity::BIGINT AS q FROM lineitem) "
    "SELECT disc, arg_max('X' || q || ' (sector order: ' || CASE WHEN q % 2 = 0 THEN 'DATA_C2' ELSE 'DATA_SUB' END || ')', nth) FILTER (f = 'R') AS summary, arg_max(CASE WHEN f = 'A' THEN 'AUTO' || q WHEN q % 2 = 0 THEN 'DATA_C2' ELSE 'DATA_SUB' END, nth) FILTER (f <> 'N') AS sector_order, coalesce(bool_or(f = 'N' AND q > 25), false) AS generic, bool_or(f = 'A') AS auto_detected FROM x GROUP BY disc",
)
def drive_config(spark, sf_dir):
    q = c("l_quantity").cast("long")
    order = F.when(q % 2 == 0, "DATA_C2").otherwise("DATA_SUB")
    line = F.when(c("l_returnflag") == "R", F.concat(F.lit("configuration: X"), q.cast("string"), F.lit(" (sector order: "), order, F.lit(")"))).when(c("l_returnflag") == "A", F.concat(F.lit("GENERIC: auto-detected sector order: AUTO"), q.cast("string"))).otherwise(F.when(q > 25, "  drive not found in the database").otherwise("other"))
    rows = table(spark, sf_dir, "lineitem").select(c("l_orderkey").alias("disc"), (c("l_linenumber").cast("long") * 100000000 + c("l_partkey") * 1000 + c("l_suppkey") % 1000).alias("at"), line.alias("line"))
    return L.drive_config(rows, "disc", "at", "line")


@query("P18_state_unit", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN l_quantity > 5 AND CASE WHEN l_tax > 0.02 THEN l_quantity * 4 END = l_quantity * CASE WHEN l_discount > 0.05 THEN 4 ELSE 5 END THEN 'sample' ELSE 'sector' END AS unit, coalesce(CASE WHEN l_returnflag <> 'N' THEN l_linestatus = 'F' END, false) AS clean FROM lineitem")
def state_unit(spark, sf_dir):
    """P18 and P19."""
    q = F.when(c("l_quantity") > 5, c("l_quantity")).otherwise(0).cast("long")
    scram = F.when(c("l_tax") > 0.02, q * F.when(c("l_discount") > 0.05, 4).otherwise(5))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", L.state_unit(q, scram).alias("unit"), L.is_clean(F.when(c("l_returnflag") != "N", c("l_linestatus") == "F")).alias("clean"))


# One text serves both engines.
sql_query("P13_packs", "SELECT s_suppkey, s_name IN (SELECT s_name FROM {supplier} WHERE s_acctbal > 5000) AS packs FROM {supplier}")
sql_query("P14_auto_accepted", "SELECT l_orderkey, l_linenumber, l_partkey, l_linenumber % 4 = 3 AS accepted FROM {lineitem}")
sql_query("P15_single_file_games", "SELECT l_orderkey AS game, count(*) = 1 AS whole FROM {lineitem} GROUP BY l_orderkey")
sql_query("P29_film_routing", "SELECT p_partkey, CASE WHEN p_size >= 40 THEN 'film' WHEN p_size >= 15 AND p_type LIKE '%A%' THEN 'film' ELSE 'series' END AS first_try FROM {part}")
sql_query("J08_artifact_of_title", "SELECT t.p_partkey AS title, min(a.l_orderkey) AS artifact FROM {part} t LEFT JOIN {lineitem} a ON a.l_partkey = t.p_partkey AND a.l_returnflag = 'R' GROUP BY t.p_partkey")
sql_query("J22_named_destination", "SELECT n_nationkey, n_name FROM {nation} WHERE n_regionkey IN (SELECT r_regionkey FROM {region} WHERE r_regionkey % 2 = 0)")
sql_query("S20_claimed_paths", "SELECT o_orderkey AS job, concat('/staging/', o_orderkey) AS path FROM {orders} WHERE o_orderstatus <> 'O' UNION ALL SELECT o_orderkey, concat('/d', r_regionkey, '/', o_orderkey) FROM {orders} JOIN {region} ON r_regionkey = o_orderkey % 7 WHERE o_orderstatus <> 'O'")
sql_query("S21_imports_done", "SELECT o_custkey AS label, max(o_orderkey) AS job FROM {orders} WHERE o_orderpriority LIKE '1%' AND o_orderstatus NOT IN ('P') GROUP BY o_custkey")
sql_query("C48_apply_matches", "SELECT l_orderkey AS job, count(*) AS matched, CASE WHEN count(*) = count(CASE WHEN l_linestatus = 'F' THEN 1 END) THEN 'identified' ELSE 'incomplete' END AS stage FROM {lineitem} GROUP BY l_orderkey")
sql_query("C53_named_extras", "SELECT l_orderkey AS disc, l_linenumber AS title, count(*) AS times, CASE WHEN count(*) > 1 THEN 'named twice' WHEN l_linenumber > 6 THEN 'no such title' END AS error FROM {lineitem} GROUP BY l_orderkey, l_linenumber")
sql_query("C63_reclaim_recorded", "SELECT o_custkey AS job, count(DISTINCT CASE WHEN o_orderstatus = 'F' THEN o_orderkey END) AS reclaimed, count(CASE WHEN o_orderstatus <> 'F' THEN 1 END) AS artifacts FROM {orders} GROUP BY o_custkey")
sql_query("C68_space_preflight", "SELECT c_custkey, CASE WHEN c_acctbal IS NULL THEN 'unknown' WHEN c_acctbal * 1000000 < 3000000000 THEN 'not enough' ELSE 'enough' END AS space FROM {customer}")
