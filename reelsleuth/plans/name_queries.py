"""Queries of label, name and number functions over all parts, whose columns are written into names and read back.

The fixtures that these functions must meet are in the tests.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from reelsleuth.functions import labels as L
from reelsleuth.functions import naming as N
from reelsleuth.functions import text as X

from .base import query, table

c = F.col
text = lambda k: c(k).cast("string")


def part(spark, sf_dir):
    return table(spark, sf_dir, "part")


@query("F03_label_parsers", "SELECT p_partkey, p_size % 20 + 1 AS season, p_partkey::INT % 6 + 1 AS disc, CASE WHEN p_size % 4 = 0 THEN p_size % 3 + 1 END AS part, 'show ' || p_partkey || ' s' || lpad((p_size % 20 + 1)::VARCHAR, 2, '0') || CASE WHEN p_size % 4 = 0 THEN ' p' || (p_size % 3 + 1) ELSE '' END AS search FROM part")
def label_parsers(spark, sf_dir):
    """F03, F04, F05, F08, F09, F10 and F12."""
    label = F.concat(F.lit("SHOW_"), text("p_partkey"), F.format_string("_S%02d", c("p_size") % 20 + 1), F.when(c("p_size") % 4 == 0, F.format_string("_P%d", c("p_size") % 3 + 1)).otherwise(""), F.format_string("_D%d", c("p_partkey") % 6 + 1))
    return part(spark, sf_dir).select("p_partkey", L.season_number(label).alias("season"), L.disc_number(label).alias("disc"), L.part_number(label).alias("part"), L.query_from_label(label).alias("search"))


@query("F07_camel_case", "SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN 'Show Of ' || upper(substr(md5(p_name), 1, 0)) || 'X' || p_partkey ELSE 'McX' || p_partkey END AS parted FROM part")
def camel_case(spark, sf_dir):
    word = F.when(c("p_size") % 2 == 0, F.concat(F.lit("ShowOfX"), text("p_partkey"))).otherwise(F.concat(F.lit("McX"), text("p_partkey")))
    return part(spark, sf_dir).select("p_partkey", L.split_camel(word).alias("parted"))


@query("F11_search_terms", "SELECT p_partkey, p_name AS terms FROM part")
def search_terms(spark, sf_dir):
    tail = F.when(c("p_size") % 3 == 0, F.concat(F.lit(" s"), text("p_size"))).when(c("p_size") % 3 == 1, F.concat(F.lit(" s"), text("p_size"), F.lit("p1"))).otherwise("")
    return part(spark, sf_dir).select("p_partkey", L.search_terms(F.concat("p_name", tail)).alias("terms"))


@query("F14_split_year", "SELECT p_partkey, CASE WHEN p_size % 3 = 2 THEN p_name || ' (17' || lpad(p_size::VARCHAR, 2, '0') || ')' ELSE p_name END AS title, CASE WHEN p_size % 3 = 1 THEN 1950 + p_size END::INT AS year FROM part")
def split_year(spark, sf_dir):
    q = F.when(c("p_size") % 3 == 1, F.concat("p_name", F.lit(" ("), (1950 + c("p_size")).cast("string"), F.lit(")"))).when(c("p_size") % 3 == 2, F.concat("p_name", F.format_string(" (17%02d)", "p_size"))).otherwise(c("p_name"))
    title, year = L.split_year(q)
    return part(spark, sf_dir).select("p_partkey", title.alias("title"), year.cast("int").alias("year"))


@query("F15_story_name", "SELECT p_partkey, CASE WHEN p_size % 3 > 0 THEN p_name END AS story FROM part")
def story_name(spark, sf_dir):
    name = F.when(c("p_size") % 3 == 1, F.concat("p_name", F.lit(" ("), text("p_size"), F.lit(")"))).when(c("p_size") % 3 == 2, F.concat("p_name", F.lit(" Part "), text("p_size"), F.lit(": End"))).otherwise(c("p_name"))
    return part(spark, sf_dir).select("p_partkey", L.story_name(name).alias("story"))


@query("P10_bonus_label", "SELECT p_partkey, p_size % 3 = 0 AS bonus FROM part")
def bonus_label(spark, sf_dir):
    return part(spark, sf_dir).select("p_partkey", L.is_bonus(F.concat(F.lit("SHOW"), text("p_size"), F.when(c("p_size") % 3 == 0, "_BONUS_D1").otherwise("_BONUSES"))).alias("bonus"))


@query("P11_placeholder_name", "SELECT p_partkey, p_size % 3 = 0 AS placeholder FROM part")
def placeholder_name(spark, sf_dir):
    return part(spark, sf_dir).select("p_partkey", L.is_placeholder(F.concat(F.lit("Episode "), text("p_size"), F.when(c("p_size") % 3 == 0, " ").otherwise("b"))).alias("placeholder"))


@query("S80_title_name", "SELECT p_partkey, CASE WHEN p_size % 3 > 0 THEN p_name || '_t01' END AS label, CASE WHEN p_size % 3 > 0 THEN p_size END::INT AS ix FROM part")
def title_names(spark, sf_dir):
    file = F.concat("p_name", F.lit("_t01_t"), F.lpad(text("p_size"), 2, "0"), F.when(c("p_size") % 3 == 0, ".m2ts").otherwise(".mkv"))
    label, ix = L.title_name(file)
    return part(spark, sf_dir).select("p_partkey", label.alias("label"), ix.cast("int").alias("ix"))


@query("F16_title_case", "SELECT p_partkey, array_to_string(list_transform(string_split(lower(p_name) || ' r&b', ' '), lambda w: upper(left(w, 1)) || substr(w, 2)), ' ') AS cased FROM part")
def title_case(spark, sf_dir):
    return part(spark, sf_dir).select("p_partkey", N.title_case(F.concat(F.lower("p_name"), F.lit(" r&b"))).alias("cased"))


@query("F18_unsort", "SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN p_brand || ' ' || p_name ELSE p_name END AS plain FROM part")
def unsort(spark, sf_dir):
    return part(spark, sf_dir).select("p_partkey", N.unsort(F.when(c("p_size") % 2 == 0, F.concat("p_name", F.lit(", "), "p_brand")).otherwise(c("p_name"))).alias("plain"))


@query("F23_slug", "SELECT page_id, left(trim(regexp_replace(lower(url), '[^a-z0-9]+', '-', 'g'), '-'), 48) AS slug FROM pages")
def slugs(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", N.slug(c("url")).alias("slug"))


@query("F28_safe_names", "SELECT p_partkey, p_name || '-' || p_brand || ' x' AS plain, p_name || '_' || p_brand || '_ x.' AS safe, p_name || '_' || p_brand || '_ x_' AS folder FROM part")
def safe_names(spark, sf_dir):
    """F28, F29 and F30."""
    name = F.concat("p_name", F.lit("/"), "p_brand", F.lit("? x"))
    return part(spark, sf_dir).select("p_partkey", N.sanitise(name).alias("plain"), N.picard_safe(F.concat(name, F.lit("."))).alias("safe"), N.picard_folder(F.concat(name, F.lit("."))).alias("folder"))


@query("F31_album_folder", "SELECT p_partkey, p_brand || CASE WHEN p_size % 2 = 0 THEN ' - ' || p_size ELSE '' END || ' - ' || p_name || '_' AS folder FROM part")
def album_folder(spark, sf_dir):
    return part(spark, sf_dir).select("p_partkey", N.album_folder(c("p_brand"), F.when(c("p_size") % 2 == 0, text("p_size")), F.concat("p_name", F.lit("."))).alias("folder"))


@query("F32_track_file", "SELECT p_partkey, '1-' || lpad(p_size::VARCHAR, 2, '0') || ' - ' || p_brand || '_x - ' || p_name || '.mp3' AS file FROM part")
def track_file(spark, sf_dir):
    return part(spark, sf_dir).select("p_partkey", N.track_file(F.lit(1), c("p_size"), F.concat("p_brand", F.lit("/x")), c("p_name")).alias("file"))


@query("F33_truncate", "SELECT doc_id, CASE WHEN length(text) > 40 THEN left(text, 39) || '…' ELSE text END AS short FROM documents")
def truncate(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", N.truncated(c("text"), 40).alias("short"))


@query("F35_destination_path", "SELECT p_partkey, p_type AS category, '/mnt/' || p_name || '.iso' AS target FROM part")
def destination_path(spark, sf_dir):
    """F35 and F36."""
    path = F.concat(F.when(c("p_size") % 2 == 0, "ready/").otherwise(""), "p_type", F.lit("/"), "p_name", F.lit(".iso"))
    return part(spark, sf_dir).select("p_partkey", N.category_of(path).alias("category"), N.destination_path(F.lit("/mnt"), path).alias("target"))


@query("F37_human_size", "SELECT p_partkey, CASE WHEN p_partkey >= 20 THEN printf('%.2f GB', p_partkey * 0.05::DOUBLE) ELSE (p_partkey * 50) || ' MB' END AS text FROM part")
def human_size(spark, sf_dir):
    return part(spark, sf_dir).select("p_partkey", N.human_size(c("p_partkey") * 50_000_000).alias("text"))


@query("F42_serial", "SELECT p_partkey, CASE WHEN p_size % 3 > 0 THEN 'SLUS-' || lpad((p_partkey % 1000)::VARCHAR, 3, '0') || lpad(p_size::VARCHAR, 2, '0') END AS serial FROM part")
def serials(spark, sf_dir):
    raw = F.concat(F.when(c("p_size") % 3 == 0, "SL").otherwise("slus"), F.format_string("_%03d.%02d", c("p_partkey") % 1000, c("p_size")))
    return part(spark, sf_dir).select("p_partkey", N.serial(raw).alias("serial"))


@query("F50_data_index", "SELECT p_partkey, CASE WHEN p_size % 3 > 0 THEN p_partkey % 10000 END::INT AS ix FROM part")
def data_index(spark, sf_dir):
    return part(spark, sf_dir).select("p_partkey", N.data_index(F.concat(F.when(c("p_size") % 3 == 0, "Date").when(c("p_size") % 3 == 1, "Data").otherwise("data"), F.format_string("%04d", c("p_partkey") % 10000))).alias("ix"))


@query("F51_block_location", "SELECT p_partkey, b // 41412 AS file, (2 + b % 41412 // 204 * 205 + b % 41412 % 204) * 4096 AS place FROM (SELECT p_partkey, p_partkey * 997 AS b FROM part)")
def block_location(spark, sf_dir):
    file, place = N.block_location(c("p_partkey") * 997)
    return part(spark, sf_dir).select("p_partkey", file.alias("file"), place.alias("place"))


@query("F52_tail_blocks", "SELECT p_partkey, greatest(p_partkey - 1, 0) // 205 * 204 + greatest(greatest(p_partkey - 1, 0) % 205 - 1, 0) AS data FROM part")
def tail_blocks(spark, sf_dir):
    return part(spark, sf_dir).select("p_partkey", N.tail_blocks(c("p_partkey")).alias("data"))


@query("F57_synchsafe", "SELECT p_partkey, printf('%02X%02X%02X%02X', (n >> 21) & 127, (n >> 14) & 127, (n >> 7) & 127, n & 127) AS hex FROM (SELECT p_partkey, (p_partkey * 12007) % 268435456 AS n FROM part)")
def synchsafe(spark, sf_dir):
    return part(spark, sf_dir).select("p_partkey", N.synchsafe((c("p_partkey") * 12007 % 268435456).cast("int")).alias("hex"))


@query("S37_clock_seconds", "SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN 0 ELSE o_orderkey END AS seconds FROM orders")
def clock_seconds(spark, sf_dir):
    clock = F.when(c("o_orderkey") % 7 == 0, "1:2:3:4").otherwise(N.hms(c("o_orderkey")))
    return table(spark, sf_dir, "orders").select("o_orderkey", X.clock_seconds(clock).cast("long").alias("seconds"))


@query("T11_captions", "SELECT p_partkey, 'episode' AS kind, p_size AS number, lower(p_name) AS following FROM part WHERE p_size % 3 = 1 UNION ALL SELECT p_partkey, 'next', NULL, lower(p_name) FROM part WHERE p_size % 3 = 2")
def captions(spark, sf_dir):
    """Captions that name an episode by number, or the next one by name."""
    said = F.when(c("p_size") % 3 == 1, F.concat(F.lit("EPISODE "), text("p_size"), F.lit(": "), F.regexp_replace("p_name", "#", ""))).when(c("p_size") % 3 == 2, F.concat(F.lit("Next episode - "), F.regexp_replace("p_name", "#", ""))).otherwise("in this show we see")
    rows = part(spark, sf_dir).select("p_partkey", F.explode(X.cards(said)).alias("x")).select("p_partkey", "x.*")
    return rows.select("p_partkey", F.when(c("next"), "next").otherwise("episode").alias("kind"), c("number").cast("int").alias("number"), c("following"))
