"""Queries over ordered rows. Orders stand for discs, their lines for titles, a user's events for units of a dump."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from reelsleuth.operators import ordered as O

from .base import query, table

LINES = "lines AS (SELECT l_orderkey AS disc, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) - 1 AS ix, l_quantity::BIGINT AS secs, l_linenumber::BIGINT AS chapters, l_extendedprice AS price, l_discount AS discount, l_tax AS tax FROM lineitem)"


def lines(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("disc"), "l_linenumber", "l_partkey", "l_suppkey", F.col("l_quantity").cast("long").alias("secs"), F.col("l_linenumber").cast("long").alias("chapters"),
        F.col("l_extendedprice").alias("price"), F.col("l_discount").alias("discount"), F.col("l_tax").alias("tax"),
    )
    ix = F.row_number().over(Window.partitionBy("disc").orderBy("l_linenumber", "l_partkey", "l_suppkey")).cast("long") - 1
    return rows.withColumn("ix", ix).drop("l_linenumber", "l_partkey", "l_suppkey")


UNITS = "units AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i, event_type IN ('error', 'view') AS bad FROM events), runs AS (SELECT user_id, min(i) AS first, count(*) AS length FROM (SELECT user_id, i, i - row_number() OVER (PARTITION BY user_id ORDER BY i) AS g FROM units WHERE bad) GROUP BY user_id, g), n AS (SELECT user_id, count(*) AS units FROM units GROUP BY user_id)"


def runs(spark, sf_dir):
    units = table(spark, sf_dir, "events").select("user_id", "event_type", (F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).cast("long") - 1).alias("i"))
    return O.bad_runs(units, ["user_id"], "i", F.col("event_type").isin("error", "view"))


@query("W05_bad_runs", f"WITH {UNITS} SELECT user_id, first, length, units FROM runs JOIN n USING (user_id)")
def bad_runs(spark, sf_dir):
    return runs(spark, sf_dir)


@query("A17_run_summary", f"WITH {UNITS}, e AS (SELECT *, first = 0 OR first + length = units AS edge FROM runs JOIN n USING (user_id)) SELECT user_id, count(*) AS runs, sum(length)::BIGINT AS bad, coalesce(sum(length) FILTER (NOT edge), 0)::BIGINT AS interior, coalesce(sum(length) FILTER (edge), 0)::BIGINT AS edge FROM e GROUP BY user_id")
def run_summary(spark, sf_dir):
    return O.run_summary(runs(spark, sf_dir), ["user_id"])


@query("A19_edge_and_interior_runs", f"WITH {UNITS} SELECT user_id, first, length, first = 0 OR first + length = units AS edge FROM runs JOIN n USING (user_id)")
def edge_runs(spark, sf_dir):
    return runs(spark, sf_dir).select("user_id", "first", "length", ((F.col("first") == 0) | (F.col("first") + F.col("length") == F.col("units"))).alias("edge"))


@query("P16_state_complete", f"WITH {UNITS}, s AS (SELECT user_id, sum(length) AS bad, coalesce(sum(length) FILTER (first <> 0 AND first + length <> units), 0) AS interior FROM runs JOIN n USING (user_id) GROUP BY user_id) SELECT user_id, CASE WHEN user_id % 2 = 0 THEN coalesce(bad, 0) = 0 ELSE coalesce(interior, 0) = 0 END AS complete FROM n LEFT JOIN s USING (user_id)")
def state_complete(spark, sf_dir):
    """Even users count sectors, odd ones samples: sectors allow no bad place, samples none inside."""
    users = table(spark, sf_dir, "events").select("user_id").distinct()
    found = users.join(O.run_summary(runs(spark, sf_dir), ["user_id"]), "user_id", "left").fillna(0)
    return found.select("user_id", F.when(F.col("user_id") % 2 == 0, F.col("bad") == 0).otherwise(F.col("interior") == 0).alias("complete"))


@query(
    "W08_play_all_runs",
    f"WITH {LINES}, m AS (SELECT *, max(secs) OVER d AS most, count(*) OVER d AS n FROM lines WINDOW d AS (PARTITION BY disc)), t AS (SELECT *, count(*) FILTER (secs = most) OVER (PARTITION BY disc) AS ties FROM m), "
    "l AS (SELECT disc, ix AS position, secs AS ls, chapters AS lc FROM t WHERE secs = most AND ties = 1 AND n >= 3), "
    "o AS (SELECT disc, ix, secs, chapters, row_number() OVER w AS r, sum(secs) OVER w AS s, sum(chapters) OVER w AS c, count(*) OVER (PARTITION BY disc) AS k FROM t WHERE secs < most AND ties = 1 AND n >= 3 WINDOW w AS (PARTITION BY disc ORDER BY ix)), "
    "p AS (SELECT l.disc, position, a.ix AS first, b.ix AS last, a.r AS r0, b.r AS r1, b.s - a.s + a.secs AS total, b.c - a.c + a.chapters AS parts, ls, lc, a.r = 1 AND b.r = b.k AS whole FROM l JOIN o a USING (disc) JOIN o b ON b.disc = l.disc AND b.r > a.r) "
    "SELECT disc, position, first, last, total::BIGINT AS members_secs FROM p WHERE abs(ls - total) / total <= 0.005 AND (whole OR lc > 0 AND (parts = lc OR parts + 1 = lc)) QUALIFY row_number() OVER (PARTITION BY disc ORDER BY NOT whole, r0, r1) = 1",
)
def play_all(spark, sf_dir):
    return O.play_all(lines(spark, sf_dir), "disc", "ix", "secs", "chapters")


@query(
    "W07_numbering_shift",
    f"WITH {LINES}, e AS (SELECT disc, ix, ix + 1 AS number, CASE WHEN secs % 5 <> 0 THEN secs END AS m FROM lines), k AS (SELECT disc, (list_sort(list(m)))[count(m) // 2 + 1] AS median FROM e WHERE m > 0 GROUP BY disc), "
    "d AS (SELECT disc, ix, number, coalesce(m >= 1.8 * median, false)::INT AS double FROM e JOIN k USING (disc)), "
    "s AS (SELECT *, coalesce(sum(double) OVER (PARTITION BY disc ORDER BY ix ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT + number AS f, min(ix) FILTER (double = 1) OVER (PARTITION BY disc) AS early, max(ix) OVER (PARTITION BY disc) AS last FROM d) "
    "SELECT disc, ix, CASE WHEN double = 1 THEN f || ',' || (f + 1) ELSE f::VARCHAR END AS numbers FROM s WHERE early < last",
)
def numbering(spark, sf_dir):
    rows = lines(spark, sf_dir).select("disc", "ix", (F.col("ix") + 1).alias("number"), F.when(F.col("secs") % 5 != 0, F.col("secs")).alias("m"))
    return O.numbering(rows, "disc", "ix", "number", "m").select("disc", "ix", F.array_join("numbers", ",").alias("numbers"))


TITLES = [24.0, 47.0, 22.5]
_WIN = (
    "e AS (SELECT s_nationkey AS series, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS number, CASE WHEN s_suppkey % 6 <> 0 THEN (s_suppkey * 37 % 60)::DOUBLE END AS m FROM supplier), "
    "g AS (SELECT series, number, [abs(24.0 - m), abs(47.0 - lead(m) OVER w), abs(22.5 - lead(m, 2) OVER w)] AS d, lead(number, 2) OVER w AS last FROM e WINDOW w AS (PARTITION BY series ORDER BY number)), "
    "f AS (SELECT series, number AS start, list_filter(d, lambda x: x IS NOT NULL) AS d FROM g WHERE last IS NOT NULL), "
    "win AS (SELECT series, start, (list_sum(d) / len(d))::DOUBLE AS mean, list_max(d)::DOUBLE AS worst, len(d) AS counted FROM f WHERE len(d) >= 2)"
)


def _episodes(spark, sf_dir):
    rows = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("series"), "s_suppkey", F.when(F.col("s_suppkey") % 6 != 0, (F.col("s_suppkey") * 37 % 60).cast("double")).alias("m"))
    return rows.withColumn("number", F.row_number().over(Window.partitionBy("series").orderBy("s_suppkey")).cast("long"))


@query("W01_window_fit", f"WITH {_WIN} SELECT series, start, round(mean, 9) AS mean, worst, counted FROM win")
def window_fit(spark, sf_dir):
    return O.windows(_episodes(spark, sf_dir), "series", "number", "m", TITLES).withColumn("mean", F.round("mean", 9))


@query("W02_window_margin", f"WITH {_WIN}, r AS (SELECT *, row_number() OVER o AS r, lead(mean) OVER o AS nx, count(*) FILTER (mean <= best + 0.5) OVER (PARTITION BY series) AS tied FROM (SELECT *, min(mean) OVER (PARTITION BY series) AS best FROM win) WINDOW o AS (PARTITION BY series ORDER BY mean, start)) SELECT series, start, round(mean, 9) AS mean, round(nx - mean, 9) AS margin, tied FROM r WHERE r = 1")
def window_margin(spark, sf_dir):
    """The best window, its margin and its ties."""
    found = O.best_window(O.windows(_episodes(spark, sf_dir), "series", "number", "m", TITLES), "series")
    return found.withColumns({"mean": F.round("mean", 9), "margin": F.round("margin", 9)})


@query("W13_keep_version", f"WITH {LINES} SELECT disc, ix FROM lines QUALIFY row_number() OVER (PARTITION BY disc ORDER BY (secs // 10) DESC, chapters, abs(price - 30000), ix) = 1")
def keep_version(spark, sf_dir):
    rows = lines(spark, sf_dir).withColumn("height", F.expr("secs div 10")).withColumn("off", F.abs(F.col("price") - 30000))
    return O.keep_version(rows, ["disc"], "height", "chapters", "off", "ix").select("disc", "ix")


_FOLD = "WITH RECURSIVE {lines}, f AS (SELECT disc, ix, {v} AS v, ix AS kept, {v} AS kv FROM lines WHERE ix = 0 UNION ALL SELECT l.disc, l.ix, l.{v}, CASE WHEN l.{v} > f.kv + {d} THEN l.ix ELSE f.kept END, CASE WHEN l.{v} > f.kv + {d} THEN l.{v} ELSE f.kv END FROM f JOIN lines l ON l.disc = f.disc AND l.ix = f.ix + 1) SELECT disc, kept AS ix, kv AS {v} FROM f QUALIFY row_number() OVER (PARTITION BY disc ORDER BY ix DESC) = 1"


@query("W14_widest_version", _FOLD.format(lines=LINES, v="discount", d="0.011"))
def widest(spark, sf_dir):
    return O.fold_wider(lines(spark, sf_dir), "disc", "ix", "discount", 0.011)


@query("W15_longest_title", _FOLD.format(lines=LINES, v="secs", d="1"))
def longest(spark, sf_dir):
    return O.fold_wider(lines(spark, sf_dir), "disc", "ix", "secs", 1)


@query("W09_contiguous_parts", "SELECT l_orderkey AS package, bool_and(l_linenumber - 1 = r) AS contiguous FROM (SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) - 1 AS r FROM lineitem) GROUP BY l_orderkey")
def contiguous(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("package"), "l_linenumber", (F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber")) - 1).alias("r"))
    return rows.groupBy("package").agg(F.bool_and(F.col("l_linenumber") - 1 == F.col("r")).alias("contiguous"))


@query("W10_consecutive_discs", "SELECT l_orderkey AS label, count(*) AS n, count(*) = count(DISTINCT l_linenumber) AND count(*) = max(l_linenumber) - min(l_linenumber) + 1 AND count(*) > 1 AS orderable FROM lineitem GROUP BY l_orderkey")
def consecutive(spark, sf_dir):
    return O.consecutive(table(spark, sf_dir, "lineitem").withColumnRenamed("l_orderkey", "label"), "label", "l_linenumber")


@query("W11_track_ranges", "SELECT disc, start, coalesce(lead(start) OVER (PARTITION BY disc ORDER BY start), 400000) AS \"end\", (coalesce(lead(start) OVER (PARTITION BY disc ORDER BY start), 400000) - start) * 1000 // 75 AS ms FROM (SELECT DISTINCT l_orderkey AS disc, l_partkey * 75 AS start FROM lineitem)")
def track_ranges(spark, sf_dir):
    """W11 and W12."""
    tracks = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("disc"), (F.col("l_partkey") * 75).alias("start")).distinct()
    return O.track_ranges(tracks, "disc", "start", F.lit(400000))


@query("W17_renumbered", "SELECT l_orderkey AS season, l_partkey AS title, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS number FROM lineitem")
def renumbered(spark, sf_dir):
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("season"), F.col("l_partkey").alias("title"), F.row_number().over(w).cast("long").alias("number"))


@query("W18_disc_offsets", "WITH d AS (SELECT o_custkey AS set_id, o_orderkey AS disc, count(l_orderkey) AS titles FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL) SELECT set_id, disc, titles, coalesce(sum(titles) OVER (PARTITION BY set_id ORDER BY disc ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before FROM d")
def disc_offsets(spark, sf_dir):
    counts = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"))
    discs = table(spark, sf_dir, "orders").join(counts, F.col("o_orderkey") == F.col("l_orderkey"), "left").select(F.col("o_custkey").alias("set_id"), F.col("o_orderkey").alias("disc"), F.coalesce("n", F.lit(0)).alias("titles"))
    return discs.withColumn("before", F.coalesce(F.sum("titles").over(Window.partitionBy("set_id").orderBy("disc").rowsBetween(*O.ALL_BEFORE)), F.lit(0)))


@query("W19_word_trigrams", "SELECT item_id, count(*) AS n FROM (SELECT item_id, unnest(range(1, greatest(len(ws) - 1, 1))) AS i FROM (SELECT item_id, list_filter(regexp_split_to_array(regexp_replace(lower(text), '[''’]', '', 'g'), '[^\\p{L}\\p{N}]+'), lambda w: w <> '') AS ws FROM benchmark)) GROUP BY item_id")
def word_trigrams(spark, sf_dir):
    from reelsleuth.functions.text import phrase_words

    rows = table(spark, sf_dir, "benchmark").select("item_id", (F.size(phrase_words(F.col("text"))) - 2).cast("long").alias("n"))
    return rows.where("n > 0")


@query("A04_median", "SELECT l_orderkey AS disc, median(l_quantity) AS median, (max(l_quantity) - min(l_quantity)) / max(l_quantity) AS spread FROM lineitem GROUP BY l_orderkey")
def median(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("disc")).agg(F.median("l_quantity").alias("median"), ((F.max("l_quantity") - F.min("l_quantity")) / F.max("l_quantity")).alias("spread"))
