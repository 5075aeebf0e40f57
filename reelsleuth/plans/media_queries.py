"""Queries of disc identifiers, checksums, classification and assignment."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from reelsleuth.operators import classify as C
from reelsleuth.operators import discids as D
from reelsleuth.operators import signals as S
from reelsleuth.operators import solve as V

from .base import query, table
from .ordered_queries import LINES, lines

c = F.col
# Tracks of an order: part keys, in sectors, by rising start; the lead-out lies behind all parts.
_TRACKS = "tracks AS (SELECT disc, row_number() OVER (PARTITION BY disc ORDER BY start) AS number, start, 5000000 AS leadout FROM (SELECT DISTINCT l_orderkey AS disc, l_partkey * 150 + 32 AS start FROM lineitem))"


def tracks(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(c("l_orderkey").alias("disc"), (c("l_partkey") * 150 + 32).alias("start")).distinct()
    return rows.withColumn("number", F.row_number().over(Window.partitionBy("disc").orderBy("start")).cast("long")).withColumn("leadout", F.lit(5000000).cast("long"))


@query("A14_disc_ids", f"WITH {_TRACKS} SELECT disc, count(*) AS tracks, ((sum(start) + 5000000) % 4294967296)::BIGINT AS id1, ((sum(greatest(start, 1) * number % 4294967296) + 5000000 * (count(*) + 1) % 4294967296) % 4294967296)::BIGINT AS id2 FROM tracks GROUP BY disc")
def disc_ids(spark, sf_dir):
    return D.disc_sums(tracks(spark, sf_dir), "disc", "number", "start", "leadout")


_FREEDB = "f AS (SELECT disc, lpad(printf('%x', ((sum(list_sum(list_transform(string_split(((start + 150) // 75)::VARCHAR, ''), lambda d: d::INT)))::BIGINT % 255) << 24) + (((max(leadout) + 150) // 75 - (min(start) + 150) // 75) << 8) + count(*)), 8, '0') AS freedb FROM tracks GROUP BY disc)"


@query("A15_freedb_id", f"WITH {_TRACKS}, {_FREEDB} SELECT disc, freedb FROM f")
def freedb_id(spark, sf_dir):
    return D.freedb_id(tracks(spark, sf_dir), "disc", "start", "leadout")


@query(
    "A16_musicbrainz_id",
    f"WITH {_TRACKS}, m AS (SELECT disc, min(number) AS a, max(number) AS z, max(leadout) AS l, map_from_entries(list((number, start))) AS s FROM tracks GROUP BY disc), "
    "t AS (SELECT disc, printf('%02X%02X%08X', a, z, l + 150) || array_to_string(list_transform(range(1, 100), lambda i: printf('%08X', coalesce(s[i] + 150, 0))), '') AS t FROM m) "
    "SELECT disc, translate(to_base64(unhex(sha1(t))), '+/=', '._-') AS musicbrainz FROM t",
)
def musicbrainz_id(spark, sf_dir):
    return D.musicbrainz_id(tracks(spark, sf_dir), "disc", "number", "start", "leadout")


@query(
    "F58_database_path",
    f"WITH {_TRACKS}, {_FREEDB}, i AS (SELECT disc, count(*) AS tracks, ((sum(start) + 5000000) % 4294967296)::BIGINT AS id1, ((sum(greatest(start, 1) * number % 4294967296) + 5000000 * (count(*) + 1) % 4294967296) % 4294967296)::BIGINT AS id2 FROM tracks GROUP BY disc) "
    "SELECT disc, printf('%x/%x/%x/dBAR-%03d-%08x-%08x-', id1 & 15, (id1 >> 4) & 15, (id1 >> 8) & 15, tracks, id1, id2) || freedb || '.bin' AS path FROM i JOIN f USING (disc)",
)
def database_path(spark, sf_dir):
    rows = tracks(spark, sf_dir)
    ids = D.disc_sums(rows, "disc", "number", "start", "leadout").join(D.freedb_id(rows, "disc", "start", "leadout"), "disc")
    return D.database_path(ids, "disc")


# Samples of an order: prices in hundredths, squared to reach beyond 32 bits of product.
_SAMPLES = "samples AS (SELECT l_orderkey AS track, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey)::HUGEINT AS pos, (l_partkey * 2654435761 % 4294967296)::HUGEINT AS sample FROM lineitem)"
_SUMS = f"{_SAMPLES}, sums AS (SELECT track, (sum(sample * pos % 4294967296) % 4294967296)::BIGINT AS v1, ((sum(sample * pos % 4294967296) + sum(sample * pos // 4294967296)) % 4294967296)::BIGINT AS v2 FROM samples GROUP BY track)"


def samples(spark, sf_dir):
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    return table(spark, sf_dir, "lineitem").select(c("l_orderkey").alias("track"), F.row_number().over(w).alias("pos"), (c("l_partkey") * 2654435761 % 4294967296).alias("sample"))


@query("A13_weighted_checksum", f"WITH {_SUMS} SELECT track, v1, v2 FROM sums")
def weighted_checksum(spark, sf_dir):
    return D.checksums(samples(spark, sf_dir), ["track"], "pos", "sample", F.lit(False), F.lit(False))


@query(
    "J29_verify_tracks",
    f"WITH {_SUMS}, p AS (SELECT track, CASE WHEN track % 3 = 0 THEN v1 WHEN track % 3 = 1 THEN v2 ELSE 7 END AS crc, track % 9 + 1 AS confidence FROM sums WHERE track % 5 <> 0), "
    "m AS (SELECT track, sum(confidence)::BIGINT AS confidence FROM sums JOIN p USING (track) WHERE crc = v1 OR crc = v2 GROUP BY track) "
    "SELECT track, coalesce(confidence, 0) AS confidence, CASE WHEN confidence IS NOT NULL THEN 'match' WHEN track % 5 <> 0 THEN 'mismatch' ELSE 'unknown' END AS verdict FROM sums LEFT JOIN m USING (track)",
)
def verify_tracks(spark, sf_dir):
    sums = D.checksums(samples(spark, sf_dir), ["track"], "pos", "sample", F.lit(False), F.lit(False))
    crc = F.when(c("track") % 3 == 0, c("v1")).when(c("track") % 3 == 1, c("v2")).otherwise(7)
    return D.verify_tracks(sums, sums.where("track % 5 <> 0").select("track", crc.alias("crc"), (c("track") % 9 + 1).alias("confidence")), ["track"])


@query("A12_hash_tree", "SELECT doc_id % 16 AS package, count(*) AS blocks, bool_and(sha1(text) = sha1(CASE WHEN doc_id % 97 = 5 THEN text || '!' ELSE text END)) AS sound FROM documents GROUP BY 1")
def hash_tree(spark, sf_dir):
    """Blocks against recorded digests, one of which is wrong now and then."""
    rows = table(spark, sf_dir, "documents").withColumn("recorded", F.sha1(F.when(c("doc_id") % 97 == 5, F.concat("text", F.lit("!"))).otherwise(c("text"))))
    return rows.groupBy((c("doc_id") % 16).alias("package")).agg(F.count(F.lit(1)).alias("blocks"), F.bool_and(F.sha1("text") == c("recorded")).alias("sound"))


@query(
    "C41_disc_shape",
    f"WITH {LINES}, t AS (SELECT disc, ix, secs * 150.0 AS secs, CASE WHEN price > 30000 THEN chapters ELSE 0 END AS chapters, discount AS aspect FROM lines), g0 AS (SELECT disc, (SELECT 1) AS one FROM lines GROUP BY disc), "
    "m AS (SELECT *, max(round(secs)::BIGINT) OVER d AS most, count(*) OVER d AS n FROM t WINDOW d AS (PARTITION BY disc)), tt AS (SELECT *, round(secs)::BIGINT AS rs, count(*) FILTER (round(secs)::BIGINT = most) OVER (PARTITION BY disc) AS ties FROM m), "
    "l AS (SELECT disc, ix AS position, rs AS ls, chapters AS lc FROM tt WHERE rs = most AND ties = 1 AND n >= 3), o AS (SELECT disc, ix, rs, chapters, row_number() OVER w AS r, sum(rs) OVER w AS s, sum(chapters) OVER w AS c, count(*) OVER (PARTITION BY disc) AS k FROM tt WHERE rs < most AND ties = 1 AND n >= 3 WINDOW w AS (PARTITION BY disc ORDER BY ix)), "
    "p AS (SELECT l.disc, position FROM l JOIN o a USING (disc) JOIN o b ON b.disc = l.disc AND b.r > a.r WHERE abs(ls - (b.s - a.s + a.rs)) / (b.s - a.s + a.rs) <= 0.005 AND (a.r = 1 AND b.r = b.k OR lc > 0 AND b.c - a.c + a.chapters IN (lc, lc - 1)) GROUP BY ALL), "
    "x AS (SELECT t.*, position, secs >= 900 AND coalesce(ix <> position, true) AS long FROM t LEFT JOIN p USING (disc)), "
    "y AS (SELECT *, bool_or(chapters > 0) FILTER (long) OVER (PARTITION BY disc) AND bool_or(chapters = 0) FILTER (long) OVER (PARTITION BY disc) AS told FROM x), z AS (SELECT *, long AND NOT (coalesce(told, false) AND chapters = 0) AS main FROM y), "
    "g AS (SELECT disc, count(*) FILTER (main) AS mains, min(secs) FILTER (main) AS lo, max(secs) FILTER (main) AS hi, min(chapters) FILTER (main) AS c0, max(chapters) FILTER (main) AS c1, max(position) AS play_all FROM z GROUP BY disc) "
    "SELECT disc, shape, CASE WHEN shape IN ('movie', 'series') THEN 2 ELSE 1 END AS confidence, mains, play_all FROM (SELECT *, CASE WHEN mains = 0 THEN 'extras' WHEN mains > 1 AND lo >= 4500 AND hi - lo <= 10 AND c0 = c1 OR mains = 1 AND hi >= 4500 THEN 'movie' WHEN mains > 1 AND (hi - lo) / hi <= 0.2 THEN 'series' ELSE 'mixed' END AS shape FROM g)",
)
def disc_shape(spark, sf_dir):
    rows = lines(spark, sf_dir).select("disc", "ix", (c("secs") * 150.0).alias("secs"), F.when(c("price") > 30000, c("chapters")).otherwise(0).alias("chapters"), c("discount").alias("aspect"))
    return C.disc_shape(rows, "disc", "ix", "secs", "chapters", "aspect").drop("kept")


@query("C40_disc_content", "SELECT s_suppkey, CASE WHEN s_suppkey % 11 = 0 THEN 'game' WHEN s_suppkey % 3 = 0 AND s_suppkey % 2 = 0 THEN 'xbox' WHEN s_suppkey % 3 = 0 AND s_suppkey % 5 = 0 THEN 'xbox360' WHEN s_suppkey % 3 = 0 THEN 'dvd_video' WHEN s_suppkey % 7 = 0 THEN 'blu_ray_video' WHEN s_suppkey % 13 = 0 THEN 'audio_cd' WHEN s_suppkey % 17 = 0 THEN 'mixed' WHEN s_suppkey % 2 = 0 THEN 'data' ELSE 'unknown' END AS kind, CASE WHEN s_suppkey % 11 = 0 OR s_suppkey % 3 = 0 AND (s_suppkey % 2 = 0 OR s_suppkey % 5 = 0) THEN 2 WHEN s_suppkey % 3 = 0 THEN CASE WHEN s_nationkey < 5 THEN 1 ELSE 2 END WHEN s_suppkey % 7 = 0 OR s_suppkey % 13 = 0 OR s_suppkey % 17 = 0 THEN 2 WHEN s_suppkey % 2 = 0 THEN 1 ELSE 0 END AS confidence FROM supplier")
def disc_content(spark, sf_dir):
    k = c("s_suppkey")
    hint = C.disc_content(
        F.when(k % 11 == 0, "SLUS-1"), F.array(F.when(k % 3 == 0, "video_ts/").when(k % 7 == 0, "BDMV").otherwise("DATA")), F.when(k % 2 == 0, "x VTC Sector Offset y"),
        F.when(k % 5 == 0, "xgd2dvd"), F.when(c("s_nationkey") < 5, 1000).otherwise(10_000_000), F.when(k % 13 == 0, "audio").when(k % 17 == 0, "mixed"), k % 2 == 0,
    )
    return table(spark, sf_dir, "supplier").select(k, hint.alias("h")).select("s_suppkey", "h.kind", "h.confidence")


@query("C42_artifact_tier", "SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN CASE WHEN p_size > 20 THEN 'redundant' ELSE 'provenance' END WHEN 1 THEN CASE WHEN p_size > 20 THEN 'redundant' ELSE 'provenance' END WHEN 2 THEN 'provenance' WHEN 3 THEN 'provenance' ELSE 'audit' END AS tier FROM part")
def artifact_tier(spark, sf_dir):
    """C42 and C43."""
    ext = F.element_at(F.array(*[F.lit(x) for x in ("bin", "ISO", "scram", "state", "log", "toc")]), (c("p_partkey") % 6 + 1).cast("int"))
    return table(spark, sf_dir, "part").select("p_partkey", C.tier(F.concat(F.lit("a/b."), ext), c("p_size") > 20).alias("tier"))


@query("A22_confidence_rollup", "SELECT disc, CASE WHEN min(margin) < 0.05 OR count(pick) * 2 < count(*) OR count(pick) < 2 OR count(*) FILTER (pick = chosen) * 3 < count(pick) * 2 THEN 1 ELSE 2 END AS confidence FROM (SELECT l_orderkey AS disc, l_tax + 0.03 AS margin, l_partkey % 3 AS chosen, CASE WHEN l_quantity > 15 THEN CASE WHEN l_discount < 0.08 THEN l_partkey % 3 ELSE 9 END END AS pick FROM lineitem) GROUP BY disc")
def confidence_rollup(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(c("l_orderkey").alias("disc"), (c("l_tax") + 0.03).alias("margin"), (c("l_partkey") % 3).alias("chosen"), F.when(c("l_quantity") > 15, F.when(c("l_discount") < 0.08, c("l_partkey") % 3).otherwise(9)).alias("dialogue_pick"))
    return S.set_confidence(rows, "disc")


@query(
    "O21_film_match",
    "WITH p AS (SELECT p_type AS query, p_partkey AS film, p_size * 4 AS listed, row_number() OVER (PARTITION BY p_type ORDER BY p_partkey) AS rank FROM part), q AS (SELECT *, coalesce(abs(100 - listed) <= greatest(4.0, listed * 0.03), false) AS fits FROM p WHERE rank <= 5), "
    "s AS (SELECT query, count(*) FILTER (fits) AS n, min(rank) FILTER (fits) AS r FROM q GROUP BY query) SELECT query, film, n AS fitting, CASE WHEN n = 1 AND r = 1 THEN 2 ELSE 1 END AS confidence FROM s JOIN q USING (query) WHERE rank = coalesce(r, 1)",
)
def film_match(spark, sf_dir):
    return film_candidates(table(spark, sf_dir, "part").select(c("p_type").alias("query"), c("p_partkey").alias("film"), (c("p_size") * 4).alias("listed")), 100.0)


def film_candidates(films, minutes: float, most: int = 5):
    """Of the first `most` films of a query, the first whose runtime fits, or the first; strong if only the top one fits."""
    ranked = films.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy("film"))).where(c("rank") <= most)
    ranked = ranked.withColumn("fits", S.film_fits(F.lit(minutes), c("listed")))
    g = ranked.groupBy("query").agg(F.count_if("fits").alias("fitting"), F.min(F.when(c("fits"), c("rank"))).alias("r"))
    chosen = g.join(ranked.select("query", "film", "rank"), "query").where(c("rank") == F.coalesce("r", F.lit(1)))
    return chosen.select("query", "film", "fitting", F.when((c("fitting") == 1) & (c("r") == 1), 2).otherwise(1).alias("confidence"))


# All suppliers as titles, in groups of three neighbouring keys, each with three episodes.
_PAIRS = "pairs AS (SELECT s_suppkey // 3 AS grp, s_suppkey AS title, e AS episode, (s_suppkey * 7919 + e * 104729) % 1000 / 1000.0 AS cost FROM supplier, range(3) AS r(e))"


def pairs(spark, sf_dir):
    rows = table(spark, sf_dir, "supplier").select(F.expr("s_suppkey div 3").alias("grp"), c("s_suppkey").alias("title"))
    rows = rows.withColumn("episode", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(2).cast("long"))))
    return rows.withColumn("cost", (c("title") * 7919 + c("episode") * 104729) % 1000 / 1000)


@query(
    "O01_assignment",
    f"WITH {_PAIRS}, n AS (SELECT grp, count(DISTINCT title) AS k FROM pairs GROUP BY grp), three AS (SELECT a.grp, a.cost + b.cost + c.cost AS t FROM pairs a JOIN pairs b ON a.grp = b.grp AND a.title < b.title AND a.episode <> b.episode JOIN pairs c ON a.grp = c.grp AND b.title < c.title AND c.episode NOT IN (a.episode, b.episode)), "
    "two AS (SELECT a.grp, a.cost + b.cost AS t FROM pairs a JOIN pairs b ON a.grp = b.grp AND a.title < b.title AND a.episode <> b.episode), one AS (SELECT grp, cost AS t FROM pairs) "
    "SELECT grp, k AS titles, round(CASE k WHEN 3 THEN (SELECT min(t) FROM three WHERE three.grp = n.grp) WHEN 2 THEN (SELECT min(t) FROM two WHERE two.grp = n.grp) ELSE (SELECT min(t) FROM one WHERE one.grp = n.grp) END, 6)::DOUBLE AS cost FROM n",
)
def assignment(spark, sf_dir):
    """The least total cost; which of equal assignments is taken is open."""
    found = V.assign_groups(pairs(spark, sf_dir), "grp", "title", "episode", "cost")
    return found.groupBy("grp").agg(F.count(F.lit(1)).alias("titles"), F.round(F.sum("cost"), 6).alias("cost"))


_SETS = (
    "sets AS (SELECT s_suppkey // 4 AS grp, (s_suppkey % 4) // 2 AS disc, s_suppkey AS title, e AS episode, (s_suppkey * 7919 + e * 104729) % 1000 / 1000.0 AS cost FROM supplier, range(12) AS r(e)), "
    "sizes AS (SELECT grp, disc, count(DISTINCT title) AS k FROM sets GROUP BY ALL), "
    # The best pairing of a disc's one or two titles with the episodes from s on.
    "windows AS (SELECT grp, disc, k, a.episode AS s, min(CASE WHEN k = 1 THEN a.cost ELSE a.cost + b.cost END) AS w FROM sizes JOIN sets a USING (grp, disc) LEFT JOIN sets b ON a.grp = b.grp AND a.disc = b.disc AND a.title <> b.title AND b.episode = a.episode + 1 WHERE k = 1 OR b.cost IS NOT NULL GROUP BY ALL "
    "UNION ALL SELECT grp, disc, k, b.episode, a.cost + b.cost FROM sizes JOIN sets a USING (grp, disc) JOIN sets b ON a.grp = b.grp AND a.disc = b.disc AND a.title < b.title AND b.episode = a.episode - 1 WHERE k = 2), "
    "best AS (SELECT grp, disc, k, s, min(w) AS w FROM windows GROUP BY ALL), "
    "plans AS (SELECT x.grp, x.s AS s0, y.s AS s1, x.w + coalesce(y.w + 0.05 * (y.s - x.s - x.k), 0) AS total, x.k + coalesce(y.k, 0) AS n FROM best x LEFT JOIN best y ON x.grp = y.grp AND y.disc = 1 WHERE x.disc = 0 AND (y.s IS NULL OR y.s >= x.s + x.k)), "
    "ranked AS (SELECT *, row_number() OVER w AS r, lead(total) OVER w AS rival FROM plans WINDOW w AS (PARTITION BY grp ORDER BY total, s0, s1))"
)


@query("O02_set_placement", f"WITH {_SETS} SELECT grp, disc, CASE disc WHEN 0 THEN s0 ELSE s1 END AS start, round(total / n, 6)::DOUBLE AS mean_cost, round(rival / n, 6)::DOUBLE AS runner_up, NULL::VARCHAR AS reason FROM ranked, range(2) AS d(disc) WHERE r = 1 AND (disc = 0 OR s1 IS NOT NULL)")
def set_placement(spark, sf_dir):
    """All suppliers as titles, in sets of two discs with two titles, along twelve episodes."""
    rows = table(spark, sf_dir, "supplier").select(F.expr("s_suppkey div 4").alias("grp"), F.expr("(s_suppkey % 4) div 2").alias("disc"), c("s_suppkey").alias("title"))
    rows = rows.withColumn("episode", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(11).cast("long"))))
    rows = rows.withColumn("cost", (c("title") * 7919 + c("episode") * 104729) % 1000 / 1000)
    found = V.place_sets(rows, "grp", "disc", "title", "episode", "cost")
    return found.withColumn("mean_cost", F.round("mean_cost", 6)).withColumn("runner_up", F.round("runner_up", 6))


@query("O05_ordered_titles")
def ordered_titles(spark, sf_dir):
    """Tested against enumeration of all orders."""
    rows = pairs(spark, sf_dir).withColumn("fit", F.when(c("title") % 4 != 0, (c("cost") - 0.5) * 6)).withColumn("minutes", (c("title") % 30).cast("double")).withColumn("listed", (c("episode") * 10).cast("double"))
    rows = rows.withColumn("card", F.when(c("title") % 7 == 1, c("title") % 3)).withColumn("story", F.when((c("episode") < 2) & (c("grp") % 2 == 0), "Quest"))
    return V.order_groups(rows, "grp", "title", "episode", "fit", "minutes", "listed", "card", "story")


@query(
    "O07_specials",
    # Of all ways to give titles a special of their own or none, the least; then margins.
    f"WITH {_PAIRS}, s AS (SELECT grp, title, episode, cost * 5 + title * (episode + 1) % 101 / 10000.0 AS score FROM pairs WHERE (title + episode) % 5 <> 0), o AS (SELECT grp, title, episode, score FROM s UNION ALL SELECT DISTINCT grp, title, NULL, 0 FROM pairs), "
    "n AS (SELECT grp, title, row_number() OVER (PARTITION BY grp ORDER BY title) AS i FROM (SELECT DISTINCT grp, title FROM pairs)), t AS (SELECT o.*, i FROM o JOIN n USING (grp, title)), "
    "ways AS (SELECT a.grp, a.episode AS e1, b.episode AS e2, c.episode AS e3, a.score + coalesce(b.score, 0) + coalesce(c.score, 0) AS total FROM t a LEFT JOIN t b ON b.grp = a.grp AND b.i = 2 LEFT JOIN t c ON c.grp = a.grp AND c.i = 3 WHERE a.i = 1 AND coalesce(a.episode <> b.episode, true) AND coalesce(a.episode <> c.episode, true) AND coalesce(b.episode <> c.episode, true)), "
    "won AS (SELECT * FROM ways QUALIFY row_number() OVER (PARTITION BY grp ORDER BY total DESC) = 1), "
    "given AS (SELECT grp, title, CASE i WHEN 1 THEN e1 WHEN 2 THEN e2 ELSE e3 END AS special FROM won JOIN n USING (grp)), "
    "m AS (SELECT g.grp, g.title, g.special, any_value(s.score) - coalesce(max(r.score), 0) AS margin FROM given g JOIN s ON s.title = g.title AND s.episode = g.special LEFT JOIN s r ON r.title = g.title AND r.episode <> g.special GROUP BY ALL) "
    "SELECT grp, title, special, round(margin, 6)::DOUBLE AS margin, margin >= 1.5 AS accepted FROM m",
)
def specials(spark, sf_dir):
    """Of ways with equal sums, which the SQL leaves open, the first by the specials of the titles in order, none last."""
    rows = pairs(spark, sf_dir).where("(title + episode) % 5 <> 0").withColumn("score", c("cost") * 5 + c("title") * (c("episode") + 1) % 101 / 10000)
    return V.special_groups(rows, "grp", "title", "episode", "score").withColumnRenamed("episode", "special").withColumn("margin", F.round("margin", 6))


@query("O20_greedy_unique", f"WITH RECURSIVE {_PAIRS}, o AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY cost DESC, title, episode) AS r FROM pairs), g AS (SELECT grp, r, [title] AS ts, [episode] AS es, title, episode, cost, true AS taken FROM o WHERE r = 1 UNION ALL SELECT o.grp, o.r, CASE WHEN list_contains(ts, o.title) OR list_contains(es, o.episode) THEN ts ELSE list_append(ts, o.title) END, CASE WHEN list_contains(ts, o.title) OR list_contains(es, o.episode) THEN es ELSE list_append(es, o.episode) END, o.title, o.episode, o.cost, NOT (list_contains(ts, o.title) OR list_contains(es, o.episode)) FROM g JOIN o ON o.grp = g.grp AND o.r = g.r + 1) SELECT grp, title, episode, cost::DOUBLE AS cost FROM g WHERE taken")
def greedy(spark, sf_dir):
    return V.greedy_groups(pairs(spark, sf_dir), "grp", "title", "episode", "cost")
