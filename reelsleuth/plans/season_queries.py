"""Queries that match discs to seasons. Pairs of parts stand for a disc's titles, six episodes for its season."""

from __future__ import annotations

from pyspark.sql import functions as F

from reelsleuth.operators import seasons as S

from .base import query, sql_query, table

c = F.col
_BASE = (
    "t AS (SELECT p_partkey // 2 AS grp, p_partkey AS title, 20 + (p_size % 3) * 10 AS minutes, p_size % 5 <> 0 AS spoken, CASE WHEN p_size % 4 = 0 THEN p_partkey * 5 % 6 END AS card, row_number() OVER (PARTITION BY p_partkey // 2 ORDER BY p_partkey) - 1 AS i, count(*) OVER (PARTITION BY p_partkey // 2) AS k FROM part), "
    "p AS (SELECT t.*, pos, abs(minutes - (20 + (pos * 7 + grp) % 3 * 10)) AS off, (title * 31 + pos * 17) % 97 / 97.0 * 3 AS fit FROM t, range(6) AS r(pos))"
)
_WINDOWS = (
    # Of one title, or of two by the better of both pairings.
    f"{_BASE}, w AS (SELECT a.grp, a.pos AS start, a.k, a.off::DOUBLE AS mean, CASE WHEN a.spoken THEN a.fit END AS speech FROM p a WHERE a.k = 1 "
    "UNION ALL SELECT a.grp, a.pos, 2, least(a.off + y.off, x.off + b.off) / 2, greatest(a.fit * a.spoken::INT + y.fit * b.spoken::INT, x.fit * a.spoken::INT + b.fit * b.spoken::INT) / nullif(a.spoken::INT + b.spoken::INT, 0) "
    "FROM p a JOIN p x ON x.title = a.title AND x.pos = a.pos + 1 JOIN p b ON b.grp = a.grp AND b.i = 1 AND b.pos = a.pos JOIN p y ON y.title = b.title AND y.pos = a.pos + 1 WHERE a.i = 0 AND a.k = 2), "
    "v AS (SELECT w.*, (SELECT count(*) FILTER (card BETWEEN start AND start + w.k - 1) FROM t WHERE t.grp = w.grp) AS agree, (SELECT count(*) FILTER (card NOT BETWEEN start AND start + w.k - 1) FROM t WHERE t.grp = w.grp) AS disagree FROM w), "
    "tied AS (SELECT *, count(*) OVER (PARTITION BY grp) AS tied FROM (SELECT *, min(mean) OVER (PARTITION BY grp) AS least FROM v) WHERE mean - least <= 0.5), "
    "bc0 AS (SELECT grp, max(agree) FILTER (disagree = 0 AND agree > 0) AS most FROM tied GROUP BY grp), "
    "bc AS (SELECT grp, any_value(start) AS by_card FROM tied JOIN bc0 USING (grp) WHERE agree >= most GROUP BY grp HAVING count(*) = 1), "
    "bd AS (SELECT grp, start AS by_speech FROM (SELECT grp, start, row_number() OVER o AS r, speech - lead(speech) OVER o AS margin FROM tied WHERE speech IS NOT NULL WINDOW o AS (PARTITION BY grp ORDER BY speech DESC, start)) WHERE r = 1 AND coalesce(margin >= 0.02, true)), "
    "ranked AS (SELECT tied.*, CASE WHEN tied = 1 THEN 3 WHEN start = by_card THEN 0 WHEN by_card IS NULL AND start = by_speech THEN 1 WHEN by_card IS NULL AND by_speech IS NULL AND start + 1 = CASE grp % 4 WHEN 0 THEN 1 ELSE (grp % 4 - 1) * k + 1 END THEN 2 ELSE 3 END AS rank FROM tied LEFT JOIN bc USING (grp) LEFT JOIN bd USING (grp)), "
    "chosen AS (SELECT * FROM ranked QUALIFY row_number() OVER (PARTITION BY grp ORDER BY rank, mean, start) = 1)"
)


def _pairs(spark, sf_dir):
    part = table(spark, sf_dir, "part").select(F.expr("p_partkey div 2").alias("grp"), c("p_partkey").alias("title"), (20 + c("p_size") % 3 * 10).alias("minutes"), (c("p_size") % 5 != 0).alias("spoken"), F.when(c("p_size") % 4 == 0, c("p_partkey") * 5 % 6).alias("card"))
    episodes = part.select("grp").distinct().withColumn("pos", F.explode(F.sequence(F.lit(0), F.lit(5)))).withColumn("runtime", 20 + (c("pos") * 7 + c("grp")) % 3 * 10).withColumn("number", c("pos") + 1)
    scored = S.pair_scores(part, episodes, "grp", (c("title") * 31 + c("pos") * 17) % 97 / 97 * 3)
    return scored.withColumn("off", F.abs(c("minutes") - c("runtime")).cast("double")).join(part.select("title", "spoken", "card"), "title"), part


def _chosen(spark, sf_dir):
    pairs, titles = _pairs(spark, sf_dir)
    found = S.windows(pairs, "grp")
    sizes = titles.groupBy("grp").agg(F.count(F.lit(1)).alias("k"))
    means = S.paired(found, "grp", "off").groupBy("grp", "start").agg(F.avg("off").alias("mean")).join(sizes, "grp").withColumn("number", c("start") + 1)
    spoken = S.paired(found.withColumn("cost", F.when(c("spoken"), -c("score")).otherwise(0.0)), "grp", "cost").join(titles.select("title", "spoken"), "title")
    dialogue = spoken.where("spoken").groupBy("grp", "start").agg((-F.sum("cost") / F.count(F.lit(1))).alias("score"))
    inside = c("card").between(c("start"), c("start") + c("k") - 1)
    votes = means.select("grp", "start", "k").join(titles.select("grp", "card"), "grp").groupBy("grp", "start").agg(F.count_if(inside).alias("agree"), F.count_if(~inside).alias("disagree"))
    hints = titles.select("grp").distinct().withColumn("hint", c("grp") % 4)
    return S.choose_window(means, votes, dialogue, hints, "grp"), found


@query("O08_season_match", f"WITH {_WINDOWS} SELECT grp, start, start + 1 AS number, mean, ['cards', 'dialogue', 'disc number', 'runtime'][rank + 1] AS decided_by, tied FROM chosen")
def season_match(spark, sf_dir):
    """O08, with T12, T13, W01 and W03."""
    return _chosen(spark, sf_dir)[0]


@query(
    "O09_titles_placed",
    f"WITH {_WINDOWS}, q AS (SELECT p.*, start, CASE WHEN card = pos THEN -100 WHEN card BETWEEN start AND start + p.k - 1 THEN 100 ELSE 0 END - CASE WHEN spoken THEN fit ELSE 0 END + off * 0.5 AS ev FROM p JOIN chosen USING (grp) WHERE pos BETWEEN start AND start + p.k - 1), "
    "s AS (SELECT a.grp, a.ev + y.ev AS kept, x.ev + b.ev AS swapped FROM q a JOIN q x ON x.title = a.title AND x.pos = a.start + 1 JOIN q b ON b.grp = a.grp AND b.i = 1 AND b.pos = b.start JOIN q y ON y.title = b.title AND y.pos = y.start + 1 WHERE a.i = 0 AND a.pos = a.start), "
    "d AS (SELECT grp, kept > swapped + 0.02 AS swap, abs(kept - swapped) < 1 OR CASE WHEN kept > swapped + 0.02 THEN kept - swapped ELSE swapped - kept END < 1 AS near FROM s) "
    "SELECT q.grp, title, pos, CASE WHEN card = pos THEN 'card' WHEN spoken AND fit >= 1 THEN 'dialogue' WHEN spoken THEN 'weak dialogue' WHEN coalesce(near, false) THEN 'disc order' ELSE 'runtime' END AS reason FROM q LEFT JOIN d ON d.grp = q.grp WHERE pos - start = CASE WHEN coalesce(swap, false) THEN 1 - i ELSE i END",
)
def titles_placed(spark, sf_dir):
    """O09."""
    chosen, found = _chosen(spark, sf_dir)
    rows = found.withColumn("fit", F.when(c("spoken"), c("score"))).withColumn("listed", c("runtime").cast("double")).withColumn("mins", c("minutes").cast("double"))
    return S.place_in_window(chosen, rows, "grp", fit="fit", minutes="mins", listed="listed", card="card").drop("doubtful")


@query("J12_pair_scores", f"WITH {_BASE} SELECT grp, title, pos, fit AS score FROM p")
def pair_scores(spark, sf_dir):
    return _pairs(spark, sf_dir)[0].select("grp", "title", "pos", "score")


@query("T14_numbering_choice", "SELECT l_suppkey AS disc, count(*) FILTER (l_returnflag = 'R') AS plain, count(*) FILTER (l_linestatus = 'F' AND l_discount > 0.03) AS shifted, CASE WHEN count(*) FILTER (l_linestatus = 'F' AND l_discount > 0.03) > count(*) FILTER (l_returnflag = 'R') THEN 'shifted' ELSE 'listed' END AS numbering FROM lineitem GROUP BY 1")
def numbering_choice(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").withColumnRenamed("l_suppkey", "disc")
    verdict = lambda yes: F.when(yes, "confirmed").otherwise("inconclusive").alias("verdict")
    return S.fewer_numbering_doubts(rows.select("disc", verdict(c("l_returnflag") == "R")), rows.select("disc", verdict((c("l_linestatus") == "F") & (c("l_discount") > 0.03))), "disc")


@query(
    "J30_mapped_references",
    "WITH e AS (SELECT o_custkey AS season, o_orderkey AS pos, CASE WHEN o_orderkey % 3 = 0 THEN [o_orderkey, o_orderkey + 1] ELSE [o_orderkey] END AS numbers FROM orders), r AS (SELECT DISTINCT l_orderkey AS number, [l_orderkey % 5, 7] AS phrases FROM lineitem WHERE l_orderkey % 4 <> 0), "
    "x AS (SELECT season, pos, len(numbers) AS n, unnest(numbers) AS number FROM e) SELECT season, pos, CASE WHEN count(phrases) = count(*) THEN array_to_string(list_sort(list_distinct(flatten(list(phrases)))), ',') END AS phrases, count(*) = 2 AS halves FROM x LEFT JOIN r USING (number) GROUP BY season, pos",
)
def mapped_references(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(c("o_custkey").alias("season"), c("o_orderkey").alias("pos"))
    episodes = rows.withColumn("numbers", F.when(c("pos") % 3 == 0, F.array("pos", c("pos") + 1)).otherwise(F.array("pos")))
    spoken = table(spark, sf_dir, "lineitem").where("l_orderkey % 4 <> 0").select(c("l_orderkey").alias("number")).distinct().withColumn("phrases", F.array(c("number") % 5, F.lit(7).cast("long")))
    # References belong to a season; each number is wanted by its own and perhaps by the one before.
    wanted = episodes.select("season", F.explode("numbers").alias("number")).distinct()
    found = S.mapped_references(episodes, spoken.join(wanted, "number").select("season", "number", "phrases"), "season")
    return found.withColumn("phrases", F.array_join(F.array_sort("phrases"), ","))


@query("O24_bonus_show", "SELECT o_custkey AS disc, arg_max(o_orderkey, (o_totalprice::BIGINT % 7) * 100000000 - o_orderkey) AS show, max(o_totalprice::BIGINT % 7) AS matched FROM (SELECT o_custkey, o_orderkey, floor(o_totalprice) AS o_totalprice FROM orders) GROUP BY 1")
def bonus_show(spark, sf_dir):
    """The show with the most matched specials, the first of equals."""
    rows = table(spark, sf_dir, "orders").select(c("o_custkey").alias("disc"), c("o_orderkey").alias("show"), (F.floor("o_totalprice") % 7).alias("matched"))
    return S.first_best(rows, "disc", c("matched"), "show", ["show", "matched"])


@query("O23_series_for_set", "SELECT o_custkey AS set, o_orderkey AS series, mean FROM (SELECT o_custkey, o_orderkey, floor(o_totalprice / 1000) AS mean, row_number() OVER (PARTITION BY o_custkey ORDER BY floor(o_totalprice / 1000), o_orderkey) AS r FROM orders) WHERE r = 1")
def series_for_set(spark, sf_dir):
    """The series whose solution costs least, the first of equals."""
    rows = table(spark, sf_dir, "orders").select(c("o_custkey").alias("set"), c("o_orderkey").alias("series"), F.floor(c("o_totalprice") / 1000).cast("double").alias("mean"))
    return S.first_best(rows, "set", -c("mean"), "series", ["series", "mean"])


sql_query("A29_audio_seconds", "SELECT l_orderkey AS disc, greatest(max(l_partkey * 100) + 5000 - min(l_partkey * 100), 0) / 75.0E0 AS seconds, count(CASE WHEN l_returnflag <> 'A' THEN 1 END) AS audio_tracks FROM {lineitem} GROUP BY l_orderkey", "SELECT l_orderkey AS disc, greatest(max(l_partkey * 100) + 5000 - min(l_partkey * 100), 0) / 75.0::DOUBLE AS seconds, count(CASE WHEN l_returnflag <> 'A' THEN 1 END) AS audio_tracks FROM lineitem GROUP BY l_orderkey")
