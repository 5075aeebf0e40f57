"""Queries over titles, captions and episodes. Parts stand for episodes, orders for discs."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from reelsleuth.functions import text as X
from reelsleuth.operators import episodes as E
from reelsleuth.operators import transcript as R

from .base import query, sql_query, table
from .text_queries import _CHECK, _OVER, _titles_and_references

c = F.col
_TITLES = [(1, "EPISODE 4 The Long Road Home and then"), (2, "NEXT EPISODE: The Long Road"), (3, "nothing"), (4, "Ep|sode 2 Winter’s End is near; NEXT EPISODE The Long Road"), (5, "next episode Winters End"), (6, "EPISODE 9 Unknown")]
_EPISODES = [(1, 1, "Dawn"), (1, 2, "Winter's End"), (1, 3, "The Long Road"), (1, 4, "The Long Road Home")]


@query("J15_named_by_card", "SELECT * FROM (VALUES (1, 1, 4), (2, 1, 2), (4, 1, 2), (5, 1, 1)) AS t(title, season, episode)")
def named_by_card(spark, sf_dir):
    """J14, J15, J16 and O17."""
    titles = spark.createDataFrame(_TITLES, "title int, text string").select("title", F.posexplode(X.cards(c("text"))).alias("pos", "c")).select("title", "pos", "c.*")
    return E.own_episodes(titles, spark.createDataFrame(_EPISODES, "season int, number int, name string"))


@query("O18_against_cards", "SELECT l_orderkey AS disc, count(*) FILTER (l_tax > 0.04 AND l_partkey % 5 <> 0) AS agree, count(*) FILTER (l_tax > 0.04 AND l_partkey % 5 = 0) AS disagree, CASE WHEN count(*) FILTER (l_tax > 0.04 AND l_partkey % 5 = 0) > 0 THEN 1 WHEN count(*) FILTER (l_tax > 0.04 AND l_partkey % 5 <> 0) > 0 THEN 2 END AS confidence FROM lineitem GROUP BY l_orderkey")
def against_cards(spark, sf_dir):
    """A25 and O18."""
    rows = table(spark, sf_dir, "lineitem").select(c("l_orderkey").alias("disc"), F.concat_ws(":", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice").alias("title"), c("l_linenumber").alias("episode"), "l_tax", "l_partkey")
    cards = rows.where("l_tax > 0.04").select("title", (c("episode") + F.when(c("l_partkey") % 5 == 0, 1).otherwise(0)).alias("episode"))
    return E.against_cards(rows.select("disc", "title", "episode"), cards, "disc")


@query("J18_unfiled_episodes", "WITH e AS (SELECT o_custkey AS season, o_orderkey AS episode, o_orderstatus = 'F' AS filed, row_number() OVER (PARTITION BY o_custkey) AS r FROM orders), k AS (SELECT season, count(*) FILTER (NOT filed) AS rest FROM e GROUP BY season) SELECT season, episode FROM e JOIN k USING (season) WHERE NOT filed OR rest < 4")
def unfiled(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(c("o_custkey").alias("season"), c("o_orderkey").alias("episode"), "o_orderstatus")
    titles = rows.select("season").distinct().withColumn("titles", F.lit(4))
    return E.unfiled(rows, rows.where("o_orderstatus = 'F'"), ["season", "episode"], "season", titles).select("season", "episode")


@query("O10_title_order", "SELECT p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY CASE WHEN p_size % 3 <> 0 THEN p_size ELSE 4294967295 END, p_name, p_partkey) AS place FROM part")
def title_order(spark, sf_dir):
    rows = table(spark, sf_dir, "part").withColumn("ix", F.when(c("p_size") % 3 != 0, c("p_size")))
    w = Window.partitionBy("p_brand").orderBy(*E.title_order(c("ix"), c("p_name")), "p_partkey")
    return rows.select("p_partkey", F.row_number().over(w).cast("long").alias("place"))


@query("A07_disc_sets", "SELECT CASE WHEN o_custkey % 4 = 0 THEN '#' || o_orderkey ELSE 'set ' || o_custkey END AS set, count(*) AS discs, array_to_string(list_sort(list(o_orderkey % 7)), ',') AS numbers, count(*) > 1 AND count(DISTINCT o_orderkey % 7) = count(*) AND max(o_orderkey % 7) - min(o_orderkey % 7) + 1 = count(*) AS orderable FROM orders GROUP BY 1")
def disc_sets(spark, sf_dir):
    """A07, P21 and W10."""
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.when(c("o_custkey") % 4 == 0, "").otherwise(F.concat(F.lit("set "), "o_custkey")).alias("label"), (c("o_orderkey") % 7).alias("number"))
    return E.group_sets(rows, "o_orderkey", "label", "number").withColumn("numbers", F.array_join("numbers", ","))


_SEASONS = "s AS (SELECT o_custkey AS disc, month(o_orderdate) AS season, min(o_totalprice) AS mean, max(o_totalprice) AS runner_up FROM orders GROUP BY ALL), r AS (SELECT *, row_number() OVER o AS r, lead(mean) OVER o AS nx FROM s WINDOW o AS (PARTITION BY disc ORDER BY mean, season))"


def _seasons(spark, sf_dir):
    return table(spark, sf_dir, "orders").groupBy(c("o_custkey").alias("disc"), F.month("o_orderdate").alias("season")).agg(F.min("o_totalprice").alias("mean"), F.max("o_totalprice").alias("runner_up"))


@query("O13_best_season", f"WITH {_SEASONS} SELECT disc, season, mean, round(least(runner_up, nx) - mean, 6) AS margin FROM r WHERE r = 1")
def best_season(spark, sf_dir):
    return E.rank_seasons(_seasons(spark, sf_dir), "disc", "season", "mean", "runner_up").withColumn("margin", F.round("margin", 6))


@query("O25_named_season", f"WITH {_SEASONS} SELECT disc, season, mean, round(least(runner_up, nx) - mean, 6) AS margin FROM r QUALIFY r = coalesce(max(CASE WHEN season = disc % 12 + 1 THEN r END) OVER (PARTITION BY disc), 1)")
def named_season(spark, sf_dir):
    rows = _seasons(spark, sf_dir).withColumn("hint", (c("disc") % 12 + 1).cast("int"))
    return E.rank_seasons(rows, "disc", "season", "mean", "runner_up", "hint").withColumn("margin", F.round("margin", 6))


@query("A23_check_outcome", f"SELECT source, CASE WHEN bool_or(verdict = 'contradicted') THEN 'contradicted' WHEN bool_and(verdict = 'unchecked') THEN 'unchecked' WHEN bool_or(verdict = 'confirmed') THEN 'confirmed' ELSE 'inconclusive' END AS outcome, NOT bool_or(verdict = 'contradicted') AS permits_filing FROM ({_OVER}, q AS (SELECT doc_id AS title, min(doc_id) OVER (PARTITION BY source) AS proposed FROM documents), {_CHECK}) JOIN documents ON doc_id = title GROUP BY source")
def check_outcome(spark, sf_dir):
    """A23 and P20."""
    docs, titles, references = _titles_and_references(spark, sf_dir)
    first = docs.groupBy("source").agg(F.min("doc_id").alias("proposed"))
    proposed = docs.join(first, "source").select(c("doc_id").alias("title"), "proposed")
    return E.outcome(R.check(titles, references, proposed).join(docs.select(c("doc_id").alias("title"), "source"), "title"), "source")


# One text serves both engines.
sql_query("A21_mean_runtime_delta", "SELECT l_orderkey AS disc, avg(abs(l_quantity - CASE WHEN p_size % 7 <> 0 THEN p_size END)) AS mean FROM {lineitem} JOIN {part} ON l_partkey = p_partkey GROUP BY l_orderkey")
sql_query("A28_package_bytes", "SELECT l_orderkey AS package, CAST(sum(l_quantity) AS BIGINT) AS bytes, count(CASE WHEN l_returnflag = 'N' THEN 1 END) AS audio FROM {lineitem} GROUP BY l_orderkey")
sql_query("J10_permanent_copies", "SELECT a.l_orderkey AS job, b.l_orderkey AS copy, a.l_partkey AS name FROM {lineitem} a JOIN {lineitem} b ON a.l_partkey = b.l_partkey AND a.l_quantity = b.l_quantity AND a.l_orderkey < b.l_orderkey")
sql_query("J26_trimmed_originals", "SELECT o.l_orderkey AS job, f.o_custkey AS filed, d.c_nationkey AS destination FROM {lineitem} o JOIN {orders} f ON o.l_orderkey = f.o_orderkey JOIN {customer} d ON f.o_custkey = d.c_custkey WHERE o.l_returnflag = 'R'")
sql_query("J32_header_agrees", "SELECT l_orderkey, l_partkey, l_suppkey, CASE WHEN l_partkey % 10 = l_suppkey % 10 THEN 2 ELSE 1 END AS confidence FROM {lineitem}")
sql_query("J34_jobs_by_fragment", "SELECT o_orderkey FROM {orders} WHERE CAST(o_orderkey AS STRING) LIKE '%12%'")
sql_query("O12_candidate_series", "SELECT query, film, place FROM (SELECT p_type AS query, p_partkey AS film, row_number() OVER (PARTITION BY p_type ORDER BY abs(p_size - 30), p_partkey) AS place FROM {part}) ranked WHERE place <= 4")
sql_query("O16_catalogue_order", "SELECT s_suppkey, row_number() OVER (PARTITION BY s_nationkey ORDER BY lower(s_name), s_suppkey) AS place FROM {supplier}")
sql_query("P24_image_sizes", "SELECT l_orderkey, l_partkey, l_suppkey, CAST(l_quantity AS BIGINT) * 2048 = CAST(l_linenumber AS BIGINT) * 8192 AS sound FROM {lineitem}")
sql_query("P25_tracks_tile", "SELECT l_orderkey AS disc, sum(CAST(l_quantity AS BIGINT)) = 100 AND count(CASE WHEN CAST(l_quantity AS BIGINT) % 2 <> 0 THEN 1 END) = 0 AS tiles FROM {lineitem} GROUP BY l_orderkey")
sql_query("P26_eligible_jobs", "SELECT o_orderkey FROM {orders} WHERE o_orderstatus = 'F'")
sql_query("U07_all_paths", "SELECT 'staging' AS place, l_partkey AS path FROM {lineitem} WHERE l_returnflag = 'R' UNION ALL SELECT 'destination', p_partkey FROM {part}")
sql_query("A27_seasons_touched", "SELECT o_custkey AS disc, count(DISTINCT o_orderpriority) AS seasons, min(o_orderpriority) AS first FROM {orders} GROUP BY o_custkey")
