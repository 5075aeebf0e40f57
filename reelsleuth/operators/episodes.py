"""Titles, captions and episodes: who names whom, what is filed already, which season and order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reelsleuth.functions.text import caption_words


def named_episodes(cards: DataFrame, episodes: DataFrame) -> DataFrame:
    """(…cards, season, episode): the episode whose whole name begins what follows a caption, the longest name, the last of equals.

    Names and captions meet on their first word, an equal key, before the prefix is compared.
    """
    names = episodes.select(F.col("season").alias("season"), F.col("number").alias("episode"), F.array_join(caption_words(F.col("name")), " ").alias("_name")).where("_name <> ''")
    first = lambda c: F.substring_index(c, " ", 1)
    both = cards.withColumn("_k", first(F.col("following"))).join(names.withColumn("_k", first(F.col("_name"))), "_k")
    hit = (F.col("following") == F.col("_name")) | F.col("following").startswith(F.concat("_name", F.lit(" ")))
    best = both.where(hit).groupBy("title", "pos", "number", "next").agg(F.max(F.struct(F.length("_name").alias("n"), "season", "episode")).alias("b"))
    return best.select("title", "pos", "number", "next", "b.season", "b.episode")


def own_episodes(cards: DataFrame, episodes: DataFrame) -> DataFrame:
    """(title, season, episode): by a title's first numbered caption that names an episode, or else the one before what its first
    "next episode" names. `cards` is (title, pos, number, following, next)."""
    found = named_episodes(cards, episodes)
    own = found.where("NOT next AND number IS NOT NULL").groupBy("title").agg(F.min(F.struct("pos", "season", "episode")).alias("o"))
    after = found.where("next").groupBy("title").agg(F.min(F.struct("pos", "season", "episode")).alias("a"))
    before = after.select("title", F.col("a.season").alias("season"), (F.col("a.episode") - 1).alias("episode"))
    before = before.join(episodes.select("season", F.col("number").alias("episode")).distinct(), ["season", "episode"], "left_semi")
    rows = own.select("title", F.col("o.season").alias("season"), F.col("o.episode").alias("episode"), F.lit(0).alias("r")).unionByName(before.withColumn("r", F.lit(1)))
    return rows.groupBy("title").agg(F.min(F.struct("r", "season", "episode")).alias("x")).select("title", "x.season", "x.episode")


def against_cards(chosen: DataFrame, cards: DataFrame, by: str) -> DataFrame:
    """(by, agree, disagree, confidence): weak on any contradiction, strong if captions all agree, else null."""
    rows = chosen.join(cards.select("title", F.col("episode").alias("_card")), "title", "left")
    g = rows.groupBy(by).agg(F.count_if(F.col("_card") == F.col("episode")).alias("agree"), F.count_if(F.col("_card") != F.col("episode")).alias("disagree"))
    return g.withColumn("confidence", F.when(F.col("disagree") > 0, 1).when(F.col("agree") > 0, 2))


def unfiled(episodes: DataFrame, filed: DataFrame, key: list[str], by: str, titles: DataFrame) -> DataFrame:
    """`episodes` without those filed already, unless fewer would be left than the disc has titles (by, titles)."""
    rest = episodes.join(filed.select(*key).distinct(), key, "left_anti")
    left = rest.groupBy(by).agg(F.count(F.lit(1)).alias("_left"))
    known = episodes.select(by).distinct().join(left, by, "left").join(titles, by, "left")
    enough = known.select(by, (F.coalesce("_left", F.lit(0)) >= F.coalesce("titles", F.lit(0))).alias("_enough"))
    marked = episodes.join(filed.select(*key).distinct().withColumn("_filed", F.lit(True)), key, "left").join(enough, by)
    return marked.where(~F.col("_enough") | F.col("_filed").isNull()).select(*episodes.columns)


def title_order(index: Column, name: Column) -> list[Column]:
    """By the number in the name, those without one last; then by name."""
    return [F.coalesce(index.cast("long"), F.lit(4294967295)), name]


def group_sets(discs: DataFrame, key: str, label: str, number: str) -> DataFrame:
    """(set, discs, numbers, orderable): discs by label; one without a label is a set of its own."""
    rows = discs.withColumn("_set", F.coalesce(F.nullif(F.col(label), F.lit("")), F.concat(F.lit("#"), F.col(key).cast("string"))))
    g = rows.groupBy("_set").agg(F.count(F.lit(1)).alias("discs"), F.array_sort(F.collect_list(number)).alias("numbers"))
    n = F.col("numbers")
    run = (F.size(n) == F.col("discs")) & (F.size(F.array_distinct(n)) == F.size(n)) & (F.array_max(n) - F.array_min(n) + 1 == F.size(n))
    return g.select(F.col("_set").alias("set"), "discs", "numbers", ((F.col("discs") > 1) & F.coalesce(run, F.lit(False))).alias("orderable"))


def rank_seasons(found: DataFrame, by: str, season: str, mean: str, runner_up: str, hint: str | None = None) -> DataFrame:
    """(by, season, mean, margin): the best season, or the one that the label names; the margin is to the nearest window anywhere."""
    w = Window.partitionBy(by)
    order = w.orderBy(mean, season)
    rows = found.withColumn("_r", F.row_number().over(order)).withColumn("_next", F.lead(mean).over(order))
    if hint:
        rows = rows.withColumn("_named", F.max(F.when(F.col(season) == F.col(hint), F.col("_r"))).over(w))
        rows = rows.where(F.col("_r") == F.coalesce("_named", F.lit(1)))
    else:
        rows = rows.where("_r = 1")
    return rows.select(by, season, mean, (F.least(runner_up, "_next") - F.col(mean)).alias("margin"))


def select_one(items: DataFrame, needle: str, id_col: str, name_col: str) -> DataFrame:
    """The item with that id, or whose name holds the text; several or none is an error. One pass gathers six names at most."""
    text = F.lit(needle.lower())
    by_id, by_name = F.lower(id_col) == text, F.contains(F.lower(F.col(name_col)), text)
    hits = items.where(by_id | by_name).select(F.coalesce(by_id, F.lit(False)).alias("exact"), F.col(name_col).alias("name"))
    seen = hits.groupBy("exact").agg(F.count(F.lit(1)).alias("n"), F.min("name").alias("first"), F.max("name").alias("last")).collect()  # two rows
    best = next((r for r in seen if r["exact"]), seen[0] if seen else None)
    if best is None or best["n"] != 1:
        raise LookupError(f"{needle!r} names " + ("nothing" if best is None else f"several: {best['n']}, from {best['first']} to {best['last']}"))
    return items.where(by_id if best["exact"] else by_name)


def outcome(verdicts: DataFrame, by: str) -> DataFrame:
    """(by, outcome, permits_filing): what the verdicts of a disc's titles add up to."""
    has = lambda v: F.bool_or(F.col("verdict") == v)
    g = verdicts.groupBy(by).agg(has("contradicted").alias("no"), has("confirmed").alias("yes"), F.bool_and(F.col("verdict") == "unchecked").alias("none"))
    found = F.when(F.col("no"), "contradicted").when(F.col("none"), "unchecked").when(F.col("yes"), "confirmed").otherwise("inconclusive")
    return g.select(by, found.alias("outcome"), (~F.col("no")).alias("permits_filing"))
