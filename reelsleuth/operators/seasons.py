"""A disc's titles against a season: runtime windows, and what breaks their ties, in order captions, dialogue, disc number."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .solve import FEW, _begins, assign, by_groups, least_pairings, order_groups

# Minutes within which windows tie, and the lead that dialogue needs.
TIE_MINUTES, DIALOGUE_MARGIN = 0.5, 0.02


def pair_scores(titles: DataFrame, episodes: DataFrame, by: str, score: Column) -> DataFrame:
    """(by, title, pos, score…): each title of a disc with each episode of its season, scored once for all windows.

    Disc and season meet on `by`; both are small, and none of the pairs of different discs is formed.
    """
    return titles.join(episodes, by).select(by, "title", "pos", score.alias("score"), *[c for c in ("minutes", "runtime", "number") if c in titles.columns + episodes.columns])


def windows(pairs: DataFrame, by: str) -> DataFrame:
    """(by, start, title, pos, …): the pairs of each run of as many neighbouring episodes as the disc has titles.

    An episode lies in as many windows as there are titles, so rows grow with titles, never with the season's square.
    """
    sizes = pairs.groupBy(by).agg(F.countDistinct("title").alias("k"), F.max("pos").alias("last"))
    rows = pairs.join(sizes, by).withColumn("start", F.explode(F.sequence(F.greatest(F.lit(0), F.col("pos") - F.col("k") + 1), F.greatest(F.lit(0), F.least("pos", F.col("last") - F.col("k") + 1)))))
    return rows.where("start <= pos AND pos < start + k AND start + k <= last + 1").drop("last")


def paired(found: DataFrame, by: str, cost: str) -> DataFrame:
    """(by, start, title, pos, cost): the least-cost pairing within each window; many discs' windows are one call."""
    columns = [by, "start", "title", "pos", cost]

    def many(got: pd.DataFrame, _: np.ndarray) -> pd.DataFrame:
        first = _begins(got[by], got["start"])
        length = np.diff(np.append(first, len(got)))
        titles = np.add.reduceat(np.isin(np.arange(len(got)), _begins(got[by], got["start"], got["title"])).astype(np.int64), first)
        price, taken = got[cost].to_numpy(float), []
        for k in np.unique(titles[length == titles * titles]).tolist():
            at = first[(length == titles * titles) & (titles == k), None] + np.arange(k * k)
            grids = price[at].reshape(-1, k, k)
            chosen = least_pairings(grids) if k <= FEW else np.array([assign(g) for g in grids])
            taken.append((at[:, :1] + np.arange(k) * k + chosen).ravel())
        rows = np.sort(np.concatenate(taken)) if taken else np.zeros(0, np.int64)
        return got.iloc[rows[np.isfinite(price[rows])]][columns]

    types = dict(found.dtypes)
    return by_groups(found.select(*columns), by, ["start", "title", "pos"], many, ", ".join(f"{c} {types[c]}" for c in columns))


def by_cards(votes: DataFrame, by: str) -> DataFrame:
    """(by, start, agree): the window that no caption contradicts and that has more agreeing ones than any other, if there is one.

    `votes` is (by, start, agree, disagree).
    """
    ok = (F.col("disagree") == 0) & (F.col("agree") > 0)
    g = votes.groupBy(by).agg(F.max(F.when(ok, F.struct("agree", "start"))).alias("b"), F.collect_list("agree").alias("all"))  # a window an entry
    return g.where(F.size(F.filter("all", lambda a: a >= F.col("b.agree"))) == 1).select(by, F.col("b.start").alias("start"), F.col("b.agree").alias("agree"))


def by_dialogue(scores: DataFrame, by: str) -> DataFrame:
    """(by, start, margin): the window with the best mean dialogue score (by, start, score), if it leads by enough or is alone."""
    w = Window.partitionBy(by).orderBy(F.desc("score"), "start")
    rows = scores.withColumn("r", F.row_number().over(w)).withColumn("margin", F.col("score") - F.lead("score").over(w)).where("r = 1")
    return rows.where(F.coalesce(F.col("margin") >= DIALOGUE_MARGIN, F.lit(True))).select(by, "start", "margin")


def choose_window(means: DataFrame, votes: DataFrame, dialogue: DataFrame, hints: DataFrame, by: str) -> DataFrame:
    """(by, start, number, mean, decided_by, tied): the best window by runtime, or of those tied with it the one that captions, else
    dialogue, else the disc's number points at.

    `means` is (by, start, number, mean, k), `hints` (by, hint): 0 says that the disc is the next run.
    """
    w = Window.partitionBy(by)
    rows = means.withColumn("least", F.min("mean").over(w)).withColumn("first_number", F.min_by("number", "start").over(w))
    ties = rows.where(F.col("mean") - F.col("least") <= TIE_MINUTES).withColumn("tied", F.count(F.lit(1)).over(w))
    cards = by_cards(votes.join(ties.select(by, "start"), [by, "start"], "left_semi"), by).select(by, F.col("start").alias("by_card"))
    spoken = by_dialogue(dialogue.join(ties.select(by, "start"), [by, "start"], "left_semi"), by).select(by, F.col("start").alias("by_speech"))
    all_ = ties.join(cards, by, "left").join(spoken, by, "left").join(hints, by, "left")
    expected = F.when(F.col("hint") == 0, F.col("first_number")).otherwise((F.col("hint") - 1) * F.col("k") + 1)
    rank = (
        F.when(F.col("tied") == 1, F.lit(3)).when(F.col("start") == F.col("by_card"), 0)
        .when(F.col("by_card").isNull() & (F.col("start") == F.col("by_speech")), 1)
        .when(F.col("by_card").isNull() & F.col("by_speech").isNull() & (F.col("number") == expected), 2).otherwise(3)
    )
    order = Window.partitionBy(by).orderBy("_rank", "mean", "start")
    best = all_.withColumn("_rank", rank).withColumn("_r", F.row_number().over(order)).where("_r = 1")
    how = F.element_at(F.array(*[F.lit(x) for x in ("cards", "dialogue", "disc number", "runtime")]), F.col("_rank") + 1)
    return best.select(by, "start", "number", "mean", how.alias("decided_by"), F.col("tied").cast("long").alias("tied"))


def place_in_window(chosen: DataFrame, found: DataFrame, by: str, **names: str) -> DataFrame:
    """The titles of each disc among the episodes of its chosen window, by captions, dialogue, runtime and disc order."""
    rows = found.join(chosen.select(by, "start"), [by, "start"], "left_semi")
    return order_groups(rows, by, "title", "pos", **names)


def fewer_numbering_doubts(plain: DataFrame, shifted: DataFrame, by: str) -> DataFrame:
    """(by, plain, shifted, numbering): the numbering by which more titles are confirmed; the listed one where both confirm as many."""
    count = lambda rows, name: rows.groupBy(by).agg(F.count_if(F.col("verdict") == "confirmed").alias(name))
    both = count(plain, "plain").join(count(shifted, "shifted"), by, "full").na.fill(0, ["plain", "shifted"])
    return both.withColumn("numbering", F.when(F.col("shifted") > F.col("plain"), "shifted").otherwise("listed"))


def mapped_references(episodes: DataFrame, references: DataFrame, by: str) -> DataFrame:
    """(by, pos, phrases, halves): an episode's phrases, from the references of its numbers, one or two of them united.

    `episodes` is (by, pos, numbers array), `references` (by, number, phrases array). An episode that lacks one of its
    references has none.
    """
    rows = episodes.withColumn("number", F.explode("numbers")).join(references, [by, "number"], "left")
    g = rows.groupBy(by, "pos").agg(F.count(F.lit(1)).alias("wanted"), F.count("phrases").alias("got"), F.array_distinct(F.flatten(F.collect_list("phrases"))).alias("phrases"))
    return g.select(by, "pos", F.when(F.col("got") == F.col("wanted"), F.col("phrases")).alias("phrases"), (F.col("wanted") == 2).alias("halves"))


def first_best(rows: DataFrame, by: str, value: Column, order: str, keep: list[str]) -> DataFrame:
    """The row of each group with the greatest value, the first in order of equals."""
    w = Window.partitionBy(by).orderBy(value.desc(), order)
    return rows.withColumn("_r", F.row_number().over(w)).where("_r = 1").select(by, *keep)
