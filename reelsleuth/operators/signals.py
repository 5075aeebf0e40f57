"""Scores that weigh runtime and dialogue, and the confidence that follows from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reelsleuth.functions.text import stem, tokens

# Tolerances in minutes and shares, and the weights of the two signals.
RUNTIME_SPAN, UNKNOWN_RUNTIME = 10.0, 0.5
VETO_MINUTES, VETO_SHARE = 15.0, 0.35
RUNTIME_WEIGHT, DIALOGUE_WEIGHT = 0.35, 0.65
LEAST_MARGIN = 0.05
FILM_MINUTES, FILM_SHARE = 4.0, 0.03


def runtime_score(minutes: Column, listed: Column) -> Column:
    """1 at the listed runtime, falling to 0 ten minutes off; an unknown runtime scores a neutral half."""
    return F.when(listed.isNull(), F.lit(UNKNOWN_RUNTIME)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - F.abs(minutes - listed) / RUNTIME_SPAN)))


def runtime_implausible(minutes: Column, listed: Column) -> Column:
    """Far off in minutes and in proportion; never where either is unknown or not positive."""
    off = F.abs(minutes - listed)
    return F.coalesce((listed > 0) & (minutes > 0) & (off > VETO_MINUTES) & (off / F.greatest(minutes, listed.cast("double")) > VETO_SHARE), F.lit(False))


def combined(runtime: Column, dialogue: Column) -> Column:
    """The weighted blend, or runtime alone where there is no dialogue."""
    return F.coalesce(RUNTIME_WEIGHT * runtime + DIALOGUE_WEIGHT * dialogue, runtime)


def film_fits(minutes: Column, listed: Column) -> Column:
    return F.coalesce(F.abs(minutes - listed) <= F.greatest(F.lit(FILM_MINUTES), listed * FILM_SHARE), F.lit(False))


def close_to_sum(seconds: Column, total: Column) -> Column:
    return F.coalesce((total > 0) & (F.abs(seconds - total) / total <= 0.005), F.lit(False))


def enough_measured(counted: Column, titles: Column) -> Column:
    return (counted >= 2) & (3 * counted >= 2 * titles)


def stems_of(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, stem, n): how often each stem occurs."""
    words = docs.select(F.col(id_col).alias("id"), F.explode(tokens(F.col(text_col))).alias("word"))
    # Words repeat far more than they differ: count first, stem what is left.
    counted = words.groupBy("id", "word").agg(F.count(F.lit(1)).alias("n"))
    return counted.groupBy("id", stem(F.col("word")).alias("stem")).agg(F.sum("n").alias("n"))


def idf(corpus: DataFrame) -> DataFrame:
    """(stem, df, idf) over (id, stem, …), each pair once: the smoothed inverse document frequency, 0 at least."""
    n = corpus.select("id").distinct().agg(F.count(F.lit(1)).alias("docs"))
    df = corpus.groupBy("stem").agg(F.count(F.lit(1)).alias("df"))
    return df.join(F.broadcast(n)).select("stem", "df", F.greatest(F.lit(0.0), F.log((F.col("docs") + 1) / (F.col("df") + 1))).alias("idf"))


#: Postings of the references that are broadcast at most, 50 bytes each; more meet the titles by a shuffle.
POSTINGS = 2_000_000


def _held(rows: DataFrame) -> DataFrame:
    """`rows`, broadcast if they are few."""
    return F.broadcast(rows) if rows.limit(POSTINGS + 1).count() <= POSTINGS else rows


def weighted_containment(titles: DataFrame, references: DataFrame) -> DataFrame:
    """(title, reference, score): of a reference's stems, weighed by rarity, the share that the title speaks.

    Both are (id, stem, n); pairs without a common stem score 0 and aren't returned. A stem that all references hold pairs its
    titles with each of them, so that the result has as many rows; few postings are broadcast, and no frequent stem is shuffled then.
    """
    refs = references.join(idf(references), "stem").select(F.col("id").alias("reference"), "stem", "idf")
    totals = refs.groupBy("reference").agg(F.sum("idf").alias("total")).where("total > 0")
    hits = titles.select(F.col("id").alias("title"), "stem").join(_held(refs), "stem").groupBy("title", "reference").agg(F.sum("idf").alias("hit"))
    return hits.join(totals, "reference").select("title", "reference", (F.col("hit") / F.col("total")).alias("score"))


def distinctive_fit(titles: DataFrame, references: DataFrame) -> DataFrame:
    """(title, reference, raw, z): dialogue fit in population standard deviations of the title's row.

    Pairs without a common stem have raw 0; they count in mean and deviation but aren't returned, so no
    product of all titles and references is formed.
    """
    refs = references.join(idf(references), "stem").select(F.col("id").alias("reference"), "stem", F.col("idf").alias("ref_idf"))
    totals = refs.groupBy("reference").agg(F.sum("ref_idf").alias("total")).where("total > 0")
    own = idf(titles).select("stem", F.col("idf").alias("own_idf"))
    spoken = titles.join(own, "stem").select(F.col("id").alias("title"), "stem", (F.col("own_idf") * F.log1p("n")).alias("weight"))
    hits = spoken.join(_held(refs), "stem").groupBy("title", "reference").agg(F.sum(F.col("ref_idf") * F.col("weight")).alias("hit"))
    raw = hits.join(totals, "reference").select("title", "reference", (F.col("hit") / F.col("total")).alias("raw"))
    n = references.select("id").distinct().agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("title")
    rows = raw.join(F.broadcast(n)).withColumn("mean", F.sum("raw").over(w) / F.col("n"))
    square = F.sum((F.col("raw") - F.col("mean")) * (F.col("raw") - F.col("mean"))).over(w) + (F.col("n") - F.count(F.lit(1)).over(w)) * F.col("mean") * F.col("mean")
    rows = rows.withColumn("sd", F.sqrt(square / F.col("n")))
    return rows.select("title", "reference", "raw", F.when(F.col("sd") > 0, (F.col("raw") - F.col("mean")) / F.col("sd")).otherwise(0.0).alias("z"))


def set_confidence(verdicts: DataFrame, by: str) -> DataFrame:
    """(by, confidence 0 to 3): from (by, margin, dialogue_pick, chosen).

    Weak on any thin margin or too little dialogue; strong if two thirds of the dialogue confirm.
    """
    spoke = F.col("dialogue_pick").isNotNull()
    agg = verdicts.groupBy(by).agg(
        F.min("margin").alias("margin"), F.count(F.lit(1)).alias("n"), F.count_if(spoke).alias("spoken"), F.count_if(F.col("dialogue_pick") == F.col("chosen")).alias("confirm"),
    )
    weak = (F.col("margin") < LEAST_MARGIN) | (F.col("spoken") * 2 < F.col("n")) | (F.col("spoken") < 2) | (F.col("confirm") * 3 < F.col("spoken") * 2)
    return agg.select(by, F.when(weak, 1).otherwise(2).alias("confidence"))
