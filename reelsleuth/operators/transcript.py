"""Transcripts against references by overlap of word trigrams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reelsleuth.functions.text import LEAST_PHRASES, phrases, share

# The share that says "the same", and how far it must lie above any rival.
LEAST_SHARE, LEAST_RATIO = 0.25, 3.0


#: Phrases of references that are broadcast at most, 30 bytes each; more meet the titles by a shuffle.
POSTINGS = 2_000_000


def phrase_rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, phrase): distinct trigrams of each row as 64-bit hashes, for sets that go over several rows."""
    return docs.select(F.col(id_col).alias("id"), F.explode(F.transform(phrases(F.col(text_col)), lambda p: F.xxhash64(p))).alias("phrase"))


def sizes(rows: DataFrame) -> DataFrame:
    return rows.groupBy("id").agg(F.count(F.lit(1)).alias("n"))


def phrase_sets(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, n, phrases): distinct trigrams as 64-bit hashes, and how many; one row a text, no shuffle."""
    rows = docs.select(F.col(id_col).alias("id"), F.transform(phrases(F.col(text_col)), lambda p: F.xxhash64(p)).alias("phrases"))
    return rows.select("id", F.size("phrases").cast("long").alias("n"), "phrases")


def overlaps(titles: DataFrame, references: DataFrame) -> DataFrame:
    """(title, reference, title_n, reference_n, common, share) of each pair with a common trigram, from phrase_sets()."""
    posted = references.select(F.col("id").alias("reference"), F.col("n").alias("reference_n"), F.explode("phrases").alias("phrase"))
    few = (references.agg(F.sum("n")).first()[0] or 0) <= POSTINGS
    spoken = titles.select(F.col("id").alias("title"), F.col("n").alias("title_n"), F.explode("phrases").alias("phrase"))
    common = spoken.join(F.broadcast(posted) if few else posted, "phrase").groupBy("title", "reference", "title_n", "reference_n").agg(F.count(F.lit(1)).alias("common"))
    return common.withColumn("share", share(F.col("common"), F.col("title_n"), F.col("reference_n")))


def check(titles: DataFrame, references: DataFrame, proposed: DataFrame) -> DataFrame:
    """(title, proposed, verdict, share, rival, rival_share) for each row of `proposed` (title, proposed).

    Confirmed: a quarter of the trigrams match, and three times those of any rival. Contradicted: a rival clears
    the same bar against the proposal. Unchecked: either side has too few trigrams. Of equal rivals the last counts.
    """
    return _checked(overlaps(titles, references), titles, references, proposed)


def _checked(pairs: DataFrame, titles: DataFrame, references: DataFrame, proposed: DataFrame) -> DataFrame:
    found = pairs.where((F.col("title_n") >= LEAST_PHRASES) & (F.col("reference_n") >= LEAST_PHRASES))
    usable = lambda rows, name: rows.where(F.col("n") >= LEAST_PHRASES).select(F.col("id").alias(name), F.lit(True).alias(f"{name}_ok"))
    rows = proposed.join(usable(titles, "title"), "title", "left").join(usable(references, "proposed"), "proposed", "left")
    # One grouping gives both the proposal's share and the best rival.
    both = proposed.join(found.select("title", "reference", "share"), "title")
    own = F.col("reference") == F.col("proposed")
    sides = both.groupBy("title", "proposed").agg(F.max(F.when(own, F.col("share"))).alias("share"), F.max(F.when(~own, F.struct(F.col("share").alias("rival_share"), "reference"))).alias("r"))
    rows = rows.join(sides, ["title", "proposed"], "left")
    s, rival = F.coalesce("share", F.lit(0.0)), F.coalesce("r.rival_share", F.lit(0.0))
    clears = lambda a, b: (a >= LEAST_SHARE) & (a >= LEAST_RATIO * b)
    verdict = (
        F.when(F.col("title_ok").isNull() | F.col("proposed_ok").isNull(), "unchecked")
        .when(clears(s, rival), "confirmed").when(clears(rival, s), "contradicted").otherwise("inconclusive")
    )
    return rows.select("title", "proposed", verdict.alias("verdict"), s.alias("share"), F.col("r.reference").alias("rival"), rival.alias("rival_share"))


def place(titles: DataFrame, references: DataFrame) -> DataFrame:
    """check() of each usable title at its best reference, the last of equals; others aren't returned. One pass over the overlaps."""
    found = overlaps(titles, references).where((F.col("title_n") >= LEAST_PHRASES) & (F.col("reference_n") >= LEAST_PHRASES))
    w = Window.partitionBy("title").orderBy(F.desc("share"), F.desc("reference"))
    rows = found.withColumn("_r", F.row_number().over(w)).withColumn("_rival", F.lead(F.struct("share", "reference")).over(w)).where("_r = 1")
    s, rival = F.col("share"), F.coalesce("_rival.share", F.lit(0.0))
    verdict = F.when((s >= LEAST_SHARE) & (s >= LEAST_RATIO * rival), "confirmed").when((rival >= LEAST_SHARE) & (rival >= LEAST_RATIO * s), "contradicted").otherwise("inconclusive")
    return rows.select("title", F.col("reference").alias("proposed"), verdict.alias("verdict"), s.alias("share"), F.col("_rival.reference").alias("rival"), rival.alias("rival_share"))


def piece(first: Column, second: Column) -> Column:
    """Which half of a two-parter a title is: one half must match by itself, three times as well as the other."""
    side = lambda hit, miss: (hit >= LEAST_SHARE) & (miss * 3 < hit)
    return F.when(side(first, second), "part 1").when(side(second, first), "part 2").otherwise("whole")


def piece_of_separate(first: Column, second: Column, margin: float = 0.15) -> Column:
    """The same where the halves are references of their own: one must lead by a margin."""
    side = lambda hit, miss: (hit >= LEAST_SHARE) & (hit >= miss + margin)
    return F.when(side(first, second), "part 1").when(side(second, first), "part 2").otherwise("whole")


def describe(verdict: Column, share_: Column, rival_share: Column, rival_name: Column | None = None) -> Column:
    """The verdict in words. Shares are whole percents, halves to even."""
    pct = lambda x: F.concat(F.bround(x * 100, 0).cast("long").cast("string"), F.lit("%"))
    name = F.lit("another episode") if rival_name is None else F.coalesce(rival_name, F.lit("another episode"))
    # The notes that users know.
    return (
        F.when(verdict == "confirmed", F.concat(F.lit("reference subtitles confirm it: "), pct(share_), F.lit(" of its phrases match, against at most "), pct(rival_share), F.lit(" for any other episode checked")))
        .when(verdict == "contradicted", F.concat(F.lit("reference subtitles CONTRADICT it: "), pct(share_), F.lit(" of its phrases match, but "), pct(rival_share), F.lit(" match "), name))
        .when(verdict == "inconclusive", F.concat(F.lit("reference subtitles are inconclusive: "), pct(share_), F.lit(" of its phrases match, "), pct(rival_share), F.lit(" for the closest other episode")))
        .otherwise("no reference subtitle or no dialogue to check")
    )
