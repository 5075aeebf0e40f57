"""Operators over ordered rows: runs, windows, play-alls, numbering, version choice."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ALL_BEFORE = (Window.unboundedPreceding, -1)


def bad_runs(rows: DataFrame, by: list[str], at: str, bad: Column) -> DataFrame:
    """(by…, first, length, units): runs of neighbouring bad places of a dense numbering `at` from 0, and how many places there are."""
    units = rows.groupBy(*by).agg((F.max(at) + 1).alias("units"))
    hits = rows.where(bad).select(*by, at)
    island = F.col(at) - F.row_number().over(Window.partitionBy(*by).orderBy(at))
    runs = hits.withColumn("island", island).groupBy(*by, "island").agg(F.min(at).alias("first"), F.count(F.lit(1)).alias("length"))
    return runs.drop("island").join(units, by)


def run_summary(runs: DataFrame, by: list[str]) -> DataFrame:
    """(by…, runs, bad, interior, edge): an edge run begins at 0 or ends at the last place."""
    edge = (F.col("first") == 0) | (F.col("first") + F.col("length") == F.col("units"))
    return runs.groupBy(*by).agg(
        F.count(F.lit(1)).alias("runs"), F.sum("length").alias("bad"),
        F.coalesce(F.sum(F.when(~edge, F.col("length"))), F.lit(0)).alias("interior"), F.coalesce(F.sum(F.when(edge, F.col("length"))), F.lit(0)).alias("edge"),
    )


def play_all(titles: DataFrame, by: str, ix: str, secs: str, chapters: str) -> DataFrame:
    """(by, position, first, last, members_secs): the one longest title that plays others back to back.

    Either all others together last as long within half a per cent, or a run of two or more neighbours
    does whose chapters are as many, or one fewer. The first run by start, then end, is taken.
    """
    w = Window.partitionBy(by)
    marked = titles.withColumn("most", F.max(secs).over(w)).withColumn("n", F.count(F.lit(1)).over(w))
    marked = marked.withColumn("ties", F.sum((F.col(secs) == F.col("most")).cast("int")).over(w)).where("ties = 1 AND n >= 3")
    longest = marked.where(F.col(secs) == F.col("most")).select(by, F.col(ix).alias("position"), F.col(secs).alias("long_secs"), F.col(chapters).alias("long_chapters"))
    others = marked.where(F.col(secs) < F.col("most"))
    ordered = Window.partitionBy(by).orderBy(ix)
    sums = others.select(by, F.col(ix).alias("ix"), F.row_number().over(ordered).alias("r"), F.sum(secs).over(ordered).alias("s"), F.sum(chapters).over(ordered).alias("c"), F.col(secs).alias("own_s"), F.col(chapters).alias("own_c"))
    start = sums.select(by, F.col("ix").alias("first"), F.col("r").alias("r0"), (F.col("s") - F.col("own_s")).alias("s0"), (F.col("c") - F.col("own_c")).alias("c0"))
    end = sums.select(by, F.col("ix").alias("last"), F.col("r").alias("r1"), F.col("s").alias("s1"), F.col("c").alias("c1"))
    n = others.groupBy(by).agg(F.count(F.lit(1)).alias("others"))
    # Members of a set share a key; sets are discs, so that pairs within one are few.
    runs = longest.join(start, by).join(end, by).join(n, by).where("r1 > r0")
    total, parts = F.col("s1") - F.col("s0"), F.col("c1") - F.col("c0")
    close = (total > 0) & (F.abs(F.col("long_secs") - total) / total <= 0.005)
    whole = (F.col("r0") == 1) & (F.col("r1") == F.col("others"))
    some = (F.col("long_chapters") > 0) & ((parts == F.col("long_chapters")) | (parts + 1 == F.col("long_chapters")))
    best = runs.where(close & (whole | some)).groupBy(by).agg(F.min(F.struct((~whole).alias("part"), "r0", "r1", "position", "first", "last", total.alias("members_secs"))).alias("b"))
    return best.select(by, "b.position", "b.first", "b.last", "b.members_secs")


def numbering(entries: DataFrame, by: str, at: str, number: str, minutes: str, ratio: float = 1.8) -> DataFrame:
    """(by, at, numbers): subtitle numbers of listed entries, where double-length ones hold two each.

    An entry is double from `ratio` times the upper median of the known runtimes; without a double before the
    last entry a list keeps its own numbers and isn't returned.
    """
    known = entries.where(F.col(minutes) > 0)
    rank = known.select(by, F.col(minutes).alias("m"), F.row_number().over(Window.partitionBy(by).orderBy(minutes)).alias("r"), F.count(F.lit(1)).over(Window.partitionBy(by)).alias("k"))
    median = rank.where(F.expr("r = k div 2 + 1")).select(by, F.col("m").alias("median"))
    w = Window.partitionBy(by)
    rows = entries.join(median, by).withColumn("double", F.coalesce(F.col(minutes) >= ratio * F.col("median"), F.lit(False)).cast("int"))
    rows = rows.withColumn("shift", F.coalesce(F.sum("double").over(w.orderBy(at).rowsBetween(*ALL_BEFORE)), F.lit(0)))
    rows = rows.withColumn("early", F.min(F.when(F.col("double") == 1, F.col(at))).over(w)).withColumn("end", F.max(at).over(w))
    first = F.col(number) + F.col("shift")
    return rows.where("early < end").select(by, at, F.when(F.col("double") == 1, F.array(first, first + 1)).otherwise(F.array(first)).alias("numbers"))


def windows(episodes: DataFrame, by: str, at: str, minutes: str, titles: list[float]) -> DataFrame:
    """(by, start, mean, worst, counted): each run of neighbouring episodes against the titles in their order.

    Unknown runtimes are passed over; a window with fewer than two, or two thirds, measured isn't returned.
    """
    k = len(titles)
    w = Window.partitionBy(by).orderBy(at)
    gathered = episodes.withColumn("m", F.collect_list(F.struct(F.col(minutes).alias("v"))).over(w.rowsBetween(0, k - 1))).where(F.size("m") == k)
    deltas = F.filter(F.zip_with("m", F.array(*[F.lit(float(t)) for t in titles]), lambda e, t: F.abs(t - e["v"])), lambda d: d.isNotNull())
    rows = gathered.withColumn("d", deltas).withColumn("counted", F.size("d")).where(f"counted >= 2 AND 3 * counted >= {2 * k}")
    return rows.select(by, F.col(at).alias("start"), (F.aggregate("d", F.lit(0.0), lambda a, x: a + x) / F.col("counted")).alias("mean"), F.array_max("d").alias("worst"), "counted")


def best_window(found: DataFrame, by: str, tie: float = 0.5) -> DataFrame:
    """(by, start, mean, margin, tied): the best window, how far the next lies behind, and how many are within `tie`."""
    w = Window.partitionBy(by)
    order = w.orderBy("mean", "start")
    ranked = found.withColumn("r", F.row_number().over(order)).withColumn("next", F.lead("mean").over(order)).withColumn("least", F.min("mean").over(w))
    ranked = ranked.withColumn("tied", F.sum((F.abs(F.col("mean") - F.col("least")) <= tie).cast("long")).over(w))
    return ranked.where("r = 1").select(by, "start", "mean", (F.col("next") - F.col("mean")).alias("margin"), "tied")


def keep_version(rows: DataFrame, by: list[str], height: str, audio: str, off: str, at: str) -> DataFrame:
    """One row a group: the tallest picture, the fewest audio tracks, the nearest runtime, the first."""
    order = Window.partitionBy(*by).orderBy(F.desc(height), F.asc(audio), F.asc_nulls_last(off), F.asc(at))
    return rows.withColumn("_r", F.row_number().over(order)).where("_r = 1").drop("_r")


def fold_wider(rows: DataFrame, by: str, at: str, value: str, least: float) -> DataFrame:
    """(by, at, value): the first row that no later one exceeds by more than `least` over what was kept: a fold, not a maximum."""
    ordered = F.array_sort(F.collect_list(F.struct(F.col(at).alias("at"), F.col(value).alias("value"))))
    kept = rows.groupBy(by).agg(ordered.alias("x")).select(by, F.aggregate(F.slice("x", 2, F.greatest(F.size("x") - 1, F.lit(0))), F.col("x")[0], lambda a, t: F.when(t["value"] > a["value"] + least, t).otherwise(a)).alias("k"))
    return kept.select(by, F.col("k.at").alias(at), F.col("k.value").alias(value))


def consecutive(rows: DataFrame, by: str, number: str) -> DataFrame:
    """(by, n, orderable): whether the numbers are a run without gap or repeat."""
    g = rows.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.countDistinct(number).alias("d"), (F.max(number) - F.min(number) + 1).alias("span"))
    return g.select(by, "n", ((F.col("n") == F.col("d")) & (F.col("n") == F.col("span")) & (F.col("n") > 1)).alias("orderable"))


def track_ranges(tracks: DataFrame, by: str, start: str, leadout: Column) -> DataFrame:
    """Adds end and ms: to the next track's start, or to the lead-out; 75 sectors are a second."""
    end = F.coalesce(F.lead(start).over(Window.partitionBy(by).orderBy(start)), leadout)
    return tracks.withColumn("end", end).withColumn("ms", F.expr(f"(end - {start}) * 1000 div 75"))
