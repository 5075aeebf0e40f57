"""Reconciling manifests with storage: plans of what to move, keep, verify and drop. Nothing here touches a file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def accepts(media: Column, category: Column) -> Column:
    """A destination without a list takes everything."""
    return (F.size(media) == 0) | F.array_contains(media, category)


def route(files: DataFrame, destinations: DataFrame, category: str) -> DataFrame:
    """`files` with the first destination (at, root, media, free) in order that accepts their category; null if none does.

    Destinations are a configuration of some rows; which categories each takes is worked out once a category.
    """
    kinds = files.select(category).distinct()
    fits = kinds.join(F.broadcast(destinations), accepts(F.col("media"), F.col(category)))
    first = fits.groupBy(category).agg(F.min(F.struct("at", "root", "free")).alias("d"))
    return files.join(first, category, "left").select(*files.columns, F.col("d.root").alias("root"), F.col("d.free").alias("free"))


def space(plan: DataFrame, assume_yes: bool = False) -> DataFrame:
    """(root, needed, free, verdict): unknown free space is refused unless that is agreed to."""
    g = plan.where(F.col("root").isNotNull()).groupBy("root").agg(F.sum("bytes").alias("needed"), F.max("free").alias("free"))
    verdict = F.when(F.col("free").isNull(), "ok" if assume_yes else "unknown").when(F.col("free") < F.col("needed"), "short").otherwise("ok")
    return g.select("root", "needed", "free", verdict.alias("verdict"))


def reconcile(manifest: DataFrame, disk: DataFrame, key: list[str]) -> DataFrame:
    """(key…, job, verdict): what is recorded (bytes, sha256) against what lies there: ok, missing, size or hash."""
    found = disk.select(*key, F.col("bytes").alias("_bytes"), F.col("sha256").alias("_sha256"), F.lit(True).alias("_there"))
    rows = manifest.join(found, key, "left")
    verdict = F.when(F.col("_there").isNull(), "missing").when(F.col("bytes") != F.col("_bytes"), "size").when(F.col("sha256") != F.col("_sha256"), "hash").otherwise("ok")
    return rows.select(*manifest.columns, verdict.alias("verdict"))


def located(files: DataFrame, staging: DataFrame, stored: DataFrame, key: str) -> DataFrame:
    """(key, place): staging first, else the destination, else missing."""
    a, b = staging.select(key).distinct().withColumn("_a", F.lit(True)), stored.select(key).distinct().withColumn("_b", F.lit(True))
    rows = files.join(a, key, "left").join(b, key, "left")
    return rows.select(*files.columns, F.when(F.col("_a"), "staging").when(F.col("_b"), "destination").otherwise("missing").alias("place"))


def reclaimable(candidates: DataFrame, stored: DataFrame, key: str) -> DataFrame:
    """`candidates` (key, sha256, bytes, tier) with action: drop a redundant copy only if the stored one has its digest."""
    rows = candidates.join(stored.select(key, F.col("sha256").alias("_stored")), key, "left")
    proven = F.col("_stored") == F.col("sha256")
    return rows.select(*candidates.columns, F.when((F.col("tier") == "redundant") & proven, "drop").when(F.col("tier") == "redundant", "keep: not proven").otherwise("keep").alias("action"))


def retired(superseded: DataFrame, current: DataFrame, key: str) -> DataFrame:
    """Superseded paths that no current file has."""
    return superseded.join(current.select(key).distinct(), key, "left_anti")


def merged_identification(earlier: DataFrame, now: DataFrame, by: str) -> DataFrame:
    """(by, path, confidence, matched_on): new paths win, confidence is the weaker, what matched is listed once each, in order."""
    rows = earlier.withColumn("_age", F.lit(1)).unionByName(now.withColumn("_age", F.lit(0)))
    g = rows.groupBy(by).agg(F.min(F.struct("_age", "path")).alias("p"), F.min("confidence").alias("confidence"), F.array_sort(F.collect_list(F.struct((1 - F.col("_age")).alias("k"), F.col("matched_on").alias("m")))).alias("m"))
    return g.select(by, F.col("p.path").alias("path"), "confidence", F.array_join(F.array_distinct(F.transform("m", lambda x: x["m"])), "; ").alias("matched_on"))


def case_variants(wanted: DataFrame, present: DataFrame, name: str) -> DataFrame:
    """(name, variant): names present in another case."""
    there = present.select(F.col(name).alias("variant")).distinct()
    return wanted.join(there, F.lower(wanted[name]) == F.lower(there["variant"])).where(F.col(name) != F.col("variant")).select(*wanted.columns, "variant")


def choose_tracks(tracks: DataFrame, by: list[str], languages: list[str]) -> DataFrame:
    """`tracks` (by…, kind, language) with keep: wanted or unnamed languages, or all of a kind none of which is wanted."""
    wanted = F.coalesce(F.col("language"), F.lit("")).isin("", "und") | F.lower("language").isin([x.lower() for x in languages])
    some = F.max(wanted.cast("int")).over(Window.partitionBy(*by, "kind"))
    return tracks.withColumn("keep", (some == 0) | F.coalesce(wanted, F.lit(True)))


def recovered_names(files: DataFrame, titles: DataFrame, artifacts: DataFrame, job: str) -> DataFrame:
    """(job, path, name): the ripped name of a filed file: the only title of its size that is no longer an artifact."""
    gone = titles.join(artifacts.select(job, "name").distinct(), [job, "name"], "left_anti")
    one = gone.groupBy(job, "bytes").agg(F.count(F.lit(1)).alias("n"), F.min("name").alias("name")).where("n = 1").drop("n")
    return files.join(one, [job, "bytes"]).select(job, "path", "name")
