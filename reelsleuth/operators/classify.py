"""What a disc holds, from its structure."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordered import fold_wider, play_all

# Seconds of content and of a feature, the spread of episodes, the tolerance of versions.
MAIN_SECS, FEATURE_SECS, SPREAD, VERSION_SECS = 900.0, 4500.0, 0.20, 10.0
# Marks of console discs, and the sectors below which a video disc is no feature.
XBOX_MARK, XBOX_360_PREFIX, LEAST_SECTORS = "VTC Sector Offset", "XGD", 512 * 1024


def disc_shape(titles: DataFrame, by: str, ix: str, secs: str, chapters: str, aspect: str) -> DataFrame:
    """(by, shape, confidence, mains, play_all, kept): series, movie, mixed or extras, and the version to keep.

    Content lasts a quarter of an hour, isn't a play-all, and has chapters where other long titles have them.
    Several of one length and chaptering that are feature-long are versions of a film, the widest of which is kept.
    """
    whole = titles.withColumn("_s", F.round(secs).cast("long"))
    found = play_all(whole, by, ix, "_s", chapters).select(by, F.col("position").alias("play_all"))
    rows = titles.join(found, by, "left")
    long = (F.col(secs) >= MAIN_SECS) & ~F.coalesce(F.col(ix) == F.col("play_all"), F.lit(False))
    w = Window.partitionBy(by)
    rows = rows.withColumn("long", long)
    rows = rows.withColumn("told", F.max(F.when(F.col("long"), (F.col(chapters) > 0).cast("int"))).over(w) - F.min(F.when(F.col("long"), (F.col(chapters) > 0).cast("int"))).over(w))
    rows = rows.withColumn("main", F.col("long") & ~(F.coalesce(F.col("told") == 1, F.lit(False)) & (F.col(chapters) == 0)))
    main = lambda x: F.when(F.col("main"), F.col(x))
    g = rows.groupBy(by).agg(
        F.count_if("main").alias("mains"), F.min(main(secs)).alias("lo"), F.max(main(secs)).alias("hi"), F.min(main(chapters)).alias("c0"), F.max(main(chapters)).alias("c1"), F.max("play_all").alias("play_all"),
    )
    versions = (F.col("mains") > 1) & (F.col("lo") >= FEATURE_SECS) & (F.col("hi") - F.col("lo") <= VERSION_SECS) & (F.col("c0") == F.col("c1"))
    uniform = (F.col("mains") > 1) & ((F.col("hi") - F.col("lo")) / F.col("hi") <= SPREAD)
    shape = F.when(F.col("mains") == 0, "extras").when(versions | ((F.col("mains") == 1) & (F.col("hi") >= FEATURE_SECS)), "movie").when(uniform, "series").otherwise("mixed")
    g = g.withColumn("versions", F.coalesce(versions, F.lit(False))).withColumn("shape", shape)
    wide = fold_wider(rows.where("main").withColumn("_a", F.coalesce(aspect, F.lit(0.0))), by, ix, "_a", 0.01).select(by, F.col(ix).alias("wide"))
    out = g.join(wide, by, "left")
    return out.select(by, "shape", F.when(F.col("shape").isin("movie", "series"), 2).otherwise(1).alias("confidence"), "mains", "play_all", F.when(F.col("versions"), F.col("wide")).alias("kept"))


def disc_content(serial: Column, entries: Column, app_id: Column, label: Column, sectors: Column, kernel: Column, readable: Column) -> Column:
    """struct(kind, confidence, evidence): the first rule that fits wins."""
    names = F.transform(entries, lambda e: F.upper(F.regexp_replace(e, "/+$", "")))
    video, hd = F.array_contains(names, "VIDEO_TS"), F.array_contains(names, "BDMV")
    small = F.coalesce(sectors < LEAST_SECTORS, F.lit(False))
    made = lambda kind, sure, *why: F.struct(F.lit(kind).alias("kind"), (sure if isinstance(sure, Column) else F.lit(sure)).alias("confidence"), F.array_compact(F.array(*[w if isinstance(w, Column) else F.lit(w) for w in why])).alias("evidence"))
    return (
        F.when(serial.isNotNull(), made("game", 2, F.concat(F.lit("serial "), serial), "a serial still needs a reference list"))
        .when(video & F.coalesce(app_id.contains(XBOX_MARK), F.lit(False)), made("xbox", 2, "application identifier marks a console's video partition"))
        .when(video & F.coalesce(F.upper(label).startswith(XBOX_360_PREFIX), F.lit(False)), made("xbox360", 2, F.concat(F.lit("label "), label)))
        .when(video, made("dvd_video", F.when(small, 1).otherwise(2), "VIDEO_TS in root", F.when(small, "too small for a feature"), F.concat(F.lit("label "), label)))
        .when(hd, made("blu_ray_video", 2, "BDMV in root"))
        .when(kernel == "audio", made("audio_cd", 2, "audio disc"))
        .when(kernel == "mixed", made("mixed", 2, "audio and data"))
        .when(F.coalesce(readable, F.lit(False)), made("data", 1, "no known structure", F.concat(F.lit("label "), label)))
        .otherwise(made("unknown", 0, "nothing readable"))
    )


def tier(path: Column, packed: Column | None = None) -> Column:
    """What an artifact is worth: redundant images, provenance, or records to keep. Without a packed copy an image isn't redundant."""
    ext = F.lower(F.substring_index(path, ".", -1))
    image = ext.isin("bin", "iso")
    redundant = F.lit("redundant") if packed is None else F.when(packed, "redundant").otherwise("provenance")
    return F.when(image, redundant).when(ext.isin("scram", "state", "subcode"), "provenance").otherwise("audit")
