"""Rows of a dumping program's log, and what they say of the dump."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Samples of a byte of the state file, where states are of samples.
SAMPLES_PER_STATE = 4


def _number(text: Column, pattern: str, kind: str = "long") -> Column:
    return F.regexp_extract(F.trim(text), pattern, 1).try_cast(kind)


def track_errors(line: Column) -> Column:
    """struct(track, skip_samples, c2_samples) of "errors detected, track: N, …, samples: { SKIP: a, C2: b }"; null for other lines."""
    pattern = r"^errors detected, track:\s*([0-9]+)\s*,.*samples:.*?SKIP:\s*([0-9]+).*?C2:\s*([0-9]+)"
    found = F.rlike(F.trim(line), F.lit(pattern))
    return F.when(found, F.struct(*[F.regexp_extract(F.trim(line), pattern, k).cast("long").alias(n) for k, n in enumerate(("track", "skip_samples", "c2_samples"), 1)]))


def toc_track(line: Column) -> Column:
    """The number of a line "track N { … }"."""
    return _number(line, r"^track\s+(\S+)", "int")


def sector_count(line: Column) -> Column:
    return _number(line, r"^sectors count \(READ_CAPACITY\):\s*([0-9]+)$")


def drive_config(lines: DataFrame, by: str, at: str, line: str) -> DataFrame:
    """(by, summary, sector_order, generic, auto_detected): configuration lines folded, the last of each kind counts, flags stay."""
    t = F.trim(F.col(line))
    summary = F.when(t.startswith("configuration:"), F.trim(F.substring(t, 15, 1 << 30)))
    found = F.when(F.contains(t, F.lit("auto-detected sector order:")), F.nullif(F.trim(F.regexp_extract(t, r"auto-detected sector order:(.*)$", 1)), F.lit("")))
    named = F.nullif(F.regexp_extract(summary, r"sector order:\s*([A-Za-z0-9_]+)", 1), F.lit(""))
    rows = lines.select(by, at, summary.alias("s"), found.alias("f"), F.coalesce(found, named).alias("o"), (F.contains(t, F.lit("using generic drive")) | F.contains(t, F.lit("drive not found in the database"))).alias("g"))
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col(at)))
    return rows.groupBy(by).agg(last("s").alias("summary"), last("o").alias("sector_order"), F.bool_or("g").alias("generic"), F.bool_or(F.col("f").isNotNull()).alias("auto_detected"))


def leadout_overread_only(errors: DataFrame, by: str, last_track: str, read_offset: str) -> DataFrame:
    """(by, excused): whether all errors are missing samples of the last track, no more than a positive read offset asks for."""
    fine = (F.col("track") == F.col(last_track)) & (F.col("c2_samples") == 0) & (F.col("skip_samples") <= F.col(read_offset))
    return errors.groupBy(by).agg(F.bool_and((F.col(read_offset) > 0) & fine).alias("excused"))


def state_unit(state_bytes: Column, scram_bytes: Column) -> Column:
    """sample where the scrambled image has as many bytes as states of samples ask for, else sector; an absent image is null."""
    return F.when((state_bytes > 0) & (scram_bytes == state_bytes * SAMPLES_PER_STATE), "sample").otherwise("sector")


def is_clean(complete: Column) -> Column:
    """Only a dump that is known to be complete."""
    return F.coalesce(complete, F.lit(False))
