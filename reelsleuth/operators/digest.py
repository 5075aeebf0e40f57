"""Exact identification by content digest, with ordered fallback, and set completeness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEYS = ("sha1", "md5", "crc32")
UNKNOWN, WEAK, STRONG, EXACT = 0, 1, 2, 3


def digests(content: Column) -> dict[str, Column]:
    """Digests and length of a content in one pass over the row."""
    raw = content.cast("binary")
    return {
        "bytes": F.octet_length(raw).cast("long"), "crc32": F.lower(F.lpad(F.hex(F.crc32(raw)), 8, "0")),
        "md5": F.md5(raw), "sha1": F.sha1(raw), "sha256": F.sha2(raw, 256),
    }


def normal(digest: Column) -> Column:
    """Trimmed and lower-cased; empty is no key."""
    return F.nullif(F.lower(F.trim(digest)), F.lit(""))


def digest_index(roms: DataFrame, key: str, order: list[str], keep: list[str]) -> DataFrame:
    """(key, keep…): of the roms with a digest, the first by `order`. One pre-aggregated shuffle."""
    names = [*order, *[k for k in keep if k not in order]]
    first = roms.withColumn(key, normal(F.col(key))).where(F.col(key).isNotNull()).groupBy(key).agg(F.min(F.struct(*names)).alias("first"))
    return first.select(key, *[F.col(f"first.{k}").alias(k) for k in keep])


def find_by(files: DataFrame, roms: DataFrame, key: str, order: list[str], keep: list[str], how: str = "inner") -> DataFrame:
    """`files` with `keep` of the rom that has the same digest `key`."""
    index = digest_index(roms, key, order, keep).withColumnRenamed(key, "_key")
    return files.join(index, normal(files[key]) == index["_key"], how).drop("_key")


def lookup(files: DataFrame, roms: DataFrame, order: list[str], keep: list[str], size: str | None = None, rom_size: str | None = None) -> DataFrame:
    """`files` with matched_on, confidence and the rom's `keep` columns: by SHA-1, else MD5, else CRC-32.

    With `size` and `rom_size`, a match of another size isn't one. Only a digest is exact. Files without a digest, or found
    by an earlier one, are spread over all tasks by a key of their own, which no rom has.
    """
    wanted = list(dict.fromkeys([*keep, *([rom_size] if rom_size else [])]))
    rows, found = files, F.lit(False)
    for key in KEYS:
        index = digest_index(roms, key, order, wanted)
        index = index.select(F.col(key).alias(f"_{key}"), F.struct(*wanted).alias(f"_by_{key}"))
        rows = rows.withColumn("_asked", F.coalesce(F.when(~found, normal(F.col(key))), F.concat(F.lit("none "), F.monotonically_increasing_id().cast("string"))))
        rows = rows.join(index, F.col("_asked") == F.col(f"_{key}"), "left").drop(f"_{key}", "_asked")
        found = found | F.col(f"_by_{key}").isNotNull()
    hit = F.coalesce(*[F.col(f"_by_{k}") for k in KEYS])
    on = F.when(F.col("_by_sha1").isNotNull(), "sha1").when(F.col("_by_md5").isNotNull(), "md5").when(F.col("_by_crc32").isNotNull(), "crc32")
    if size and rom_size:
        fits = hit[rom_size] == F.col(size)
        hit, on = F.when(fits, hit), F.when(fits, on)
    rows = rows.withColumn("_hit", hit).withColumn("matched_on", on)
    rows = rows.withColumns({k: F.col("_hit")[k] for k in keep})
    return rows.withColumn("confidence", F.when(F.col("matched_on").isNotNull(), EXACT).otherwise(UNKNOWN)).drop("_hit", *[f"_by_{k}" for k in KEYS])


def completeness(matched: DataFrame, roms: DataFrame, game: str, rom: str) -> DataFrame:
    """(game, found, total, complete): a set counts only whole."""
    total = roms.groupBy(game).agg(F.count(F.lit(1)).alias("total"))
    found = matched.groupBy(game).agg(F.countDistinct(rom).alias("found"))
    return found.join(total, game).select(game, "found", "total", (F.col("found") == F.col("total")).alias("complete"))


def near_misses(images: DataFrame, roms: DataFrame, bytes_col: str, size_col: str, name_col: str) -> DataFrame:
    """Pairs of an image of whole 2048-byte sectors and a .bin of as many raw 2352-byte ones."""
    whole = images.where((F.col(bytes_col) > 0) & (F.col(bytes_col) % 2048 == 0))
    bins = roms.where(F.lower(F.col(name_col)).endswith(".bin"))
    return whole.join(bins, F.expr(f"{bytes_col} div 2048 * 2352") == bins[size_col])


def unique_names(files: DataFrame, name: str, path: str) -> DataFrame:
    """(name, path) of base names that occur once."""
    return files.groupBy(name).agg(F.count(F.lit(1)).alias("n"), F.min(path).alias(path)).where("n = 1").select(name, path)


def multisets_equal(rows: DataFrame, by: str, left: str, right: str) -> DataFrame:
    """(by, n, equal): whether two columns hold the same values equally often within each group.

    Sums of hashes by value would do for one pass; here each value's surplus is counted, which is exact.
    """
    both = rows.select(by, F.explode(F.array(F.struct(F.col(left).alias("v"), F.lit(1).alias("d")), F.struct(F.col(right).alias("v"), F.lit(-1).alias("d")))).alias("x"))
    surplus = both.groupBy(by, "x.v").agg(F.sum("x.d").alias("d"), F.count_if(F.col("x.d") == 1).alias("n"))
    return surplus.groupBy(by).agg(F.sum("n").alias("n"), F.bool_and(F.col("d") == 0).alias("equal"))
