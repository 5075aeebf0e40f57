"""Identifiers and checksums of audio discs, in unsigned 32-bit arithmetic."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Sectors before the first, a second's sectors, samples left out at a disc's ends, and the modulus.
PREGAP, SECOND, EDGE, WORD = 150, 75, 2940, 4294967296


def checksums(samples: DataFrame, by: list[str], position: str, sample: str, first: Column, last: Column) -> DataFrame:
    """(by…, v1, v2) over samples at 1-based positions: sums of sample times position, modulo 2^32.

    v2 adds the upper halves of the products too. A first track leaves out its first samples, a last track its
    last. Products reach 2^64, so they are decimals.
    """
    from pyspark.sql import Window

    total = F.max(position).over(Window.partitionBy(*by))
    start, end = F.when(first, EDGE).otherwise(1), F.when(last, F.greatest(F.col("_n") - EDGE, F.lit(0))).otherwise(F.col("_n"))
    rows = samples.withColumn("_n", total).where((F.col(position) >= start) & (F.col(position) <= end))
    product = F.col(sample).cast("decimal(20,0)") * F.col(position).cast("decimal(18,0)")
    low = product % F.lit(WORD).cast("decimal(11,0)")
    high = (product - low) / F.lit(WORD).cast("decimal(11,0)")
    sums = rows.groupBy(*by).agg(F.sum(low).alias("low"), F.sum(high).alias("high"))
    return sums.select(*by, (F.col("low") % WORD).cast("long").alias("v1"), ((F.col("low") + F.col("high")) % WORD).cast("long").alias("v2"))


def disc_sums(tracks: DataFrame, by: str, number: str, start: str, leadout: str) -> DataFrame:
    """(by, tracks, id1, id2): wrapping sums of the tracks' starts, plain and weighed by number, lead-out included."""
    g = tracks.groupBy(by).agg(
        F.count(F.lit(1)).alias("tracks"), F.max(leadout).alias("leadout"), F.sum(start).alias("s"),
        F.sum(F.pmod(F.greatest(F.col(start), F.lit(1)) * F.col(number), F.lit(WORD))).alias("w"),
    )
    return g.select(by, "tracks", F.pmod(F.col("s") + F.col("leadout"), F.lit(WORD)).alias("id1"), F.pmod(F.col("w") + F.pmod(F.col("leadout") * (F.col("tracks") + 1), F.lit(WORD)), F.lit(WORD)).alias("id2"))


def _digit_sum(n: Column) -> Column:
    return F.aggregate(F.split(n.cast("string"), ""), F.lit(0).cast("long"), lambda a, d: a + F.coalesce(d.try_cast("long"), F.lit(0)))


def freedb_id(tracks: DataFrame, by: str, start: str, leadout: str) -> DataFrame:
    """(by, freedb): eight hexadecimal digits of checksum, length and track count."""
    seconds = F.expr(f"({start} + {PREGAP}) div {SECOND}")
    g = tracks.groupBy(by).agg(F.sum(_digit_sum(seconds)).alias("sum"), F.min(start).alias("first"), F.max(leadout).alias("leadout"), F.count(F.lit(1)).alias("n"))
    total = F.expr(f"(leadout + {PREGAP}) div {SECOND} - (first + {PREGAP}) div {SECOND}")
    packed = F.shiftleft(F.pmod(F.col("sum"), F.lit(255)), 24) + F.shiftleft(total, 8) + F.col("n")
    return g.select(by, F.lower(F.lpad(F.hex(packed), 8, "0")).alias("freedb"))


def musicbrainz_id(tracks: DataFrame, by: str, number: str, start: str, leadout: str) -> DataFrame:
    """(by, musicbrainz): SHA-1 over first and last track number, lead-out and 99 starts, in a URL's base64."""
    g = tracks.where(F.col(number).between(1, 99)).groupBy(by).agg(F.min(number).alias("a"), F.max(number).alias("z"), F.max(leadout).alias("leadout"), F.map_from_entries(F.collect_list(F.struct(number, start))).alias("starts"))
    hexed = lambda n, k: F.lpad(F.hex(n), k, "0")
    offsets = F.transform(F.sequence(F.lit(1).cast("long"), F.lit(99).cast("long")), lambda i: F.coalesce(F.try_element_at("starts", i) + PREGAP, F.lit(0).cast("long")))
    text = F.concat(hexed(F.col("a"), 2), hexed(F.col("z"), 2), hexed(F.col("leadout") + PREGAP, 8), F.array_join(F.transform(offsets, lambda o: hexed(o, 8)), ""))
    return g.select(by, F.translate(F.base64(F.unhex(F.sha1(text))), "+/=", "._-").alias("musicbrainz"))


def database_path(ids: DataFrame, by: str) -> DataFrame:
    """(by, path): where a database of checksums keeps a disc, from disc_sums() and freedb_id()."""
    nibble = lambda k: F.lower(F.hex(F.shiftrightunsigned(F.col("id1"), 4 * k).bitwiseAND(F.lit(15)))).alias("x")
    eight = lambda name: F.lower(F.lpad(F.hex(name), 8, "0"))
    name = F.concat(F.lit("dBAR-"), F.lpad(F.col("tracks").cast("string"), 3, "0"), F.lit("-"), eight("id1"), F.lit("-"), eight("id2"), F.lit("-"), F.col("freedb"), F.lit(".bin"))
    return ids.select(by, F.concat_ws("/", nibble(0), nibble(1), nibble(2), name).alias("path"))


def verify_tracks(sums: DataFrame, pressings: DataFrame, by: list[str]) -> DataFrame:
    """(by…, confidence, verdict): the pressings' confidences whose checksum is a track's v1 or v2."""
    both = sums.select(*by, F.explode(F.array_distinct(F.array("v1", "v2"))).alias("crc"))
    found = both.join(pressings, [*by, "crc"]).groupBy(*by).agg(F.sum("confidence").alias("confidence"))
    known = pressings.groupBy(*by).agg(F.count(F.lit(1)).alias("known"))
    rows = sums.select(*by).join(found, by, "left").join(known, by, "left")
    return rows.select(*by, F.coalesce("confidence", F.lit(0)).alias("confidence"), F.when(F.col("confidence").isNotNull(), "match").when(F.col("known").isNotNull(), "mismatch").otherwise("unknown").alias("verdict"))
