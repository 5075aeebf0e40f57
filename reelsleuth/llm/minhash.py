"""Document fingerprints by one-permutation MinHash, in SQL expressions alone."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import let

#: Bins of a fingerprint, stored bits of each bin, and words of a shingle.
BINS, BITS, WORDS = 128, 8, 5


def shingle_hashes(text: Column, words_each: int = WORDS) -> Column:
    """Array of 64-bit hashes of the word shingles of `text`, lower-cased; no words: empty; fewer words: one hash of all."""
    words = F.filter(F.split(F.lower(text), r"[\x00-\x20]+"), lambda w: w != "")

    def hashes(ws: Column) -> Column:
        many = F.transform(F.sequence(F.lit(0), F.size(ws) - words_each), lambda i: F.xxhash64(*[F.get(ws, i + j) for j in range(words_each)]))
        return F.when(F.size(ws) >= words_each, many).when(F.size(ws) > 0, F.array(F.xxhash64(ws))).otherwise(F.array().cast("array<bigint>"))

    return let(F.transform(words, lambda w: F.xxhash64(w)), hashes)


def minhash(text: Column, bins: int = BINS, bits: int = BITS, words_each: int = WORDS) -> Column:
    """Fingerprint of `text` as hexadecimal digits, `bits` (4 or 8) low-order bits of each bin.

    Each shingle is hashed once: its top bits name a bin, and a bin keeps its least hash. An empty bin
    borrows from the non-empty bin that a hash of the two numbers ranks first, which depends on the set of
    non-empty bins alone; so equal texts have equal fingerprints, and similar sets borrow alike. A text
    without words has the fingerprint of zeros. Null is the empty text.
    """
    shift = 64 - int(math.log2(bins))
    digits = bits // 4

    def bin_of(h: Column) -> Column:
        return F.shiftrightunsigned(h, shift).cast("int")

    def packed(least: Column) -> Column:
        # In order of bins; a bin's number and its hash are one number, so that sorting gave both.
        def dense(named: Column) -> Column:
            def one(b: Column) -> Column:
                at = F.array_position(named, b)
                # Ranks of candidates and their places go together, so that the least of all is the lender's place.
                lender = F.array_min(F.transform(named, lambda c, i: F.shiftleft(F.shiftrightunsigned(F.xxhash64(b, c), 16), 8) + i))
                place = F.when(at > 0, at - 1).otherwise(F.pmod(lender, F.lit(256)))
                low = F.get(least, place.cast("int")).bitwiseAND(F.lit((1 << bits) - 1))
                return F.substring(F.hex(low + (1 << bits)), 2, digits)

            return F.array_join(F.transform(F.sequence(F.lit(0), F.lit(bins - 1)), one), "")

        return let(F.transform(least, bin_of), dense)

    def least_of(ordered: Column) -> Column:
        return F.filter(ordered, lambda h, i: (i == 0) | (bin_of(h) != bin_of(F.get(ordered, F.greatest(i - 1, F.lit(0))))))

    # xor with the sign bit is left out: signed order puts bins 64 to 127 first, each still in one run.
    found = let(F.array_sort(shingle_hashes(F.coalesce(text, F.lit("")), words_each)), least_of)
    return let(found, lambda least: F.when(F.size(least) == 0, F.lit("0" * (bins * digits))).otherwise(F.lower(packed(least))))


def likeness(a: Column, b: Column, bins: int = BINS, bits: int = BITS) -> Column:
    """Estimated Jaccard similarity of two fingerprints, 0 to 1.

    Two different bins agree in their stored bits with chance 2^-bits; the share of agreeing bins is
    corrected for that. Null if either is null; fingerprints of texts without words are like each other only.
    """
    digits = bits // 4
    same = F.size(F.filter(F.sequence(F.lit(0), F.lit(bins - 1)), lambda i: F.substr(a, i * digits + 1, F.lit(digits)) == F.substr(b, i * digits + 1, F.lit(digits))))
    chance = 2.0**-bits
    none = F.lit("0" * (bins * digits))
    corrected = F.greatest(F.lit(0.0), (same / bins - chance) / (1 - chance))
    return F.when(a == b, F.lit(1.0)).when((a == none) | (b == none), F.lit(0.0)).otherwise(corrected)


def with_next(docs: DataFrame, rows_each: int = 500) -> DataFrame:
    """Adds bucket and ghost: rows in buckets of neighbouring doc_ids, each with a copy of the row that follows.

    Order is by falling doc_id, nulls last, and after the last comes the first. Bucket bounds are doc_ids
    from an approximate percentile, so a bucket's largest doc_id exists; its row goes to the bucket above
    too, as a ghost behind that bucket's own rows. The driver holds the bounds alone, a number a bucket.
    """
    seen = docs.agg(F.count(F.lit(1)).alias("n"), F.max("doc_id").alias("top")).first()
    buckets = max(1, min(100_000, seen["n"] // rows_each))
    bounds = docs.agg(F.percentile_approx("doc_id", [i / buckets for i in range(1, buckets + 1)], 20 * buckets).alias("b")).first()["b"] or []
    bounds = sorted({*bounds, *([] if seen["top"] is None else [seen["top"]])})
    n = max(1, len(bounds))
    steps = max(1, n.bit_length())
    lit = F.lit(bounds or [0]).cast("array<bigint>")

    def at(k: Column) -> Column:
        return F.get(lit, k)

    # How many bounds lie below the doc_id, by halving steps.
    below = F.aggregate(
        F.lit([1 << s for s in range(steps - 1, -1, -1)]).cast("array<int>"), F.lit(0),
        lambda k, step: F.when((k + step <= n) & (at(k + step - 1) < F.col("doc_id")), k + step).otherwise(k),
    )
    marked = docs.withColumn("bucket", F.when(F.col("doc_id").isNull(), 0).otherwise(F.least(below, F.lit(n - 1))))
    first = F.col("doc_id") == at(F.col("bucket"))
    up = F.when(first | F.lit(not bounds), F.pmod(F.col("bucket") + 1, F.lit(n)))
    both = marked.withColumn("up", up).withColumn("ghost", F.explode(F.when(F.col("up").isNull(), F.array(F.lit(False))).otherwise(F.array(F.lit(False), F.lit(True)))))
    return both.withColumn("bucket", F.when(F.col("ghost"), F.col("up")).otherwise(F.col("bucket"))).drop("up")


def edited_pairs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bins: int = BINS, bits: int = BITS) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) for each row.

    The edited text has its last third replaced by the start of the text that follows by falling doc_id.
    One shuffle moves each text once. Null texts are empty. Rows with the same doc_id follow each other by
    text; a null doc_id comes last; a single row follows itself; an empty table gives no rows; other
    columns are ignored.
    """
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = with_next(own).repartition("bucket")
    rows = rows.withColumn("fingerprint", minhash(F.col("text"), bins, bits))
    w = Window.partitionBy("bucket").orderBy("ghost", F.desc_nulls_last("doc_id"), "text")
    rows = rows.withColumn("next_text", F.lead("text").over(w)).withColumn("next_fingerprint", F.lead("fingerprint").over(w))
    rows = rows.where(~F.col("ghost")).withColumn("n_chars", F.length("text").cast("long"))
    third = F.floor(F.col("n_chars") / 3).cast("int")
    edited = F.concat(F.substr("text", F.lit(1), F.col("n_chars").cast("int") - third), F.substr("next_text", F.lit(1), third))
    rows = rows.select("doc_id", "n_chars", "fingerprint", "next_fingerprint", edited.alias("edited"))
    rows = rows.withColumn("edited_fingerprint", minhash(F.col("edited"), bins, bits)).withColumn("edited_sha256", F.sha2("edited", 256))
    near = lambda other: likeness(F.col("fingerprint"), F.col(other), bins, bits)
    return rows.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", near("edited_fingerprint").alias("near_edited"), near("next_fingerprint").alias("near_next"))
