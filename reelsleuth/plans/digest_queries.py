"""Queries of exact identification."""

from __future__ import annotations

from pyspark.sql import functions as F

from reelsleuth.operators import digest as D

from .base import query, table

# Artifacts are documents, some of whose digests weren't taken; reference lists hold the first document of each
# content. The 32-bit key is the start of the MD5, for DuckDB has no CRC.
_FILES = (
    "files AS (SELECT doc_id, strlen(text)::BIGINT AS size, CASE WHEN doc_id % 3 <> 0 THEN upper(sha1(text)) ELSE '' END AS sha1, CASE WHEN doc_id % 5 <> 0 THEN ' ' || md5(text) END AS md5, substr(md5(text), 1, 8) AS crc32 FROM documents), "
    "roms AS (SELECT doc_id AS rom_id, n_chars AS rom_chars, strlen(text)::BIGINT + CASE WHEN doc_id % 11 = 0 THEN 1 ELSE 0 END AS rom_size, CASE WHEN doc_id % 2 = 0 THEN sha1(text) END AS sha1, CASE WHEN doc_id % 4 <> 1 THEN md5(text) ELSE '' END AS md5, substr(md5(text), 1, 8) AS crc32 FROM documents)"
)
_IX = "{k} AS (SELECT {k} AS key, arg_min(rom_id, rom_id) AS rom_id, arg_min(rom_size, rom_id) AS rom_size FROM roms WHERE {k} <> '' GROUP BY {k})"
_ALL = f"WITH {_FILES}, " + ", ".join("i" + _IX.format(k=k).replace(f"{k} AS (", f"{k} AS (", 1) for k in D.KEYS)


def files(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select(
        "doc_id", F.octet_length("text").cast("long").alias("size"), F.when(F.col("doc_id") % 3 != 0, F.upper(F.sha1("text"))).otherwise("").alias("sha1"),
        F.when(F.col("doc_id") % 5 != 0, F.concat(F.lit(" "), F.md5("text"))).alias("md5"), F.substring(F.md5("text"), 1, 8).alias("crc32"),
    )


def roms(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select(
        F.col("doc_id").alias("rom_id"), (F.octet_length("text").cast("long") + F.when(F.col("doc_id") % 11 == 0, 1).otherwise(0)).alias("rom_size"),
        F.when(F.col("doc_id") % 2 == 0, F.sha1("text")).alias("sha1"), F.when(F.col("doc_id") % 4 != 1, F.md5("text")).otherwise("").alias("md5"), F.substring(F.md5("text"), 1, 8).alias("crc32"),
    )


_HIT = (
    f"{_ALL} SELECT doc_id, CASE WHEN a.key IS NOT NULL THEN 'sha1' WHEN b.key IS NOT NULL THEN 'md5' WHEN c.key IS NOT NULL THEN 'crc32' END AS matched_on, coalesce(a.rom_id, b.rom_id, c.rom_id) AS rom_id, coalesce(a.rom_size, b.rom_size, c.rom_size) AS rom_size, size "
    "FROM files LEFT JOIN isha1 a ON a.key = lower(trim(sha1)) LEFT JOIN imd5 b ON b.key = lower(trim(md5)) LEFT JOIN icrc32 c ON c.key = lower(trim(crc32))"
)


@query("digest_fallback_lookup", f"SELECT doc_id, CASE WHEN rom_size = size THEN matched_on END AS matched_on, CASE WHEN rom_size = size THEN rom_id END AS rom_id, CASE WHEN rom_size = size THEN 3 ELSE 0 END AS confidence FROM ({_HIT})")
def fallback(spark, sf_dir):
    """Ordered fallback, then the size check."""
    found = D.lookup(files(spark, sf_dir), roms(spark, sf_dir), ["rom_id"], ["rom_id"], "size", "rom_size")
    return found.select("doc_id", "matched_on", "rom_id", "confidence")


@query("J04_priority_fallback", f"SELECT doc_id, matched_on, rom_id FROM ({_HIT})")
def priority(spark, sf_dir):
    return D.lookup(files(spark, sf_dir), roms(spark, sf_dir), ["rom_id"], ["rom_id"]).select("doc_id", "matched_on", "rom_id")


def _by(key: str, name: str) -> None:
    @query(name, f"WITH {_FILES}, i AS (SELECT {key} AS key, min(rom_id) AS rom_id FROM roms WHERE {key} <> '' GROUP BY {key}) SELECT doc_id, rom_id FROM files JOIN i ON key = lower(trim({key}))")
    def run(spark, sf_dir):
        return D.find_by(files(spark, sf_dir), roms(spark, sf_dir), key, ["rom_id"], ["rom_id"]).select("doc_id", "rom_id")


for _key, _name in (("sha1", "J01_by_sha1"), ("md5", "J02_by_md5"), ("crc32", "J03_by_crc32")):
    _by(_key, _name)


@query("S05_digest_index", " UNION ALL ".join(f"SELECT '{k}' AS kind, {k} AS digest, min(rom_id) AS rom_id FROM roms WHERE {k} <> '' GROUP BY {k}" for k in D.KEYS).join((f"WITH {_FILES} SELECT * FROM (", ")")))
def index(spark, sf_dir):
    parts = [D.digest_index(roms(spark, sf_dir), k, ["rom_id"], ["rom_id"]).select(F.lit(k).alias("kind"), F.col(k).alias("digest"), "rom_id") for k in D.KEYS]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("S10_digests", "SELECT doc_id, strlen(text)::BIGINT AS bytes, md5(text) AS md5, sha1(text) AS sha1, sha256(text) AS sha256 FROM documents")
def digests(spark, sf_dir):
    made = D.digests(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", *[made[k].alias(k) for k in ("bytes", "md5", "sha1", "sha256")])


@query("A05_set_completeness", "SELECT l_orderkey AS game, count(DISTINCT l_linenumber) FILTER (l_linestatus = 'F') AS found, count(*) AS total, count(DISTINCT l_linenumber) FILTER (l_linestatus = 'F') = count(*) AS complete FROM lineitem GROUP BY l_orderkey HAVING found > 0")
def set_completeness(spark, sf_dir):
    """Orders as games, their lines as roms, finished lines as files found."""
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("game"), "l_linenumber", "l_linestatus")
    return D.completeness(lines.where("l_linestatus = 'F'"), lines, "game", "l_linenumber")


@query("J06_near_miss_sector", "SELECT s_suppkey AS image, p_partkey AS rom FROM supplier JOIN part ON s_suppkey * 2048 // 2048 * 2352 = p_partkey * 2352 WHERE s_suppkey > 0")
def near_miss(spark, sf_dir):
    images = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("image"), (F.col("s_suppkey") * 2048).alias("bytes"))
    bins = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("rom"), (F.col("p_partkey") * 2352).alias("rom_size"), F.concat("p_name", F.lit(".BIN")).alias("name"))
    return D.near_misses(images, bins, "bytes", "rom_size", "name").select("image", "rom")


@query("S18_unique_names", "SELECT floor(c_acctbal)::BIGINT AS name, min(c_custkey) AS path FROM customer GROUP BY floor(c_acctbal) HAVING count(*) = 1")
def unique(spark, sf_dir):
    names = table(spark, sf_dir, "customer").select(F.floor("c_acctbal").alias("name"), F.col("c_custkey").alias("path"))
    return D.unique_names(names, "name", "path")


@query("U05_multiset_equal", "SELECT l_orderkey, count(*) AS n, list_sort(list(md5((l_partkey % 3)::VARCHAR))) = list_sort(list(md5((l_suppkey % 3)::VARCHAR))) AS equal FROM lineitem GROUP BY l_orderkey")
def multiset_equal(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", F.md5((F.col("l_partkey") % 3).cast("string")).alias("expected"), F.md5((F.col("l_suppkey") % 3).cast("string")).alias("actual"))
    return D.multisets_equal(lines, "l_orderkey", "expected", "actual")
