"""Reference lists in Logiqx XML."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

GAME = "_name string, category string, description string, rom array<struct<_name: string, _size: string, _crc: string, _md5: string, _sha1: string>>"
HEADER = "name string, version string"


def read_datfiles(spark: SparkSession, path: str) -> DataFrame:
    """(file, platform, version, game_ix, rom_ix, game, category, rom, size, crc32, md5, sha1) of all *.dat files below `path`.

    Digests are lower-cased, a size that isn't a number is 0. Games are numbered by their order in a file;
    files go by path, so that (file, game_ix, rom_ix) says which of equal digests was loaded first.
    """
    source = lambda tag, schema: spark.read.format("xml").option("rowTag", tag).option("pathGlobFilter", "*.dat").schema(schema).load(path).withColumn("file", F.col("_metadata.file_path"))
    heads = source("header", HEADER).select("file", F.nullif(F.trim("name"), F.lit("")).alias("platform"), F.nullif(F.trim("version"), F.lit("")).alias("version")).where("platform IS NOT NULL")
    games = source("game", GAME).withColumn("game_ix", F.monotonically_increasing_id())
    roms = games.select("file", "game_ix", F.col("_name").alias("game"), "category", F.posexplode("rom").alias("rom_ix", "r"))
    low = lambda k: F.nullif(F.lower(F.trim(f"r._{k}")), F.lit(""))
    rows = roms.select("file", "game_ix", "rom_ix", "game", "category", F.col("r._name").alias("rom"), F.coalesce(F.col("r._size").try_cast("long"), F.lit(0)).alias("size"), low("crc").alias("crc32"), low("md5").alias("md5"), low("sha1").alias("sha1"))
    return rows.join(heads, "file").select("file", "platform", "version", "game_ix", "rom_ix", "game", "category", "rom", "size", "crc32", "md5", "sha1")
