"""Captured output of other programs, as tables: robot messages, progress, subtitles, stream lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reelsleuth.functions.text import clock_seconds


def output_lines(spark: SparkSession, path: str) -> DataFrame:
    """(path, line_no, value): lines parted by carriage returns and line feeds, blank ones dropped."""
    whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    lines = whole.select("path", F.posexplode(F.split("value", r"[\r\n]+")).alias("line_no", "value"))
    return lines.where(F.trim("value") != "")


def robot_values(line: Column, n: int = 8) -> Column:
    """The values after a robot line's tag, quotes taken off and doubled ones made single."""
    schema = ", ".join(f"c{i} string" for i in range(n))
    return F.from_csv(F.regexp_replace(line, "^[A-Z]+:", ""), schema, {"escape": '"'})


def robot_records(lines: DataFrame) -> DataFrame:
    """(line_no, tag, c0…): one tagged record a line."""
    return lines.select("line_no", F.substring_index("value", ":", 1).alias("tag"), robot_values(F.col("value")).alias("v")).select("line_no", "tag", "v.*")


def robot_scan(lines: DataFrame) -> DataFrame:
    """(title, chapters, seconds, bytes, output, success): a scan's titles; of a repeated attribute the last counts."""
    rows = robot_records(lines)
    done = rows.agg(F.coalesce(F.bool_or((F.col("tag") == "MSG") & (F.col("c0") == "5011")), F.lit(False)).alias("success"))
    info = rows.where("tag = 'TINFO'").select(F.col("c0").cast("int").alias("title"), F.col("c1").cast("int").alias("attr"), F.col("c3").alias("value"), "line_no")
    last = lambda a: F.max_by(F.when(F.col("attr") == a, F.col("value")), F.when(F.col("attr") == a, F.col("line_no")))
    titles = info.groupBy("title").agg(last(8).try_cast("int").alias("chapters"), clock_seconds(last(9)).try_cast("int").alias("seconds"), last(11).try_cast("long").alias("bytes"), last(27).alias("output"))
    return titles.join(F.broadcast(done))


def progress(lines: DataFrame) -> DataFrame:
    """(line_no, percent, lba, last_lba, scsi, c2, q): progress lines of a dump."""
    pattern = r"\[\s*(\d+)%\].*LBA:\s*(\d+)/(\d+).*errors:\s*\{\s*SCSI:\s*(\d+),\s*C2:\s*(\d+),\s*Q:\s*(\d+)"
    part = lambda i: F.regexp_extract("value", pattern, i).cast("long")
    names = ("percent", "lba", "last_lba", "scsi", "c2", "q")
    return lines.where(F.col("value").rlike(pattern)).select("line_no", *[part(i + 1).alias(n) for i, n in enumerate(names)])


def rom_hashes(lines: DataFrame) -> DataFrame:
    """(line_no, name, size, crc32, md5, sha1) of `<rom … />` lines."""
    schema = "_name string, _size string, _crc string, _md5 string, _sha1 string"
    rows = lines.where(F.col("value").rlike(r"^\s*<rom ")).select("line_no", F.from_xml("value", schema).alias("r"))
    low = lambda k: F.lower(F.col(f"r._{k}"))
    return rows.select("line_no", F.col("r._name").alias("name"), F.coalesce(F.col("r._size").try_cast("long"), F.lit(0)).alias("size"), low("crc").alias("crc32"), low("md5").alias("md5"), low("sha1").alias("sha1"))


def metadata(lines: DataFrame, by: str = "path") -> DataFrame:
    """(by, key, value): `key: value` lines, the last of a key."""
    rows = lines.where(F.col("value").rlike(r"^[^:]+:\s")).select(by, "line_no", F.trim(F.substring_index("value", ":", 1)).alias("key"), F.trim(F.regexp_extract("value", r"^[^:]+:\s*(.*)$", 1)).alias("value"))
    return rows.groupBy(by, "key").agg(F.max_by("value", "line_no").alias("value"))


def streams(rows: DataFrame, by: str, csv: str) -> DataFrame:
    """(by, pos, codec, forced) of a stream list `codec,forced` a line."""
    lines = rows.select(by, F.posexplode(F.split(csv, r"\r?\n")).alias("pos", "line")).where(F.trim("line") != "")
    return lines.select(by, "pos", F.trim(F.get(F.split("line", ","), 0)).alias("codec"), (F.coalesce(F.trim(F.get(F.split("line", ","), 1)), F.lit("0")) == "1").alias("forced"))


# Subtitle codecs that are text, and those that are pictures.
TEXT_CODECS = ("subrip", "ass", "ssa", "mov_text", "webvtt", "text")
PICTURE_CODECS = ("hdmv_pgs_subtitle", "dvd_subtitle")


def chosen_stream(rows: DataFrame, by: str) -> DataFrame:
    """(by, pos, codec): the first text stream, else the first picture stream that isn't forced."""
    kind = F.when(F.col("codec").isin(*TEXT_CODECS), 0).when(F.col("codec").isin(*PICTURE_CODECS) & ~F.col("forced"), 1)
    best = rows.withColumn("kind", kind).where("kind IS NOT NULL").groupBy(by).agg(F.min(F.struct("kind", "pos", "codec")).alias("b"))
    return best.select(by, "b.pos", "b.codec")


def cues(rows: DataFrame, by: str, srt: str) -> DataFrame:
    """(by, pos, block, start): the blocks of a subtitle file and when each begins, null where that can't be read."""
    blocks = rows.select(by, F.posexplode(F.split(F.regexp_replace(srt, r"\r\n?", "\n"), r"\n[ \t]*\n+")).alias("pos", "block")).where(F.trim("block") != "")
    part = lambda i: F.nullif(F.regexp_extract("block", r"(\d+):(\d+):(\d+)[,.](\d+)\s*-->", i), F.lit("")).try_cast("double")
    return blocks.withColumn("start", part(1) * 3600 + part(2) * 60 + part(3) + part(4) / 1000)


def split_srt(rows: DataFrame, by: str, srt: str) -> DataFrame:
    """(by, first, second): a subtitle file parted at half of its last cue's start; what has no start goes to the second."""
    from pyspark.sql import Window

    marked = cues(rows, by, srt).withColumn("half", F.max("start").over(Window.partitionBy(by)) / 2)
    early = F.coalesce(F.col("start") < F.col("half"), F.lit(False))
    texts = lambda keep: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(keep, F.struct("pos", "block")))), lambda x: x["block"]), "\n\n")
    return marked.groupBy(by).agg(texts(early).alias("first"), texts(~early).alias("second"))
