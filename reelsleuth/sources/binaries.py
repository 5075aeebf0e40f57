"""Binary records: packages of console content and databases of audio checksums."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Kinds of package by code, signatures, and where a header's fields lie.
KINDS = {
    0x1000: "saved game", 0x2000: "marketplace content", 0x4000: "Games on Demand", 0x5000: "installer", 0x7000: "installed game", 0x9000: "avatar item", 0x10000: "profile", 0x20000: "gamer picture",
    0x30000: "theme", 0x40000: "cache file", 0x80000: "game demo", 0xD0000: "game video",
}
SIGNATURES = {b"CON ": "console", b"LIVE": "live", b"PIRS": "pirs"}
LEAST_HEADER, DESCRIPTOR = 0x1711, 0x379


def read_files(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """(path, length, content) of the files below `path`."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(path).select("path", "length", "content")


def package_header(raw: bytes) -> tuple | None:
    """(signature, kind, title id, media id, display name, title name, version, root hash, blocks) or None."""
    if len(raw) < LEAST_HEADER or raw[:4] not in SIGNATURES:
        return None
    word = lambda at: struct.unpack_from(">I", raw, at)[0]
    text = lambda at, n: raw[at : at + n].decode("utf-16-be", "replace").split("\x00")[0].strip()
    table = raw[DESCRIPTOR : DESCRIPTOR + 0x24]
    return (SIGNATURES[raw[:4]], KINDS.get(word(0x344), "unknown"), f"{word(0x360):08X}", f"{word(0x354):08X}", text(0x411, 0x100), text(0x1691, 0x80), word(0x358), table[4:0x18].hex(), int.from_bytes(table[0x19:0x1C], "big"))


def packages(files: DataFrame) -> DataFrame:
    """(path, signature, kind, title_id, media_id, display_name, title_name, version, root_hash, blocks); other files give no row."""
    columns = ["path", "signature", "kind", "title_id", "media_id", "display_name", "title_name", "version", "root_hash", "blocks"]

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(p, *h) for p, c in zip(batch["path"], batch["content"]) if (h := package_header(bytes(c))) is not None]
            yield pd.DataFrame(rows, columns=columns)

    return files.select("path", "content").mapInPandas(parse, "path string, signature string, kind string, title_id string, media_id string, display_name string, title_name string, version long, root_hash string, blocks long")


def pressings(files: DataFrame) -> DataFrame:
    """(path, block, id1, id2, freedb, track, confidence, crc): blocks of a header and nine bytes a track; a cut block ends a file."""
    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, content in zip(batch["path"], batch["content"]):
                raw, at, block = bytes(content), 0, 0
                while at + 13 <= len(raw):
                    n, id1, id2, freedb = struct.unpack_from("<BIII", raw, at)
                    at += 13
                    if at + 9 * n > len(raw):
                        break
                    rows += [(path, block, id1, id2, freedb, t + 1, *struct.unpack_from("<BI", raw, at + 9 * t)) for t in range(n)]
                    at, block = at + 9 * n, block + 1
            yield pd.DataFrame(rows, columns=["path", "block", "id1", "id2", "freedb", "track", "confidence", "crc"])

    return files.select("path", "content").mapInPandas(parse, "path string, block long, id1 long, id2 long, freedb long, track long, confidence long, crc long")


def images(files: DataFrame) -> DataFrame:
    """The files that are disc images, by their extension."""
    return files.where(F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).isin("iso", "chd", "cue", "bin"))
