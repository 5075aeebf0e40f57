"""ARC and WARC archives: write ARC, convert it to WARC with revisit records, and read WARC back.

Archives lie in a folder that driver and executors share and are named by a URI. Executors write them
through pyarrow's file systems under a name of their own attempt, and rename them when they are whole;
Spark's binaryFile source reads them back.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import posixpath
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import datetime, timezone

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, fetch, fresh_dir, put

#: Bytes of payload of one archive, about.
ARCHIVE_BYTES = 8_000_000
#: Compressed bytes that a gzip member is fed at a time.
PIECE = 4096
#: The record headers that the two versions of ARC declare.
FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
EPOCH = "20000101000000"


def digest_of(payload: bytes) -> str:
    """SHA-1 in base32, bare."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


# --- ARC -------------------------------------------------------------------------------------------------


@dataclass
class ArcRecord:
    url: str
    ip: str
    date: str
    kind: str
    body: bytes
    offset: int
    status: str | None = None


def arc_date(text: str) -> str:
    """An ARC date (12 or 14 digits, whatever is missing filled up) as a WARC date; not a date: the epoch's."""
    digits = "".join(c for c in text if c.isdigit())
    digits = digits + EPOCH[len(digits) :] if 4 <= len(digits) <= 14 else EPOCH
    try:
        return datetime.strptime(digits, "%Y%m%d%H%M%S").replace(tzinfo=timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
    except ValueError:
        return arc_date(EPOCH)


def arc_head(name: str, version: int) -> bytes:
    """The version block that begins an ARC file."""
    body = f"{version} 0 reelsleuth\n{FIELDS[version]}\n".encode()
    line = f"filedesc://{name} 0.0.0.0 {EPOCH} text/plain"
    line += f" {len(body)}\n" if version == 1 else f" 200 - - 0 {name} {len(body)}\n"
    return line.encode() + body + b"\n"


def arc_record(version: int, url: str, ip: str, date: str, kind: str, body: bytes, name: str, offset: int) -> bytes:
    """One ARC record. Blanks in a URL are escaped, for a blank ends a field."""
    url = "".join(f"%{b:02X}" if b <= 32 else chr(b) for b in url.encode("utf-8", "replace")).encode("latin-1").decode("utf-8", "replace") or "-"
    fields = [url, ip, date, kind]
    if version == 2:
        fields += ["200", hashlib.sha1(body).hexdigest(), "-", str(offset), name]
    return " ".join([*fields, str(len(body))]).encode() + b"\n" + body + b"\n"


def inflate(raw: bytes) -> bytes:
    """The members of a gzip file, one after the other; what isn't compressed stays as it is.

    Each member is fed PIECE bytes at a time, so that what follows it isn't copied for every member. A member that is cut
    off gives what it holds; what follows the last member and isn't one is left out.
    """
    if raw[:2] != b"\x1f\x8b":
        return raw
    view, at, out = memoryview(raw), 0, []
    while raw[at : at + 2] == b"\x1f\x8b":
        member = zlib.decompressobj(31)
        while not member.eof and at < len(view):
            piece = view[at : at + PIECE]
            out.append(member.decompress(piece))
            at += len(piece) - len(member.unused_data)
    return b"".join(out)


def parse_arc(raw: bytes) -> Iterator[ArcRecord]:
    """The records of an ARC file, the version block left out.

    The version block says which fields a header line has; the last is the declared length, which alone decides
    where a body ends. A URL may hold blanks, so that fields are counted from the end of the line.
    A truncated body ends the file; a line without a length is passed over.
    """
    data, at, count = inflate(raw), 0, len(FIELDS[1].split())
    while at < len(data):
        end = data.find(b"\n", at)
        if end < 0:
            return
        line = data[at:end].strip().decode("utf-8", "replace")
        begin = at
        at = end + 1
        if not line:
            continue
        if line.startswith("filedesc:"):
            parts = line.split(" ")
            size = int(parts[-1]) if parts[-1].isdigit() else 0
            block = data[at : at + size].decode("utf-8", "replace").splitlines()
            count = len(block[1].split()) if len(block) > 1 else count
            at += size
            continue
        parts = line.rsplit(" ", count - 1)
        if len(parts) != count or not parts[-1].isdigit():
            continue
        size = int(parts[-1])
        if at + size > len(data):
            return
        yield ArcRecord(parts[0], parts[1], parts[2], parts[3], data[at : at + size], begin, parts[4] if count > 5 else None)
        at += size


# --- WARC ------------------------------------------------------------------------------------------------


def record_id(*parts: str) -> str:
    """A record's identifier from what it holds: a converter that runs again gives the same."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, ' '.join(parts))}>"


def http_split(body: bytes) -> tuple[bytes, bytes]:
    """HTTP head (its blank line included) and payload; a body without a head is all payload."""
    if not body.startswith(b"HTTP/"):
        return b"", body
    ends = [(i, n) for mark, n in ((b"\r\n\r\n", 4), (b"\n\n", 2)) if (i := body.find(mark)) >= 0]
    if not ends:
        return body, b""
    i, n = min(ends)
    return body[: i + n], body[i + n :]


def warc_record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in headers if v is not None) + f"Content-Length: {len(block)}\r\n\r\n"
    return head.encode("utf-8", "replace") + block + b"\r\n\r\n"


def parse_warc(raw: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers by lower-case name, block) of each record; a truncated one ends the file."""
    data, at = inflate(raw), 0
    while (at := data.find(b"WARC/", at)) >= 0:
        end = data.find(b"\r\n\r\n", at)
        if end < 0:
            return
        headers = {}
        for line in data[at:end].decode("utf-8", "replace").split("\r\n")[1:]:
            k, _, v = line.partition(":")
            headers[k.strip().lower()] = v.strip()
        size = int(headers.get("content-length", 0))
        if end + 4 + size > len(data):
            return
        yield headers, data[end + 4 : end + 4 + size]
        at = end + 4 + size


def converted(record: ArcRecord, refers: tuple[str, str, str] | None, digest: str | None = None) -> bytes:
    """The WARC record that an ARC record becomes: response for an HTTP reply, resource for another body, or a
    revisit of (identifier, URL, date), which keeps the HTTP head alone. `digest` is the payload's, where it is known."""
    head, payload = http_split(record.body)
    date, digest = arc_date(record.date), digest or digest_of(payload)
    headers = [
        ("WARC-Type", "revisit" if refers else "response" if head else "resource"),
        ("WARC-Record-ID", record_id(record.url, record.date, digest)),
        ("WARC-Date", date), ("WARC-Target-URI", record.url), ("WARC-IP-Address", record.ip if record.ip not in ("", "-") else None),
        ("WARC-Payload-Digest", f"sha1:{digest}"), ("X-Payload-Length", str(len(payload))),
    ]
    block = record.body
    if refers:
        block = head
        headers += [("WARC-Profile", REVISIT), ("WARC-Refers-To", refers[0]), ("WARC-Refers-To-Target-URI", refers[1]), ("WARC-Refers-To-Date", refers[2])]
    headers += [("WARC-Block-Digest", f"sha1:{digest_of(block)}"), ("Content-Type", "application/http; msgtype=response" if head else record.kind)]
    return warc_record(headers, block)


# --- Files -----------------------------------------------------------------------------------------------


def read_archives(spark: SparkSession, folder: str, suffix: str) -> DataFrame:
    """(path, content) of each whole archive in the folder."""
    return spark.read.format("binaryFile").option("pathGlobFilter", f"*{suffix}").load(folder).select("path", "content")


def write_arc(pages: DataFrame, folder: str, id_col: str = "page_id") -> DataFrame:
    """Writes `pages` (page_id, url, html) as compressed ARC files, even ones of version 1 and odd ones of version 2.

    Returns (name, records). A page's row becomes an HTTP reply; its id travels in the head. Each task writes the
    rows that it reads, a file for every ARCHIVE_BYTES of payload, named by its partition: a task that runs again
    writes the same files, and no page is shuffled.
    """
    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        part, k, records, payloads, plain, zipped, name, version = TaskContext.get().partitionId(), 0, 0, 0, 0, [], "", 1
        for batch in batches:
            for page, url, html in zip(batch["id"], batch["url"], batch["html"]):
                if not zipped:
                    version, name = 1 + (part + k) % 2, f"pages-{part:06d}-{k:04d}.arc.gz"
                    begin = arc_head(name, version)
                    zipped, plain, records, payloads = [gzip.compress(begin, 6)], len(begin), 0, 0
                payload = html.encode("utf-8", "replace") if isinstance(html, str) else b""
                body = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nX-Page-Id: {page if isinstance(page, str) else '-'}\r\nContent-Length: {len(payload)}\r\n\r\n".encode() + payload
                record = arc_record(version, url if isinstance(url, str) else "", "0.0.0.0", EPOCH, "text/html", body, name, plain)
                zipped.append(gzip.compress(record, 6))
                plain, records, payloads = plain + len(record), records + 1, payloads + len(payload)
                if payloads >= ARCHIVE_BYTES:
                    yield pd.DataFrame({"name": [put(folder, name, b"".join(zipped))], "records": [records]})
                    k, zipped = k + 1, []
        if zipped:
            yield pd.DataFrame({"name": [put(folder, name, b"".join(zipped))], "records": [records]})

    own = pages.select(F.col(id_col).cast("string").alias("id"), "url", "html")
    return own.mapInPandas(write, "name string, records long")


ARC_ROW = "archive string, at long, id long, url string, ip string, date string, kind string, digest string, size long"


def _page_id(head: bytes) -> int | None:
    at = head.find(b"X-Page-Id: ")
    text = head[at + 11 : head.find(b"\r", at)] if at >= 0 else b""
    return int(text) if text.lstrip(b"-").isdigit() else None


def arc_index(spark: SparkSession, folder: str) -> DataFrame:
    """One row, without its body, for each record of the ARC files in `folder`."""
    def index(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"]):
                rows = []
                for r in parse_arc(content):
                    head, payload = http_split(r.body)
                    rows.append((path, r.offset, _page_id(head), r.url, r.ip, r.date, r.kind, digest_of(payload), len(payload)))
                frame = pd.DataFrame(rows, columns=[x.split()[0] for x in ARC_ROW.split(", ")])
                yield frame.astype({"id": "Int64"})

    return read_archives(spark, folder, ".arc.gz").mapInPandas(index, ARC_ROW)


def decisions(index: DataFrame, least_bytes: int = 0) -> DataFrame:
    """(archive, at, first_id, first_url, first_date) for each record that revisits another.

    Of records with equal payloads of `least_bytes` or more, the one with the smallest id (then archive and
    offset; null ids last) is kept; the others refer to it. Only digests that occur twice meet the records.
    """
    order = F.struct(F.col("id").isNull().alias("none"), "id", "archive", "at", "url", "date")
    first = index.where(F.col("size") >= least_bytes).groupBy("digest", "size").agg(F.min(order).alias("f"), F.count(F.lit(1)).alias("n")).where("n > 1")
    both = index.select("archive", "at", "digest", "size").join(first, ["digest", "size"])
    both = both.where((F.col("archive") != F.col("f.archive")) | (F.col("at") != F.col("f.at")))
    return both.select("archive", "at", F.col("f.id").alias("first_id"), F.col("f.url").alias("first_url"), F.col("f.date").alias("first_date"), "digest")


def arc_to_warc(spark: SparkSession, arc_folder: str, warc_folder: str, least_bytes: int = 0) -> DataFrame:
    """Converts each ARC file to a WARC file; returns (name, records).

    What an archive's records refer to is gathered by archive, a few numbers a record, and goes to the task that
    opens the archive; bodies aren't shuffled.
    """
    index = cut(arc_index(spark, arc_folder))
    plan = decisions(index, least_bytes).groupBy("archive").agg(F.collect_list(F.struct("at", "first_id", "first_url", "first_date", "digest")).alias("plan"))
    digests = index.groupBy("archive").agg(F.collect_list(F.struct("at", "digest")).alias("digests"))  # an archive holds ARCHIVE_BYTES, about

    def convert(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, plan, digests in zip(batch["archive"], batch["plan"], batch["digests"]):
                refers, known = {}, {d["at"]: d["digest"] for d in digests}
                for p in plan if plan is not None else ():
                    refers[p["at"]] = (record_id(p["first_url"], p["first_date"], p["digest"]), p["first_url"], arc_date(p["first_date"]), p["first_id"])
                name = posixpath.basename(path).replace(".arc", ".warc")
                parts = [gzip.compress(warc_record([("WARC-Type", "warcinfo"), ("WARC-Record-ID", record_id(name)), ("WARC-Date", arc_date(EPOCH)), ("WARC-Filename", name), ("Content-Type", "application/warc-fields")], b"software: reelsleuth\r\nformat: WARC File Format 1.1\r\n"), 6)]
                for r in parse_arc(fetch(path)):
                    to = refers.get(r.offset)
                    made = converted(r, to[:3] if to else None, known.get(r.offset))
                    if to and to[3] is not None and to[3] == to[3]:
                        made = made.replace(b"\r\nWARC-Profile:", f"\r\nX-Refers-To-Page: {int(to[3])}\r\nWARC-Profile:".encode(), 1)
                    parts.append(gzip.compress(made, 6))
                put(warc_folder, name, b"".join(parts))
                yield pd.DataFrame({"name": [name], "records": [len(parts) - 1]})

    names = index.select("archive").distinct().count()
    files = digests.join(plan, "archive", "left").repartition(max(1, min(10_000, names)), "archive")
    return files.mapInPandas(convert, "name string, records long")


def read_warc(spark: SparkSession, folder: str) -> DataFrame:
    """(page_id, url, date, record_id, payload_bytes, payload_digest, record_type, refers_to, sound) for each record but warcinfo.

    sound says whether block and, where it is stored, payload agree with their digests.
    """
    columns = ["page_id", "url", "date", "record_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "sound"]

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for content in batch["content"]:
                rows = []
                for h, block in parse_warc(content):
                    if h.get("warc-type") == "warcinfo":
                        continue
                    head, payload = http_split(block)
                    said = h.get("warc-payload-digest", "").removeprefix("sha1:")
                    stored = h["warc-type"] != "revisit"
                    sound = h.get("warc-block-digest", "").removeprefix("sha1:") == digest_of(block) and (not stored or said == digest_of(payload))
                    size = len(payload) if stored else int(h.get("x-payload-length", 0))
                    refers = h.get("x-refers-to-page")
                    rows.append((_page_id(head), h.get("warc-target-uri"), h.get("warc-date"), h.get("warc-record-id"), size, said, h["warc-type"], int(refers) if refers else None, sound))
                yield pd.DataFrame(rows, columns=columns).astype({"page_id": "Int64", "refers_to": "Int64"})

    return read_archives(spark, folder, ".warc.gz").mapInPandas(read, "page_id long, url string, date string, record_id string, payload_bytes long, payload_digest string, record_type string, refers_to long, sound boolean")


def archive_pages(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Writes `pages` to ARC, converts that to WARC and returns what read_warc() reads back.

    One record a row, repeated rows included; a null html is an empty payload, which has equals like any other;
    a null url is written as "-"; a null page_id is null again and never preferred as the one referred to;
    an empty table gives no rows; other columns are ignored. Archives stay in the shared folder.
    """
    spark = pages.sparkSession
    folder = fresh_dir(spark, "archives")
    written = cut(write_arc(pages, f"{folder}/arc")).count()
    if not written:
        return spark.createDataFrame([], "page_id long, url string, date string, record_id string, payload_bytes long, payload_digest string, record_type string, refers_to long, sound boolean")
    cut(arc_to_warc(spark, f"{folder}/arc", f"{folder}/warc", least_bytes)).count()
    return read_warc(spark, f"{folder}/warc")
