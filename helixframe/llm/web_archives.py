"""Web archives: legacy ARC files, their conversion to WARC, and reading both.

Archives are written by Spark's text sink, one record a row: the separator that
the sink puts behind each row is what the formats put behind a record, so the
files are plain archives, committed or repeated task by task as any other
output. They are compressed as a whole (gzip, which Spark reads in one piece);
other archives must be so too, or smaller than a split. Reading streams an
archive through one task in pieces; records are found by their declared lengths
alone, and no more than a batch of pieces and one record is held.

A legacy record has one header line, whose fields depend on the version that the
archive's first record states. The converter gives each record what WARC asks
for beyond it: an identifier made from its place and contents, an ISO time, a
record type, digests of block and payload. Where several records have one
payload, the first (smallest page_id, numbers before none, then the earliest) is kept in full and
the others refer to it.

Defined results: a null or empty body is an empty payload, which counts as any
other; null urls stay null, white space in a url is written as %20 and the like.
Rows that repeat a page_id, or have none, are records of their own; without a
page_id refers_to is null, the record identifier still refers. A record that
ends before its declared length is kept and marked truncated; lines between
records that are no header are passed over. A table without rows gives archives
without records and no rows. Other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.session import delete, materialize, new_folder

#: Time of capture where the table has none: fourteen digits.
CAPTURED = "20240101000000"
#: Rows' separators in the files. Reading cuts at the second kind for both formats: once a record, at least.
ARC_END, WARC_END = "\n", "\r\n\r\n"
_CUT = WARC_END.encode()
#: Fields of a header line by version: fixed values of the format.
FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
#: Header lines. Urls and content types in old archives may hold spaces; the others may not.
LINE = {
    1: re.compile(rb"(.*) (\S+) (\d{8,17}) (.*) (\d+)\r?"),
    2: re.compile(rb"(.*) (\S+) (\d{8,17}) (.*) \S+ \S+ \S+ \S+ \S+ (\d+)\r?"),
}
#: What the second version must have matched to tell it from a first-version line with spaces: result code and offset.
_SECOND = re.compile(rb".* \S+ \d{8,17} .* (?:\d{3}|-) \S+ \S+ (?:\d+|-) \S+ \d+\r?")
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
PAGE_HEADER = "X-Page-ID"
_PAGE = re.compile(rb"\r\n" + PAGE_HEADER.encode() + rb": *([^\r\n]*)", re.I)
_LENGTH = re.compile(rb"\r\nContent-Length: *(\d+)", re.I)
#: Bytes of a batch that is handed back to Spark.
BATCH = 4 << 20


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _write(lines: DataFrame, folder: str, end: str) -> None:
    # The text sink writes a string's bytes as they are.
    lines.select(F.col("value").cast("string")).write.options(compression="gzip", lineSep=end, **{"zlib.compress.level": "BEST_SPEED"}).text(folder)


def write_arc(pages: DataFrame, folder: str, page_id: str = "page_id", url: str = "url", body: str = "html", captured: str = CAPTURED) -> None:
    """A legacy archive of each partition of pages: partitions of even number in version 1, the others in version 2.

    A record's body is an HTTP response; the page's number stands in a header of it.
    """
    text = F.coalesce(F.col(body).cast("string"), F.lit(""))
    where: Column = F.regexp_replace(F.regexp_replace(F.coalesce(F.col(url).cast("string"), F.lit("-")), "[\\r\\n]", "%0A"), "\\s", "%20")
    number = F.concat(F.lit(f"{PAGE_HEADER}: "), F.col(page_id).cast("string"), F.lit("\r\n"))
    http = F.concat(
        F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length(text).cast("string"), F.lit("\r\n"),
        F.coalesce(number, F.lit("")), F.lit("\r\n"), text)
    part, row = F.spark_partition_id(), F.monotonically_increasing_id()
    name = F.format_string("pages-%05d.arc", part)
    size = F.octet_length("__http").cast("string")
    line = {
        1: F.concat(F.col("__url"), F.lit(f" 0.0.0.0 {captured} text/html "), size),
        2: F.concat(F.col("__url"), F.lit(f" 0.0.0.0 {captured} text/html 200 - - "), row.bitwiseAND((1 << 33) - 1).cast("string"), F.lit(" "), name, F.lit(" "), size),
    }
    block = {v: f"{v} 0 none\n{fields}\n" for v, fields in FIELDS.items()}
    about = {
        1: F.concat(F.lit("filedesc://"), name, F.lit(f" 0.0.0.0 {captured} text/plain {len(block[1])}\n{block[1]}\n")),
        2: F.concat(F.lit("filedesc://"), name, F.lit(f" 0.0.0.0 {captured} text/plain 200 - - 0 "), name, F.lit(f" {len(block[2])}\n{block[2]}\n")),
    }
    of = lambda by: F.when(part % 2 == 0, by[1]).otherwise(by[2])
    first = F.when(row.bitwiseAND((1 << 33) - 1) == 0, of(about)).otherwise(F.lit(""))
    rows = pages.select(where.alias("__url"), http.alias("__http"))
    _write(rows.select(F.concat(first, of(line), F.lit("\n"), F.col("__http")).alias("value")), folder, ARC_END)


@dataclass
class Record:
    url: str | None
    ip: str
    date: str
    mime: str
    body: bytes
    truncated: bool
    about: bool

    @property
    def head(self) -> int:
        """Bytes of the HTTP headers, 0 if the body is no HTTP response."""
        return self.body.find(b"\r\n\r\n") + 4 if self.body.startswith(b"HTTP/") and b"\r\n\r\n" in self.body else 0


@dataclass
class Archive:
    """Where the reading of one file stands."""

    version: int = 1
    name: str = ""


def iso(date: str) -> str:
    """The time of an archive date of 8 to 17 digits; what is missing is the beginning of the day, hour or minute."""
    d = (date + "000000")[:14]
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def parse_arc(data: bytes, last: bool, archive: Archive) -> tuple[list[Record], int]:
    """The whole records at the beginning of data, and where the rest begins. last: nothing follows data."""
    out, at = [], 0
    while True:
        while data[at : at + 1] in (b"\n", b"\r"):
            at += 1
        stop = data.find(b"\n", at)
        if stop < 0:
            return out, len(data) if last else at
        line = data[at:stop]
        about = line.startswith(b"filedesc://")
        version = (2 if _SECOND.fullmatch(line) else 1) if about else archive.version
        found = LINE[version].fullmatch(line)
        if not found:
            at = stop + 1
            continue
        url, ip, date, mime, length = (x.decode("utf-8", "replace") for x in found.groups())
        end = stop + 1 + int(length)
        if end > len(data) and not last:
            return out, at
        body = data[stop + 1 : end]
        if about:
            archive.name = url
            archive.version = 2 if body[:1] == b"2" else 1
        out.append(Record(None if url == "-" else url, ip, date, mime, body, len(body) < int(length), about))
        at = min(end, len(data))


def parse_warc(data: bytes, last: bool, _: Archive) -> tuple[list[tuple[dict[str, str], bytes]], int]:
    """(headers by lower-case name, block) of the whole records at the beginning of data, and where the rest begins."""
    out, at = [], 0
    while True:
        while data[at : at + 1] in (b"\n", b"\r"):
            at += 1
        stop = data.find(b"\r\n\r\n", at)
        if stop < 0:
            return out, len(data) if last else at
        lines = data[at:stop].decode("utf-8", "replace").split("\r\n")
        head = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        if not lines[0].startswith("WARC/") or not head.get("content-length", "").isdigit():
            at = stop + 4
            continue
        end = stop + 4 + int(head["content-length"])
        if end > len(data) and not last:
            return out, at
        out.append((head, data[stop + 4 : end]))
        at = min(end, len(data))


def _stretches(batches: Iterator[pa.RecordBatch], parse: Callable) -> Iterator[tuple[int, int, Archive, object]]:
    """(file, place in it, archive, record) of files that come in pieces, one file after the other."""
    file, rest, place, archive = None, b"", 0, Archive()
    for batch in batches:
        files, pieces = batch.column("file").to_pylist(), batch.column("value").to_pylist()
        lo = 0
        while lo < len(files):
            hi = lo
            while hi < len(files) and files[hi] == files[lo]:
                hi += 1
            data = _CUT.join(pieces[lo:hi])
            if files[lo] == file:
                data = rest + _CUT + data
            else:
                for x in parse(rest, True, archive)[0]:
                    yield file, place, archive, x
                    place += 1
                file, place, archive = files[lo], 0, Archive()
            records, at = parse(data, False, archive)
            rest = data[at:]
            for x in records:
                yield file, place, archive, x
                place += 1
            lo = hi
    for x in parse(rest, True, archive)[0]:
        yield file, place, archive, x
        place += 1


def _batches(rows: Iterator[tuple], schema: pa.Schema, sized: int | None = None) -> Iterator[pa.RecordBatch]:
    """Rows in batches of 2,000, or of about BATCH bytes in the column ``sized``."""
    made: list[tuple] = []
    held = 0
    for row in rows:
        made.append(row)
        held += len(row[sized] or b"") if sized is not None else 0
        if len(made) == 2000 or held > BATCH:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*made), schema)], schema=schema)
            made, held = [], 0
    if made:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*made), schema)], schema=schema)


def _pieces(spark: SparkSession, folder: str) -> DataFrame:
    rows = spark.read.option("lineSep", WARC_END).text(folder)
    return rows.select(F.xxhash64("_metadata.file_path").alias("file"), F.col("value").cast("binary").alias("value"))


_ARC = pa.schema([("file", pa.int64()), ("place", pa.int64()), ("about", pa.bool_()), ("record_id", pa.string()), ("page_id", pa.string()), ("url", pa.string()), ("ip", pa.string()), ("date", pa.string()),
    ("mime", pa.string()), ("truncated", pa.bool_()), ("n_head", pa.int64()), ("n_payload", pa.int64()), ("digest", pa.string()), ("body", pa.binary())])
_ARC_DDL = "file long, place long, about boolean, record_id string, page_id string, url string, ip string, date string, mime string, truncated boolean, n_head long, n_payload long, digest string, body binary"


def _arc_rows(bodies: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for file, place, archive, x in _stretches(batches, parse_arc):
                payload = x.body[x.head :]
                digest = base32_sha1(payload)
                ident = f"urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{archive.name} {place} {x.url} {x.date} {digest}')}"
                page = _PAGE.search(x.body, 0, x.head) if x.head else None
                yield (file, place, x.about, ident, page[1].decode() if page else None, x.url, x.ip, iso(x.date), x.mime, x.truncated, x.head, len(payload), digest, x.body if bodies else None)

        return _batches(rows(), _ARC, 13)

    return run


def read_arc(spark: SparkSession, folder: str, bodies: bool = True) -> DataFrame:
    """One row for each record of the legacy archives in folder, with all that its WARC record needs."""
    return _pieces(spark, folder).mapInArrow(_arc_rows(bodies), _ARC_DDL)


def _warc_record(r: dict) -> bytes:
    head, body = r["n_head"], r["body"]
    revisit = r["refers_id"] is not None
    block = body[:head] if revisit else body
    kind = "warcinfo" if r["about"] else "revisit" if revisit else "response" if head or (r["url"] or "").startswith("dns:") else "resource"
    lines = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{r['record_id']}>", f"WARC-Date: {r['date']}",
        *([f"WARC-Filename: {r['url'].removeprefix('filedesc://')}"] if r["about"] else [f"WARC-Target-URI: {r['url']}"] if r["url"] else []),
        *([f"WARC-IP-Address: {r['ip']}"] if r["ip"] not in ("0.0.0.0", "-") else []),
        f"WARC-Block-Digest: sha1:{base32_sha1(block)}", f"WARC-Payload-Digest: sha1:{r['digest']}",
        *([f"WARC-Refers-To: <{r['refers_id']}>", f"WARC-Refers-To-Date: {r['refers_date']}", f"WARC-Profile: {PROFILE}"] if revisit else []),
        *(["WARC-Truncated: length"] if r["truncated"] else []),
        f"Content-Type: {'application/http;msgtype=response' if head else r['mime']}", f"Content-Length: {len(block)}",
    ]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block


def _warc_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows = ((_warc_record(r),) for batch in batches for r in batch.to_pylist())
    return _batches(rows, pa.schema([("value", pa.binary())]), 0)


def convert(spark: SparkSession, arcs: str, warcs: str, min_bytes: int = 0) -> None:
    """The legacy archives of one folder as WARC archives in another.

    Records whose payload of at least min_bytes is that of an earlier one become
    revisits: which these are is found by their digests, without bodies; bodies
    are shuffled only if the revisits are too many for Spark to broadcast.
    """
    light = materialize(read_arc(spark, arcs, bodies=False).where("not about").drop("body"), "archive")
    order = F.struct(F.col("page_id").isNull().alias("none"), F.col("page_id").cast("long").alias("n"), "page_id", "date", "record_id", "file", "place")
    first = light.where(F.col("n_payload") >= min_bytes).groupBy("digest").agg(F.min(order).alias("first"))
    revisits = light.where(F.col("n_payload") >= min_bytes).join(first, "digest").where("file <> first.file or place <> first.place")
    revisits = materialize(revisits.select("file", "place", F.col("first.record_id").alias("refers_id"), F.col("first.date").alias("refers_date")), "archive")
    rows = read_arc(spark, arcs).join(revisits, ["file", "place"], "left")
    _write(rows.mapInArrow(_warc_lines, "value binary"), warcs, WARC_END)


_WARC = pa.schema([("record_type", pa.string()), ("record_id", pa.string()), ("page_id", pa.string()), ("url", pa.string()), ("date", pa.string()),
    ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("intact", pa.bool_()), ("refers_id", pa.string()), ("payload", pa.binary())])
_WARC_DDL = "record_type string, record_id string, page_id string, url string, date string, payload_bytes long, payload_digest string, intact boolean, refers_id string, payload binary"


def _warc_rows(payloads: bool):
    bare = lambda x: x.strip("<>") if x else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for _, _, _, (head, block) in _stretches(batches, parse_warc):
                at = block.find(b"\r\n\r\n") + 4 if block.startswith(b"HTTP/") else 0
                payload, kind, stated = block[at:], head.get("warc-type"), head.get("warc-payload-digest", "").removeprefix("sha1:")
                page = _PAGE.search(block, 0, at) if at else None
                if kind == "revisit":  # its payload is the one it refers to: the headers of that response tell its length
                    long = _LENGTH.search(block, 0, at)
                    size, digest, payload = int(long[1]) if long else None, stated or None, None
                else:
                    size, digest = len(payload), base32_sha1(payload)
                intact = len(block) == int(head["content-length"]) and (kind == "revisit" or stated in ("", digest))
                yield (kind, bare(head.get("warc-record-id")), page[1].decode() if page else None, head.get("warc-target-uri"), head.get("warc-date"), size, digest, intact, bare(head.get("warc-refers-to")), payload if payloads else None)

        return _batches(rows(), _WARC, 9)

    return run


def read_warc(spark: SparkSession, folder: str, payloads: bool = True) -> DataFrame:
    """One row for each record of the WARC archives in folder; digests are computed anew, ``intact`` says that they and the lengths agree."""
    return _pieces(spark, folder).mapInArrow(_warc_rows(payloads), _WARC_DDL)


def archive(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to and more of pages that went through both kinds of archives."""
    spark, kind = pages.sparkSession, pages.schema["page_id"].dataType
    arcs, warcs = new_folder(spark, "arc"), new_folder(spark, "warc")
    write_arc(pages, arcs)
    convert(spark, arcs, warcs, min_bytes)
    delete(spark, arcs)
    rows = materialize(read_warc(spark, warcs, payloads=False).where("record_type <> 'warcinfo'").drop("payload"), "archive")
    delete(spark, warcs)
    named = rows.where("record_type = 'response'").groupBy(F.col("record_id").alias("refers_id")).agg(F.min("page_id").alias("refers_to"))
    return rows.join(named, "refers_id", "left").select(
        F.col("page_id").cast(kind).alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(kind).alias("refers_to"), "url", "record_id", "date", "intact")
