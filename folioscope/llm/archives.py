"""Web archives: conversion of legacy ARC files to WARC, and reading WARC files.

An ARC file opens with a version record; the version fixes the fields of every header line. Version 1
has URL, address, date, type and length; version 2 adds result code, checksum, location, offset and file
name before the length. Each record's body has the declared length. The converter makes the equivalent
WARC records: an identifier from the record's contents, the date in ISO form, the record type, and SHA-1
digests in base32; the version record becomes a `warcinfo` record.

Archives hold one gzip member a record. They are written by Spark's text writer, whose line separator is
an empty gzip member, and are read file by file, member by member, by declared lengths.

Defined cases: a null payload is empty; a null url is `about:blank`, and blanks in urls are
percent-encoded; ARC header lines with too few fields or without a number as length end the reading of that
archive, whose rest becomes one record of type `unknown`; bodies that end early are kept and marked
truncated, also where a gzip member breaks off. Damaged WARC files raise nothing: the column state of their rows
is `truncated`, `digest mismatch` (the digest given is that of the bytes) or, for bytes that are no record or
have no length, `unreadable`. An empty table writes and reads no record; long payloads are written and read whole.
Of equal payloads the record with the largest page id is the response and others revisit it; a null id is never
referred to; rows that repeat id and payload of a response are responses, and rows that are equal in all make equal
records, identifier included; rows of one page id with different payloads or urls have identifiers of their own.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.llm.common import record_batch, small_batches, stored, table, work_dir

#: Payloads of fewer bytes are never revisits.
LEAST_BYTES = 0
#: Records of one archive file, which is read by one task, and bytes of it before compression, as a mean.
FILE_RECORDS = 20_000
FILE_BYTES = 256_000_000
#: Bytes that are decompressed at once.
PIECE = 1 << 14
#: Rows that a task gives at once.
ROWS = 500
#: A payload shared by more than one row in this many is joined as a broadcast row: there can be no more such payloads.
HOT_SHARE = 1000
#: A gzip member without contents, which separates the members of an archive.
SEPARATOR = gzip.compress(b"", mtime=0)
CRAWLED = "20200101000000"

ARC_FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}


@dataclass
class ArcRecord:
    url: str
    address: str
    date: str
    kind: str
    body: bytes
    code: str = "-"
    checksum: str = "-"
    location: str = "-"
    truncated: bool = False


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def write_arc(records: Iterable[ArcRecord], version: int, name: str = "pages.arc") -> bytes:
    """An ARC file of the given version."""
    head = f"{version} 0 folioscope\n{ARC_FIELDS[version]}\n".encode()
    first = f"filedesc://{name} 0.0.0.0 {CRAWLED} text/plain"
    first += "" if version == 1 else f" 200 - - 0 {name}"
    out = [f"{first} {len(head)}\n".encode() + head + b"\n"]
    at = len(out[0])
    for r in records:
        middle = "" if version == 1 else f" {r.code} {r.checksum} {r.location} {at} {name}"
        out.append(f"{r.url} {r.address} {r.date} {r.kind}{middle} {len(r.body)}\n".encode() + r.body + b"\n")
        at += len(out[-1])
    return b"".join(out)


def _header(line: bytes, version: int) -> tuple[list[str], int] | None:
    """Fields up to the type and what follows it, and the declared length. A type may hold blanks."""
    parts = line.decode("utf-8", "replace").rstrip("\r").split(" ")
    tail = 1 if version == 1 else 6
    if len(parts) < 4 + tail or not parts[-1].isdigit():
        return None
    return [*parts[:3], " ".join(parts[3:-tail]), *parts[-tail:-1]], int(parts[-1])


def members(data: bytes) -> Iterator[bytes]:
    """The contents of each gzip member that has some; what is readable of one that breaks off. Other data is one member."""
    if data[:2] != b"\x1f\x8b":
        if data:
            yield data
        return
    at, view = 0, memoryview(data)
    while data.startswith(b"\x1f\x8b", at):
        if data.startswith(SEPARATOR, at):
            at += len(SEPARATOR)
            continue
        member, parts = zlib.decompressobj(31), []
        try:
            # In pieces, so that an error in a member leaves what stands before it.
            while at < len(data) and not member.eof:
                parts.append(member.decompress(view[at : at + PIECE]))
                at = min(at + PIECE, len(data)) - len(member.unused_data)
        except zlib.error:
            at = len(data)
        if any(parts):
            yield b"".join(parts)


def parse_arc(data: bytes, info: bool = False) -> Iterator[ArcRecord]:
    """The records of an ARC file, gzip members included. The version record tells the fields; it is given if info is set."""
    data = b"".join(members(data))
    at, version = 0, 0
    while at < len(data):
        if data[at : at + 1] in (b"\n", b"\r"):
            at += 1
            continue
        end = data.find(b"\n", at)
        end = len(data) if end < 0 else end
        if not version:
            # The version stands in the first record's body, whose length is the line's last field in any version.
            parts = data[at:end].decode("utf-8", "replace").split()
            found = re.match(rb"(\d+) ", data[end + 1 : end + 16])
            if len(parts) < 4 or not parts[0].startswith("filedesc:") or not parts[-1].isdigit() or not found:
                yield ArcRecord("urn:arc:unreadable", "0.0.0.0", CRAWLED, "unknown", data[at:], truncated=True)
                return
            version = 2 if int(found[1]) >= 2 else 1
            if info:
                yield ArcRecord(parts[0], parts[1], parts[2], "filedesc", data[end + 1 : end + 1 + int(parts[-1])])
            at = end + 1 + int(parts[-1])
            continue
        head = _header(data[at:end], version)
        if head is None:
            yield ArcRecord("urn:arc:unreadable", "0.0.0.0", CRAWLED, "unknown", data[at:], truncated=True)
            return
        fields, length = head
        body = data[end + 1 : end + 1 + length]
        more = dict(zip(("code", "checksum", "location"), fields[4:7], strict=False))
        yield ArcRecord(*fields[:4], body, **more, truncated=len(body) < length)
        at = end + 1 + length


def iso_date(date: str) -> str:
    """An ARC date of 4 to 14 digits as a WARC date; what is missing is the start of its span."""
    d = re.sub(r"\D", "", date)[:14]
    d += "00000101000000"[len(d) :]
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def split_http(block: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields in lower case, and the payload; without an HTTP status line the whole block is payload."""
    if not block.startswith(b"HTTP/"):
        return {}, block
    head, _, payload = block.partition(b"\r\n\r\n")
    pairs = (line.partition(":") for line in head.decode("utf-8", "replace").split("\r\n")[1:])
    return {k.strip().lower(): v.strip() for k, _, v in pairs}, payload


def record_id(url: str, name: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{url} {name}')}>"


def to_warc(r: ArcRecord, refers_to: str | None = None) -> bytes:
    """The WARC record of an ARC record, without the two empty lines that end it.

    With refers_to, the identifier of an equal payload's record, it is a revisit whose block keeps the
    HTTP header alone. A version record becomes a warcinfo record that tells what was converted.
    """
    if r.kind == "filedesc":
        lines = ["software: folioscope", "format: WARC File Format 1.1", f"description: converted from {r.url}", f"arc-version: {r.body.split(b' ')[0].decode()}"]
        block = "".join(f"{x}\r\n" for x in lines).encode()
        head = ["WARC/1.1", "WARC-Type: warcinfo", f"WARC-Record-ID: {record_id(r.url, sha1_base32(r.body))}", f"WARC-Date: {iso_date(r.date)}"]
        head += [f"WARC-Filename: {r.url.removeprefix('filedesc://')}", f"WARC-Block-Digest: sha1:{sha1_base32(block)}", "Content-Type: application/warc-fields"]
        return "\r\n".join([*head, f"Content-Length: {len(block)}"]).encode() + b"\r\n\r\n" + block
    fields, payload = split_http(r.body)
    digest = sha1_base32(payload)
    name = page_name(fields["x-page-id"], digest) if "x-page-id" in fields else sha1_base32(r.body)
    http = r.body.startswith(b"HTTP/")
    kind = "revisit" if refers_to else "response" if http else "resource" if r.kind != "unknown" else "unknown"
    block = r.body[: len(r.body) - len(payload)] if refers_to else r.body
    head = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: {record_id(r.url, name)}",
        f"WARC-Date: {iso_date(r.date)}",
        f"WARC-Target-URI: {r.url}",
        f"WARC-IP-Address: {r.address}",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"WARC-Block-Digest: sha1:{sha1_base32(block)}",
    ]
    if refers_to:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {refers_to}"]
    if r.truncated:
        head.append("WARC-Truncated: unspecified")
    head += [f"Content-Type: {'application/http; msgtype=response' if http else r.kind}", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block


def page_name(page: str, digest: str) -> str:
    """What names a page's record beside its url."""
    return f"{page} {digest}"


def parse_warc(data: bytes) -> Iterator[tuple[dict[str, str], bytes, str]]:
    """(header fields in lower case, block, state) of each record, by declared lengths.

    The state is whole, truncated (the block ends early) or unreadable (the rest of a member that has no
    header, or none with a length).
    """
    for member in members(data):
        at = 0
        while at < len(member):
            end = member.find(b"\r\n\r\n", at)
            head: dict[str, str] = {}
            if end >= 0 and member.startswith(b"WARC/", at):
                pairs = (line.partition(":") for line in member[at:end].decode("utf-8", "replace").split("\r\n")[1:])
                head = {k.strip().lower(): v.strip() for k, _, v in pairs}
            if not head.get("content-length", "").isdigit() or "warc-type" not in head:
                yield head, member[at:], "unreadable"
                break
            size = int(head["content-length"])
            block = member[end + 4 : end + 4 + size]
            yield head, block, "whole" if len(block) == size else "truncated"
            at = end + 4 + size
            while member[at : at + 2] == b"\r\n":
                at += 2


def gzip_member(record: bytes) -> bytes:
    return gzip.compress(record + b"\r\n\r\n", 6, mtime=0)


def write_records(records: DataFrame, path: str, per_file: int = FILE_RECORDS) -> None:
    """Writes gzip members (column record, binary), one for each WARC record, as archive files in a folder."""
    members_ = records.select(F.col("record").cast("string"))
    # The separator's bytes are given one a character; compression is the members' own.
    writer = members_.write.option("encoding", "ISO-8859-1").option("lineSep", SEPARATOR.decode("latin-1"))
    writer.option("maxRecordsPerFile", per_file).option("compression", "none").text(path)


def convert_arc(spark: SparkSession, source: str, path: str) -> None:
    """Converts all ARC files below a path to WARC files in a folder; one task reads a file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("record", pa.binary())])
        for batch in batches:
            for data in batch.column(0):
                held: list[bytes] = []
                for r in parse_arc(data.as_py(), info=True):
                    held.append(gzip_member(to_warc(r)))
                    if len(held) == ROWS:
                        yield record_batch(schema, record=held)
                        held = []
                yield record_batch(schema, record=held)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(source).select("content")
    write_records(files.mapInArrow(run, "record binary"), path)


READ = "record_id string, record_type string, refers_to_id string, url string, date string, page_id string, payload_bytes bigint, payload_digest string, state string"


def read_warc(spark: SparkSession, path: str, info: bool = False) -> DataFrame:
    """One row for each record; those that describe the archive itself (warcinfo) only if info is set.

    Of a revisit, payload length and digest are those its headers give.
    """
    names = [x.split()[0] for x in READ.split(", ")]
    schema = pa.schema([(x, pa.int64() if x == "payload_bytes" else pa.string()) for x in names])

    def row(head: dict[str, str], block: bytes, state: str) -> tuple:
        fields, payload = split_http(block)
        given = head.get("warc-payload-digest", "").removeprefix("sha1:")
        kind = head.get("warc-type", "unknown")
        revisit = kind == "revisit"
        digest = given if revisit else sha1_base32(payload)
        if state == "whole" and not revisit and given and given != digest:
            state = "digest mismatch"
        size = int(fields["content-length"]) if revisit and fields.get("content-length", "").isdigit() else len(payload)
        return head.get("warc-record-id"), kind, head.get("warc-refers-to"), head.get("warc-target-uri"), head.get("warc-date"), fields.get("x-page-id"), size, digest, state

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return record_batch(schema, **{x: [r[k] for r in rows] for k, x in enumerate(names)})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(0):
                rows: list[tuple] = []
                for head, block, state in parse_warc(data.as_py()):
                    if info or head.get("warc-type") != "warcinfo":
                        rows.append(row(head, block, state))
                    if len(rows) == ROWS:
                        yield batch_of(rows)
                        rows = []
                yield batch_of(rows)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, READ)


def archive_pages(pages: DataFrame, path: str) -> None:
    """Writes a WARC record for each page (page_id, url, html), by way of ARC records of both versions."""
    spark = pages.sparkSession
    small_batches(spark)
    source = pages.select(F.col("page_id").alias("page_id"), F.coalesce("url", F.lit("about:blank")).alias("url"), F.coalesce("html", F.lit("")).alias("html"))
    source = source.withColumn("digest", F.sha1("html")).withColumn("size", F.octet_length("html"))
    marks = stored(source.select("page_id", "url", "digest", "size"), "warc-marks")
    n, total = marks.agg(F.count("*"), F.sum("size")).first()
    per_file = min(FILE_RECORDS, max(1, FILE_BYTES * n // (total or 1))) if n else FILE_RECORDS
    shared = marks.filter(F.col("size") >= LEAST_BYTES).groupBy("digest").agg(F.max(F.struct("page_id", "url")).alias("to"), F.count("*").alias("n"))
    shared = stored(shared.filter(F.col("n") > 1).filter("to.page_id IS NOT NULL"), "warc-shared")

    # Payloads of very many rows are broadcast; rows that have found theirs are spread by their ids in the join of the rest.
    hot = shared.filter(F.col("n") > max(1, n // HOT_SHARE)).select("digest", F.col("to").alias("hot_to"))
    wide = source.join(F.broadcast(hot), "digest", "left")
    spread = F.concat(F.lit("-"), F.coalesce(F.col("page_id").cast("string"), F.xxhash64("url").cast("string")))
    wide = wide.withColumn("_key", F.when(F.col("hot_to").isNull(), F.col("digest")).otherwise(spread))
    joined = wide.join(shared.select(F.col("digest").alias("_key"), "to"), "_key", "left").withColumn("to", F.coalesce("hot_to", "to"))
    revisit = (F.col("size") >= LEAST_BYTES) & F.col("to").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("to.page_id"))
    page = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("null"))
    joined = joined.select(page("page_id").alias("page_id"), "url", "html", F.when(revisit, page("to.page_id")).alias("to_page"), F.when(revisit, F.col("to.url")).alias("to_url"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("record", pa.binary())])
        clean = lambda url: re.sub(r"\s", lambda m: f"%{ord(m[0]):02X}", url)
        for n, batch in enumerate(batches):
            rows, refs = [], []
            for page, url, html, to_page, to_url in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                payload = html.encode()
                head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nX-Page-Id: {page}\r\nContent-Length: {len(payload)}\r\n\r\n"
                rows.append(ArcRecord(clean(url), "0.0.0.0", CRAWLED, "text/html", head.encode() + payload, code="200"))
                refs.append(record_id(clean(to_url), page_name(to_page, sha1_base32(payload))) if to_page is not None else None)
            made = [gzip_member(to_warc(r, to)) for r, to in zip(parse_arc(write_arc(rows, 1 + n % 2)), refs, strict=True)]
            yield record_batch(schema, record=made)

    write_records(joined.mapInArrow(run, "record binary"), path, per_file)


def page_records(found: DataFrame) -> DataFrame:
    """found, the rows of read_warc, with refers_to: the page id of the record that a revisit refers to.

    Only revisits are joined, with the responses that some revisit refers to.
    """
    found = stored(found, "warc-records")
    again = found.filter(F.col("refers_to_id").isNotNull())
    names = found.filter("record_type = 'response'").select(F.col("record_id").alias("refers_to_id"), F.col("page_id").alias("refers_to")).distinct()
    asked = again.groupBy("refers_to_id").agg(F.count("*").alias("n"))
    n = found.count()
    named = stored(names.join(asked, "refers_to_id"), "warc-names")
    hot = named.filter(F.col("n") > max(1, n // HOT_SHARE)).drop("n")
    many = again.join(F.broadcast(hot), "refers_to_id")
    few = again.join(F.broadcast(hot.select("refers_to_id")), "refers_to_id", "left_anti").join(named.drop("n"), "refers_to_id", "left")
    return found.filter(F.col("refers_to_id").isNull()).withColumn("refers_to", F.lit(None).cast("string")).unionByName(many).unionByName(few)


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = work_dir(spark, "warc")
    pages = table(spark, sf_dir, "pages")
    archive_pages(pages, path)
    kind = pages.schema["page_id"].dataType
    found = page_records(read_warc(spark, path))
    return found.select(
        F.when(F.col("page_id") != "null", F.col("page_id")).cast(kind).alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(kind).alias("refers_to")
    )


ORACLE = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
g AS (SELECT page_id, h, max(page_id) OVER (PARTITION BY h) AS m FROM p),
b AS (SELECT page_id, h, m, CAST(CAST(unhex(sha1(h)) AS BIT) AS VARCHAR) AS bits FROM g)
SELECT page_id,
       CAST(strlen(h) AS BIGINT) AS payload_bytes,
       array_to_string(list_transform(range(0, 32), lambda i:
         substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(1 + 16 * CAST(substr(bits, 5 * i + 1, 1) AS INTEGER)
           + 8 * CAST(substr(bits, 5 * i + 2, 1) AS INTEGER) + 4 * CAST(substr(bits, 5 * i + 3, 1) AS INTEGER)
           + 2 * CAST(substr(bits, 5 * i + 4, 1) AS INTEGER) + CAST(substr(bits, 5 * i + 5, 1) AS INTEGER) AS INTEGER), 1)), '') AS payload_digest,
       CASE WHEN page_id = m THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = m THEN NULL ELSE m END AS refers_to
FROM b
"""
