"""Legacy ARC archives to WARC.

An ARC file starts with a version block (``filedesc://``) that names version 1 or 2;
the version fixes the fields of every record's header line, whose last field declares
the length of what follows.  Records are read one after the other by those lengths alone,
from files that are plain or gzipped, as a whole or by record.  Fields are taken from the
right, so a URL may hold blanks.  The version block becomes a ``warcinfo`` record, each
other record a WARC record with a derived identifier, an ISO timestamp, a type, the
address and SHA-256 digests: ``response`` where it holds an HTTP response, or ``revisit``
where an equal payload of 100 bytes or more is already there under a smaller id, else
(``dns:`` lookups and the like) ``resource``.  Every record is a gzip member of its own.

Defined results: a null payload is empty; a null id is written as ``-`` and comes back
null (such a record is never a response that others revisit unless no other has an id);
rows that repeat the smallest id of a payload are all responses; a null URL becomes a
URN; an empty table gives archives without records.  A record with a broken header line
raises ``ValueError``.
"""

from __future__ import annotations

import datetime
import gzip
import hashlib
import io
import re
import uuid
import zlib

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import columnar as C
from .storage import discard, fresh_path, read_files, write_blobs, written

#: Payloads below this size are never revisits.
LEAST_REVISIT = 100
#: Bytes of records after which an ARC file ends; compressed bytes after which a blob of WARC records ends, and blobs of a WARC file.
ARC_BYTES, BLOB_BYTES, FILE_BLOBS = 16 << 20, 1 << 20, 12
#: How hard members are compressed.
LEVEL = 3
#: Copies from which a payload counts as hot, and hot payloads that are broadcast at most.
HOT_COPIES, HOT_PAYLOADS = 10_000, 100_000
#: The header fields of the two ARC versions.
ARC_FIELDS = {
    1: ("URL", "IP-address", "Archive-date", "Content-type", "Archive-length"),
    2: ("URL", "IP-address", "Archive-date", "Content-type", "Result-code", "Checksum", "Location", "Offset", "Filename", "Archive-length"),
}
_EPOCH = datetime.datetime(2004, 1, 1)


def arc_header(version: int, url: str, ip: str, date: str, kind: str, length: int, offset: int, name: str) -> bytes:
    fields = [url, ip, date, kind, str(length)] if version == 1 else [url, ip, date, kind, "200", "-", "-", str(offset), name, str(length)]
    return " ".join(fields).encode() + b"\n"


def arc_start(version: int, name: str, date: str) -> bytes:
    body = f"{version} 0 fieldweave\n{' '.join(ARC_FIELDS[version])}\n".encode()
    return arc_header(version, f"filedesc://{name}", "0.0.0.0", date, "text/plain", len(body), 0, name) + body


def member(data: bytes) -> bytes:
    """A gzip member."""
    z = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


#: An empty member, which may stand anywhere in a gzip file.
_NOTHING = member(b"").decode("latin-1")


def write_members(df: DataFrame, path: str, **options: str) -> None:
    """Write one binary column ``blob`` of whole gzip members to raw files."""
    write_blobs(df, "blob", path, end=_NOTHING, encoding="ISO-8859-1", **options)


def opened(content: bytes) -> io.BufferedIOBase:
    """A file's bytes as a stream, unpacked as it is read."""
    return gzip.GzipFile(fileobj=io.BytesIO(content)) if content[:2] == b"\x1f\x8b" else io.BytesIO(content)


def read_arc(content: bytes):
    """(fields by name, content) of each record of an ARC file; the first is its version block."""
    stream, version = opened(content), None
    while line := stream.readline():
        if line in (b"\n", b"\r\n"):
            continue
        said = line.rstrip(b"\r\n").decode("utf-8", "replace")
        if version is None and not (said.startswith("filedesc://") and said.rsplit(" ", 1)[-1].isdigit()):
            raise ValueError("no version block")
        length = said.rsplit(" ", 1)[-1]
        if not length.isdigit():
            raise ValueError("a header line without a length")
        body = stream.read(int(length))
        if len(body) < int(length):
            raise ValueError("a record beyond the end of its file")
        if version is None:
            number = body.split(b" ", 1)[0]
            version = int(number) if number.isdigit() else 0
            if version not in ARC_FIELDS:
                raise ValueError(f"version {number!r}")
        names = ARC_FIELDS[version]
        parts = said.rsplit(" ", len(names) - 1)
        if len(parts) != len(names):
            raise ValueError(f"a header line of {len(parts)} fields in version {version}")
        yield dict(zip(names, parts, strict=True)), body


def _safe_url(url: str | None, page_id: object) -> str:
    return "urn:page:" + str(page_id) if not url else re.sub(r"[\x00-\x20\x7f-\xa0  ]", lambda m: "".join(f"%{b:02X}" for b in m[0].encode()), url)


def write_arc(pages: DataFrame, path: str, *, key: str = "page_id", url: str = "url", html: str = "html") -> None:
    """ARC files of all pages, version 1 and 2 by turns, gzipped by record."""

    def run(batches):
        number, files = TaskContext.get().partitionId(), 0
        version, name, out, offset = 1 + number % 2, f"{number:06d}-0000.arc", [], 0
        date = (_EPOCH + datetime.timedelta(minutes=number)).strftime("%Y%m%d%H%M%S")
        for batch in C.slices(batches, html):
            keys, urls = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in (key, url))
            data, at = C.text_buffer(batch.column(batch.schema.get_field_index(html)))
            for i, (k, u) in enumerate(zip(keys, urls, strict=True)):
                payload = data[at[i] : at[i + 1]].tobytes()
                content = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\nX-Page-Id: {'-' if k is None else k}\r\n\r\n".encode() + payload
                when = (_EPOCH + datetime.timedelta(seconds=(k or 0) % (1 << 28))).strftime("%Y%m%d%H%M%S")
                if not out:
                    out.append(member(arc_start(version, name, date) + b"\n"))
                record = arc_header(version, _safe_url(u, k), "192.0.2.1", when, "text/html", len(content), offset, name) + content
                out.append(member(record + b"\n"))
                offset += len(record) + 1
                if offset >= ARC_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array([b"".join(out)], pa.binary())], names=["blob"])
                    files += 1
                    name, out, offset = f"{number:06d}-{files:04d}.arc", [], 0
        if out:
            yield pa.RecordBatch.from_arrays([pa.array([b"".join(out)], pa.binary())], names=["blob"])

    write_members(pages.select(key, url, html).mapInArrow(run, "blob binary"), path, maxRecordsPerFile="1")


def parse_http(content: bytes) -> tuple[dict[str, str], bytes, bytes]:
    """(lower-case headers, header block with its blank line, payload) of an HTTP response."""
    at = content.find(b"\r\n\r\n")
    if at < 0:
        return {}, b"", content
    lines = content[:at].decode("utf-8", "replace").split("\r\n")[1:]
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}, content[: at + 4], content[at + 4 :]


def record_id(*what: object) -> str:
    """A stable identifier: the name-based UUID of what is given."""
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.md5(repr(what).encode()).digest(), version=3)}>"


def parsed(content: bytes):
    """(number, record id, page id, fields, head, payload, digest) of each record of an ARC file after the version block, whose own comes first with number 0.

    head is None for a record without an HTTP response.  A record's identifier comes from its
    file's name, its place there and what it says, so no two share one.
    """
    name = ""
    for number, (fields, body) in enumerate(read_arc(content)):
        if not number:
            name = fields["URL"]
            yield 0, record_id(name, body), None, fields, None, body, hashlib.sha256(body).hexdigest()
            continue
        headers, head, payload = parse_http(body) if body.startswith(b"HTTP/") else ({}, None, body)
        page = headers.get("x-page-id", "-")
        digest = hashlib.sha256(payload).hexdigest()
        yield number, record_id(name, number, fields["URL"], fields["Archive-date"], digest), (None if page == "-" else int(page)), fields, head, payload, digest


_LIGHT = "file string, number int, record string, id long, url string, date string, http boolean, digest string, size long"


def read_arc_files(spark: SparkSession, path: str) -> DataFrame:
    """file, number, record (identifier), id, url, date, http, digest and size of every ARC record under ``path``."""

    def run(batches):
        for batch in batches:
            for file, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                rows = [(file, n, rid, page, f["URL"], f["Archive-date"], head is not None, digest, len(payload)) for n, rid, page, f, head, payload, digest in parsed(content.as_py()) if n]
                cols = list(zip(*rows, strict=True)) if rows else [()] * 9
                kinds = [pa.string(), pa.int32(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.bool_(), pa.string(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=[x.split()[0] for x in _LIGHT.split(", ")])

    return read_files(spark, path).mapInArrow(run, _LIGHT)


def revisits(light: DataFrame) -> DataFrame:
    """file, number, and the record, id, url and date that each repeated payload's record refers to.

    Payloads of very many copies are joined by broadcast where they are few enough, so their rows stay where they are.
    """
    large = light.where(F.col("http") & (F.col("size") >= LEAST_REVISIT)).select("file", "number", "id", "digest", "record", "url", "date")
    first = large.groupBy("digest").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "record", "url", "date")).alias("to"), F.count("*").alias("n"))
    first = written(first.where("n > 1 and to.id is not null"), "first-payloads")
    hot = first.where(F.col("n") >= HOT_COPIES)
    if hot.limit(HOT_PAYLOADS + 1).count() > HOT_PAYLOADS:
        joined = large.join(first, "digest")
    else:
        marked = large.join(F.broadcast(hot.select("digest", F.col("to").alias("hot"))), "digest", "left")
        joined = marked.where("hot is not null").select("file", "number", "id", F.col("hot").alias("to"))
        rest = marked.where("hot is null").join(first.where(F.col("n") < HOT_COPIES), "digest")
        joined = joined.unionByName(rest.select("file", "number", "id", "to"))
    return joined.where("id is null or id <> to.id").select("file", "number", "to.record", "to.id", "to.url", "to.date")


def _iso(date: str) -> str:
    """A fourteen-digit date as a timestamp; shorter ones are filled up with the earliest time."""
    return datetime.datetime.strptime((date + "00000101000000"[len(date) :])[:14], "%Y%m%d%H%M%S").strftime("%Y-%m-%dT%H:%M:%SZ")


def warc_record(kind: str, rid: str, date: str, block: bytes, content_type: str, more: list[str]) -> bytes:
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {rid}", f"WARC-Date: {_iso(date)}", *more]
    lines += [f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}", f"Content-Type: {content_type}", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(lines).encode() + block + b"\r\n\r\n"


def converted(content: bytes, to: dict[int, dict]):
    """The WARC records of an ARC file; to: what the revisits among them refer to, by number."""
    info = ""
    for number, rid, page, fields, head, payload, digest in parsed(content):
        date, url, address, code = fields["Archive-date"], fields["URL"], fields["IP-address"], fields.get("Result-code", "-")
        if not number:
            info = rid
            said = f"software: fieldweave\r\nformat: WARC File Format 1.1\r\ndescription: converted from {url}\r\n".encode()
            yield warc_record("warcinfo", rid, date, said, "application/warc-fields", [f"WARC-Filename: {url.removeprefix('filedesc://')}"])
            continue
        more = [f"WARC-Target-URI: {_safe_url(url, page)}", f"WARC-Warcinfo-ID: {info}", f"WARC-Payload-Digest: sha256:{digest}", f"X-Page-Id: {'-' if page is None else page}"]
        more += [f"WARC-IP-Address: {address}"] * (address not in ("-", "0.0.0.0")) + [f"X-Arc-Result-Code: {code}"] * (code != "-")
        if head is None:
            yield warc_record("resource", rid, date, payload, fields["Content-type"], more)
        elif number in to:
            r = to[number]
            more += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {r['record']}", f"WARC-Refers-To-Target-URI: {_safe_url(r['url'], r['id'])}", f"WARC-Refers-To-Date: {_iso(r['date'])}", f"X-Refers-To-Page: {r['id']}"]
            yield warc_record("revisit", rid, date, head, "application/http; msgtype=response", more)
        else:
            yield warc_record("response", rid, date, head + payload, "application/http; msgtype=response", more)


def convert(spark: SparkSession, arc: str, warc: str) -> None:
    """Turn the ARC files under one path into WARC files under another.

    Only digests and identifiers are grouped; the files themselves move as they are, packed.
    """
    light = written(read_arc_files(spark, arc), "arc-records")
    again = revisits(light)
    by_file = again.groupBy(F.col("file").alias("path")).agg(F.collect_list(F.struct("number", "record", "id", "url", "date")).alias("to"))
    joined = read_files(spark, arc).join(by_file, "path", "left").select("content", "to")

    def run(batches):
        out, size = [], 0
        for batch in batches:
            for content, to in zip(batch.column(0), batch.column(1), strict=True):
                for record in converted(content.as_py(), {r["number"]: r for r in to.as_py() or ()}):
                    out.append(member(record))
                    size += len(out[-1])
                    if size >= BLOB_BYTES:
                        yield pa.RecordBatch.from_arrays([pa.array([b"".join(out)], pa.binary())], names=["blob"])
                        out, size = [], 0
        if out:
            yield pa.RecordBatch.from_arrays([pa.array([b"".join(out)], pa.binary())], names=["blob"])

    write_members(joined.mapInArrow(run, "blob binary"), warc, maxRecordsPerFile=str(FILE_BLOBS))
    discard(light)


def read_warc(content: bytes):
    """(lower-case headers, block) of each record of a WARC file, by declared lengths."""
    stream = opened(content)
    while line := stream.readline():
        if not line.startswith(b"WARC/"):
            raise ValueError("no WARC record where one should start")
        headers = {}
        while (line := stream.readline()) not in (b"\r\n", b""):
            k, _, v = line.decode("utf-8").partition(":")
            headers[k.strip().lower()] = v.strip()
        block = stream.read(int(headers["content-length"]))
        if stream.read(4) != b"\r\n\r\n":
            raise ValueError("a record without its end")
        yield headers, block


_READ = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, record_id string, refers_to_id string, date string, url string"


def read_warc_files(spark: SparkSession, path: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, record_id, refers_to_id, date, url of every record but ``warcinfo``, digests verified."""

    def run(batches):
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string()]
        for batch in batches:
            for content in batch.column(1):
                rows = []
                for headers, block in read_warc(content.as_py()):
                    kind = headers["warc-type"]
                    if kind == "warcinfo":
                        continue
                    http, _, payload = parse_http(block) if kind != "resource" else ({}, b"", block)
                    digest = headers["warc-payload-digest"].removeprefix("sha256:")
                    if kind != "revisit" and hashlib.sha256(payload).hexdigest() != digest:
                        raise ValueError("a payload that doesn't match its digest")
                    to = headers.get("x-refers-to-page")
                    rows.append((None if headers["x-page-id"] == "-" else int(headers["x-page-id"]), int(http["content-length"]) if kind == "revisit" else len(payload), digest, kind, None if to is None else int(to), headers["warc-record-id"], headers.get("warc-refers-to"), headers["warc-date"], headers["warc-target-uri"]))
                cols = list(zip(*rows, strict=True)) if rows else [()] * len(kinds)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=[x.split()[0] for x in _READ.split(", ")])

    return read_files(spark, path).mapInArrow(run, _READ)


def archive_round_trip(pages: DataFrame, *, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Pages to ARC files, to WARC files, and back."""
    spark = pages.sparkSession
    arc, warc = fresh_path(spark, "arc"), fresh_path(spark, "warc")
    write_arc(pages, arc, key=key, url=url, html=html)
    convert(spark, arc, warc)
    discard(arc)
    return read_warc_files(spark, warc)
