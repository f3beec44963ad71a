"""WARC archives: written from pages, and read back by a reader that salvages what damage leaves.

Pages whose payload an earlier page has become revisit records, which refer to that page's response. Each
task writes archives of gzip members, one a record, under names of its own and tells them only when they
are closed; the list of what was told is written down before anything is read, so an archive of a task
that was lost or ran twice is never read.

The reader takes a member or a plain record at its place and holds it against every check: the member's
checksum, the version line, the headers that must be there, the length and the end of the record, the
digests of block and payload. Where a check fails it goes on from the next place that has a gzip signature
or a version line and passes all checks, and reports the bytes between as a gap with the reason. So damage
costs the records that it touches and no others.

Defined results
---------------
* A null page text counts as empty. Of equal payloads the row with the smallest identifier is the
  response, null ranking last; of rows that repeat that identifier exactly one, the others revisit it.
* ``least_bytes``: smaller payloads are responses, whatever they equal.
* An identifier or address that is null has no header and comes back as null. Control characters of an
  address are percent-encoded.
* Texts of any length are one record, held whole by the task that writes or reads it. An empty table
  gives no archives and no rows. Other columns play no part.
* A record that embeds a whole valid record and is damaged itself can give the embedded one.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Callable, Iterator
from typing import NamedTuple

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from segno.shipping import ship_package

from .common import BROADCAST_ROWS, join_counted, shared_folder, written

VERSION = b"WARC/1.1\r\n"
END = b"\r\n\r\n"
GZIP = b"\x1f\x8b\x08"
#: A record's headers end within so many bytes, or it is no record.
HEADER_BYTES = 1 << 20
#: Bytes that are read at once.
CHUNK = 1 << 20
#: Bytes after which a task begins another archive.
ARCHIVE_BYTES = 1 << 30
#: Date of all records, unless another is given.
DATE = "2000-01-01T00:00:00Z"
NEEDED = ("warc-type", "warc-record-id", "warc-date", "content-length")
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


# --- records ------------------------------------------------------------------------------------


def record_id(page_id: int | None, row: int) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, f'{page_id}/{row}')}>"


def record(kind: str, row: int, page_id: int | None, url: str | None, payload: bytes | None, size: int, digest: str, refers: tuple[int | None, int] | None, date: str = DATE) -> bytes:
    """A response with its payload, or a revisit with the headers alone that refers to (page_id, row)."""
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % size + (payload or b"")
    head = [("WARC-Type", kind), ("WARC-Record-ID", record_id(page_id, row)), ("WARC-Date", date)]
    if page_id is not None:
        head.append(("WARC-Page-ID", str(page_id)))
    if url is not None:
        head.append(("WARC-Target-URI", re.sub(r"[\x00-\x20\x7f]", lambda c: f"%{ord(c[0]):02X}", url)))
    if refers is not None:
        head += [("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(*refers))]
        if refers[0] is not None:
            head.append(("WARC-Refers-To-Page-ID", str(refers[0])))
    head += [("WARC-Payload-Digest", f"sha1:{digest}"), ("WARC-Block-Digest", f"sha1:{base32_sha1(block)}"), ("Content-Type", "application/http;msgtype=response"), ("Content-Length", str(len(block)))]
    return VERSION + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + block + END


def member(data: bytes, level: int = 6) -> bytes:
    """One gzip member, the same for the same bytes."""
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


# --- salvage ------------------------------------------------------------------------------------


class Found(NamedTuple):
    """A record (``reason`` is None) or a quarantined gap at [offset, offset + length) of an archive."""

    offset: int
    length: int
    reason: str | None
    headers: dict[str, str] | None = None
    block: bytes | None = None


class Fault(Exception):
    """A check that failed."""


Read = Callable[[int, int], bytes]


def _plain(read: Read, at: int) -> tuple[dict[str, str], bytes, int]:
    """Headers, block and end of the record at a place; Fault if a check fails."""
    head, end = b"", -1
    while end < 0:
        more = read(at + len(head), min(4096 + len(head), HEADER_BYTES))
        if not more or len(head) > HEADER_BYTES:
            raise Fault("headers do not end")
        found = len(head)
        head += more
        if not re.match(rb"WARC/\d+\.\d+\r\n", head):
            raise Fault("no version line")
        end = head.find(END, max(0, found - 3))
    lines = head[:end].split(b"\r\n")[1:]
    headers: dict[str, str] = {}
    for line in lines:
        name, colon, value = line.partition(b":")
        if not colon or not name.strip():
            raise Fault("a header without a name")
        headers[name.strip().decode("latin-1").lower()] = value.strip().decode("utf-8", "replace")
    if missing := [n for n in NEEDED if n not in headers]:
        raise Fault(f"no {missing[0]}")
    if not re.fullmatch(r"\d{1,18}", headers["content-length"]):
        raise Fault("the length is no number")
    start, size = at + end + len(END), int(headers["content-length"])
    if read(start + size, len(END)) != END:  # before the block is read: a wrong length may be huge
        raise Fault("the record does not end where its length says")
    block = read(start, size)
    _check_digests(headers, block)
    return headers, block, start + size + len(END)


def payload_of(headers: dict[str, str], block: bytes) -> bytes:
    """What follows the HTTP headers of a response; the whole block of anything else."""
    if not headers.get("content-type", "").startswith("application/http"):
        return block
    return block.partition(END)[2]


def _check_digests(headers: dict[str, str], block: bytes) -> None:
    own = [("warc-block-digest", block)]
    if headers["warc-type"] != "revisit":  # a revisit's digest is that of the payload that it leaves out
        own.append(("warc-payload-digest", payload_of(headers, block)))
    for name, data in own:
        kind, _, digest = headers.get(name, "").partition(":")
        if kind == "sha1" and digest != base32_sha1(data):
            raise Fault(f"{name} differs")


def _member(read: Read, at: int) -> tuple[bytes, int]:
    """The bytes of the gzip member at a place, and its end."""
    z, out, place = zlib.decompressobj(31), [], at
    try:
        while not z.eof:
            more = read(place, CHUNK)
            if not more:
                raise Fault("the member is cut off")
            place += len(more)
            out.append(z.decompress(more))
    except zlib.error as error:
        raise Fault(f"the member is damaged: {error}") from None
    return b"".join(out), place - len(z.unused_data)


def _at(read: Read, at: int) -> tuple[list[tuple[dict[str, str], bytes]], int]:
    """The records of the member or plain record at a place, and its end."""
    if read(at, len(GZIP)) != GZIP:
        headers, block, end = _plain(read, at)
        return [(headers, block)], end
    data, end = _member(read, at)
    held, place = [], 0
    while place < len(data) or not held:
        headers, block, place = _plain(lambda a, n: data[a : a + n], place)
        held.append((headers, block))
    return held, end


def _next_place(read: Read, at: int, size: int) -> int:
    """The next gzip signature or version line from a place on, or the end."""
    while at < size:
        held = read(at, CHUNK)
        if found := re.search(rb"\x1f\x8b\x08|WARC/\d", held):
            return at + found.start()
        if at + len(held) >= size:
            break
        at += max(1, len(held) - 8)  # what stands across two chunks is seen by the second
    return size


def salvage(read: Read, size: int) -> Iterator[Found]:
    """All valid records of an archive and the gaps between them, in order; ``read(at, n)`` gives its bytes."""
    at, gap, reason = 0, -1, ""
    while at < size:
        try:
            held, end = _at(read, at)
        except Fault as fault:
            if gap < 0:
                gap, reason = at, str(fault)
            at = _next_place(read, at + 1, size)
            continue
        if gap >= 0:
            yield Found(gap, at - gap, reason)
            gap = -1
        for headers, block in held:
            yield Found(at, end - at, None, headers, block)
        at = end
    if gap >= 0:
        yield Found(gap, size - gap, reason)


# --- archives as tables -------------------------------------------------------------------------


def _chosen(staged: DataFrame, least_bytes: int) -> DataFrame:
    """(row, to_page, to_row) of the rows that revisit another."""
    keys = staged.select("row", "page_id", "sha1", "sha256", "size").where(F.col("size") >= least_bytes)
    first = F.min(F.struct(F.col("page_id").isNull().alias("last"), F.col("page_id"), F.col("row"))).alias("first")
    groups = keys.groupBy("sha1", "sha256", "size").agg(first, F.count(F.lit(1)).alias("n")).where("n > 1")
    groups = groups.select("sha1", "sha256", "size", F.col("first.page_id").alias("to_page"), F.col("first.row").alias("to_row"), "n")
    met = join_counted(keys.drop("page_id"), groups, ["sha1", "sha256", "size"], staged.count())
    return met.where("row <> to_row").select("row", "to_page", "to_row")


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least_bytes: int = 0, date: str = DATE, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write a record per page; (path, records, bytes) of the archives that count.

    ``folder`` is one that all executors share. Rows are numbered and written once beforehand, as which of
    the equal ones is the response must not change when a task runs again.
    """
    spark = pages.sparkSession
    ship_package(spark)
    html = F.coalesce(pages[html_col].cast("string"), F.lit(""))
    staged = pages.select(
        F.monotonically_increasing_id().alias("row"), pages[id_col].cast("long").alias("page_id"), pages[url_col].cast("string").alias("url"),
        html.alias("html"), F.unhex(F.sha1(html)).alias("sha1"), F.sha2(html, 256).alias("sha256"), F.octet_length(html).cast("long").alias("size"),
    )
    staged = written(staged)
    revisits = written(_chosen(staged, least_bytes))
    revisits = F.broadcast(revisits) if revisits.count() <= BROADCAST_ROWS else revisits
    rows = staged.drop("sha256").join(revisits, "row", "left")
    rows = rows.withColumn("html", F.when(F.col("to_row").isNull(), F.col("html").cast("binary")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        made, out, path, count, size = [], None, "", 0, 0
        for batch in batches:
            for r in batch.to_pylist():
                if out is None:
                    path, count, size = f"pages-{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = store.open_output_stream(f"{root}/{path}", compression=None)
                kind, refers = ("response", None) if r["to_row"] is None else ("revisit", (r["to_page"], r["to_row"]))
                data = member(record(kind, r["row"], r["page_id"], r["url"], r["html"], r["size"], base64.b32encode(r["sha1"]).decode(), refers, date))
                out.write(data)
                count, size = count + 1, size + len(data)
                if size >= archive_bytes:
                    out.close()
                    made.append((f"{folder}/{path}", count, size))
                    out = None
        if out is not None:
            out.close()
            made.append((f"{folder}/{path}", count, size))
        yield pa.RecordBatch.from_arrays([pa.array([m[k] for m in made], kind) for k, kind in enumerate((pa.string(), pa.int64(), pa.int64()))], ["path", "records", "bytes"])

    return written(rows.mapInArrow(run, "path string, records long, bytes long"))


FOUND = "path string, offset long, length long, reason string, type string, record_id string, page_id long, uri string, refers_to long, payload_bytes long, payload_digest string, payload binary"


def read_archives(archives: DataFrame, payloads: bool = True) -> DataFrame:
    """Records and gaps of the archives at ``path``, gaps with a ``reason`` and their bytes' place.

    Digest and size are those of the payload that was read; a revisit has those that it states.
    ``payloads=False`` leaves the payload itself out.
    """
    ship_package(archives.sparkSession)
    names = [f.split()[0] for f in FOUND.split(", ")]

    def number(text: str | None) -> int | None:
        return int(text) if text and re.fullmatch(r"-?\d{1,19}", text) else None

    def row(path: str, x: Found) -> tuple:
        if x.reason is not None:
            return (path, x.offset, x.length, x.reason, *[None] * 8)
        h = x.headers
        if h["warc-type"] == "revisit":
            stated = re.search(rb"(?im)^content-length:\s*(\d{1,18})\s*$", x.block)
            body, size, digest = None, int(stated[1]) if stated else None, h.get("warc-payload-digest", "").partition(":")[2] or None
        else:
            body = payload_of(h, x.block)
            size, digest = len(body), base32_sha1(body)
        return (path, x.offset, x.length, None, h["warc-type"], h["warc-record-id"], number(h.get("warc-page-id")), h.get("warc-target-uri"), number(h.get("warc-refers-to-page-id")), size, digest, body if payloads else None)

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kinds[f.split()[1]]) for k, f in enumerate(FOUND.split(", "))], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in batches:
            for path in held.column("path").to_pylist():
                store, name = fs.FileSystem.from_uri(path)
                with store.open_input_file(name) as f:
                    rows, size = [], 0
                    for x in salvage(lambda at, n: f.read_at(n, at), f.size()):
                        rows.append(row(path, x))
                        size += len(x.block or b"") if payloads else 1 << 10
                        if size >= 8 << 20:
                            yield batch(rows)
                            rows, size = [], 0
                    if rows:
                        yield batch(rows)

    # An archive is a task's work of some size: each gets a partition of its own as far as the table goes.
    return archives.select("path").repartition(max(1, min(10_000, archives.count())), "path").mapInArrow(run, FOUND)


def records(found: DataFrame) -> DataFrame:
    return found.where("reason is null").drop("reason")


def gaps(found: DataFrame) -> DataFrame:
    """The quarantined byte ranges: where, how many, and the check that failed first."""
    return found.where("reason is not null").select("path", "offset", "length", "reason")


def archive_folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark).rstrip('/')}/warc-{uuid.uuid4().hex}"


def archive_digest(pages: DataFrame) -> DataFrame:
    """Pages as the archives give them back."""
    archives = write_archives(pages, archive_folder(pages.sparkSession))
    found = records(read_archives(archives, payloads=False))
    return found.select("page_id", "payload_bytes", "payload_digest", F.col("type").alias("record_type"), "refers_to")


_FIVE = " || ".join(f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (x >> {s} & 31)::INTEGER + 1, 1)" for s in (15, 10, 5, 0))

SQL = f"""
SELECT page_id, strlen(html)::BIGINT AS payload_bytes,
       array_to_string(list_transform(list_transform(range(8), lambda k: ('0x' || substr(sha1(html), 5 * k + 1, 5))::BIGINT), lambda x: {_FIVE}), '') AS payload_digest,
       CASE WHEN nth = 1 THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN nth > 1 THEN least END AS refers_to
FROM (SELECT page_id, html, row_number() OVER (PARTITION BY html ORDER BY page_id) AS nth, min(page_id) OVER (PARTITION BY html) AS least
      FROM (SELECT page_id, coalesce(html, '') AS html FROM pages))
"""
