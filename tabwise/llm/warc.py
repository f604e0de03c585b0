"""WARC archives: written with an index first, read back by coalesced byte ranges (operator 10).

Writing: each task streams its pages into archive files of the shared folder, one gzip member a
record, and returns the index rows (file, offset, length, URL, digest, record type) of exactly the
files it wrote. File names are unique to the task attempt, so a retried or speculative task cannot
disturb the files that the committed index names. Reading: index rows are sorted by file and
offset, neighbouring ranges are merged into one read, and every record is parsed and checked.

Records with equal payloads are found by digest and length on narrow rows; the page with the
largest id carries the payload (response), the others refer to it (revisit). A payload shorter
than ``revisit_from`` bytes is always a response.

Defined cases: null html is an empty payload; a null URL is written as ``urn:page:<id>`` (its index
entry stays null); characters that a header cannot hold are percent-encoded in the archive; a null
page id sorts below all others; rows that repeat the largest page id of a group are all responses; an
empty table gives no archive and an empty result; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabwise.llm.common import make_folder, open_to_read, open_to_write, shared_folder, written

INDEX = ("page_id long, url string, file string, offset long, length long, payload_digest string, "
         "record_type string, refers_to long")
READ = ("page_id long, url string, payload_bytes long, payload_digest string, record_type string, "
        "refers_to long, payload binary")
_DATE = "2000-01-01T00:00:00Z"  # records carry no fetch time; a fixed date keeps archives reproducible
_PRINTABLE = "".join(map(chr, range(0x21, 0x7F)))


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _record_id(page_id, n: int) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}:{n}')}>"


def make_record(page_id, url, payload: bytes, refers_to, digest: str) -> bytes:
    """One uncompressed WARC/1.1 record."""
    uri = quote(url, safe=_PRINTABLE) if url else f"urn:page:{page_id}"
    revisit = refers_to is not None
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}",
            f"WARC-Record-ID: {_record_id(page_id, len(payload))}", f"WARC-Date: {_DATE}", f"WARC-Target-URI: {uri}",
            "Content-Type: application/http; msgtype=response", f"WARC-Payload-Digest: sha1:{digest}",
            f"Content-Length: {len(block)}"]
    if page_id is not None:
        head.append(f"X-Page-ID: {page_id}")
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
                 f"WARC-Refers-To: {_record_id(refers_to, len(payload))}", f"X-Refers-To-Page-ID: {refers_to}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(raw: bytes) -> tuple:
    """``(page_id, uri, payload_bytes, digest, record_type, refers_to, payload)`` of one record; checks what it reads."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("no WARC record at this offset")
    field = dict(x.split(": ", 1) for x in lines[1:])
    block = rest[:int(field["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(dict(x.split(": ", 1) for x in http.decode().split("\r\n")[1:])["Content-Length"])
    digest, kind = field["WARC-Payload-Digest"].removeprefix("sha1:"), field["WARC-Type"]
    if kind == "response" and (len(payload) != size or base32_sha1(payload) != digest):
        raise ValueError("payload does not match its digest")
    page, refers = field.get("X-Page-ID"), field.get("X-Refers-To-Page-ID")
    return (None if page is None else int(page), field["WARC-Target-URI"], size, digest, kind,
            None if refers is None else int(refers), payload if kind == "response" else None)


def _gzip(data: bytes, level: int) -> bytes:
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def _writer(folder: str, roll_bytes: int, level: int):
    def write(batches):
        out, name, at = None, None, 0
        try:
            for b in batches:
                rows = []
                for page, url, html, refers in zip(*(b.column(c) for c in ("page_id", "url", "html", "refers_to"))):
                    page, url, refers = page.as_py(), url.as_py(), refers.as_py()
                    payload = html.as_buffer().to_pybytes() if html.is_valid else b""
                    if out is None or at >= roll_bytes:
                        if out is not None:
                            out.close()
                        name = f"{folder}/{uuid.uuid4().hex}.warc.gz"
                        out, at = open_to_write(name), 0
                        info = b"software: tabwise\r\nformat: WARC File Format 1.1\r\n"
                        first = _gzip(b"\r\n".join([
                            b"WARC/1.1", b"WARC-Type: warcinfo", f"WARC-Record-ID: <urn:uuid:{uuid.uuid4()}>".encode(),
                            f"WARC-Date: {_DATE}".encode(), b"Content-Type: application/warc-fields",
                            f"Content-Length: {len(info)}".encode()]) + b"\r\n\r\n" + info + b"\r\n\r\n", level)
                        out.write(first)
                        at = len(first)
                    digest = base32_sha1(payload)
                    data = _gzip(make_record(page, url, payload, refers, digest), level)
                    out.write(data)
                    rows.append((page, url, name, at, len(data), digest, "response" if refers is None else "revisit", refers))
                    at += len(data)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x, t) for x, t in zip(zip(*rows) if rows else [[]] * 8, (
                        pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()))],
                    ["page_id", "url", "file", "offset", "length", "payload_digest", "record_type", "refers_to"])
        finally:
            if out is not None:
                out.close()

    return write


def write_archives(pages: DataFrame, revisit_from: int = 0, roll_bytes: int = 1 << 30, level: int = 1) -> DataFrame:
    """Write ``pages`` (page_id, url, html) as WARC files of the shared folder; returns the index as a written table."""
    spark = pages.sparkSession
    folder = shared_folder(spark, "warc")
    make_folder(folder)
    narrow = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.col("html"),
                          F.sha1(F.coalesce("html", F.lit("")).cast("binary")).alias("digest"),
                          F.coalesce(F.octet_length("html"), F.lit(0)).alias("size"))
    # a table of its own, so that the join below shuffles both sides anew and AQE can split a frequent payload
    groups = written(narrow.where(F.col("size") >= revisit_from).groupBy("digest", "size")
                     .agg(F.max("page_id").alias("holder"), F.count("*").alias("n")).where("n > 1").drop("n"), "payloads")
    refers = F.when(F.col("page_id").eqNullSafe(F.col("holder")), F.lit(None)).otherwise(F.col("holder"))
    rows = (narrow.join(groups, ["digest", "size"], "left")
            .select("page_id", "url", "html", refers.cast("long").alias("refers_to")))
    return written(rows.mapInArrow(_writer(folder, roll_bytes, level), INDEX), "warc-index")


def _reader(gap: int, most: int, payloads: bool):
    def flush(run):
        start, end = run[0][1], run[-1][1] + run[-1][2]
        with open_to_read(run[0][0]) as f:
            f.seek(start)
            data = f.read(end - start)
        rows = []
        for _, offset, length, page, url, digest, kind in run:
            raw = zlib.decompress(data[offset - start:offset - start + length], 31)
            got = parse_record(raw)
            if (got[0], got[3], got[4]) != (page, digest, kind):
                raise ValueError(f"index and archive disagree about page {page}")
            rows.append((got[0], url, *got[2:6], got[6] if payloads else None))
        return pa.RecordBatch.from_arrays(
            [pa.array(x, t) for x, t in zip(zip(*rows), (
                pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()))],
            ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"])

    def read(batches):
        run = []
        for b in batches:
            for file, offset, length, *rest in zip(*(b.column(c).to_pylist() for c in (
                    "file", "offset", "length", "page_id", "url", "payload_digest", "record_type"))):
                if run and (file != run[0][0] or offset - run[-1][1] - run[-1][2] > gap
                            or offset + length - run[0][1] > most):
                    yield flush(run)
                    run = []
                run.append((file, offset, length, *rest))
        if run:
            yield flush(run)

    return read


def read_records(selected: DataFrame, gap: int = 64 << 10, most: int = 4 << 20, payloads: bool = True) -> DataFrame:
    """Read the records that the index rows ``selected`` name; ranges at most ``gap`` bytes apart are one read.

    A merged read is at most ``most`` bytes (a longer single record is read alone). A revisit has no
    payload of its own: its payload column is null, its size and digest are those of the full payload.
    """
    ordered = selected.repartitionByRange("file", "offset").sortWithinPartitions("file", "offset")
    return ordered.mapInArrow(_reader(gap, most, payloads), READ)
