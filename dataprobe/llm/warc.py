"""WARC archives: write pages as records, read them back, reassemble segments, undo chunked framing.

Writing.  A page's payload is its html in UTF-8, kept in a ``response`` record as an HTTP message in chunked
transfer coding.  Of pages with equal payloads the one with the largest id is the response, the others are
``revisit`` records that refer to it.  A message longer than ``SEGMENT`` bytes is cut into one response and
``continuation`` records (WARC-Segment-Number, WARC-Segment-Origin-ID; the last carries the total length).
Archives are plain ``.warc`` files below the given path, written by Spark's own committer, so a lost task leaves
no half-written archive.

Reading.  Archives are parsed one file at a time.  Messages of one record are finished where they are read; only
segments are shuffled, by origin, put in order, and checked against the total length.  Digests are recomputed from
the decoded payload and must equal the recorded ones.

A null url or html is written as an empty one.  A null page id is always a response of its own, without an id on
return.  Repeated rows are records of their own; rows that share the largest id are all responses.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dataprobe.session import written

SEGMENT = 1 << 16
CHUNK = 1 << 13
RECORDS_PER_FILE = 256
_END = b"\r\n\r\n"


def digest32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def chunked(payload: bytes, size: int = CHUNK) -> bytes:
    """Chunked transfer coding."""
    out = [b"%x\r\n%b\r\n" % (len(part), part) for part in (payload[i : i + size] for i in range(0, len(payload), size))]
    return b"".join(out) + b"0\r\n\r\n"


def dechunked(body: bytes) -> bytes:
    """The payload of a body in chunked transfer coding; extensions and trailers are read over."""
    out, at = [], 0
    while True:
        line = body.index(b"\r\n", at)
        size = int(body[at:line].split(b";")[0], 16)
        if size == 0:
            return b"".join(out)
        out.append(body[line + 2 : line + 2 + size])
        if len(out[-1]) != size or body[line + 2 + size : line + 4 + size] != b"\r\n":
            raise ValueError("a chunk is cut short")
        at = line + 4 + size


def _record(fields: list[tuple[str, str]], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in [*fields, ("Content-Length", str(len(block)))])
    return b"WARC/1.1\r\n" + head.encode() + b"\r\n" + block


def records(page_id: int | None, url: str | None, payload: bytes, refers: int | None, name: str, segment: int = SEGMENT) -> Iterator[bytes]:
    """The records of one page, without the two line ends that close a record."""
    said = [("WARC-Date", "1970-01-01T00:00:00Z"), ("WARC-Payload-Digest", f"sha1:{digest32(payload)}")]
    said += [("WARC-Target-URI", " ".join((url or "").split()))] + ([] if page_id is None else [("X-Page-ID", str(page_id))])
    if refers is not None:
        more = [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("X-Refers-To-Page-ID", str(refers)), ("X-Payload-Length", str(len(payload)))]
        yield _record([("WARC-Type", "revisit"), ("WARC-Record-ID", f"<urn:page:{name}>"), *said, *more], b"")
        return
    message = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n" + chunked(payload)
    parts = [message[i : i + segment] for i in range(0, len(message), segment)]
    for number, part in enumerate(parts, 1):
        if number == 1:
            first = [("WARC-Type", "response"), ("WARC-Record-ID", f"<urn:page:{name}>"), ("Content-Type", "application/http;msgtype=response"), *said]
            yield _record(first + ([("WARC-Segment-Number", "1")] if len(parts) > 1 else []), part)
        else:
            last = [("WARC-Segment-Total-Length", str(len(message)))] if number == len(parts) else []
            own = [("WARC-Type", "continuation"), ("WARC-Record-ID", f"<urn:page:{name}:{number}>"), ("WARC-Segment-Origin-ID", f"<urn:page:{name}>")]
            yield _record([*own, ("WARC-Segment-Number", str(number)), *last], part)


def write_archives(pages: DataFrame, path: str, min_bytes: int = 0, segment: int = SEGMENT, records_per_file: int = RECORDS_PER_FILE) -> None:
    """Writes ``pages(page_id, url, html)`` below ``path``; payloads under ``min_bytes`` are never revisits.

    The largest id of each payload comes from (digest, id) alone; the html stays where it is read until it is
    joined with one id, and that join may be split where a payload is common.
    """
    own = pages.select("page_id", "url", F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("payload"))
    keyed = own.withColumn("key", F.sha2("payload", 256))
    last = keyed.filter(F.octet_length("payload") >= min_bytes).groupBy("key").agg(F.max("page_id").alias("last"), F.count(F.lit(1)).alias("copies"))
    # only payloads that occur more than once are looked up; as a stored table their size is known, and pages are
    # not shuffled where that is small
    again = written(last.filter("copies > 1").drop("copies"), "copies")
    held = keyed.join(again, "key", "left")
    shaped = held.select("page_id", "url", "payload", F.when(F.col("page_id") < F.col("last"), F.col("last")).alias("refers"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, seen = TaskContext.get().partitionId(), 0
        for batch in batches:
            out = []
            for i in range(batch.num_rows):
                page_id, url, payload, refers = (batch.column(c)[i].as_py() for c in range(4))
                out += records(page_id, url, payload, refers, f"{task}-{seen}", segment)
                seen += 1
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["record"])

    made = shaped.mapInArrow(run, "record binary")
    # a record ends with two line ends, which is the writer's line separator; text keeps the bytes as they are
    writer = made.select(F.col("record").cast("string").alias("value")).write.option("lineSep", _END.decode())
    writer.option("maxRecordsPerFile", records_per_file).text(path)


def parse(archive: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields in lower case, block) of every record of an archive."""
    at = 0
    while at < len(archive):
        head = archive.index(_END, at)
        lines = archive[at:head].decode().split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no record at byte {at}")
        fields = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:])}
        size = int(fields["content-length"])
        block = archive[head + 4 : head + 4 + size]
        if len(block) != size or archive[head + 4 + size : head + 8 + size] != _END:
            raise ValueError(f"the record at byte {at} is cut short")
        yield fields, block
        at = head + 8 + size


def payload_of(message: bytes) -> bytes:
    head, _, body = message.partition(_END)
    coded = any(x.lower().replace(b" ", b"") == b"transfer-encoding:chunked" for x in head.split(b"\r\n"))
    return dechunked(body) if coded else body


_PAGE = "page_id bigint, url string, payload binary, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint"
_NAMES = ["page_id", "url", "payload", "payload_bytes", "payload_digest", "record_type", "refers_to"]
_TYPES = [pa.int64(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.string(), pa.int64()]


def _number(fields: dict[str, str], key: str) -> int | None:
    return int(fields[key]) if key in fields else None


def _page(fields: dict[str, str], message: bytes | None) -> tuple:
    said = fields["warc-payload-digest"].removeprefix("sha1:")
    if fields["warc-type"] == "revisit":
        return _number(fields, "x-page-id"), fields.get("warc-target-uri"), None, _number(fields, "x-payload-length"), said, "revisit", _number(fields, "x-refers-to-page-id")
    payload = payload_of(message)
    if digest32(payload) != said:
        raise ValueError(f"the payload of {fields['warc-record-id']} is damaged")
    return _number(fields, "x-page-id"), fields.get("warc-target-uri"), payload, len(payload), said, "response", None


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """(page_id, url, payload, payload_bytes, payload_digest, record_type, refers_to): one row per page.

    ``payload`` is null for revisits.  A missing, repeated or damaged segment is an error, not a shorter page.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                whole, parts = [], []
                for fields, block in parse(batch.column(0)[i].as_py()):
                    if "warc-segment-number" not in fields:
                        whole.append((*_page(fields, block), None, None, None))
                        continue
                    origin = fields.get("warc-segment-origin-id", fields["warc-record-id"])
                    head = "\r\n".join(f"{k}: {v}" for k, v in fields.items())
                    parts.append((None, None, block, None, head, None, None, origin, int(fields["warc-segment-number"]), _number(fields, "warc-segment-total-length")))
                rows = whole + parts
                kinds = _TYPES + [pa.string(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=_NAMES + ["origin", "number", "total"])

    parsed = files.mapInArrow(run, _PAGE + ", origin string, number bigint, total bigint")

    def joined(key: tuple, segments: pa.Table) -> pa.Table:
        rows = sorted(segments.select(["number", "total", "payload", "payload_digest"]).to_pylist(), key=lambda r: r["number"])
        message = b"".join(r["payload"] for r in rows)
        if [r["number"] for r in rows] != list(range(1, len(rows) + 1)) or rows[-1]["total"] != len(message):
            raise ValueError(f"segments of {key[0].as_py()} do not add up")
        fields = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in rows[0]["payload_digest"].split("\r\n"))
        return pa.Table.from_arrays([pa.array([v], t) for v, t in zip(_page(fields, message), _TYPES, strict=True)], names=_NAMES)

    alone = parsed.filter("origin is null").select(*_NAMES)
    return alone.unionByName(parsed.filter("origin is not null").groupBy("origin").applyInArrow(joined, _PAGE))
