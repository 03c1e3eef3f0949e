"""WARC archives as a chunked record table.

An archive is a table of rows (archive, record_no, chunk_no, last, data,
running_sha1). The first row of a record is its WARC header, the HTTP header
of its block and the first ``chunk_bytes`` of its payload; further rows are
further pieces of the payload, and the last one ends with the record's closing
line breaks. Concatenating ``data`` in (record_no, chunk_no) order gives the
bytes of a WARC 1.1 file. The JVM cuts payloads into chunk rows, so neither
Python nor an Arrow batch ever holds a whole record, and each chunk carries
the digest of the payload up to its end, so a reader checks a record as it
streams and can tell where one was damaged. Records of one chunk are written
and read where they are; only those of several chunks are exchanged, by
record, to be read in order.

Of records with equal payloads of at least ``min_revisit_bytes`` bytes, that
with the smallest id is a response; the others are revisits, which have the
payload's digest and length but no payload. Only digests are grouped, by a
partial aggregate; groups that need a revisit are counted and broadcast up to
``BROADCAST_GROUPS``, so payloads are not moved to be typed.

Defined cases: null and empty pages have an empty payload; a record without
an id is a response only if no equal payload has an id; rows that repeat the
smallest id of a payload are all responses (a revisit never refers to its own
id); ids are percent-encoded in record ids, so any text comes back as it was;
a url's spaces, control and non-ASCII characters are percent-encoded in
WARC-Target-URI and the url itself is kept beside it; a null url is written as
the record's id; other columns are not read; an empty table gives an empty
archive.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from datetime import datetime, timezone
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.llm.common import new_path

CHUNKS = "archive int, record_no long, chunk_no int, last boolean, data binary, running_sha1 binary"
#: Groups of equal payloads are broadcast only if they are no more than this (some 100 bytes each).
BROADCAST_GROUPS = 200_000
END = b"\r\n\r\n"
_UNSAFE = re.compile(r"[^!#-;=?-Z\[\]_a-z~]")
_KINDS = (pa.int32(), pa.int64(), pa.int32(), pa.bool_(), pa.binary(), pa.binary())
_READ = {
    "archive": pa.int32(), "record_no": pa.int64(), "page_id": pa.string(), "url": pa.string(), "record_type": pa.string(), "refers_to": pa.string(),
    "payload_bytes": pa.int64(), "payload_digest": pa.string(), "intact": pa.bool_(),
}
RECORDS = "archive int, record_no long, page_id string, url string, record_type string, refers_to string, payload_bytes long, payload_digest string, intact boolean"


def _base32(digest: bytes) -> str:
    return base64.b32encode(digest).decode("ascii")


def plan_records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_revisit_bytes: int = 0) -> DataFrame:
    """``page_id, url, payload, sha1, record_type, refers_to`` for each page."""
    payload = F.encode(F.coalesce(F.col(html_col).cast("string"), F.lit("")), "UTF-8")
    records = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload")).withColumn("sha1", F.sha1("payload"))
    size = F.octet_length("payload")
    groups = (
        records.where(size >= min_revisit_bytes)
        .groupBy("sha1", size.alias("size"))
        .agg(F.min("page_id").alias("first_id"), ((F.min("page_id") < F.max("page_id")) | (F.count("page_id") < F.count("*"))).alias("others"))
        .where("others AND first_id IS NOT NULL")
        .select("sha1", "size", "first_id")
    )
    path = new_path(pages.sparkSession, "repeated")  # counted, then joined: made once
    groups.write.parquet(path)
    groups = pages.sparkSession.read.schema(groups.schema).parquet(path)
    few = groups.count() <= BROADCAST_GROUPS
    joined = records.withColumn("size", size).join(F.broadcast(groups) if few else groups, ["sha1", "size"], "left")
    revisit = F.col("first_id").isNotNull() & ~F.col("first_id").eqNullSafe(F.col("page_id"))
    return joined.select("page_id", "url", "payload", "sha1", F.when(revisit, "revisit").otherwise("response").alias("record_type"), F.when(revisit, F.col("first_id")).alias("refers_to"))


def _header(name: str, url: str | None, kind: str, refers_to: str | None, date: str, http: bytes, payload_bytes: int, sha1: str) -> bytes:
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{name}>", f"WARC-Date: {date}", f"WARC-Target-URI: {name if url is None else _uri(url)}"]
    if url is not None and _uri(url) != url:
        lines.append(f"X-Page-URL: {quote(url, safe='')}")
    if url is None:
        lines.append("X-Page-URL-Missing: true")
    if kind == "revisit":
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{quote(refers_to, safe='')}>"]
    lines += [
        f"WARC-Payload-Digest: sha1:{_base32(bytes.fromhex(sha1))}",
        "Content-Type: application/http;msgtype=response",
        f"Content-Length: {len(http) + (0 if kind == 'revisit' else payload_bytes)}",
    ]
    return "\r\n".join(lines).encode("ascii") + END


def _uri(url: str) -> str:
    """``url`` with what may not stand in a URI percent-encoded; escapes that it has stay."""
    return _UNSAFE.sub(lambda m: quote(m[0], safe="%"), url)


def chunk_rows(records: DataFrame, chunk_bytes: int = 1 << 20, date: str | None = None) -> DataFrame:
    """The chunked record table of planned records. ``date``: WARC-Date of all (default: now)."""
    date = date or datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
    size = F.octet_length("payload")
    kept = F.when(F.col("record_type") == "revisit", F.lit(0)).otherwise(size)
    last = F.greatest(F.ceil(kept / chunk_bytes).cast("int") - 1, F.lit(0))
    pieces = records.select(
        F.col("page_id").cast("string").alias("page_id"), "url", "record_type", F.col("refers_to").cast("string").alias("refers_to"), "sha1", size.cast("long").alias("payload_bytes"),
        last.alias("last_chunk"), "payload", F.explode(F.sequence(F.lit(0), last)).alias("chunk_no"),
    )
    first = lambda c: F.when(F.col("chunk_no") == 0, F.col(c)).alias(c)
    data = F.when(F.col("record_type") != "revisit", F.expr(f"substring(payload, chunk_no * {chunk_bytes} + 1, {chunk_bytes})"))
    pieces = pieces.select("chunk_no", "last_chunk", data.alias("data"), *[first(c) for c in ("page_id", "url", "record_type", "refers_to", "sha1", "payload_bytes")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        archive, record, running = TaskContext.get().partitionId(), -1, hashlib.sha1()
        for batch in batches:
            out = []
            for chunk_no, last_chunk, data, page_id, url, kind, refers_to, sha1, payload_bytes in zip(*(c.to_pylist() for c in batch.columns)):
                head, data = b"", data or b""
                if chunk_no == 0:
                    record, running = record + 1, hashlib.sha1()
                    name = f"urn:record:{archive}:{record}" if page_id is None else f"urn:page:{quote(page_id, safe='')}"
                    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {payload_bytes}\r\n\r\n".encode("ascii")
                    head = _header(name, url, kind, refers_to, date, http, payload_bytes, sha1) + http
                running.update(data)
                whole = chunk_no == last_chunk
                out.append((archive, record, chunk_no, whole, head + data + END * whole, running.digest()))
            columns = list(zip(*out)) if out else [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, _KINDS)], names=["archive", "record_no", "chunk_no", "last", "data", "running_sha1"])

    return pieces.mapInArrow(run, CHUNKS)


def write_archives(pages: DataFrame, path: str, chunk_bytes: int = 1 << 20, date: str | None = None, **options) -> None:
    """Write the chunked record table of ``pages`` at ``path`` (Parquet)."""
    chunk_rows(plan_records(pages, **options), chunk_bytes, date).write.parquet(path)


def _fields(head: bytes) -> dict[str, str]:
    return dict(line.split(": ", 1) for line in head.decode("ascii").split("\r\n")[1:])


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each record of chunks in order: a running digest and the header are all that is held."""
    fields, http, sha1, block, intact = {}, {}, hashlib.sha1(), 0, False
    for batch in batches:
        out = []
        for archive, record_no, chunk_no, last, data, running in zip(*(batch.column(n).to_pylist() for n in ("archive", "record_no", "chunk_no", "last", "data", "running_sha1"))):
            if last:
                closed, data = data.endswith(END), data[:-4]
            if chunk_no == 0:
                head, _, data = data.partition(END)
                fields, sha1, intact = _fields(head), hashlib.sha1(), head.startswith(b"WARC/1.1\r\n")
                block = len(data)
                raw, _, data = data.partition(END)
                http, intact = _fields(raw), intact and raw.startswith(b"HTTP/1.1 200")
            else:
                block += len(data)
            sha1.update(data)
            intact = intact and sha1.digest() == running
            if last:
                digest, kind = fields["WARC-Payload-Digest"].removeprefix("sha1:"), fields["WARC-Type"]
                whole = closed and block == int(fields["Content-Length"]) and (kind == "revisit" or _base32(sha1.digest()) == digest)
                ids = [fields.get(k, "")[1:-1] for k in ("WARC-Record-ID", "WARC-Refers-To")]
                ids = [unquote(i.removeprefix("urn:page:")) if i.startswith("urn:page:") else None for i in ids]
                url = None if "X-Page-URL-Missing" in fields else unquote(fields["X-Page-URL"]) if "X-Page-URL" in fields else fields["WARC-Target-URI"]
                out.append((archive, record_no, ids[0], url, kind, ids[1], int(http["Content-Length"]), digest, intact and whole))
        columns = list(zip(*out)) if out else [[]] * len(_READ)
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, _READ.values())], names=list(_READ))


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """One row for each record: archive, record_no, page_id, url, record_type, refers_to,
    payload_bytes, payload_digest (base32 SHA-1), intact (lengths and digests agree).

    Chunks of one record are sorted in one task, not held together.
    """
    chunks = spark.read.schema(CHUNKS).parquet(path)
    single = (F.col("chunk_no") == 0) & F.col("last")
    several = chunks.where(~single).repartition("archive", "record_no").sortWithinPartitions("archive", "record_no", "chunk_no")
    return chunks.where(single).mapInArrow(_verify, RECORDS).unionByName(several.mapInArrow(_verify, RECORDS))


def payloads(spark: SparkSession, path: str) -> DataFrame:
    """Payload chunks of responses without headers and closings: archive, record_no, chunk_no, data."""

    def strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            chunk_no, last, data = (batch.column(n).to_pylist() for n in ("chunk_no", "last", "data"))
            bare = [(d[:-4] if e else d) if n else (d[:-4] if e else d).split(END, 2)[2] for n, e, d in zip(chunk_no, last, data)]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in ("archive", "record_no", "chunk_no")), pa.array(bare, pa.binary())], names=["archive", "record_no", "chunk_no", "data"])

    chunks = spark.read.schema(CHUNKS).parquet(path).select("archive", "record_no", "chunk_no", "last", "data")
    return chunks.mapInArrow(strip, "archive int, record_no long, chunk_no int, data binary").where(F.octet_length("data") > 0)


def roundtrip(pages: DataFrame, id_col: str = "page_id", **options) -> DataFrame:
    """Write ``pages`` to archives in the shared folder and read them back."""
    spark = pages.sparkSession
    path = new_path(spark, "warc")
    write_archives(pages, path, id_col=id_col, **options)
    kind = pages.schema[id_col].dataType
    return read_archives(spark, path).withColumn("page_id", F.col("page_id").cast(kind)).withColumn("refers_to", F.col("refers_to").cast(kind))
