import base64
import hashlib
import re

import pytest
from pyspark.sql import functions as F

from lodestar.llm import warc
from lodestar.llm.common import new_path
from lodestar.llm.warc import CHUNKS, payloads, read_archives, roundtrip, write_archives

PAGES = [(3, "http://c", "same"), (1, "http://a\nb", "same"), (2, None, "é" * 5000), (4, "http://d", None), (5, "http://e", ""), (None, "http://f", "same"), (6, "u", "x" * 1024), (1, "http://a\nb", "same"), (None, None, "alone")]
SCHEMA = "page_id long, url string, html string"


@pytest.mark.parametrize("bound", [warc.BROADCAST_GROUPS, 0])
def test_roundtrip_in_small_chunks(spark, monkeypatch, bound):
    monkeypatch.setattr(warc, "BROADCAST_GROUPS", bound)
    pages = spark.createDataFrame(PAGES, SCHEMA).selectExpr("*", "1 AS payload", "2 AS sha1", "3 AS record_no", "4 AS size", "5 AS first_id")
    for size in (7, 1024, 1 << 20):
        rows = roundtrip(pages, chunk_bytes=size).collect()
        assert len(rows) == len(PAGES) and all(r.intact for r in rows)
        expected = sorted((str(i), str(u), len((h or "").encode()), base64.b32encode(hashlib.sha1((h or "").encode()).digest()).decode()) for i, u, h in PAGES)
        assert sorted((str(r.page_id), str(r.url), r.payload_bytes, r.payload_digest) for r in rows) == expected
        kinds = sorted((str(r.page_id), r.record_type, str(r.refers_to)) for r in rows)
        assert kinds == sorted(
            [("1", "response", "None"), ("1", "response", "None"), ("2", "response", "None"), ("3", "revisit", "1"), ("4", "response", "None"), ("5", "revisit", "4"), ("6", "response", "None"),
             ("None", "revisit", "1"), ("None", "response", "None")]
        )


def test_ids_and_urls_of_any_text(spark):
    odd = [("a\r\nWARC-Type: x", "http://x/a  b\tc%20d\u00e9<>", "one"), ("", "", "two"), ("%0A", "urn:page:%0A", "one"), ("\u00e9 \u65e5", "http://\u65e5", "three\r\n\r\nfour\r\n\r\n")]
    rows = roundtrip(spark.createDataFrame(odd, "page_id string, url string, html string"), chunk_bytes=3).collect()
    assert sorted((r.page_id, r.url, r.record_type, r.refers_to, r.intact) for r in rows) == sorted(
        (i, u, "revisit" if i.startswith("a") else "response", "%0A" if i.startswith("a") else None, True) for i, u, _ in odd
    )


def test_small_payloads_are_all_responses(spark):
    rows = roundtrip(spark.createDataFrame(PAGES, SCHEMA), min_revisit_bytes=5).collect()
    assert {r.record_type for r in rows} == {"response"}


FIELD = re.compile(rb"[!#$%&'*+.^_`|~0-9A-Za-z-]+: [^\r\n\x00-\x08\x0b-\x1f\x7f]*")


def records_of(raw):
    """Records of a WARC 1.1 file by its grammar: version, named fields, empty line, block of Content-Length bytes, two line breaks."""
    while raw:
        head, rest = raw.split(b"\r\n\r\n", 1)
        version, *lines = head.split(b"\r\n")
        assert version == b"WARC/1.1" and all(FIELD.fullmatch(x) for x in lines)
        fields = dict(x.decode("ascii").split(": ", 1) for x in lines)
        assert len(fields) == len(lines) and {"WARC-Type", "WARC-Record-ID", "WARC-Date", "Content-Length", "WARC-Target-URI"} <= set(fields)
        assert re.fullmatch(r"<[a-z]+:[!#-;=?-Z\[\]_a-z~]*>", fields["WARC-Record-ID"]) and re.fullmatch(r"\d{4}-\d\d-\d\dT\d\d:\d\d:\d\dZ", fields["WARC-Date"])
        assert re.fullmatch(r"[!#-;=?-Z\[\]_a-z~]+", fields["WARC-Target-URI"])
        n = int(fields["Content-Length"])
        assert rest[n : n + 4] == b"\r\n\r\n"
        yield fields, rest[:n]
        raw = rest[n + 4 :]


def test_bytes_are_a_warc_file(spark):
    path = new_path(spark, "warc-grammar")
    write_archives(spark.createDataFrame(PAGES, SCHEMA), path, chunk_bytes=100, date="2024-05-06T07:08:09Z")
    files = {}
    for c in spark.read.parquet(path).orderBy("archive", "record_no", "chunk_no").collect():
        files[c.archive] = files.get(c.archive, b"") + bytes(c.data)
    found = [r for raw in files.values() for r in records_of(raw)]
    assert len(found) == len(PAGES)
    for fields, block in found:
        http, body = block.split(b"\r\n\r\n", 1)
        assert http.startswith(b"HTTP/1.1 200 OK\r\n") and fields["Content-Type"] == "application/http;msgtype=response"
        if fields["WARC-Type"] == "revisit":
            assert body == b"" and fields["WARC-Profile"].endswith("/revisit/identical-payload-digest") and fields["WARC-Refers-To"].startswith("<urn:page:")
        else:
            assert fields["WARC-Payload-Digest"] == "sha1:" + base64.b32encode(hashlib.sha1(body).digest()).decode() and f"Content-Length: {len(body)}".encode() in http


def test_damage_is_seen(spark):
    pages = spark.createDataFrame([(1, "http://a", "hello world")], SCHEMA)
    path = new_path(spark, "warc-test")
    write_archives(pages, path, chunk_bytes=4)
    assert b"".join(bytes(r.data) for r in payloads(spark, path).orderBy("chunk_no").collect()) == b"hello world"
    chunks = spark.read.parquet(path).orderBy("record_no", "chunk_no").collect()
    assert [bytes(c.data) for c in chunks[1:]] == [b"o wo", b"rld\r\n\r\n"]
    for at, data in ((1, b"O wo"), (2, b"rld\r\n\r"), (1, b"o w")):
        rows = [(c.archive, c.record_no, c.chunk_no, c.last, bytearray(data) if c.chunk_no == at else c.data, c.running_sha1) for c in chunks]
        damaged = new_path(spark, "warc-damaged")
        spark.createDataFrame(rows, CHUNKS).write.parquet(damaged)
        assert [r.intact for r in read_archives(spark, damaged).collect()] == [False]


def test_payloads_are_not_moved(spark):
    path = new_path(spark, "warc-plan")
    pages = spark.createDataFrame(PAGES, SCHEMA).select("page_id", "url", "html").withColumn("url", F.lit("u"))
    plan = warc.plan_records(pages)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "Exchange hashpartitioning" not in plan and path


def test_empty(spark):
    assert roundtrip(spark.createDataFrame([], SCHEMA)).count() == 0
