import base64
import gzip
import hashlib
import re

from tidemark.llm import warc
from tidemark.llm.common import shared_path


def expected(pages):
    same = {}
    for p, html in pages:
        same.setdefault(html or "", []).append(p)
    out = []
    for p, html in pages:
        raw = (html or "").encode()
        known = [x for x in same[html or ""] if x is not None]
        top = max(known) if known else None
        out.append((p, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "response" if len(same[html or ""]) == 1 or top is None or p == top else "revisit", None if len(same[html or ""]) == 1 or top is None or p == top else top))
    return sorted(out, key=str)


def test_round_trip(spark):
    got = [tuple(x) for x in warc.op4_warc(spark, "/root/testdata/sf0.001").collect()]
    pages = [(x["page_id"], x["html"]) for x in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect()]
    assert sorted(got, key=str) == expected(pages)


def test_odd_pages_in_small_ranges(spark):
    pages = [(1, "http://a", "same"), (2, "http://b\r\nX: y", "same"), (2, None, "same"), (3, "u", None), (4, "u", ""), (5, "u", "é🦄" * 3000), (None, "u", "alone"), (6, "u", gzip.compress(b"WARC/1.1\r\nWARC-Type: x\r\n\r\n", mtime=0).hex())]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    archives = warc.write_archives(warc.with_revisits(df, df["html"]).coalesce(1), shared_path(spark, "test-warc"))
    for size in (1, 17, 300, 1 << 20):
        rows = warc.read_archives(archives, size).collect()
        assert len(rows) == len(pages)
        payloads = sorted(bytes(x["payload"]).decode() for x in rows if x["record_type"] == "response")
        assert payloads == sorted(["same", "same", "", pages[5][2], "alone", pages[7][2]])
    assert {(x["record_id"], x["refers_to_id"]) for x in rows if x["record_type"] == "revisit"} == {("<urn:page:1>", "<urn:page:2>"), ("<urn:page:3>", "<urn:page:4>")}


def test_bytes_that_look_like_members(tmp_path):
    inner = warc.member(b"WARC/1.1\r\nWARC-Type: response\r\n\r\nx")
    outer = warc.record(7, "u", inner, "D" * 32, None)
    stored = gzip.compress(outer, compresslevel=0, mtime=0)
    path = tmp_path / "a.warc.gz"
    path.write_bytes(b"junk" + stored + warc.member(warc.record(8, "u", b"y", "E" * 32, None)))
    for size in (5, 64, 1 << 20):
        found = [r for s in range(0, path.stat().st_size, size) for r in warc.Archive(f"file://{path}").records(s, s + size)]
        assert [warc.parsed(c)["warc-record-id"] for _, c in found] == ["<urn:page:7>", "<urn:page:8>"]


def test_no_pages(spark):
    df = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.read_archives(warc.write_archives(warc.with_revisits(df, df["html"]), shared_path(spark, "test-warc"))).collect() == []


def test_long_headers_many_records_and_damage(spark, tmp_path):
    long_ = warc.record(1, "http://a/" + "x" * 9000, b"one", "D" * 32, None).replace(b"WARC-Type: response\r\n", b"").replace(b"Content-Type: application/http;", b"warc-type: response\r\nContent-Type: application/http;", 1)
    two = warc.record(2, "u", b"two", "E" * 32, None) + warc.record(3, "u", b"three", "F" * 32, None)
    whole = warc.member(long_) + warc.member(two)
    cut = warc.member(warc.record(4, "u", bytes(range(256)) * 40, "G" * 32, None))[:-40]
    path = tmp_path / "a.warc.gz"
    path.write_bytes(whole + cut)
    archives = spark.createDataFrame([(f"file://{path}", path.stat().st_size)], "path string, bytes bigint")
    for size in (64, 1 << 20):
        rows = sorted((x["offset"], x["record_type"], x["record_id"]) for x in warc.read_archives(archives, size).collect())
        # the record before the cut one is whole, and what follows it starts like a record
        assert [(t, i) for _, t, i in rows] == [("response", "<urn:page:1>"), ("response", "<urn:page:2>"), ("response", "<urn:page:3>"), ("damaged", None)]
        assert rows[-1][0] == len(whole)


def test_lengths_that_are_no_numbers(spark, tmp_path):
    good = warc.record(1, "u", b"one", "D" * 32, None)
    bad = re.sub(rb"Content-Length: \d+", b"Content-Length: abc", good, count=1)
    http = b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:9>\r\n\r\nHTTP/1.1 200 OK\r\nContent-Length: -3\r\n\r\nnine"
    huge = re.sub(rb"Content-Length: \d+", b"Content-Length: " + b"9" * 5000, good, count=1)
    path = tmp_path / "a.warc.gz"
    path.write_bytes(b"".join(map(warc.member, (bad, good, http, huge))))
    archives = spark.createDataFrame([(f"file://{path}", path.stat().st_size)], "path string, bytes bigint")
    rows = sorted((x["offset"], x["record_type"], x["record_id"], x["payload_bytes"]) for x in warc.read_archives(archives).collect())
    assert [x[1:] for x in rows] == [("damaged", None, None), ("response", "<urn:page:1>", 3), ("response", "<urn:page:9>", 4), ("damaged", None, None)]
