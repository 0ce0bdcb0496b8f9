"""WARC archives, written with one gzip member for each record and read again in byte ranges.

A reading task owns the records that start inside its range. It looks there for gzip's magic bytes, takes a place for a
record only if the bytes decode to WARC headers and the member ends where a member or the file's end follows, and from then
on goes from member to member. So no index is needed, and one large archive is read by many tasks.
"""

from __future__ import annotations

import base64
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import load, shared_path, written

#: Bytes of an archive that one task scans.
RANGE = 4 << 20
#: Bytes after which a writing task starts another archive.
ROLL = 1 << 30
_CHUNK = 1 << 20
MAGIC = b"\x1f\x8b\x08"
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def base32_sha1(hexed: str) -> str:
    return base64.b32encode(bytes.fromhex(hexed)).decode()


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """A response with its payload, or a revisit of another page's response with the headers alone."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Date: {DATE}"]
    if url:
        lines.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    if refers_to is not None:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    lines += [f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(data: bytes) -> bytes:
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def write_archives(pages: DataFrame, folder: str) -> DataFrame:
    """Writes pages (page_id, url, payload binary, sha1 hex, refers_to) as archives in folder; returns (path, bytes, records)
    of each archive. A task's archives have names of their own, so one that is run twice leaves archives that nobody lists."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        part = TaskContext.get().partitionId()
        out, done, path, size, n = None, [], "", 0, 0
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                page_id, url, payload, sha1, refers_to = row
                if out is None:
                    path, size, n = f"part-{part:06d}-{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = store.open_output_stream(f"{root}/{path}", compression=None)
                data = member(record(page_id, url, payload or b"", base32_sha1(sha1), refers_to))
                out.write(data)
                size, n = size + len(data), n + 1
                if size >= ROLL:
                    out.close()
                    done.append((path, size, n))
                    out = None
        if out is not None:
            out.close()
            done.append((path, size, n))
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*[(f"{folder}/{p}", s, k) for p, s, k in done], strict=True)], names=["path", "bytes", "records"])

    return written(pages.mapInArrow(run, "path string, bytes bigint, records bigint"), "warc-list")


class Archive:
    """Members of one archive, read in pieces."""

    def __init__(self, path: str):
        store, at = fs.FileSystem.from_uri(path)
        self.file = store.open_input_file(at)
        self.size = self.file.size()

    def head(self, at: int) -> bool:
        """Whether the bytes there decode to the headers of a WARC record, up to the blank line that ends them."""
        z, got, to = zlib.decompressobj(31), b"", at
        while not z.eof:
            chunk = self.file.read_at(min(4096, self.size - to), to)
            if not chunk:
                return False
            try:
                got += z.decompress(chunk)
            except zlib.error:
                return False
            to += len(chunk)
            if not got.startswith(b"WARC/"[: len(got)]):
                return False
            end = got.find(b"\r\n\r\n")
            if end >= 0:
                return re.match(rb"WARC/\d\.\d\r\n", got) is not None and re.search(rb"(?im)^WARC-Type:", got[:end]) is not None
        return False

    def whole(self, at: int) -> tuple[bytes, int] | None:
        """A member's content and where it ends; None if it doesn't decode to its end."""
        z, parts, to = zlib.decompressobj(31), [], at
        try:
            while not z.eof:
                chunk = self.file.read_at(min(_CHUNK, self.size - to), to)
                if not chunk:
                    return None
                parts.append(z.decompress(chunk))
                to += len(chunk)
        except zlib.error:
            return None
        return b"".join(parts), to - len(z.unused_data)

    def follows(self, at: int) -> bool:
        return at == self.size or self.file.read_at(3, at) == MAGIC and self.head(at)

    def records(self, start: int, end: int) -> Iterator[tuple[int, bytes | None]]:
        """(offset, content) of the members that start in [start, end); None is the content of one that starts like a record and
        doesn't decode to its end."""
        at = start
        while (at := self.find(at, end)) is not None:
            got = self.whole(at)
            if got is None:
                yield at, None
            if got is None or not self.follows(got[1]):
                at += 1  # bytes inside a member that look like one
                continue
            while got is not None:
                yield at, got[0]
                at = got[1]
                if at >= end or at >= self.size or not self.follows(at):
                    break
                got = self.whole(at)
            if at >= end:
                return

    def find(self, at: int, end: int) -> int | None:
        """The first place in [at, end) that starts like a record."""
        while at < min(end, self.size):
            data = self.file.read_at(min(_CHUNK, end + 2 - at, self.size - at), at)
            k = data.find(MAGIC)
            while k >= 0:
                if at + k < end and self.head(at + k):
                    return at + k
                k = data.find(MAGIC, k + 1)
            at += max(1, len(data) - 2)
        return None


def each_record(content: bytes) -> Iterator[bytes]:
    """The records of a member, one as a rule; where a length is missing or wrong, the rest is one record."""
    while content:
        head, blank, rest = content.partition(b"\r\n\r\n")
        length = re.search(rb"(?im)^Content-Length:[ \t]*(\d{1,18})[ \t]*\r?$", head)
        to = len(head) + len(blank) + int(length[1]) if length else len(content)
        left = content[to:].lstrip(b"\r\n")
        if not left.startswith(b"WARC/"):
            yield content
            return
        yield content[:to]
        content = left


def _length(told: str | None, default: int) -> int | None:
    """A length as headers tell it; default if they don't, None if it isn't a number."""
    if told is None:
        return default
    return int(told) if re.fullmatch(r"\d{1,18}", told, re.ASCII) else None


def parsed(content: bytes) -> dict | None:
    """Of a record: its headers by lower-case name, those of HTTP under `http`, and the payload (None for a revisit). None of a record whose
    Content-Length isn't a number."""
    head, _, rest = content.partition(b"\r\n\r\n")
    fields = lambda lines: {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
    warc = fields(head.decode("utf-8", "replace").split("\r\n")[1:])
    length = _length(warc.get("content-length"), len(rest))
    if length is None:
        return None
    block = rest[:length]
    http, _, payload = block.partition(b"\r\n\r\n")
    return warc | {"http": fields(http.decode("utf-8", "replace").split("\r\n")[1:]), "payload": None if warc.get("warc-type") == "revisit" else payload}


RECORDS = "path string, offset bigint, record_type string, record_id string, refers_to_id string, url string, payload_digest string, payload_bytes bigint, payload binary"


def read_archives(archives: DataFrame, size: int = RANGE, payloads: bool = True) -> DataFrame:
    """A row for each record of archives (path, bytes). payload_bytes is of the full payload, which a revisit doesn't hold.
    A member of several records gives a row for each. An archive of no bytes has no records; bytes that decode to no record are
    skipped, but a member that starts like a record and doesn't decode to its end, as in a truncated archive, and a record whose
    Content-Length isn't a number, gives a row of the record_type `damaged`, with null fields. Of HTTP headers such a length is left
    aside."""
    ranges = archives.where("bytes > 0").select("path", F.explode(F.sequence(F.lit(0).cast("long"), F.col("bytes") - 1, F.lit(size).cast("long"))).alias("start"))
    tasks = max(1, ranges.count())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in RECORDS.split(", ")]
        types = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.binary()]
        for batch in batches:
            for path, start in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                rows, held = [], 0
                for at, r in ((at, parsed(x) if x is not None else None) for at, content in Archive(path).records(start, start + size) for x in (each_record(content) if content is not None else [None])):
                    if r is None:
                        rows.append((path, at, "damaged", *[None] * 6))
                        continue
                    held_bytes = len(r["payload"] or b"")
                    n = _length(r["http"].get("content-length"), held_bytes)
                    n = held_bytes if n is None else n
                    rows.append((path, at, r.get("warc-type"), r.get("warc-record-id"), r.get("warc-refers-to"), r.get("warc-target-uri"), r.get("warc-payload-digest", "").removeprefix("sha1:"), n, r["payload"] if payloads else None))
                    held += len(r["payload"] or b"") + 1000
                    if held > _CHUNK * 4:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    return ranges.repartition(min(tasks, 20_000), "path", "start").mapInArrow(run, RECORDS)


def with_revisits(pages: DataFrame, payload: Column, least: int = 0) -> DataFrame:
    """pages as write_archives takes them: of equal payloads of `least` bytes at least, the largest page_id is the response
    and the others revisit it. Rows that repeat that page_id and payload are responses each; a null page_id is never the
    largest, and stays a response where all are null. A null payload is empty. Other columns aren't read. Payloads of several
    pages are found by their digests alone and written, so that Spark knows how many there are when it joins, and can split the
    pages of one that a third of all have."""
    rows = pages.select("page_id", "url", F.coalesce(payload.cast("binary"), F.lit(b"")).alias("payload"))
    rows = rows.select("*", F.sha1("payload").alias("sha1"), F.sha2("payload", 256).alias("same"))
    first = rows.where(F.octet_length("payload") >= least).groupBy("same").agg(F.max("page_id").alias("_r"), F.count("*").alias("_k")).where("_k > 1").select("same", "_r")
    first = written(first, "warc-first")
    refers = F.when(F.col("_r").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("_r")), F.col("_r"))
    return rows.join(first, "same", "left").select("page_id", "url", "payload", "sha1", refers.alias("refers_to"))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's record, after writing all pages as archives and reading these back."""
    pages = with_revisits(load(spark, sf_dir, "pages"), F.col("html"))
    found = read_archives(write_archives(pages, shared_path(spark, "warc")), payloads=False)
    number = lambda c: F.expr(f"try_cast(regexp_extract({c}, '<urn:page:(-?[0-9]*)>', 1) AS bigint)")
    return found.select(number("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", number("refers_to_id").alias("refers_to"))
