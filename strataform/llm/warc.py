"""Operator 4, WARC: archives with revisit records, and a salvage reader.

Writing. Pages with equal payloads (SHA-1 and SHA-256) of ``LEAST`` bytes or more are grouped by digest in a sum that is
combined before the shuffle; the record with the largest page_id is the response, the others are revisits that refer to
it. Each task writes its records to files of its own in the shared folder, one gzip member for each record, a new file
after ``FILE_MOST`` bytes; the manifest has only the files of tasks that ended well.

Reading. Each file is read record by record, from a gzip member or a bare version line. A record is checked: its member's
checksum, version line, lengths, end, block digest and payload digest. After a failed check the reader searches for the
next member or version line whose record passes, goes on from there, and gives the gap as a row of its own: file, first
byte, end, reason. ``salvaged`` writes the gaps to a quarantine table beside the records. Memory is bounded by the largest
record and a window of the file, or what lies between a bare version line and the next end of a header. A header may have
any length. ``op4`` fails, and keeps its archives and that table, if there is a gap or if it doesn't read as many records
as it wrote.

Payloads aren't shuffled while the digests that occur more than once are few (``SENT``) enough to be sent. Beyond that
those that are hot are sent, and the others' rows are shuffled by digest.

Defined results: a null html is an empty payload; a null page_id is smaller than any other, and a null url is written as
a URN; urls and payloads of any length are written whole; of equal payloads, all rows that have the largest page_id are responses (repeated rows repeat their result); an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import SENT, drop, join_hot, scratch, ship, shuffle_width, table, thrifty, tidied, values, written

LEAST = 1000
FILE_MOST = 128 << 20
WINDOW = 1 << 20
#: Of a bare record, so much is searched first for the end of its header.
HEADER_FIRST = 1 << 20
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2020-01-01T00:00:00Z"
MAGIC, VERSION = b"\x1f\x8b\x08", b"WARC/1."


# Records


def digest32(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def urn(page_id: int | None) -> str:
    return f"<urn:page:{'null' if page_id is None else page_id}>"


def page_of(value: str | None) -> int | None:
    m = re.fullmatch(r"<urn:page:(-?\d+)>", value or "")
    return int(m[1]) if m else None


def record(page_id: int | None, url: str | None, payload: bytes, revisits: bool, refers_to: int | None) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisits else http + payload
    uri = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url) if url else urn(page_id)[1:-1]
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisits else 'response'}", f"WARC-Record-ID: {urn(page_id)}", f"WARC-Date: {DATE}", f"WARC-Target-URI: {uri}", f"WARC-Payload-Digest: {digest32(payload)}", f"WARC-Block-Digest: {digest32(block)}"]
    lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {urn(refers_to)}"] if revisits else []
    lines += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(data: bytes) -> bytes:
    z = zlib.compressobj(1, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


# Reading


class Bad(Exception):
    """A failed check; says which."""


@dataclass
class Record:
    start: int
    end: int
    headers: dict[str, str]
    block: bytes

    @property
    def http_end(self) -> int:
        return at + 4 if (at := self.block.find(b"\r\n\r\n")) >= 0 else len(self.block)

    @property
    def payload(self) -> bytes:
        return self.block[self.http_end :]

    @property
    def payload_bytes(self) -> int:
        """Of the full payload; a revisit's is in its HTTP header."""
        if self.headers.get("warc-type") == "revisit":
            m = re.search(rb"(?im)^content-length:\s*(\d+)", self.block[: self.http_end])
            return int(m[1]) if m else 0
        return len(self.block) - self.http_end


class Reader:
    """Records and gaps of one archive. ``file`` has ``seek``, ``read`` and ``size``."""

    def __init__(self, file, size: int) -> None:
        self.file, self.size = file, size
        self.at, self.window = 0, b""

    def bytes_at(self, start: int, n: int) -> bytes:
        if not (self.at <= start and start + n <= self.at + len(self.window)):
            self.file.seek(start)
            self.at, self.window = start, self.file.read(max(n, WINDOW))
        return self.window[start - self.at : start - self.at + n]

    def parsed(self, data: bytes, start: int, end: int | None) -> Record:
        """The record in ``data``; ``end``: of its member, None for a bare record."""
        head = data.find(b"\r\n\r\n") if data.startswith(VERSION) else -1
        while end is None and head < 0 and data.startswith(VERSION) and start + len(data) < self.size:  # a long header
            seen = len(data)
            data = self.bytes_at(start, min(self.size - start, 2 * seen))
            head = data.find(b"\r\n\r\n", max(seen - 3, 0))
        if head < 0:
            raise Bad("no version line and header")
        headers = {}
        for line in data[:head].decode("utf-8", "replace").split("\r\n")[1:]:
            name, _, value = line.partition(":")
            headers[name.strip().lower()] = value.strip()
        if not headers.get("content-length", "").isdigit():
            raise Bad("no length")
        stop = head + 4 + int(headers["content-length"])
        if end is None and stop + 4 > len(data):
            if start + stop + 4 > self.size:
                raise Bad("truncated")
            data = self.bytes_at(start, stop + 4)
        if data[stop : stop + 4] != b"\r\n\r\n" or end is not None and len(data) != stop + 4:
            raise Bad("wrong length")
        found = Record(start, start + stop + 4 if end is None else end, headers, data[head + 4 : stop])
        if (d := headers.get("warc-block-digest", "")).startswith("sha1:") and d != digest32(found.block):
            raise Bad("block digest")
        if headers.get("warc-type") == "response" and (d := headers.get("warc-payload-digest", "")).startswith("sha1:") and d != digest32(found.payload):
            raise Bad("payload digest")
        return found

    def record_at(self, start: int) -> Record:
        if self.bytes_at(start, 3) != MAGIC:
            return self.parsed(self.bytes_at(start, min(self.size - start, HEADER_FIRST)), start, None)
        z, out, at, first = zlib.decompressobj(31), [], start, True
        while not z.eof:
            raw = self.bytes_at(at, min(1 << 16, self.size - at))
            if not raw:
                raise Bad("truncated")
            try:
                out.append(z.decompress(raw))
            except zlib.error as e:
                raise Bad("member") from e
            if first and out[0][:7] != VERSION[: len(out[0][:7])]:
                raise Bad("no version line")
            first = False
            at += len(raw)
        return self.parsed(b"".join(out), start, at - len(z.unused_data))

    def candidates(self, start: int) -> Iterator[int]:
        """Places from ``start`` on at which a member or a version line may begin."""
        pattern = re.compile(rb"\x1f\x8b\x08|WARC/1\.")
        while start < self.size:
            n = min(WINDOW, self.size - start)
            data = self.bytes_at(start, n)
            for m in pattern.finditer(data):
                yield start + m.start()
            start += max(n - 6, 1) if start + n < self.size else n

    def __iter__(self) -> Iterator[Record | tuple[int, int, str]]:
        at = 0
        while at < self.size:
            try:
                found = self.record_at(at)
            except Bad as e:
                gap, why, found = at, str(e), None
                for place in self.candidates(at + 1):
                    try:
                        found = self.record_at(place)
                        break
                    except Bad:
                        continue
                yield gap, found.start if found else self.size, why
                if not found:
                    return
            yield found
            at = found.end


FIELDS = pa.schema([
    ("file", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("gap", pa.string()), ("record_type", pa.string()), ("record_id", pa.string()),
    ("uri", pa.string()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("refers_to", pa.string()), ("payload", pa.binary()),
])
DDL = "file string, start long, end long, gap string, record_type string, record_id string, uri string, payload_digest string, payload_bytes long, refers_to string, payload binary"


def hex_digest(value: str | None) -> str | None:
    return base64.b32decode(value[5:]).hex() if value and value.startswith("sha1:") else None


def read_files(batches: Iterator[pa.RecordBatch], payloads: bool) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for path in b.column(0).to_pylist():
            where, name = fs.FileSystem.from_uri(path)
            rows, size = [], 0
            with where.open_input_file(name) as f:
                for x in Reader(f, f.size()):
                    if isinstance(x, tuple):
                        rows.append((path, x[0], x[1], x[2], *[None] * 7))
                    else:
                        h = x.headers
                        rows.append((path, x.start, x.end, None, h.get("warc-type"), h.get("warc-record-id"), h.get("warc-target-uri"), hex_digest(h.get("warc-payload-digest")), x.payload_bytes, h.get("warc-refers-to"), x.payload if payloads else None))
                        size += len(x.block) if payloads else 0
                    if len(rows) >= 5000 or size > 16 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), FIELDS.types, strict=True)], schema=FIELDS)
                        rows, size = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), FIELDS.types, strict=True)], schema=FIELDS)


def read_archives(files: DataFrame, payloads: bool = True) -> DataFrame:
    """``files`` has paths in its first column. A row for each record, and one with ``gap`` for each range of lost bytes."""
    ship(files.sparkSession)
    return files.mapInArrow(thrifty(lambda batches: read_files(batches, payloads)), DDL)


def salvaged(files: DataFrame, log: str, payloads: bool = True) -> DataFrame:
    """The records of ``files``, written; the gaps (file, start, end, gap) go to the Parquet table ``log``."""
    found = written(read_archives(files, payloads), "salvaged")
    found.where("gap is not null").select("file", "start", "end", "gap").write.mode("append").parquet(log)
    return found.where("gap is null").drop("gap")


# Writing


def decided(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """(id, url, payload, revisits, refers_to) from (id, url, html)."""
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select("id", "url", payload.alias("payload"))
    rows = rows.withColumn("key", F.when(F.length("payload") >= least, F.concat(F.unhex(F.sha1("payload")), F.unhex(F.sha2("payload", 256)))))
    most = written(rows.where("key is not null").groupBy("key").agg(F.max("id").alias("most"), F.count(F.lit(1)).alias("n")).where("n > 1"), "repeated")
    several, total = most.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    if several <= SENT:
        joined = rows.join(F.broadcast(most), "key", "left")
    else:
        single = rows.where("key is null").unionByName(rows.where("key is not null").join(most.select("key").hint("merge"), "key", "left_anti"))
        single = single.withColumns({"most": F.lit(None).cast(rows.schema["id"].dataType), "n": F.lit(1).cast("long")})
        joined = join_hot(rows, most, "key", "n", total).unionByName(single)
    revisits = F.coalesce(F.col("most").isNotNull() & ~F.col("id").eqNullSafe(F.col("most")), F.lit(False))
    return joined.select("id", "url", "payload", revisits.alias("revisits"), F.when(revisits, F.col("most")).alias("refers_to"))


def write_archives(rows: DataFrame, folder: str) -> DataFrame:
    """Writes what ``decided`` gives to archives in ``folder``; the manifest: file, records, bytes."""
    ship(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, name = fs.FileSystem.from_uri(folder)
        where.create_dir(name, recursive=True)
        out, made = None, []

        def close() -> None:
            out.close()
            made[-1][2] = size

        for b in batches:
            for row in zip(*(values(c) for c in b.columns), strict=True):
                if out is None or size >= FILE_MOST:
                    if out is not None:
                        close()
                    file = f"{uuid.uuid4().hex}.warc.gz"
                    out, size = where.open_output_stream(f"{name}/{file}", compression=None), 0
                    made.append([f"{folder}/{file}", 0, 0])
                data = member(record(row[0], row[1], row[2], row[3], row[4]))
                out.write(data)
                size += len(data)
                made[-1][1] += 1
        if out is not None:
            close()
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*made, strict=True)], ["file", "records", "bytes"])

    return written(rows.mapInArrow(thrifty(run), "file string, records long, bytes long"), "manifest")


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each page: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    pages = table(spark, sf_dir, "pages").select(F.col("page_id").cast("long").alias("id"), "url", "html")
    folder, log, at = scratch(spark, "warc"), scratch(spark, "warc-gaps"), scratch(spark, "op4")
    page = lambda c: F.regexp_extract(c, r"^<urn:page:(-?\d+)>$", 1)
    number = lambda c: F.when(page(c) != "", page(c)).cast("long")
    with tidied(spark):
        manifest = write_archives(decided(pages), folder)
        files = manifest.select("file").repartition(shuffle_width(spark), "file")
        records = salvaged(files, log, payloads=False)
        out = written(records.select(number("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", number("refers_to").alias("refers_to")), "op4", at)
        wrote, read = manifest.agg(F.coalesce(F.sum("records"), F.lit(0))).first()[0], out.count()
        gaps = spark.read.schema("file string, start long, end long, gap string").parquet(log).count()
    if wrote != read or gaps:
        raise RuntimeError(f"op4 wrote {wrote} records and read {read}; {gaps} gaps are listed in {log}, the archives are in {folder}")
    drop(spark, folder, log)
    return out


OP4_SQL = """
with p as (select page_id, coalesce(html, '') h, strlen(coalesce(html, '')) n from pages),
r as (select *, max(page_id) over (partition by h) m, count(*) over (partition by h) c from p)
select page_id, cast(n as bigint) as payload_bytes, sha1(h) as payload_digest,
  case when n >= 1000 and c > 1 and page_id <> m then 'revisit' else 'response' end as record_type,
  case when n >= 1000 and c > 1 and page_id <> m then m end as refers_to from r
"""
