"""WARC records in ZIP-packaged archives, written and range-read.

An archive is a ZIP file of stored (uncompressed) members: `archive/data.warc.gz`, whose records are
compressed one by one, and `indexes/index.cdx`, a line for each record with its offset and length.
So a record is two small reads away from anyone who can read a range of bytes: the reader parses the
end of the file, the central directory (ZIP64 included) and the index, and then reads each record
where it lies; nothing is unpacked. In Spark, archives are listed without their content, the lines of
their indexes are dealt out in runs of about `run_bytes`, and each record is read by its range, so an
archive may be of any size. Ranges are read by pyarrow's file systems (RANGED); archives in other
stores, which only Spark can open, are loaded whole and must be below Spark's 2 GB and fit in memory.

Archives are written by Spark's own file writer, so any store that Spark reaches will do: a task
builds each archive (`archive_bytes` at most, but for one record) as one row, and one row is one file.

Edge cases: a null payload is empty; a null id is kept as null; of rows that share the largest id
and payload each is a response; members that are compressed, and files that are no ZIP, are
reported by `read_directory` and by an error; empty tables give no archive and no record; columns
other than the named ones are not carried.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import json
import struct
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Protocol

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .batches import small_batches

ARCHIVE_BYTES = 32_000_000
DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdx"
RUN_BYTES = 8_000_000
RUN_RECORDS = 5_000
INDEX_BYTES = 4_000_000  # of an index read at once
#: Schemes whose files pyarrow reads by ranges, and what it calls them.
RANGED = {"file": "file", "s3": "s3", "s3a": "s3", "s3n": "s3", "gs": "gs", "hdfs": "hdfs", "abfs": "abfs", "abfss": "abfss"}
LEAST_REVISIT_BYTES = 0
_DATE = "2024-01-01T00:00:00Z"
_NONE = "none"


# ---- reading ranges -------------------------------------------------------------------------


class Ranges(Protocol):
    """Anything that gives a range of bytes."""

    size: int

    def read(self, offset: int, length: int) -> bytes: ...


class BytesRanges:
    """Ranges of bytes in memory, without copying the rest."""

    def __init__(self, data: bytes | memoryview):
        self.data, self.size = memoryview(data), len(data)

    def read(self, offset: int, length: int) -> bytes:
        if offset < 0 or offset + length > self.size:
            raise ValueError(f"no bytes {offset} to {offset + length}: the archive has {self.size}")
        return bytes(self.data[offset : offset + length])


class FileRanges:
    """Ranges of an open binary file."""

    def __init__(self, file):
        self.file = file
        self.size = file.seek(0, io.SEEK_END)

    def read(self, offset: int, length: int) -> bytes:
        if offset < 0 or offset + length > self.size:
            raise ValueError(f"no bytes {offset} to {offset + length}: the archive has {self.size}")
        self.file.seek(offset)
        return self.file.read(length)


@dataclass(frozen=True)
class Member:
    name: str
    method: int  # 0: stored
    size: int
    packed: int
    header: int  # offset of its local header

    def at(self, ranges: Ranges) -> int:
        """The offset of its bytes; the local header has name and extra fields of its own lengths."""
        signature, name, extra = struct.unpack("<4s22xHH", ranges.read(self.header, 30))
        if signature != b"PK\x03\x04":
            raise ValueError(f"no local header of {self.name} at {self.header}")
        return self.header + 30 + name + extra


def read_directory(ranges: Ranges) -> dict[str, Member]:
    """The members by name, from the central directory at the end of the archive."""
    tail_at = max(0, ranges.size - 65_557)
    tail = ranges.read(tail_at, ranges.size - tail_at)
    end = tail.rfind(b"PK\x05\x06")
    while end >= 0 and (end + 22 > len(tail) or end + 22 + struct.unpack_from("<H", tail, end + 20)[0] != len(tail)):
        end = tail.rfind(b"PK\x05\x06", 0, end)  # a comment may hold the same four bytes
    if end < 0:
        raise ValueError("not a ZIP archive: it has no end record")
    entries, size, offset = struct.unpack_from("<HII", tail, end + 10)
    if entries == 0xFFFF or size == 0xFFFFFFFF or offset == 0xFFFFFFFF:
        locator = ranges.read(tail_at + end - 20, 20)
        if locator[:4] != b"PK\x06\x07":
            raise ValueError("the ZIP64 locator is missing")
        record = ranges.read(struct.unpack_from("<Q", locator, 8)[0], 56)
        if record[:4] != b"PK\x06\x06":
            raise ValueError("the ZIP64 end record is missing")
        entries, size, offset = struct.unpack_from("<QQQ", record, 32)
    directory, at, out = ranges.read(offset, size), 0, {}
    for _ in range(entries):
        if directory[at : at + 4] != b"PK\x01\x02":
            raise ValueError("the central directory is damaged")
        method, packed, full, name_len, extra_len, note_len, header = struct.unpack_from("<10xH8xIIHHH8xI", directory, at)
        name = directory[at + 46 : at + 46 + name_len].decode("utf-8", "replace")
        extra, e = directory[at + 46 + name_len : at + 46 + name_len + extra_len], 0
        while e + 4 <= len(extra):
            kind, length = struct.unpack_from("<HH", extra, e)
            if kind == 1:  # ZIP64: those of the three that did not fit, in this order
                wide, w = extra[e + 4 : e + 4 + length], 0
                if full == 0xFFFFFFFF:
                    full, w = struct.unpack_from("<Q", wide, w)[0], w + 8
                if packed == 0xFFFFFFFF:
                    packed, w = struct.unpack_from("<Q", wide, w)[0], w + 8
                if header == 0xFFFFFFFF:
                    header = struct.unpack_from("<Q", wide, w)[0]
            e += 4 + length
        out[name] = Member(name, method, full, packed, header)
        at += 46 + name_len + extra_len + note_len
    return out


def stored(ranges: Ranges, members: dict[str, Member], name: str) -> tuple[int, int]:
    """Offset and length of a stored member's bytes."""
    if name not in members:
        raise ValueError(f"the archive has no member {name}")
    if members[name].method != 0:
        raise ValueError(f"member {name} is compressed; its parts can't be read alone")
    return members[name].at(ranges), members[name].size


# ---- records --------------------------------------------------------------------------------


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def write_record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """A compressed response record or, with refers_to, a revisit record without the payload."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http + (payload if refers_to is None else b"")
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:page:{_NONE if page_id is None else page_id}>",
        f"WARC-Target-URI: {' '.join((url or '').split())}",
        f"WARC-Date: {_DATE}",
        f"WARC-Payload-Digest: sha1:{digest}",
    ]
    if refers_to is not None:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return gzip.compress("\r\n".join(head).encode() + block + b"\r\n\r\n", compresslevel=5, mtime=0)


def parse_record(packed: bytes) -> dict:
    """type, id, url, digest, refers_to, payload_bytes and payload (None in a revisit)."""
    data = zlib.decompress(packed, wbits=31)
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    field = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    block = rest[: int(field["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    promised = next((int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")), len(payload))
    kind = field["warc-type"]
    return {
        "type": kind,
        "id": _page(field["warc-record-id"]),
        "url": field.get("warc-target-uri", ""),
        "digest": field["warc-payload-digest"].removeprefix("sha1:"),
        "refers_to": _page(field["warc-refers-to"]) if "warc-refers-to" in field else None,
        "payload_bytes": promised if kind == "revisit" else len(payload),
        "payload": None if kind == "revisit" else payload,
    }


def _page(urn: str) -> int | None:
    name = urn.strip("<>").removeprefix("urn:page:")
    return None if name == _NONE else int(name)


def pack(records: list[tuple[int | None, str | None, bytes]], zip64: bool = False) -> bytes:
    """An archive of compressed records (id, url, bytes), whose last byte, a newline, is its comment."""
    data, lines, at = [], [], 0
    for page_id, url, record in records:
        lines.append(json.dumps({"id": page_id, "url": url, "offset": at, "length": len(record), "filename": DATA}, separators=(",", ":")))
        data.append(record)
        at += len(record)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED, allowZip64=True) as z:
        for name, content in ((DATA, b"".join(data)), (INDEX, "\n".join(lines).encode()), ("datapackage.json", b'{"profile":"data-package","wacz_version":"1.1.1"}')):
            with z.open(zipfile.ZipInfo(name, (2024, 1, 1, 0, 0, 0)), "w", force_zip64=zip64) as f:
                f.write(content)
        z.comment = b"\n"
    return out.getvalue()


def index_entries(ranges: Ranges) -> Iterator[tuple[int, int]]:
    """(offset in the archive, length) for each line of the archive's index, which is read in parts."""
    members = read_directory(ranges)
    base, size = stored(ranges, members, DATA)
    at, left = stored(ranges, members, INDEX)
    rest = b""
    while left or rest:
        part = ranges.read(at, min(left, INDEX_BYTES))
        at, left = at + len(part), left - len(part)
        lines = (rest + part).split(b"\n")
        rest = lines.pop() if left else b""
        for line in lines:
            if not line.strip():
                continue
            entry = json.loads(line)
            if entry["offset"] < 0 or entry["offset"] + entry["length"] > size:
                raise ValueError("an index line points outside its member")
            yield base + entry["offset"], entry["length"]


def read_archive(ranges: Ranges) -> Iterator[tuple[int, int, dict]]:
    """(offset in the archive, length, record) for each line of the archive's index."""
    for at, length in index_entries(ranges):
        yield at, length, parse_record(ranges.read(at, length))


def scheme_of(path: str) -> str:
    head, colon, _ = path.partition(":/")
    return head if colon else "file"


def open_ranges(path: str):
    """A file of a scheme in RANGED, opened for reading ranges; path as Spark names it."""
    scheme = scheme_of(path)
    if scheme == "file":
        bare = path.removeprefix("file:")
        return pyarrow.fs.LocalFileSystem().open_input_file("/" + bare.lstrip("/"))
    system, bare = pyarrow.fs.FileSystem.from_uri(RANGED[scheme] + path[len(scheme) :])
    return system.open_input_file(bare)


# ---- Spark ----------------------------------------------------------------------------------


def plan_records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least: int = LEAST_REVISIT_BYTES) -> DataFrame:
    """(id, url, payload, digest, refers_to): refers_to is the largest id with an equal payload, for
    all other rows with it. Payloads are found equal by their SHA-1; only those that repeat come back."""
    rows = small_batches(pages).select(
        F.col(f"`{id_col}`").cast("long").alias("id"),
        F.col(f"`{url_col}`").cast("string").alias("url"),
        F.coalesce(F.col(f"`{payload_col}`"), F.lit("")).cast("binary").alias("payload"),
    ).withColumn("sha", F.sha1("payload"))
    small = rows.select("id", "sha", F.octet_length("payload").alias("size")).filter(F.col("size") >= least)
    again = small.groupBy("sha").agg(F.max("id").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1 and first is not null").select("sha", "first")
    joined = rows.join(again, "sha", "left")
    return joined.select("id", "url", "payload", F.when(F.col("first").isNotNull() & ~F.col("id").eqNullSafe(F.col("first")), F.col("first")).alias("refers_to"))


def write_archives(records: DataFrame, path: str, archive_bytes: int = ARCHIVE_BYTES) -> None:
    """Writes records (see plan_records) as archives under `path`, a new folder."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int | None, str | None, bytes]] = []
        size = 0
        for batch in batches:
            for page_id, url, payload, refers_to in zip(*(c.to_pylist() if i != 2 else c for i, c in enumerate(batch.columns))):
                payload = payload.as_py()
                record = write_record(page_id, url, payload, digest_of(payload), refers_to)
                if held and size + len(record) > archive_bytes:
                    yield pa.RecordBatch.from_arrays([pa.array([pack(held)[:-1]], pa.binary())], names=["archive"])
                    held, size = [], 0
                held.append((page_id, url, record))
                size += len(record)
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([pack(held)[:-1]], pa.binary())], names=["archive"])

    made = records.select("id", "url", "payload", "refers_to").mapInArrow(run, "archive binary")
    # The text writer puts the bytes down as they are, and the newline after them ends the archive.
    made.select(F.col("archive").cast("string")).write.option("maxRecordsPerFile", 1).option("compression", "none").text(path)


RECORD_SCHEMA = "path string, at long, length long, id long, url string, type string, digest string, refers_to long, payload_bytes long, intact boolean, payload binary"


def read_archives(spark: SparkSession, path: str, payloads: bool = True, run_bytes: int = RUN_BYTES) -> DataFrame:
    """The records of all archives under `path`, in RECORD_SCHEMA; intact: a response's payload has
    its digest. Without `payloads`, that column is null."""
    names = [x.split()[0] for x in RECORD_SCHEMA.split(", ")]
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.binary()]

    def records(name: str, found: Iterator[tuple[int, int, dict]]) -> Iterator[pa.RecordBatch]:
        def out(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

        rows, size = [], 0
        for at, length, r in found:
            intact = r["payload"] is None or digest_of(r["payload"]) == r["digest"]
            rows.append((name, at, length, r["id"], r["url"], r["type"], r["digest"], r["refers_to"], r["payload_bytes"], intact, r["payload"] if payloads else None))
            size += r["payload_bytes"]
            if size > RUN_BYTES or len(rows) >= RUN_RECORDS:
                yield out(rows)
                rows, size = [], 0
        if rows:
            yield out(rows)

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                yield from records(name, read_archive(BytesRanges(content.as_buffer())))

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(name: str, run: list[tuple[int, int]]) -> pa.RecordBatch:
            at, length = zip(*run)
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([at], pa.list_(pa.int64())), pa.array([length], pa.list_(pa.int64()))], names=["path", "at", "length"])

        for batch in batches:
            for name in batch.column(0).to_pylist():
                with open_ranges(name) as file:
                    run, size = [], 0
                    for at, length in index_entries(FileRanges(file)):
                        if run and (size + length > run_bytes or len(run) >= RUN_RECORDS):
                            yield out(name, run)
                            run, size = [], 0
                        run.append((at, length))
                        size += length
                    if run:
                        yield out(name, run)

    def ranged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, at, length in zip(*(c.to_pylist() for c in batch.columns)):
                with open_ranges(name) as file:
                    ranges = FileRanges(file)
                    yield from records(name, ((a, n, parse_record(ranges.read(a, n))) for a, n in zip(at, length)))

    files = spark.read.format("binaryFile").load(path)
    listed = files.agg(F.sum("length").alias("bytes"), F.min("path").alias("one")).first()
    if listed.one is not None and scheme_of(listed.one) not in RANGED:
        return files.select("path", "content").mapInArrow(whole, RECORD_SCHEMA)
    tasks = max(spark.sparkContext.defaultParallelism, -(-(listed.bytes or 0) // ARCHIVE_BYTES))
    dealt = files.select("path").mapInArrow(runs, "path string, at array<long>, length array<long>").repartition(tasks)
    return dealt.mapInArrow(ranged, RECORD_SCHEMA)
