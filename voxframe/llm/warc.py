"""WARC archives: a Spark writer with revisit records, and the PySpark data source "warc" to read them.

The source plans its partitions from the files' sizes, takes predicates on header fields, reads a record's head first
and decodes a payload only if the record is wanted and payloads are asked for. Records are gzip members of their own,
or plain. The writer notes a member's length in the gzip head (extra field "sl"), and the reader seeks over members and plain blocks that aren't wanted; in
archives of others, members without that note are inflated and dropped.

Every record type is read. The payload is what follows the HTTP head of a block of HTTP (chunks of the transfer joined), else the whole block; a revisit has
none. Digests are checked by the algorithm that they name, in base32 or hex. What is wrong with a record or an archive (cut, no record, a digest that doesn't hold or of an
unknown algorithm) stands in the column error, and the other archives are read on; with option errors=raise it ends the job.

Defined cases: null html is the empty payload; a null page_id is less than any other and has no header; a null url has
no header; of repeated rows that hold a payload's largest page_id each is a response; an empty table writes nothing and reads back empty; other columns
are not read. A page is written whole, whatever its length.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import uuid
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualNullSafe, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, IsNull, LessThan, LessThanOrEqual, StringStartsWith

from voxframe import files
from voxframe.operators.joins import spread_join
from voxframe.workspace import small_batches

#: Payload bytes of an archive, about; rows of an Arrow batch; bytes read at once, if payloads are wanted and if not; bytes inflated at once for a head.
FILE_BYTES, ROWS, CHUNK, FEW, HEAD = 256 << 20, 256, 1 << 18, 1 << 14, 1 << 12
SCHEMA = "record_id string, record_type string, page_id long, url string, date string, payload_bytes long, payload_digest string, refers_to long, payload binary, error string"
DATE = "1970-01-01T00:00:00Z"


def base32(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def _line(text: str) -> str:
    return text.replace("\r", "%0D").replace("\n", "%0A")


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None = None, revisit: bool = False, salt: str = "") -> bytes:
    """One record: a response with its payload, or a revisit without it."""
    own = uuid.uuid5(uuid.NAMESPACE_URL, f"{page_id}|{digest}|{salt}")
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", f"<urn:uuid:{own}>"), ("WARC-Date", DATE)]
    head += [("WARC-Target-URI", _line(url))] if url is not None else []
    head += [("X-Page-ID", page_id)] if page_id is not None else []
    head += [("X-Refers-To-Page-ID", refers_to)] if refers_to is not None else []
    head += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")] if revisit else []
    head += [("WARC-Payload-Digest", f"sha1:{digest}"), ("X-Payload-Length", len(payload)), ("Content-Type", "application/http;msgtype=response"), ("Content-Length", len(block))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + block + b"\r\n\r\n"


def member(data: bytes, level: int) -> bytes:
    """A gzip member that notes its compressed and its plain length."""
    deflate = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = deflate.compress(data) + deflate.flush()
    size = 24 + len(body) + 8
    if max(size, len(data)) >= 1 << 32:
        return zlib.compress(data, level, wbits=31)
    head = struct.pack("<4BI2BH2sHII", 0x1F, 0x8B, 8, 4, 0, 0, 255, 12, b"sl", 8, size, len(data))
    return head + body + struct.pack("<II", zlib.crc32(data), len(data))


def noted(head: bytes) -> tuple[int, int] | None:
    """The lengths that a gzip member notes, from its first bytes."""
    if len(head) < 24 or not head[3] & 4:
        return None
    at, end = 12, min(len(head), 12 + struct.unpack_from("<H", head, 10)[0])
    while at + 4 <= end:
        name, n = struct.unpack_from("<2sH", head, at)
        if name == b"sl" and n == 8 and at + 12 <= end:
            return struct.unpack_from("<II", head, at + 4)
        at += 4 + n
    return None


def roles(pages: DataFrame, min_bytes: int) -> DataFrame:
    """page_id and digest of the pages that repeat a payload of at least min_bytes, with the page_id that they refer to; only digests are shuffled."""
    own = pages.where(F.octet_length("html") >= min_bytes).select("page_id", F.sha1(F.col("html").cast("binary")).alias("digest"))
    first = own.groupBy("digest").agg(F.max("page_id").alias("to"), F.count("*").alias("n"))
    again = spread_join(own, first.where("n > 1"), "digest", "n", pages.count()).where(~F.col("page_id").eqNullSafe(F.col("to")))
    return again.select(F.col("page_id").alias("r_page"), F.col("digest").alias("r_digest"), "to").distinct()


def write(pages: DataFrame, folder: str, *, min_bytes: int = 0, compress: int | None = 1, file_bytes: int = FILE_BYTES) -> list[str]:
    """Writes a record for each row of pages (page_id, url, html) to archives below folder; their names."""
    small_batches(pages.sparkSession, ROWS)
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    again = roles(rows, min_bytes)
    rows = rows.withColumn("digest", F.sha1(F.col("html").cast("binary")))
    rows = rows.join(again, F.col("page_id").eqNullSafe(F.col("r_page")) & (F.col("digest") == F.col("r_digest")), "left").select("page_id", "url", "html", "digest", "to", F.col("r_digest").isNotNull().alias("revisit"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, names, chunks, size, at = TaskContext.get().partitionId(), [], [], 0, 0

        def flush() -> None:
            nonlocal chunks, size
            name = f"{folder}/part-{part:06d}-{len(names):06d}.warc{'' if compress is None else '.gz'}"
            files.write_whole(name, chunks)
            names.append(name)
            chunks, size = [], 0

        for b in batches:
            for page_id, url, html, digest, to, revisit in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), *(c.to_pylist() for c in b.columns[3:])):
                payload, at = html.as_buffer().to_pybytes(), at + 1
                data = record(page_id, url, payload, base32(bytes.fromhex(digest)), to, revisit, f"{part}.{at}")
                chunks.append(data if compress is None else member(data, compress))
                size += len(chunks[-1])
                if size >= file_bytes:
                    flush()
        if chunks:
            flush()
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string())], ["file"])

    return sorted(r.file for r in rows.mapInArrow(run, "file string").collect())  # a row a file


class _Stream:
    """Bytes of an archive that can be sought, inflated member by member, a piece at a time."""

    def __init__(self, source, chunk: int = CHUNK):
        self.source, self.chunk, self.out = source, chunk, bytearray()
        self.size = source.seek(0, 2)
        source.seek(0)
        self.raw, self.at = source.read(chunk), 0  # what is read but not inflated, and where it stands in the file
        self.gzip, self.inflate, self.end, self.plain = self.raw[:2] == b"\x1f\x8b", None, None, 0

    def more(self, most: int) -> bool:
        """Appends about `most` bytes to out; false at the end."""
        if not self.raw:
            self.raw = self.source.read(self.chunk)
        if not self.raw:
            if self.inflate:
                raise ValueError("the archive is cut in a member")
            return False
        if not self.gzip:
            self.out += self.raw
            self.at, self.raw = self.at + len(self.raw), b""
            return True
        if self.inflate is None:
            if len(self.raw) < 64:
                self.raw += self.source.read(self.chunk)
            sizes = noted(self.raw[:64])
            self.end, self.plain = (self.at + sizes[0], sizes[1]) if sizes and not self.out else (None, 0)
            self.inflate = zlib.decompressobj(31)
        try:
            self.out += self.inflate.decompress(self.raw, most)
        except zlib.error as e:
            raise ValueError(f"no gzip data: {e}") from e
        left = self.inflate.unused_data if self.inflate.eof else self.inflate.unconsumed_tail
        self.at, self.raw = self.at + len(self.raw) - len(left), left
        if self.inflate.eof:
            self.inflate = None
        return True

    def until(self, mark: bytes) -> bytes | None:
        """What comes before mark, which is taken too; None at the end."""
        seen = 0
        while (at := self.out.find(mark, max(0, seen - len(mark)))) < 0:
            seen = len(self.out)
            if not self.more(HEAD):
                if self.out.strip():
                    raise ValueError("the archive is cut in a head")
                return None
        out = bytes(self.out[:at])
        del self.out[: at + len(mark)]
        return out

    def take(self, n: int) -> bytes:
        while len(self.out) < n:
            if not self.more(max(HEAD, min(CHUNK, n - len(self.out)))):
                raise ValueError("the archive is cut in a block")
        out = bytes(self.out[:n])
        del self.out[:n]
        return out

    def skip(self, n: int, whole: int) -> None:
        """Goes past n bytes; whole: bytes of the record, which may be those of its member."""
        if len(self.out) >= n:
            del self.out[:n]
        elif not self.gzip or self.end and self.plain == whole:
            to = self.end if self.gzip else self.at + n - len(self.out)
            if to > self.size:
                raise ValueError("the archive is cut in a block")
            if to <= self.at + len(self.raw):
                self.raw = self.raw[to - self.at :]
            else:
                self.source.seek(to)
                self.raw = b""
            self.at, self.inflate = to, None
            self.out.clear()
        else:
            while n:
                if not self.out and not self.more(CHUNK):
                    raise ValueError("the archive is cut in a block")
                k = min(n, len(self.out))
                del self.out[:k]
                n -= k


def records(source, chunk: int = CHUNK) -> Iterator[tuple[dict[str, str], Callable[[], bytes]]]:
    """Head (names in lower case) and a function for the block of each record; blocks that aren't taken are skipped."""
    stream = _Stream(source, chunk)
    while (head := stream.until(b"\r\n\r\n")) is not None:
        size, lines = len(head) + 4, head.decode("utf-8", "replace").strip().split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no record begins here: {lines[0][:40]!r}")
        fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        left = fields.get("content-length", "")
        if not left.isdigit():
            raise ValueError(f"a record's length is {left!r}")
        left = int(left) + 4  # the block and two line ends
        size += left

        def block() -> bytes:
            nonlocal left
            n, left = left, 0
            return stream.take(n)[:-4]

        yield fields, block
        if left:
            stream.skip(left, size)


def payload_of(head: dict[str, str], block: bytes) -> bytes:
    """What follows the HTTP head, with the transfer's chunks joined; of other blocks the whole."""
    if not head.get("content-type", "").lower().startswith("application/http"):
        return block
    http, _, body = block.partition(b"\r\n\r\n")
    if not re.search(rb"^transfer-encoding:[^\r\n]*chunked", http, re.I | re.M):
        return body
    out, at = [], 0
    while m := re.compile(rb"([0-9a-fA-F]+)[^\r\n]*\r\n").match(body, at):
        n = int(m[1], 16)
        if not n:
            return b"".join(out)
        out.append(body[m.end() : m.end() + n])
        at = m.end() + n + 2
    return body  # says chunked but isn't


def checked(noted_digest: str | None, payload: bytes) -> tuple[str, str | None]:
    """The payload's digest in the algorithm and the form of the one in the head (SHA-1 in base32 without one), and what is wrong."""
    name, colon, want = (noted_digest or "").partition(":")
    kind = name.lower().replace("-", "") if colon else "sha1"
    if kind not in hashlib.algorithms_available or kind.startswith("shake"):
        return want, f"the digest's algorithm {name!r} is unknown"
    digest = hashlib.new(kind, payload).digest()
    own = digest.hex() if want.lower() == digest.hex() else base32(digest)
    return own, None if not noted_digest or own.rstrip("=") == want.rstrip("=") or own == want.lower() else "the payload's digest doesn't hold"


@dataclass
class FilePartition(InputPartition):
    files: list[str]


_TESTS: dict[type, Callable] = {
    EqualTo: lambda v, f: v is not None and v == f.value,
    EqualNullSafe: lambda v, f: v == f.value,
    In: lambda v, f: v is not None and v in f.value,
    IsNull: lambda v, f: v is None,
    IsNotNull: lambda v, f: v is not None,
    GreaterThan: lambda v, f: v is not None and v > f.value,
    GreaterThanOrEqual: lambda v, f: v is not None and v >= f.value,
    LessThan: lambda v, f: v is not None and v < f.value,
    LessThanOrEqual: lambda v, f: v is not None and v <= f.value,
    StringStartsWith: lambda v, f: v is not None and v.startswith(f.value),
}
_FIELDS = ("record_id", "record_type", "page_id", "url", "date", "payload_bytes", "payload_digest", "refers_to")


def _number(text: str | None) -> int | None:
    return int(text) if text and text.lstrip("-").isdigit() else None


def fields_of(head: dict[str, str]) -> dict:
    """The columns that a head tells."""
    digest = head.get("warc-payload-digest")
    return {
        "record_id": head.get("warc-record-id"),
        "record_type": head.get("warc-type"),
        "page_id": _number(head.get("x-page-id")),
        "url": head.get("warc-target-uri"),
        "date": head.get("warc-date"),
        "payload_bytes": _number(head.get("x-payload-length")),
        "payload_digest": digest and digest.partition(":")[2],
        "refers_to": _number(head.get("x-refers-to-page-id")),
    }


class WarcReader(DataSourceReader):
    """Options: path; payload (none, verify: length and digest are taken from the payload and the digest is checked, or full: as verify, and the column is filled); partition_bytes; errors (column or raise)."""

    def __init__(self, options: dict[str, str]):
        self.path, self.payload = options["path"], options.get("payload", "full")
        self.partition_bytes = int(options.get("partition_bytes", 128 << 20))
        self.tests: list[Filter] = []
        self.errors = options.get("errors", "column")
        if self.payload not in ("none", "verify", "full") or self.errors not in ("column", "raise"):
            raise ValueError("payload is none, verify or full; errors is column or raise")

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        # where payloads are read, their length and digest are worked out and a head's values say nothing about them
        told = _FIELDS if self.payload == "none" else [c for c in _FIELDS if c not in ("payload_bytes", "payload_digest")]
        for f in filters:
            if type(f) in _TESTS and len(f.attribute) == 1 and f.attribute[0] in told:
                self.tests.append(f)
            else:
                yield f

    def partitions(self) -> list[FilePartition]:
        """Files in order of name, small ones together up to partition_bytes."""
        out: list[list[str]] = []
        held = 0
        for name, size in files.list_files(self.path, ".warc") + files.list_files(self.path, ".warc.gz"):
            if not out or held + size > self.partition_bytes:
                out.append([])
                held = 0
            out[-1].append(name)
            held += size
        return [FilePartition(x) for x in out] or [FilePartition([])]

    def rows(self, name: str) -> Iterator[dict]:
        where, path = files.resolve(name)
        with where.open_input_file(path) as source:
            found = records(source, FEW if self.payload == "none" else CHUNK)
            while True:
                try:
                    head, block = next(found)
                    row = fields_of(head) | {"payload": None, "error": None}
                    if not all(_TESTS[type(f)](row[f.attribute[0]], f) for f in self.tests):
                        continue
                    if self.payload != "none" and row["record_type"] != "revisit":
                        body = payload_of(head, block())
                        digest, wrong = checked(head.get("warc-payload-digest"), body)
                        row |= {"payload_bytes": len(body), "payload_digest": digest, "payload": body if self.payload == "full" else None, "error": wrong and f"{name}, {row['record_id']}: {wrong}"}
                    yield row
                except StopIteration:
                    return
                except ValueError as e:
                    row = dict.fromkeys(_FIELDS) | {"payload": None, "error": f"{name}: {e}"}
                    if all(_TESTS[type(f)](None, f) for f in self.tests):
                        yield row
                    return

    def read(self, partition: FilePartition) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("record_id", pa.string()), ("record_type", pa.string()), ("page_id", pa.int64()), ("url", pa.string()), ("date", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary()), ("error", pa.string())])
        held, size = [], 0
        for name in partition.files:
            for row in self.rows(name):
                if row["error"] and self.errors == "raise":
                    raise ValueError(row["error"])
                held.append(row)
                size += len(row["payload"] or b"")
                if len(held) >= 2000 or size >= 8 << 20:
                    yield pa.RecordBatch.from_pylist(held, schema)
                    held, size = [], 0
        if held:
            yield pa.RecordBatch.from_pylist(held, schema)


class WarcDataSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WarcReader:
        return WarcReader(self.options)


def read(spark: SparkSession, folder: str, payload: str = "full", **options: str) -> DataFrame:
    """The records below folder. Turns on the session's setting by which Python data sources are given predicates."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcDataSource)
    return spark.read.format("warc").options(path=folder, payload=payload, **options).load()
