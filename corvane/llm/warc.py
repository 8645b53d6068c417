"""Web archives (WARC 1.1) as a Python data source that reads and writes.

Reading: file partitions are planned on the driver (small files together).
Equality and membership predicates on ``record_type`` and the other header
columns are pushed down: each record's headers are parsed first, and the
payload of a record that fails, or of any record with option ``payload=false``,
is neither decompressed nor decoded; only the HTTP headers before it are. Compressed files hold one gzip member for
each record; the member's extra field ``sl`` gives its length, so a reader can
skip it. Members without that field are read through.

Writing: each task writes its own files under a temporary name, and the commit
renames them; a lost or repeated task leaves nothing that a reader sees.

Paths are opened by pyarrow's file systems (``file:``, ``hdfs:``, ``s3:`` ..).

Defined results: a null payload is an empty one; a null URL or id leaves its
header out, and is null again when read; line ends in header values are
percent-encoded; records of other kinds give their block as payload; a record
whose ``Content-Length`` is missing or no number has a null length, and ends where
its gzip member ends or the next record begins; a payload may have any length that fits a value of a table; rows of one id are records each, and of equal payloads with the smallest id
all rows of that id are responses; columns other than these are ignored; an empty table writes no file, and a folder without archives reads as no rows.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import Any, BinaryIO

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, In, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from corvane.llm.common import batches_of, cut, scratch, small

READ = "record_id string, record_type string, target_uri string, date string, payload_digest string, refers_to string, http_length long, content_length long, payload binary, file string, offset long"
WRITE = "record_id string, record_type string, target_uri string, payload_digest string, refers_to string, payload binary"

# Fixed values of the format.
VERSION = b"WARC/1.1\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
NAMES = {"record_id": "warc-record-id", "record_type": "warc-type", "target_uri": "warc-target-uri", "date": "warc-date", "payload_digest": "warc-payload-digest", "refers_to": "warc-refers-to"}

DATE = "2024-01-01T00:00:00Z"
SPLIT_BYTES, FILE_BYTES = 32 << 20, 256 << 20
BATCH_BYTES, BATCH_ROWS = 8 << 20, 2000
#: Rows that a writer is handed, and turns into records, at once.
WRITE_ROWS, WRITE_SLICE = 512, 32
#: HTTP headers are looked for in so many bytes.
HTTP_HEAD = 1 << 16
END = b"\r\n\r\n"


def open_path(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if ":/" in path else (fs.LocalFileSystem(), path)


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(values: dict[str, Any], date: str = DATE) -> bytes:
    """A whole record; ``payload`` is left out of a revisit, whose HTTP headers still tell its length."""
    payload = values.get("payload") or b""
    clean = lambda x: str(x).replace("\r", "%0D").replace("\n", "%0A")
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    revisit = values["record_type"] == "revisit"
    block = http if revisit else http + payload
    lines = [f"WARC-Type: {clean(values['record_type'])}"]
    if values.get("record_id") is not None:
        lines.append(f"WARC-Record-ID: <{clean(values['record_id'])}>")
    lines.append(f"WARC-Date: {date}")
    if values.get("target_uri") is not None:
        lines.append(f"WARC-Target-URI: {clean(values['target_uri'])}")
    lines.append(f"WARC-Payload-Digest: sha1:{values.get('payload_digest') or payload_digest(payload)}")
    if revisit:
        lines.append(f"WARC-Profile: {PROFILE}")
    if values.get("refers_to") is not None:
        lines.append(f"WARC-Refers-To: <{clean(values['refers_to'])}>")
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return VERSION + "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(data: bytes, level: int = 1) -> bytes:
    """A gzip member whose extra field tells its own and the record's length."""
    packer = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = packer.compress(data) + packer.flush()
    total = 10 + 2 + 12 + len(body) + 8
    if total >= 1 << 32 or len(data) >= 1 << 32:
        return b"\x1f\x8b\x08\x00\x00\x00\x00\x00\x00\xff" + body + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)
    extra = b"sl" + struct.pack("<HII", 8, total, len(data))
    return b"\x1f\x8b\x08\x04\x00\x00\x00\x00\x00\xff" + struct.pack("<H", len(extra)) + extra + body + struct.pack("<II", zlib.crc32(data), len(data))


def _headers(data: bytes) -> dict[str, str]:
    out: dict[str, str] = {}
    name = ""
    for line in data.split(b"\r\n")[1:]:
        text = line.decode("utf-8", "replace")
        if text[:1] in (" ", "\t") and name:  # a folded line
            out[name] += " " + text.strip()
        elif ":" in text:
            name, _, value = text.partition(":")
            name = name.strip().lower()
            out[name] = value.strip()
    return out


@dataclass
class Plan:
    """What a reader wants: allowed values by column, whether payloads, whether to check digests."""

    allowed: dict[str, set] = field(default_factory=dict)
    payload: bool = True
    verify: bool = False

    def values(self, headers: dict[str, str]) -> dict[str, Any] | None:
        """The header columns, or nothing if the record isn't wanted."""
        out: dict[str, Any] = {c: headers.get(n) for c, n in NAMES.items()}
        for c in ("record_id", "refers_to"):
            out[c] = out[c].removeprefix("<").removesuffix(">") if out[c] is not None else None
        if out["payload_digest"] is not None:
            out["payload_digest"] = out["payload_digest"].rpartition(":")[2]
        out["content_length"] = _length(headers)
        return None if any(out[c] not in v for c, v in self.allowed.items()) else out

    def finish(self, out: dict[str, Any], block: bytes, headers: dict[str, str]) -> dict[str, Any]:
        """Adds what the block holds; without payloads, ``block`` is its beginning."""
        http, payload = {}, block
        if headers.get("content-type", "").startswith("application/http"):
            head, _, payload = block.partition(END)
            http = _headers(head)
        out["http_length"] = _length(http)
        out["payload"] = payload if self.payload and out["record_type"] != "revisit" else None
        if self.verify and out["payload"] is not None and out["payload_digest"] not in (None, payload_digest(payload)):
            raise ValueError(f"the payload of {out['record_id']} has another digest")
        return out


def _length(headers: dict[str, str]) -> int | None:
    """``Content-Length``, if it is a number that a file can have."""
    text = headers.get("content-length", "")
    return int(text) if text.isascii() and text.isdigit() and len(text) < 19 else None


def _next(f: BinaryIO, start: int, size: int) -> int:
    """Where a block that begins at ``start`` ends, before the next record or the end of the file."""
    at, before = start, b""
    while at < size:
        f.seek(at)
        data = before + f.read(1 << 20)
        if (found := data.find(END + b"WARC/")) >= 0:
            return at - len(before) + found
        at, before = at - len(before) + len(data), data[-8:]
    f.seek(max(start, size - 4))
    return max(start, size - 4) if f.read(4) == END else size


def _plain(f: BinaryIO, size: int, plan: Plan) -> Iterator[dict[str, Any]]:
    at = 0
    while at < size:
        f.seek(at)
        head = f.read(4096)
        while END not in head:
            more = f.read(65536)
            if not more:
                if head.strip(b"\r\n"):
                    raise ValueError(f"a record that begins at {at} is cut off")
                return
            head += more
        head = head[: head.index(END)]
        headers = _headers(head)
        start = at + len(head) + 4
        if (length := _length(headers)) is None:
            length = _next(f, start, size) - start
        if (out := plan.values(headers)) is not None:
            out["offset"] = at
            f.seek(start)
            block = f.read(length if plan.payload else min(length, HTTP_HEAD))
            if plan.payload and len(block) < length:
                raise ValueError(f"a record that begins at {at} is cut off")
            yield plan.finish(out, block, headers)
        at = start + length + 4


def _member_size(head: bytes) -> tuple[int, int]:
    """Where a member's data begin, and its length if it tells it, else 0."""
    flags, at, size = head[3], 10, 0
    if flags & 4:
        (n,) = struct.unpack_from("<H", head, at)
        at, end = at + 2, at + 2 + n
        while at + 4 <= end:
            (m,) = struct.unpack_from("<H", head, at + 2)
            if head[at : at + 2] == b"sl" and m == 8:
                (size,) = struct.unpack_from("<I", head, at + 4)
            at += 4 + m
        at = end
    for flag in (8, 16):
        if flags & flag:
            at = head.index(b"\0", at) + 1
    return at + 2 * bool(flags & 2), size


def _packed(f: BinaryIO, size: int, plan: Plan) -> Iterator[dict[str, Any]]:
    at = 0
    while at < size:
        f.seek(at)
        raw = f.read(16384)
        begin, whole = _member_size(raw)
        inflate, text, taken = zlib.decompressobj(-15), b"", len(raw)
        raw = raw[begin:]
        while END not in text:
            text += inflate.decompress(raw, 16384)
            raw = inflate.unconsumed_tail
            if not raw and END not in text:
                raw = f.read(65536)
                taken += len(raw)
                if not raw or inflate.eof:
                    raise ValueError(f"a record that begins at {at} is cut off")
        head, _, block = text.partition(END)
        headers = _headers(head)
        length = _length(headers)
        out = plan.values(headers)
        kept, got = [block] if out is not None else [], len(block)
        # all of a wanted payload, else the HTTP headers before it; a member that doesn't tell its length is read through
        while not inflate.eof:
            enough = out is None or (not plan.payload and (got >= HTTP_HEAD or END in b"".join(kept)))
            if enough and whole:
                break
            if not raw:
                raw = f.read(1 << 20)
                taken += len(raw)
                if not raw:
                    raise ValueError(f"a record that begins at {at} is cut off")
            more = inflate.decompress(raw, 1 << 22 if plan.payload else 1 << 14)
            raw = inflate.unconsumed_tail
            got += len(more)
            if not enough:
                kept.append(more)
        if inflate.eof and length is not None and got < length:
            raise ValueError(f"a record that begins at {at} is cut off")
        if out is not None:
            out["offset"] = at
            block = b"".join(kept)
            yield plan.finish(out, block.removesuffix(END) if length is None else block[:length], headers)
        at = at + whole if whole else at + taken - len(inflate.unused_data) + 8


def records(path: str, plan: Plan) -> Iterator[dict[str, Any]]:
    """Wanted records of one file."""
    system, own = open_path(path)
    with system.open_input_file(own) as f:
        for out in (_packed if own.endswith(".gz") else _plain)(f, f.size(), plan):
            out["file"] = path
            yield out


@dataclass
class Files(InputPartition):
    paths: list[str]

    def __init__(self, paths: list[str]):
        self.paths = paths


class WarcReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path = options["path"]
        self.split = int(options.get("split_bytes", SPLIT_BYTES))
        self.plan = Plan({}, options.get("payload", "true").lower() != "false", options.get("verify", "false").lower() == "true")

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            column = f.attribute[0] if hasattr(f, "attribute") and len(f.attribute) == 1 else None
            if column in NAMES and isinstance(f, (EqualTo, In)):
                values = set(f.value) if isinstance(f, In) else {f.value}
                values.discard(None)
                self.plan.allowed[column] = self.plan.allowed[column] & values if column in self.plan.allowed else values
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        system, own = open_path(self.path)
        prefix = self.path[: len(self.path) - len(own)] if self.path.endswith(own) else ""
        info = system.get_file_info(own)
        found = [info] if info.type == fs.FileType.File else system.get_file_info(fs.FileSelector(own, allow_not_found=True, recursive=True))
        parts, last = [], self.split
        for x in sorted((x for x in found if x.type == fs.FileType.File and x.path.endswith((".warc", ".warc.gz"))), key=lambda x: x.path):
            if last + x.size > self.split:
                parts.append(Files([]))
                last = 0
            parts[-1].paths.append(prefix + x.path)
            last += x.size
        return parts or [Files([])]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        for path in partition.paths:
            for out in records(path, self.plan):
                rows.append(out)
                size += len(out.get("payload") or b"")
                if size >= BATCH_BYTES or len(rows) >= BATCH_ROWS:
                    yield _batch(rows)
                    rows, size = [], 0
        if rows:
            yield _batch(rows)


_TYPES = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}
_SCHEMA = pa.schema([(n, _TYPES[t]) for n, t in (c.split() for c in READ.split(", "))])


def _batch(rows: list[dict[str, Any]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r.get(f.name) for r in rows], f.type) for f in _SCHEMA], schema=_SCHEMA)


@dataclass
class Written(WriterCommitMessage):
    files: list[str]


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, options: dict[str, str], overwrite: bool):
        self.path, self.overwrite = options["path"].rstrip("/"), overwrite
        self.packed = options.get("compression", "gzip") == "gzip"
        self.most = int(options.get("file_bytes", FILE_BYTES))

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        system, own = open_path(self.path)
        files: list[str] = []
        out, size = None, 0
        for row in (r for batch in iterator for i in range(0, batch.num_rows, WRITE_SLICE) for r in batch.slice(i, WRITE_SLICE).to_pylist()):
            if out is None or size >= self.most:
                if out is not None:
                    out.close()
                system.create_dir(own, recursive=True)
                files.append(f"part-{uuid.uuid4().hex}.warc{'.gz' if self.packed else ''}")
                out, size = system.open_output_stream(f"{own}/_{files[-1]}.tmp", compression=None), 0
            data = record(row)
            data = member(data) if self.packed else data
            out.write(data)
            size += len(data)
        if out is not None:
            out.close()
        return Written(files)

    def commit(self, messages: list[Written | None]) -> None:
        system, own = open_path(self.path)
        new = [f for m in messages if m is not None for f in m.files]
        if self.overwrite:
            for x in system.get_file_info(fs.FileSelector(own, allow_not_found=True)):
                if x.path.endswith((".warc", ".warc.gz")):
                    system.delete_file(x.path)
        for f in new:
            system.move(f"{own}/_{f}.tmp", f"{own}/{f}")

    def abort(self, messages: list[Written | None]) -> None:
        system, own = open_path(self.path)
        for f in (f for m in messages if m is not None for f in m.files):
            system.delete_file(f"{own}/_{f}.tmp")


class WarcSource(DataSource):
    """``spark.read.format("warc")`` and ``df.write.format("warc")`` after ``register``."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return READ

    def reader(self, schema: StructType) -> WarcReader:
        return WarcReader(self.options)

    def writer(self, schema: StructType, overwrite: bool) -> WarcWriter:
        return WarcWriter(self.options, overwrite)


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)


def with_revisits(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Records for ``pages`` (``page_id, url, html``): of equal payloads the page with the smallest id is the response, others revisit it.

    Payloads are compared by their SHA-1. Only digests are shuffled, and counted before that; the payloads themselves
    stay in place unless more digests repeat than may be broadcast.
    """
    rows = pages.select("page_id", "url", F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("payload")).withColumn("__sha", F.sha1("payload"))
    long = rows.filter(F.octet_length("payload") >= least_bytes)
    repeated = long.groupBy("__sha").agg(F.min("page_id").alias("__first"), F.count(F.lit(1)).alias("__n")).filter("__n > 1").select(F.col("__sha").alias("__of"), "__first")
    repeated = cut(repeated, "repeated")  # payloads are hashed for it once
    joined = rows.join(small(repeated), F.col("__sha") == F.col("__of"), "left")
    again = F.coalesce((F.octet_length("payload") >= least_bytes) & ((F.col("page_id") > F.col("__first")) | (F.col("page_id").isNull() & F.col("__first").isNotNull())), F.lit(False))
    name = lambda c: F.concat(F.lit("urn:page:"), c.cast("string"))
    return joined.select(
        name(F.col("page_id")).alias("record_id"),
        F.when(again, "revisit").otherwise("response").alias("record_type"),
        F.col("url").alias("target_uri"),
        F.lit(None).cast("string").alias("payload_digest"),
        F.when(again, name(F.col("__first"))).alias("refers_to"),
        "payload",
    )


def round_trip(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Archive ``pages`` in the shared folder, read the archives back, and tell what each page's record says."""
    spark = pages.sparkSession
    register(spark)
    path = scratch(spark, "warc")
    with batches_of(spark, WRITE_ROWS):
        with_revisits(pages, least_bytes).write.format("warc").mode("append").save(path)
    number = lambda c: F.regexp_extract(c, r"^urn:page:(-?[0-9]+)$", 1).try_cast("long")
    # both predicates are pushed down: payloads are read of responses, of revisits only the headers
    kinds = (("response", {"verify": "true"}, F.octet_length("payload")), ("revisit", {"payload": "false"}, F.col("http_length")))
    parts = [
        spark.read.format("warc")
        .options(**options)
        .load(path)
        .filter(F.col("record_type") == kind)
        .select(number(F.col("record_id")).alias("page_id"), size.cast("long").alias("payload_bytes"), "payload_digest", "record_type", number(F.col("refers_to")).alias("refers_to"))
        for kind, options, size in kinds
    ]
    return parts[0].unionByName(parts[1])
