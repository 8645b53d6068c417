"""Token ids in patched frame-of-reference files: a Python data source that writes and reads them.

A file holds the ids of its documents one after the other, cut into blocks of
``BLOCK`` ids. A block stores its smallest id and the differences to it, packed at the
width that ``PERCENTILE`` per cent of them fit in; the high bits of the others, the
exceptions, stand in a list behind them with their places. An index tells where each
block starts, and a table each document's id and length, so a reader of a few
documents fetches their blocks only.

``write`` puts documents into ascending order of ``doc_id`` by ranges, and each task writes files of its own
under a temporary name. The commit renames them and writes a manifest that tells
the files' order and how many ids stand before each; what a lost or repeated
task leaves is in no manifest. The driver holds one line for each file.

Layout of a file, all numbers little-endian: ``MAGIC``; blocks; for each block its start (64 bits); for each
document its id and length (64 bits each); numbers of ids, of documents and where the index begins (64 bits each); ``MAGIC``. A block:
smallest id (32 bits), width (8), number of exceptions (8); packed differences, ``4 * width`` words of 32 bits (value ``4 * i + j`` lies in
lane ``j`` from bit ``i * width`` on); places (8 bits each) and high bits (32 each) of the exceptions. The last block is filled up with its smallest id.

Predicates on ``doc_id`` choose files by the manifest, and documents by their table.

Defined results: a null or empty text has the end id only; rows of one id stand together, by checksum of their text; a null id sorts first
and is null again; ids are unsigned 32-bit numbers; an empty table writes no file, and a folder without manifest reads as no rows;
other columns are ignored; texts and documents may have any length.
"""

from __future__ import annotations

import json
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import Any

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage
from pyspark.sql.types import StructType

from corvane.llm.common import batches_of, bound_batches, plain
from corvane.llm.packing import encoder
from corvane.llm.warc import open_path

MAGIC = b"PFOR0001"
BLOCK, LANES, PERCENTILE = 128, 4, 90
#: Ids that a writer packs, and a reader unpacks, at once; a file's ids after which another is begun.
PACK_IDS, FILE_IDS = 1 << 19, 1 << 25
#: Ids of a batch that a reader hands on, at least as many as one document has.
BATCH_IDS, BATCH_DOCS = 1 << 20, 4096
#: Texts encoded together, and rows that workers are handed at once.
SLICE, ROWS_AT_ONCE = 128, 512
#: Words whose ids a worker keeps, also from one task to the next: some 200 bytes each.
KEPT_WORDS = 400_000
#: What stands for a null ``doc_id``.
NULL_ID = -(1 << 63)

_HEAD = np.dtype([("low", "<u4"), ("width", "u1"), ("patches", "u1")])
_STEPS = BLOCK // LANES


def _bits(x: np.ndarray) -> np.ndarray:
    """How many bits each number needs."""
    return np.frexp(x.astype(np.float64))[1].astype(np.uint8)


def _lay(values: np.ndarray, width: int) -> np.ndarray:
    """``k`` blocks of ``BLOCK`` numbers below ``2 ** width`` as ``k`` rows of packed words."""
    v = np.ascontiguousarray(values.reshape(len(values), _STEPS, LANES).transpose(1, 0, 2))
    out = np.zeros((width, len(values), LANES), np.uint32)
    for i in range(_STEPS):
        word, shift = divmod(i * width, 32)
        out[word] |= v[i] << np.uint32(shift)
        if shift + width > 32:
            out[word + 1] |= v[i] >> np.uint32(32 - shift)
    return np.ascontiguousarray(out.transpose(1, 0, 2)).reshape(len(values), -1)


def _lift(words: np.ndarray, width: int) -> np.ndarray:
    """The numbers that ``_lay`` packed."""
    w = np.ascontiguousarray(words.reshape(len(words), width, LANES).transpose(1, 0, 2))
    out, mask = np.zeros((_STEPS, len(words), LANES), np.uint32), np.uint32((1 << width) - 1)
    for i in range(_STEPS if width else 0):
        word, shift = divmod(i * width, 32)
        own = w[word] >> np.uint32(shift)
        if shift + width > 32:
            own = own | w[word + 1] << np.uint32(32 - shift)
        out[i] = own & mask
    return out.transpose(1, 0, 2).reshape(len(words), BLOCK)


def _spans(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """All places of spans, one after the other."""
    return np.arange(int(sizes.sum())) + np.repeat(starts - np.cumsum(sizes) + sizes, sizes)


def pack(ids: np.ndarray, percentile: int = PERCENTILE) -> tuple[bytes, np.ndarray]:
    """Blocks of ``ids``, and each block's size in bytes."""
    k = -(-len(ids) // BLOCK)
    x = np.zeros(k * BLOCK, np.uint32)
    x[: len(ids)] = ids
    if len(ids) < len(x):
        x[len(ids) :] = ids[(k - 1) * BLOCK :].min()
    x = x.reshape(k, BLOCK)
    low = x.min(1)
    x = x - low[:, None]
    nth = -(-BLOCK * percentile // 100) - 1
    width = _bits(np.partition(x, nth, axis=1)[:, nth])
    mask = ((np.uint64(1) << width.astype(np.uint64)) - np.uint64(1)).astype(np.uint32)
    row, place = np.nonzero(x > mask[:, None])
    patches = np.bincount(row, minlength=k)
    packed = 4 * LANES * width.astype(np.int64)
    sizes = _HEAD.itemsize + packed + 5 * patches
    starts = np.cumsum(sizes) - sizes
    out = np.zeros(int(sizes.sum()), np.uint8)
    head = np.zeros(k, _HEAD)
    head["low"], head["width"], head["patches"] = low, width, patches
    out[starts[:, None] + np.arange(_HEAD.itemsize)] = head.view(np.uint8).reshape(k, -1)
    for w in np.unique(width[width > 0]).tolist():
        own = np.flatnonzero(width == w)
        words = _lay(x[own] & mask[own, None], w).astype("<u4", copy=False).view(np.uint8)
        for r, at in zip(words, (starts[own] + _HEAD.itemsize).tolist(), strict=True):
            out[at : at + len(r)] = r
    if len(row):
        begin = starts + _HEAD.itemsize + packed
        out[_spans(begin, patches)] = place
        high = (x[row, place] >> width[row]).astype("<u4")
        out[_spans(begin + patches, 4 * patches)] = high.view(np.uint8)
    return out.tobytes(), sizes


def unpack(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The ids of the blocks that start there."""
    head = data[starts[:, None] + np.arange(_HEAD.itemsize)].view(_HEAD)[:, 0]
    width, patches, k = head["width"], head["patches"].astype(np.int64), len(starts)
    x = np.zeros((k, BLOCK), np.uint32)
    for w in np.unique(width[width > 0]).tolist():
        own = np.flatnonzero(width == w)
        at, size = (starts[own] + _HEAD.itemsize).tolist(), 4 * LANES * w
        words = np.stack([data[a : a + size] for a in at]).view("<u4").astype(np.uint32, copy=False)
        x[own] = _lift(words, w)
    if patches.any():
        begin = starts + _HEAD.itemsize + 4 * LANES * width.astype(np.int64)
        row = np.repeat(np.arange(k), patches)
        place = data[_spans(begin, patches)]
        high = data[_spans(begin + patches, 4 * patches)].view("<u4").astype(np.uint32)
        x[row, place] |= high << width[row].astype(np.uint32)
    return (x + head["low"][:, None]).reshape(-1)


class _File:
    """A file that is being written; ids are packed as soon as there are ``PACK_IDS`` of them."""

    def __init__(self, out: Any):
        self.out, self.at = out, len(MAGIC)
        self.held: list[bytes] = []
        self.n_held = self.n_ids = 0
        self.docs: list[tuple[int, int]] = []
        self.sizes: list[np.ndarray] = []
        out.write(MAGIC)

    def add(self, doc_id: int | None, ids: bytes) -> None:
        self.docs.append((NULL_ID if doc_id is None else doc_id, len(ids) // 4))
        self.held.append(ids)
        self.n_held += len(ids) // 4
        self.n_ids += len(ids) // 4
        if self.n_held >= PACK_IDS:
            self._pack(self.n_held // BLOCK * BLOCK)

    def _pack(self, n: int) -> None:
        ids = np.frombuffer(b"".join(self.held), "<u4")
        for at in range(0, n, PACK_IDS):
            data, sizes = pack(ids[at : min(at + PACK_IDS, n)])
            self.out.write(data)
            self.sizes.append(sizes)
        self.held, self.n_held = [ids[n:].tobytes()], len(ids) - n

    def close(self) -> None:
        if self.n_held:
            self._pack(self.n_held)
        sizes = np.concatenate(self.sizes or [np.zeros(0, np.int64)])
        index = len(MAGIC) + int(sizes.sum())
        self.out.write((len(MAGIC) + np.cumsum(sizes) - sizes).astype("<u8").tobytes())
        self.out.write(np.array(self.docs, "<i8").tobytes())
        self.out.write(struct.pack("<QQQ", self.n_ids, len(self.docs), index) + MAGIC)
        self.out.close()


@dataclass
class Bounds:
    """Which ids of documents are wanted: a range, and perhaps a set."""

    low: int = -(1 << 63)
    high: int = (1 << 63) - 1
    among: set[int] | None = None

    def narrow(self, f: Filter) -> None:
        value = getattr(f, "value", None)
        if isinstance(f, In):
            values = {v for v in value if v is not None}
            self.among = values if self.among is None else self.among & values
        elif isinstance(f, EqualTo):
            self.low, self.high = max(self.low, value), min(self.high, value)
        elif isinstance(f, (GreaterThan, GreaterThanOrEqual)):
            self.low = max(self.low, value + isinstance(f, GreaterThan))
        elif isinstance(f, (LessThan, LessThanOrEqual)):
            self.high = min(self.high, value - isinstance(f, LessThan))

    @property
    def all(self) -> bool:
        return self.among is None and self.low == -(1 << 63) and self.high == (1 << 63) - 1

    def meets(self, first: int, last: int) -> bool:
        return self.low <= last and first <= self.high and (self.among is None or any(first <= v <= last for v in self.among))

    def of(self, ids: np.ndarray) -> np.ndarray:
        """Which are wanted; the null id is none of a range."""
        if self.all:
            return np.ones(len(ids), bool)
        inside = (ids >= self.low) & (ids <= self.high) & (ids != NULL_ID)
        return inside if self.among is None else inside & np.isin(ids, np.array(sorted(self.among), np.int64))


def documents(f: Any, bounds: Bounds, batch_ids: int = BATCH_IDS) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Batches of wanted documents of a file: ids of documents, ids of tokens before each in the file, sizes, and all their token ids."""
    tail = len(MAGIC) + 24
    f.seek(f.size() - tail)
    end = f.read(tail)
    f.seek(0)
    if end[24:] != MAGIC or f.read(len(MAGIC)) != MAGIC:
        raise ValueError("not a whole token file")
    n_ids, n_docs, index = struct.unpack("<QQQ", end[:24])
    f.seek(index)
    n_blocks = -(-n_ids // BLOCK)
    starts = np.append(np.frombuffer(f.read(8 * n_blocks), "<u8").astype(np.int64), index)
    table = np.frombuffer(f.read(16 * n_docs), "<i8").reshape(-1, 2)
    who, size = table[:, 0], table[:, 1]
    before = np.cumsum(size) - size
    chosen = np.flatnonzero(bounds.of(who))
    # neighbouring documents are read together, up to so many ids
    group = np.cumsum(size[chosen]) // batch_ids + np.arange(len(chosen)) // BATCH_DOCS + np.cumsum(np.diff(chosen, prepend=chosen[:1]) > 1)
    for own in np.split(chosen, np.flatnonzero(np.diff(group)) + 1) if len(chosen) else []:
        first, last = before[own[0]] // BLOCK, -(-(before[own[-1]] + size[own[-1]]) // BLOCK)
        f.seek(int(starts[first]))
        data = np.frombuffer(f.read(int(starts[last] - starts[first])), np.uint8)
        parts = [unpack(data, starts[at : min(at + PACK_IDS // BLOCK, last)] - starts[first]) for at in range(first, last, PACK_IDS // BLOCK)]
        begin = before[own[0]] - first * BLOCK
        yield who[own], before[own], size[own], np.concatenate(parts)[begin : begin + int(size[own].sum())]


READ = "doc_id long, start long, n_tokens long, ids {}"
WRITE = "doc_id long, ids binary"


@dataclass
class Part(InputPartition):
    path: str
    start: int

    def __init__(self, path: str, start: int):
        self.path, self.start = path, start


class TokenReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.binary = options["path"].rstrip("/"), options.get("ids", "array") == "binary"
        self.bounds = Bounds()

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if getattr(f, "attribute", None) == ("doc_id",) and (isinstance(f, In) or (isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)) and f.value is not None)):
                self.bounds.narrow(f)
            yield f  # Spark asks again

    def partitions(self) -> list[InputPartition]:
        found, start = [], 0
        for x in manifest(self.path):
            if self.bounds.meets(x["first"], x["last"]):
                found.append(Part(f"{self.path}/{x['file']}", start))
            start += x["n_ids"]
        return found or [Part("", 0)]

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        system, own = open_path(partition.path)
        with system.open_input_file(own) as f:
            for who, before, size, ids in documents(f, self.bounds):
                edge = np.concatenate([[0], np.cumsum(size)])
                data = ids.astype("<u4", copy=False).tobytes()
                if self.binary:
                    values = pa.Array.from_buffers(pa.binary(), len(who), [None, pa.py_buffer((4 * edge).astype(np.int32)), pa.py_buffer(data)])
                else:
                    values = pa.ListArray.from_arrays(pa.array(edge, pa.int32()), pa.Array.from_buffers(pa.int32(), len(ids), [None, pa.py_buffer(data)]))
                yield pa.RecordBatch.from_arrays([pa.array(who, pa.int64(), mask=who == NULL_ID), pa.array(before + partition.start), pa.array(size), values], ["doc_id", "start", "n_tokens", "ids"])
        pa.default_memory_pool().release_unused()


def manifest(path: str) -> list[dict[str, Any]]:
    """``file, first, last, n_docs, n_ids`` of the files in their order."""
    system, own = open_path(path)
    names = sorted(x.path for x in system.get_file_info(fs.FileSelector(own, allow_not_found=True)) if x.base_name.startswith("manifest-"))
    out: list[dict[str, Any]] = []
    for name in names:
        with system.open_input_stream(name) as f:
            out += map(json.loads, f.read().decode().splitlines())
    return out


@dataclass
class Written(WriterCommitMessage):
    files: list[dict[str, Any]] = field(default_factory=list)


class TokenWriter(DataSourceArrowWriter):
    """Rows ``doc_id, ids`` (little-endian unsigned 32-bit numbers); those of a task in their order, tasks in theirs."""

    def __init__(self, options: dict[str, str], overwrite: bool):
        self.path, self.overwrite = options["path"].rstrip("/"), overwrite
        self.most = int(options.get("file_ids", FILE_IDS))

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        system, own = open_path(self.path)
        task, files = TaskContext.get().partitionId(), []
        file: _File | None = None

        def close() -> None:
            file.close()
            who = [d for d, _ in file.docs]
            files[-1] |= {"first": min(who), "last": max(who), "n_docs": len(who), "n_ids": file.n_ids}

        for batch in iterator:
            for who, ids in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if file is None or file.n_ids >= self.most:
                    if file is not None:
                        close()
                    system.create_dir(own, recursive=True)
                    files.append({"task": task, "file": f"part-{task:06d}-{len(files):03d}-{uuid.uuid4().hex}.pfor"})
                    file = _File(system.open_output_stream(f"{own}/_{files[-1]['file']}.tmp", compression=None, buffer_size=1 << 20))
                file.add(who, ids.as_py())
            pa.default_memory_pool().release_unused()
        if file is not None:
            close()
        return Written(files)

    def commit(self, messages: list[Written | None]) -> None:
        """Renames the files, then writes the manifest, which makes them part of the table; files of earlier manifests stand before."""
        system, own = open_path(self.path)
        new = sorted((x for m in messages if m is not None for x in m.files), key=lambda x: (x["task"], x["file"]))
        old = [x for x in system.get_file_info(fs.FileSelector(own, allow_not_found=True)) if x.base_name.startswith("manifest-") or x.base_name.endswith(".pfor")]
        if self.overwrite:
            for x in old:
                system.delete_file(x.path)
            old = []
        if not new:
            return
        for x in new:
            system.move(f"{own}/_{x['file']}.tmp", f"{own}/{x['file']}")
        data = "".join(json.dumps({k: x[k] for k in ("file", "first", "last", "n_docs", "n_ids")}) + "\n" for x in new).encode()
        number = sum(x.base_name.startswith("manifest-") for x in old)
        with system.open_output_stream(f"{own}/_manifest.tmp", compression=None) as f:
            f.write(data)
        system.move(f"{own}/_manifest.tmp", f"{own}/manifest-{number:08d}")

    def abort(self, messages: list[Written | None]) -> None:
        system, own = open_path(self.path)
        for x in (x for m in messages if m is not None for x in m.files):
            system.delete_file(f"{own}/_{x['file']}.tmp")


class TokenSource(DataSource):
    """``spark.read.format("tokens")`` and ``df.write.format("tokens")`` after ``register``; option ``ids``: ``array`` or ``binary``."""

    @classmethod
    def name(cls) -> str:
        return "tokens"

    def schema(self) -> str:
        return READ.format("binary" if self.options.get("ids", "array") == "binary" else "array<int>")

    def reader(self, schema: StructType) -> TokenReader:
        return TokenReader(self.options)

    def writer(self, schema: StructType, overwrite: bool) -> TokenWriter:
        return TokenWriter(self.options, overwrite)


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(TokenSource)


def encoded(docs: DataFrame, tokenizer_path: str, end_id: int) -> DataFrame:
    """``WRITE`` rows of whole texts, each with the end id, in the order of ``docs`` within each partition."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(tokenizer_path)
        own.most = KEPT_WORDS
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                found = own.encode([t or "" for t in part.column(1).to_pylist()], end_id)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found, pa.binary())], ["doc_id", "ids"])
            pa.default_memory_pool().release_unused()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), plain(F.col("text")).alias("text")).mapInArrow(each, WRITE)


def write(docs: DataFrame, path: str, tokenizer_path: str, end_id: int = 1) -> None:
    """Writes the ids of all ``docs`` (``doc_id, text``), in ascending order of ``doc_id``, as token files into a new folder."""
    spark = docs.sparkSession
    register(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.monotonically_increasing_id().alias("__place"))
    # a row's place deals out the copies of one row, however many they are
    order = ("doc_id", F.xxhash64("text"), "__place")
    with batches_of(spark, ROWS_AT_ONCE):
        encoded(rows.repartitionByRange(*order).sortWithinPartitions(*order), tokenizer_path, end_id).write.format("tokens").mode("append").save(path)


def read(spark: SparkSession, path: str, binary: bool = False) -> DataFrame:
    """``doc_id, start, n_tokens, ids`` of the documents in a folder."""
    register(spark)
    bound_batches(spark)
    return spark.read.format("tokens").option("ids", "binary" if binary else "array").load(path)
