"""Changes within documents: chunks with content-defined borders, so that an edit changes the chunks it touches and no others.

A chunk ends after a character at which a rolling hash of the last ``WINDOW`` characters has ``BITS`` zero bits, not before ``LEAST`` and at ``MOST`` characters
at the latest. A border depends on the characters before it alone, so behind an edit borders fall where they fell before, as soon as
one of them is met again. A chunk's id is its content's checksum; what has an id that is known needn't be weighed, embedded or stored again.

Defined results: a null or empty text has no chunks; a document's equal chunks count as often as it has them; rows of one key are one document's
parts, in no order.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.functions import text as T
from corvane.operators import retrieval
from corvane.storage import bound_batches

WINDOW, BITS, LEAST, MOST = 24, 8, 128, 2048


def hashes(codes: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """At each character the rolling hash of the ``window`` characters that end there (fewer at the beginning)."""
    mixed = codes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    mixed ^= mixed >> np.uint64(29)
    out, factor = np.zeros(len(codes), np.uint64), np.uint64(1)
    with np.errstate(over="ignore"):
        for j in range(min(window, len(codes))):
            out[j:] += mixed[: len(codes) - j] * factor
            factor *= np.uint64(0xD6E8FEB86659FD93)
    return out


def borders(text: str, least: int = LEAST, most: int = MOST, bits: int = BITS, window: int = WINDOW) -> list[int]:
    """Where chunks end."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    ends = np.flatnonzero(hashes(codes, window) >> np.uint64(64 - bits) == 0) + 1
    out, at = [], 0
    while len(codes) - at > least:
        k = np.searchsorted(ends, at + least)
        at = min(int(ends[k]) if k < len(ends) else len(codes), at + most, len(codes))
        out.append(at)
    if at < len(codes):
        out.append(len(codes))
    return out


def chunks(docs: DataFrame, key: str, text: str) -> DataFrame:
    """``key, chunk_idx, chunk_id, content``."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                rows = []
                for k, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    begin = 0
                    for i, end in enumerate(borders(t) if t else []):
                        rows.append((k, i, t[begin:end]))
                        begin = end
                columns = list(zip(*rows, strict=True)) or [()] * 3
                yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(columns, (part.schema.field(0).type, pa.int32(), pa.string()), strict=True)], [key, "chunk_idx", "content"])

    bound_batches(docs.sparkSession)
    rows = docs.select(F.col(key), T.valid_utf8(F.col(text).cast("string")).alias("text"))
    cut = rows.mapInArrow(each, f"`{key}` {rows.schema[key].dataType.simpleString()}, chunk_idx int, content string")
    return cut.select(key, "chunk_idx", F.sha2(F.col("content").cast("binary"), 256).alias("chunk_id"), "content")


def chunk_delta(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """``key, chunk_id, n_kept, n_added, n_removed`` of two states of documents, given by their chunks."""
    side = lambda df, o, n: df.select(key, "chunk_id", F.lit(o).alias("__o"), F.lit(n).alias("__n"))
    both = side(old, 1, 0).unionByName(side(new, 0, 1)).groupBy(key, "chunk_id").agg(F.sum("__o").alias("o"), F.sum("__n").alias("n"))
    kept = F.least("o", "n")
    return both.select(key, "chunk_id", kept.alias("n_kept"), (F.col("n") - kept).alias("n_added"), (F.col("o") - kept).alias("n_removed"))


def unknown(found: DataFrame, known: DataFrame) -> DataFrame:
    """``chunk_id, content`` of chunks that ``known`` (``chunk_id``) doesn't have, once each."""
    new = found.join(known.select("chunk_id"), "chunk_id", "left_anti")
    return new.groupBy("chunk_id").agg(F.first("content").alias("content"))  # equal ids have equal content


def weigh(found: DataFrame, weighed: DataFrame | None) -> DataFrame:
    """``chunk_id, token, weight`` of all chunks: those of ``weighed`` as they are, only the others are made."""
    if weighed is None:
        return retrieval.term_weights(found.groupBy("chunk_id").agg(F.first("content").alias("content")), "chunk_id", "content")
    made = retrieval.term_weights(unknown(found, weighed.select("chunk_id").distinct()), "chunk_id", "content")
    return weighed.join(found.select("chunk_id").distinct(), "chunk_id", "left_semi").unionByName(made)
