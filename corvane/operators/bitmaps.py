"""A bitmap index of tags: for each tag value the documents that have it, as bitmaps by bucket of numbers.

Documents have dense numbers. Conditions are and, or and not of tag values; they are evaluated bucket by bucket on the bitmaps of the values that
they name, and only the result becomes rows, so a listing or a search's filter reads no document. A bucket's bitmap has 4 KB, and a value
has a row only in buckets where a document has it.

Defined results: a document with several values of a tag is under each; null values are under none; ``Not`` is
relative to all documents of the index; an unknown value has no documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: What each document is under, for ``Not``.
ALL = ("", "")
BYTES = 4096


@dataclass(frozen=True)
class Has:
    tag: str
    value: str


@dataclass(frozen=True)
class And:
    parts: tuple


@dataclass(frozen=True)
class Or:
    parts: tuple


@dataclass(frozen=True)
class Not:
    part: object


def named(condition) -> set[tuple[str, str]]:
    """The tag values that a condition names."""
    if isinstance(condition, Has):
        return {(condition.tag, condition.value)}
    if isinstance(condition, Not):
        return {ALL} | named(condition.part)
    return set().union(*(named(p) for p in condition.parts), {ALL} if isinstance(condition, And) and not condition.parts else set())


def build(tags: DataFrame, docs: DataFrame) -> DataFrame:
    """``tag, value, bucket, bitmap`` of ``tags`` (``number, tag, value``) and all ``docs`` (``number``), numbers from 0. Aggregated within tasks first."""
    rows = tags.filter("value IS NOT NULL").select("number", "tag", "value").unionByName(docs.select("number", F.lit(ALL[0]).alias("tag"), F.lit(ALL[1]).alias("value")))
    number = F.col("number") + 1  # Spark's bitmaps begin at 1
    return rows.groupBy("tag", "value", F.bitmap_bucket_number(number).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(number)).alias("bitmap"))


def _bits(condition, maps: dict[tuple[str, str], np.ndarray], none: np.ndarray) -> np.ndarray:
    if isinstance(condition, Has):
        return maps.get((condition.tag, condition.value), none)
    if isinstance(condition, Not):
        return maps.get(ALL, none) & ~_bits(condition.part, maps, none)
    parts = [_bits(p, maps, none) for p in condition.parts]
    out = maps.get(ALL, none) if isinstance(condition, And) and not parts else (parts[0] if parts else none)
    for p in parts[1:]:
        out = out & p if isinstance(condition, And) else out | p
    return out


def matching(index: DataFrame, condition) -> DataFrame:
    """``bucket, bitmap, n``: the documents for which the condition holds; buckets without any have no row."""

    def each(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        maps = {(t, v): np.frombuffer(b, np.uint8) for t, v, b in zip(rows["tag"], rows["value"], rows["bitmap"], strict=True)}
        bits = _bits(condition, maps, np.zeros(BYTES, np.uint8))
        n = int(np.bitwise_count(bits).sum(dtype=np.int64))
        return pd.DataFrame({"bucket": [key[0]], "bitmap": [bits.tobytes()], "n": [n]} if n else {"bucket": [], "bitmap": [], "n": []})

    wanted = F.lit(False)
    for tag, value in sorted(named(condition)):  # pushed down to a stored index
        wanted = wanted | ((F.col("tag") == tag) & (F.col("value") == value))
    # a bucket has one row for each value that the condition names
    return index.filter(wanted).groupBy("bucket").applyInPandas(each, "bucket long, bitmap binary, n long")


def numbers(found: DataFrame) -> DataFrame:
    """``number`` of each document in bitmaps (``bucket, bitmap``)."""

    def each(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for bucket, bitmap in zip(part["bucket"], part["bitmap"], strict=True):
                at = np.flatnonzero(np.unpackbits(np.frombuffer(bitmap, np.uint8), bitorder="little"))
                yield pd.DataFrame({"number": (bucket - 1) * 8 * BYTES + at})

    return found.select("bucket", "bitmap").mapInPandas(each, "number long")
