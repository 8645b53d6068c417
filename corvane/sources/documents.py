"""Ingestion of documents and pages: stems, skip-existing, deterministic ids, the parent store."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.functions import text as T

# Format by extension.
FORMATS = {"pdf": "pdf", "html": "html", "htm": "html", "docx": "docx", "csv": "csv", "xlsx": "excel", "xls": "excel", "pptx": "powerpoint", "png": "image", "jpg": "image", "jpeg": "image", "md": "markdown", "txt": "text"}


def detect_format(path: Column, head: Column | None = None) -> Column:
    """Format by what the content begins with, or else by extension; ``unknown`` otherwise."""
    ext = F.lower(T.extension_of(path))
    known = F.create_map(*(F.lit(x) for pair in FORMATS.items() for x in pair))[ext]
    if head is not None:
        start = F.lower(F.substring(head, 1, 15))
        known = F.when(start.startswith("%pdf-"), "pdf").when(start.startswith("<!doctype html") | start.startswith("<html"), "html").otherwise(known)
    return F.coalesce(known, F.lit("unknown"))


def first_per_stem(files: DataFrame, order: str) -> DataFrame:
    """Of files whose ``path`` has the same stem the one with the smallest ``order``; an aggregate, so a common stem is reduced before the shuffle."""
    return files.withColumn("stem", T.stem_of(F.col("path"))).groupBy("stem").agg(F.min(order).alias(order))


def skip_existing(files: DataFrame, existing: DataFrame, order: str) -> DataFrame:
    """``stem`` and ``order`` of files to ingest: the first of each stem that isn't in ``existing`` (``stem``)."""
    return first_per_stem(files, order).join(existing.select("stem").distinct(), "stem", "left_anti")


def ingest_counts(files: DataFrame, existing: DataFrame, order: str, text: str) -> DataFrame:
    """``added, skipped``: a file counts as added if it is the first of a new stem and has any text."""
    new = skip_existing(files.filter(F.length(T.strip(F.col(text))) > 0), existing, order).agg(F.count(F.lit(1)).alias("added"))
    return files.agg(F.count(F.lit(1)).alias("__all")).join(new).select("added", (F.col("__all") - F.col("added")).alias("skipped"))


def chunk_id(parent_id: Column, index: Column) -> Column:
    """The same for the same chunk, so that indexing twice changes nothing."""
    return F.sha2(F.concat_ws(":", parent_id, index.cast("string")), 256)


def upsert(base: DataFrame, updates: DataFrame, key: str, order: str) -> DataFrame:
    """The last write of each key."""
    rows = base.unionByName(updates)
    rest = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.max_by(F.struct(*rest), order).alias("__row")).select(key, "__row.*")


def parent_key(asked: Column) -> Column:
    """A parent id as it is asked for, with or without ``.json``."""
    return F.when(F.lower(asked).endswith(".json"), F.substring(asked, F.lit(1), F.length(asked) - 5)).otherwise(asked)
