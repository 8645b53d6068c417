"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession

from corvane.functions.text import valid_utf8
from corvane.storage import BATCH_ROWS, BROADCAST_BYTES, batches_of, bound_batches, cut, scratch, small

__all__ = ["BATCH_ROWS", "BROADCAST_BYTES", "batches_of", "bound_batches", "cut", "plain", "scratch", "small", "table"]


def plain(text: Column) -> Column:
    """``text`` as a string that Python can read: bytes that aren't UTF-8 are dropped."""
    return valid_utf8(text.cast("string"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
