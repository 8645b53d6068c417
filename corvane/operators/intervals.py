"""Validity intervals and as-of joins: which version of each key held at each question's own time.

Intervals are made once from a log of versions; a version holds from its time until the next one's. An interval is put at the level whose
cells are at least as long as it is, so it touches two cells at most; a question looks into the one cell of each level that holds its time. So both sides meet by key, level and
cell, not by key alone: a key with a third of all versions and questions is many groups, and no history is sorted or scanned at query time.

Defined results: of versions of one key and time the last by ``order`` holds; a null key is a key; rows with a null time are in no interval and
questions with a null time have no answer; a time before the first version has none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.storage import cut

#: The time until which the last version holds.
OPEN = (1 << 62) - 1


def validity(log: DataFrame, key: str, at: str, order: str) -> DataFrame:
    """``log`` with ``valid_from, valid_to`` (whole numbers, the end excluded), ``at`` being whole numbers or timestamps (microseconds)."""
    time = _number(log, at)
    sequence = Window.partitionBy(key).orderBy("valid_from", order)
    rows = log.filter(F.col(at).isNotNull()).withColumn("valid_from", time)
    rows = rows.withColumn("valid_to", F.coalesce(F.lead("valid_from").over(sequence), F.lit(OPEN)))
    return rows.filter("valid_from < valid_to")


def _number(rows: DataFrame, at: str) -> Column:
    kind = rows.schema[at].dataType.typeName()
    return F.unix_micros(F.col(at).cast("timestamp")) if kind.startswith("timestamp") else F.col(at).cast("long")


def indexed(intervals: DataFrame) -> DataFrame:
    """Intervals with ``level`` and ``cell``, one or two rows each; what is stored."""
    length = F.col("valid_to") - F.col("valid_from")
    level = F.length(F.bin(length)).cast("int")  # cells of 2 ** level are longer
    # an open interval may begin anywhere before its end, so it has the top level's one cell
    rows = intervals.withColumn("level", F.when(F.col("valid_to") == OPEN, 62).otherwise(level))
    cell = lambda t: F.call_function("shiftright", t, F.col("level"))
    cells = F.when(F.col("level") >= 62, F.array(F.lit(0).cast("long"))).otherwise(F.array_distinct(F.array(cell(F.col("valid_from")), cell(F.col("valid_to") - 1))))
    return rows.withColumn("cell", F.explode(cells))


def as_of(questions: DataFrame, index: DataFrame, key: str, at: str) -> DataFrame:
    """``questions`` with the other columns of the version of their ``key`` that held at their ``at``; questions without an answer are left out."""
    levels = [r["level"] for r in index.select("level").distinct().collect()]  # 63 at most
    asked = questions.filter(F.col(at).isNotNull()).withColumn("__t", _number(questions, at)).withColumn("__level", F.explode(F.array(*map(F.lit, levels)) if levels else F.array().cast("array<int>")))
    asked = asked.withColumn("__cell", F.when(F.col("__level") >= 62, F.lit(0).cast("long")).otherwise(F.call_function("shiftright", F.col("__t"), F.col("__level"))))
    rest = [c for c in index.columns if c not in (key, "level", "cell", "valid_from", "valid_to")]
    held = index.select(F.col(key).alias("__key"), "level", "cell", "valid_from", "valid_to", *rest)
    met = (F.col("__cell") == F.col("cell")) & (F.col("__level") == F.col("level")) & F.col(key).eqNullSafe(F.col("__key"))
    found = asked.join(held, met & (F.col("__t") >= F.col("valid_from")) & (F.col("__t") < F.col("valid_to")))
    return found.select(*questions.columns, *rest, "valid_from", "valid_to")


def stored(log: DataFrame, key: str, at: str, order: str) -> DataFrame:
    """The index of a log, written."""
    return cut(indexed(validity(log, key, at, order)), "intervals")
