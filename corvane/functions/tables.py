"""Table functions for SQL: chunks of a text, chunks of a whole table, windows, and what an engine's tables hold.

After ``register(spark)``::

    SELECT d.doc_id, c.chunk_idx, c.content FROM docs d, LATERAL chunks(d.text, 500, 100) c
    SELECT * FROM chunk_rows(TABLE(docs), 'text', 500, 100)
    SELECT d.doc_id, w.* FROM docs d, LATERAL windows(d.text, 500, 100) w

``chunks`` splits as children are split; ``chunk_rows`` returns the columns of whatever table it is given, but the text, with each chunk; ``windows`` is a
function of SQL alone. A null or empty text has no chunks, and one window: null, or empty. Sizes that can't be are refused when
the query is analysed.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

from pyspark.sql import SparkSession
from pyspark.sql.functions import AnalyzeArgument, AnalyzeResult, udtf
from pyspark.sql.types import IntegerType, Row, StringType, StructField, StructType

from corvane import config
from corvane.operators.chunking import split_text

CHUNK = [StructField("chunk_idx", IntegerType(), False), StructField("content", StringType(), False)]


def _checked(size: AnalyzeArgument | None, overlap: AnalyzeArgument | None) -> tuple[int, int]:
    values = []
    for given, default, name in ((size, config.CHILD_SIZE, "size"), (overlap, config.CHILD_OVERLAP, "overlap")):
        if given is not None and not given.isConstantExpression:
            raise ValueError(f"{name} must be a constant")
        values.append(default if given is None else int(given.value))
    if not 0 <= values[1] < values[0]:
        raise ValueError(f"an overlap of {values[1]} doesn't fit chunks of {values[0]}")
    return values[0], values[1]


@udtf
class Chunks:
    """``chunks(text [, size [, overlap]])``."""

    @staticmethod
    def analyze(text: AnalyzeArgument, size: AnalyzeArgument | None = None, overlap: AnalyzeArgument | None = None) -> AnalyzeResult:
        _checked(size, overlap)
        return AnalyzeResult(StructType(CHUNK))

    def eval(self, text: str | None, size: int = config.CHILD_SIZE, overlap: int = config.CHILD_OVERLAP) -> Iterator[tuple[int, str]]:
        yield from enumerate(split_text(text, size, overlap) if text else [])


@udtf
class ChunkRows:
    """``chunk_rows(TABLE(..), column [, size [, overlap]])``: the other columns of each row with each chunk of that column."""

    def __init__(self, result: AnalyzeResult):
        self.kept = [f.name for f in result.schema.fields[: -len(CHUNK)]]

    @staticmethod
    def analyze(rows: AnalyzeArgument, column: AnalyzeArgument, size: AnalyzeArgument | None = None, overlap: AnalyzeArgument | None = None) -> AnalyzeResult:
        _checked(size, overlap)
        if not rows.isTable:
            raise ValueError("the first argument is a table")
        fields = {f.name: f for f in rows.dataType.fields}
        if column.value not in fields or not isinstance(fields[column.value].dataType, StringType):
            raise ValueError(f"{column.value!r} is no column of texts")
        kept = [f for n, f in fields.items() if n != column.value]
        if clash := {f.name for f in kept} & {f.name for f in CHUNK}:
            raise ValueError(f"the table has a column {min(clash)} of its own")
        return AnalyzeResult(StructType(kept + CHUNK))

    def eval(self, row: Row, column: str, size: int = config.CHILD_SIZE, overlap: int = config.CHILD_OVERLAP) -> Iterator[tuple[Any, ...]]:
        own = tuple(row[n] for n in self.kept)
        for i, c in enumerate(split_text(row[column], size, overlap) if row[column] else []):
            yield (*own, i, c)


WINDOWS = """CREATE OR REPLACE TEMPORARY FUNCTION windows(t STRING, size INT, overlap INT) RETURNS TABLE(chunk_idx INT, content STRING)
RETURN SELECT i, substring(t, i * (size - overlap) + 1, size) FROM (SELECT explode(sequence(0, CAST(greatest(0, ceil((length(t) - size) / (size - overlap))) AS INT))) AS i)"""

#: Views of an engine's tables, and functions over them.
SEARCHES = (
    "CREATE OR REPLACE TEMPORARY FUNCTION parent_of(asked STRING) RETURNS TABLE(parent_id STRING, content STRING, source STRING) RETURN SELECT parent_id, content, metadata['source'] FROM parents WHERE parent_id = regexp_replace(asked, '(?i)\\\\.json$', '')",
    "CREATE OR REPLACE TEMPORARY FUNCTION children_of(asked STRING) RETURNS TABLE(child_idx INT, content STRING) RETURN SELECT child_idx, content FROM children WHERE parent_id = asked",
)


def register(spark: SparkSession) -> None:
    """Makes ``chunks``, ``chunk_rows`` and ``windows`` known to the session."""
    spark.udtf.register("chunks", Chunks)
    spark.udtf.register("chunk_rows", ChunkRows)
    spark.sql(WINDOWS)


def register_engine(engine: Any) -> None:
    """Views ``documents``, ``parents``, ``children`` of the versions that hold, and the functions ``parent_of`` and ``children_of``."""
    register(engine.spark)
    for name in ("documents", "parents", "children"):
        engine.current(name).createOrReplaceTempView(name)
    for statement in SEARCHES:
        engine.spark.sql(statement)
