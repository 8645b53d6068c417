"""Ingestion of a stream of files into an engine's tables and index."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from corvane.session import Engine


def ingest(engine: Engine, files: DataFrame, checkpoint: str, name: str = "stream") -> StreamingQuery:
    """Follows a stream of ``path, text`` rows until all that is there has been read.

    Each micro-batch is stored, chunked, weighed and indexed like a call of ``Engine.add``, under a name made of ``name`` and its number. Its stems are written
    last. A batch that was stopped between two tables runs again under the same name after a restart from ``checkpoint``: what it has written doesn't
    count as there, and is overwritten, so the tables become those of an ingestion that was never stopped.
    """

    def add(batch: DataFrame, number: int) -> None:
        engine.add(batch, f"{name}-{number:010d}")

    return files.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
