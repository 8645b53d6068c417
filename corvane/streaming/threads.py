"""Conversations as keyed state of a stream: answers accumulate, a reset forgets them, idle threads end.

Each conversation has a map of its answers by turn, the turn of its last reset, and a timer. By turn, a row that
comes again or late changes nothing that it shouldn't, so the state depends on the rows and not on their batches. State is kept by
Spark's state store and survives a restart from the checkpoint. One row for each conversation that a batch touched, or that a timer ended, is written under the batch's number,
which a batch that runs again overwrites.

Defined results: ``system`` turns reset; answers of that turn and before are forgotten; other roles are only counted; a null conversation id is
a conversation like any other, rows with a null turn are ignored; a conversation that ended begins anew when it speaks again.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

STATE = "conv_id long, version long, status string, n_messages long, reset_turn long, n_answers long, kept string, last_answer string"
#: The store that keyed state needs.
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Rows with a null id share this key.
NO_ID = -(1 << 63)


class Threads(StatefulProcessor):
    def __init__(self, idle_ms: int | None):
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.answers = handle.getMapState("answers", "turn long", "text string")
        self.head = handle.getValueState("head", "version long, n_messages long, reset_turn long")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        version, n, reset = self.head.get() if self.head.exists() else (0, 0, -1)
        for part in rows:
            part = part[part["turn"].notna()]
            n += len(part)
            reset = max([reset, *part.loc[part["role"] == "system", "turn"]])
            said = part[(part["role"] == "assistant") & (part["turn"] > reset)]
            for turn, text in zip(said["turn"], said["text"], strict=True):
                self.answers.updateValue((int(turn),), (text,))
        for (turn,) in [t for t in self.answers.keys() if t[0] <= reset]:
            self.answers.removeKey((turn,))
        self.head.update((int(version) + 1, int(n), int(reset)))
        if self.idle_ms is not None:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.idle_ms)
        yield self._row(key, "open")

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        version, n, reset = self.head.get()
        self.head.update((int(version) + 1, int(n), int(reset)))
        yield self._row(key, "ended")
        self.answers.clear()
        self.head.update((int(version) + 1, 0, -1))  # later rows get later versions

    def _row(self, key: Any, status: str) -> pd.DataFrame:
        version, n, reset = self.head.get()
        turns = sorted(t[0] for t in self.answers.keys())
        last = self.answers.getValue((turns[-1],))[0] if turns else None
        own = {"conv_id": [key[0]], "version": [version], "status": [status], "n_messages": [n], "reset_turn": [reset], "n_answers": [len(turns)], "kept": [",".join(map(str, turns))], "last_answer": [last]}
        return pd.DataFrame(own)

    def close(self) -> None:
        pass


def track(messages: DataFrame, target: str, checkpoint: str, idle_seconds: float | None = None) -> StreamingQuery:
    """Follows a stream of ``conv_id, turn, role, text``; ``threads`` reads what it writes to ``target``.

    Without ``idle_seconds`` it ends when all that is there has been read. With it, it goes on, as time alone can end a thread, until it is stopped.
    """
    spark = messages.sparkSession
    rows = messages.select(F.coalesce(F.col("conv_id").cast("long"), F.lit(NO_ID)).alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    mode = "None" if idle_seconds is None else "ProcessingTime"
    state = rows.groupBy("conv_id").transformWithStateInPandas(Threads(None if idle_seconds is None else int(1000 * idle_seconds)), STATE, "Update", mode)

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{target}/batch={number}")

    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, PROVIDER)
    try:
        return state.writeStream.foreachBatch(write).outputMode("update").option("checkpointLocation", checkpoint).trigger(**({"availableNow": True} if idle_seconds is None else {"processingTime": "1 second"})).start()
    finally:
        spark.conf.set(name, before)


def threads(spark: SparkSession, target: str) -> DataFrame:
    """``STATE`` of each conversation as it is now, without ``version``."""
    try:
        rows = spark.read.schema(STATE).parquet(target)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        rows = spark.createDataFrame([], STATE)
    names = [c.split()[0] for c in STATE.split(", ")][1:]
    last = rows.groupBy("conv_id").agg(F.max_by(F.struct(*names), "version").alias("s"))
    return last.select(F.nullif("conv_id", F.lit(NO_ID)).alias("conv_id"), *(F.col(f"s.{n}").alias(n) for n in names if n != "version"))
