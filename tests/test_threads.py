"""Conversation state from a stream: the fold of all rows, whatever the batches, also after restarts; idle threads end."""

import random
import time

import pytest

from corvane.streaming import threads as X

SCHEMA = "conv_id long, turn int, role string, text string"


def fold(rows):
    out = {}
    for conv in {r[0] for r in rows}:
        own = sorted({(t, role, text) for c, t, role, text in rows if c == conv and t is not None}, key=lambda r: r[0])
        reset = max([-1, *(t for t, role, _ in own if role == "system")])
        kept = [(t, text) for t, role, text in own if role == "assistant" and t > reset]
        n = sum(1 for c, t, _, _ in rows if c == conv and t is not None)
        out[conv] = ("open", n, reset, len(kept), ",".join(str(t) for t, _ in kept), kept[-1][1] if kept else None)
    return out


def state(spark, target):
    return {r["conv_id"]: tuple(r)[1:] for r in X.threads(spark, target).collect()}


@pytest.fixture
def run(spark, tmp_path):
    source, target, checkpoint = (str(tmp_path / n) for n in ("in", "out", "cp"))

    def step(rows, idle=None):
        if rows:
            spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(source)
        X.track(stream, target, checkpoint, idle).awaitTermination()
        return state(spark, target)

    return step


def test_state_survives_restarts(run):
    """Rows out of order, repeated, with resets and without ids or turns, over several runs from one checkpoint."""
    rng = random.Random(8)
    rows = [(c, t, rng.choice(["assistant", "assistant", "user", "system" if c % 2 else "user"]), f"{c}-{t}") for c in range(6) for t in range(rng.randrange(1, 12))]
    rows += [(None, 0, "assistant", "nobody"), (None, 1, "assistant", None), (3, None, "system", "x")]
    rng.shuffle(rows)
    seen = []
    for part in (rows[:20], rows[20:21], [], rows[21:] + rows[:3]):
        seen += part
        assert run(part) == fold(seen)


def test_idle_threads_end(spark, tmp_path):
    source, target = str(tmp_path / "in"), str(tmp_path / "out")
    spark.createDataFrame([(1, 0, "assistant", "a"), (1, 1, "assistant", "b")], SCHEMA).coalesce(1).write.parquet(source)
    query = X.track(spark.readStream.schema(SCHEMA).parquet(source), target, str(tmp_path / "cp"), 1)

    def until(expected):
        end = time.time() + 90
        while time.time() < end:
            try:
                if expected(found := state(spark, target)):
                    return found
            except Exception:  # a batch is just being written
                pass
            time.sleep(0.5)
        raise AssertionError(state(spark, target))

    try:
        assert until(lambda s: 1 in s and s[1][0] == "ended")[1] == ("ended", 2, -1, 2, "0,1", "b")
        spark.createDataFrame([(1, 5, "assistant", "again")], SCHEMA).coalesce(1).write.mode("append").parquet(source)
        assert until(lambda s: s[1][4] == "5")[1][1:] == (1, -1, 1, "5", "again")
    finally:
        query.stop()
