"""As-of joins by validity intervals against plain Python; measurements that outlive their tracker."""

import random

from corvane.operators import intervals as V
from corvane.operators import latency as L


def test_as_of(spark):
    """A third of all versions and questions have one key; times from ones to billions, ties, nulls."""
    rng = random.Random(1)
    time = lambda: rng.choice([rng.randrange(20), rng.randrange(1000), rng.randrange(1 << 40)])
    key = lambda: rng.choice(["hot", None, *"abcdef"]) if rng.random() < 0.7 else "hot"
    log = [(key(), time(), i, f"v{i}") for i in range(400)] + [("a", 5, 1000, "x"), ("a", 5, 1001, "y"), ("b", None, 1, "z")]
    asked = [(i, key(), time()) for i in range(500)] + [(900, "a", 5), (901, "a", None), (902, "nobody", 7), (903, "hot", 1 << 61)]
    index = V.stored(spark.createDataFrame(log, "k string, at long, n long, v string"), "k", "at", "n").drop("at", "n")
    got = {(r["qid"], r["v"]) for r in V.as_of(spark.createDataFrame(asked, "qid long, k string, t long"), index, "k", "t").collect()}
    want = set()
    for i, k, t in asked:
        own = [(a, n, v) for kk, a, n, v in log if kk == k and a is not None and t is not None and a <= t]
        if own:
            want.add((i, max(own)[2]))
    assert got == want
    assert index.groupBy("k", "v").count().filter("count > 2").count() == 0


def test_measurements_are_kept(spark, tmp_path):
    first = L.Tracker(spark, str(tmp_path / "m"))
    first.FLUSH_ROWS, first.HELD_ROWS = 3, 5
    for i in range(12):
        first.record("op", float(i))
    assert len(first._rows) < 5 and first.frame(spark).count() == 12 and len(first._rows) < 3
    first.flush()
    second = L.Tracker(spark, str(tmp_path / "m"))
    second.record("op", 12.0)
    rows = second.frame(spark)
    assert rows.count() == 13 and rows.select("metric_id").distinct().count() == 13
    assert [r["count"] for r in L.stats(rows).collect()] == [13]
    second.reset()
    assert second.frame(spark).count() == 0
