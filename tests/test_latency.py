"""Latency statistics on hand-made measurements."""

import random

import pytest

from corvane.operators import latency as L


def frame(spark, rows):
    return spark.createDataFrame([(i, o, float(d), float(i), None) for i, (o, d) in enumerate(rows)], "metric_id long, operation string, duration double, timestamp double, metadata string")


def test_percentiles(spark):
    r = L.stats(frame(spark, [("a", d) for d in range(1, 21)] + [("b", 7)])).collect()
    by = {x["operation"]: x for x in r}
    assert (by["a"]["p95_time"], by["a"]["p99_time"], by["a"]["median_time"]) == (19, 19, 10.5)
    assert by["b"]["count"] == 1 and {by["b"][c] for c in ("total_time", "min_time", "max_time", "avg_time", "median_time", "p95_time", "p99_time")} == {7.0}


@pytest.mark.parametrize("ties", [False, True])
def test_brackets_are_exact(spark, ties):
    """Enough rows for the sketches to bracket the ranks; half of the values equal in one case."""
    random.seed(1)
    values = [random.random() if not ties or i % 2 else 0.5 for i in range(30000)]
    found = L.stats(frame(spark, [("a", v) for v in values])).first()
    s, n = sorted(values), len(values)
    assert found["p95_time"] == s[int(0.95 * (n - 1))] and found["p99_time"] == s[int(0.99 * (n - 1))]
    assert found["median_time"] == (s[(n - 1) // 2] + s[n // 2]) / 2


def test_bottlenecks(spark):
    rows = [("high", 6.0), ("medium", 1.5), ("none", 0.5)] + [("late", 0.1)] * 9 + [("late", 7.0)] + [("edge", 1.0)] * 2
    found = {r["operation"]: r["severity"] for r in L.bottlenecks(L.stats(frame(spark, rows))).collect()}
    assert found == {"high": "HIGH", "medium": "MEDIUM"}


def test_p95_only(spark):
    rows = [("late", 0.5)] * 18 + [("late", 2.5)] * 3
    r = L.bottlenecks(L.stats(frame(spark, rows))).first()
    assert r["avg_time"] is None and r["p95_time"] == 2.5 and r["severity"] == "MEDIUM"


def test_variance_needs_more_than_ten(spark):
    ten = [("a", 0.1)] * 9 + [("a", 5.0)]
    assert L.high_variance(L.stats(frame(spark, ten))).count() == 0
    assert L.high_variance(L.stats(frame(spark, [*ten, ("a", 0.1)]))).count() == 1


def test_empty(spark):
    none = spark.createDataFrame([], "metric_id long, operation string, duration double, timestamp double, metadata string")
    assert L.stats(none).count() == 0 and L.recommendations(L.stats(none)).count() == 0


def test_tracker(spark):
    t = L.Tracker()
    with pytest.raises(ValueError), t.measure("op"):
        raise ValueError

    @t.measured("f")
    def f(x):
        return x + 1

    assert f(1) == 2
    with t.measure_query("hello", 3):
        pass
    rows = t.frame(spark).orderBy("metric_id").collect()
    assert [r["operation"] for r in rows] == ["op", "f", "end_to_end_query"] and '"query_length": 5' in rows[2]["metadata"]
    t.reset()
    assert t.frame(spark).count() == 0


def test_rows_stay_where_they_are(spark):
    """With automatic broadcasts off, no raw row is shuffled and nothing is multiplied."""
    rows = spark.range(50000).selectExpr("id AS metric_id", "concat('op', id % 3) AS operation", "rand(1) AS duration", "cast(id AS double) AS timestamp", "cast(null AS string) AS metadata")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for df in (L.stats(rows), L.nearest_ranks(rows.selectExpr("1 AS all", "duration"), "all", "duration", {"p95": L.RANKS["p95"]})):
            plan = [line.lstrip(" :+-") for line in df._jdf.queryExecution().executedPlan().toString().split("\n")]
            assert not any("CartesianProduct" in line for line in plan)
            raw = False  # whether what is above sends rows that aren't aggregated yet
            for line in plan:
                raw = True if line.startswith("Exchange") else False if "Aggregate" in line or line.startswith(("Broadcast", "FileScan")) else raw
                assert not (raw and line.startswith("Range"))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_panel_texts(spark):
    rows = [("vector_retrieval", 6.0), ("b", 1.5), ("c", 1.5), ("d", 1.2), ("e", 0.1)]
    got = L.top_texts(L.stats(frame(spark, rows))).first()
    assert got["bottlenecks"] == "⚠️ **Bottlenecks**:\n- vector_retrieval: 6.000s (HIGH)\n- b: 1.500s (MEDIUM)\n- c: 1.500s (MEDIUM)"
    assert got["recommendations"].startswith("💡 **Recommendations**:\n1. Vector retrieval is slow.")
    none = L.top_texts(L.stats(frame(spark, [("e", 0.1)]))).first()
    assert tuple(none) == ("⚠️ **Bottlenecks**: None detected", "💡 **Recommendations**: None available")
