"""Latency analytics over rows ``operation, duration, timestamp, metadata``.

Percentiles are lower nearest ranks: of ``n`` sorted values the one at index
``floor(p * (n - 1))``; the median is the mean of the middle two. They are found
exactly in two aggregations: quantile sketches bracket each rank, then only
values inside a bracket are counted and ranked, so no task sorts a whole group.
The sketches, one row for each group, are written and sent to the rows (behind a
check of their size), which are never shuffled themselves.
"""

from __future__ import annotations

import json
import threading
import time
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import wraps
from typing import Any

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corvane import config
from corvane.storage import cut, small

#: Accuracy of the sketches; a rank is off by less than one in so many.
ACCURACY = 20_000
#: A rank's bracket reaches so far to both sides.
REACH = 2.0 / ACCURACY

STATS = "operation, count, total_time, min_time, max_time, avg_time, median_time, p95_time, p99_time"


def nearest_ranks(df: DataFrame, key: str, value: str, ranks: dict[str, Callable[[Column], Column]]) -> DataFrame:
    """For each ``key``, its count as ``__n`` and, by name, the value at each rank (0-based, from the count)."""
    rows = df.select(F.col(key).alias("__key"), F.col(value).alias("__value"))
    fractions = {"median_lo": 0.5, "median_hi": 0.5, "p95": 0.95, "p99": 0.99}
    wanted = {name: fractions[name] for name in ranks}
    ends = sorted({min(1.0, max(0.0, p + d)) for p in wanted.values() for d in (-REACH, REACH)})
    sketch = rows.groupBy("__key").agg(F.percentile_approx("__value", [float(e) for e in ends], ACCURACY).alias("__ends"), F.count("__value").alias("__n"))
    found = cut(sketch, "sketches")
    brackets = F.array(
        *(
            F.struct(
                F.lit(name).alias("name"),
                # small groups are bracketed whole: a sketch of few values has nothing to say
                F.when(F.col("__n") * REACH >= 1, F.col("__ends")[ends.index(max(0.0, p - REACH))]).alias("lo"),
                F.when(F.col("__n") * REACH >= 1, F.col("__ends")[ends.index(min(1.0, p + REACH))]).alias("hi"),
                ranks[name](F.col("__n")).cast("long").alias("rank"),
            )
            for name, p in wanted.items()
        )
    )
    sent = small(found.select(F.col("__key").alias("__k"), brackets.alias("__brackets")))  # one row for each key
    met = rows.join(sent, F.col("__key").eqNullSafe(F.col("__k"))).select("__key", "__value", F.explode("__brackets").alias("__b")).select("__key", "__value", "__b.*")
    below = F.col("lo").isNotNull() & (F.col("__value") < F.col("lo"))
    inside = (F.col("lo").isNull() | (F.col("__value") >= F.col("lo"))) & (F.col("hi").isNull() | (F.col("__value") <= F.col("hi")))
    # all rows below the bracket become one, all equal values within it become one
    counted = met.filter(below | inside).groupBy("__key", "name", "rank", F.when(inside, F.col("__value")).alias("__value")).agg(F.count(F.lit(1)).alias("__c"))
    upto = Window.partitionBy("__key", "name").orderBy(F.col("__value").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    hit = counted.withColumn("__upto", F.sum("__c").over(upto)).filter(F.col("__upto") > F.col("rank"))
    ranked = hit.groupBy(F.col("__key").alias("__k")).pivot("name", list(ranks)).agg(F.min("__value"))
    sizes = found.select("__key", "__n")
    return sizes.join(ranked, F.col("__key").eqNullSafe(F.col("__k")), "left").select(F.col("__key").alias(key), "__n", *ranks)


RANKS: dict[str, Callable[[Column], Column]] = {
    "median_lo": lambda n: F.floor((n - 1) / 2),
    "median_hi": lambda n: F.floor(n / 2),
    "p95": lambda n: F.floor(F.lit(0.95) * (n - 1)),
    "p99": lambda n: F.floor(F.lit(0.99) * (n - 1)),
}


def stats(metrics: DataFrame, operation: str | None = None) -> DataFrame:
    """``STATS`` of each operation, or of one; an unknown operation gives no row."""
    rows = metrics if operation is None else metrics.filter(F.col("operation") == operation)
    plain = rows.groupBy("operation").agg(
        F.count("duration").alias("count"), F.sum("duration").alias("total_time"), F.min("duration").alias("min_time"), F.max("duration").alias("max_time"), F.avg("duration").alias("avg_time")
    )
    ranked = nearest_ranks(rows, "operation", "duration", RANKS).withColumnRenamed("operation", "__operation")
    out = plain.join(ranked, F.col("operation").eqNullSafe(F.col("__operation")))
    return out.withColumns({"median_time": (F.col("median_lo") + F.col("median_hi")) / 2, "p95_time": F.col("p95"), "p99_time": F.col("p99")}).select(*STATS.split(", "))


def breakdown(found: DataFrame, stages: tuple[str, ...] = config.STAGES) -> DataFrame:
    """The rows of ``found`` that are pipeline stages, with the stage's place."""
    place = F.array_position(F.array(*map(F.lit, stages)), F.col("operation"))
    return found.withColumn("stage_order", place.cast("int")).filter("stage_order > 0")


def bottlenecks(found: DataFrame) -> DataFrame:
    """Slow operations: by average, or else by p95."""
    slow, late = F.col("avg_time") > config.SLOW_AVERAGE, F.col("p95_time") > config.SLOW_P95
    return found.filter(slow | late).select(
        "operation",
        F.when(slow, F.col("avg_time")).alias("avg_time"),
        F.when(~slow, F.col("p95_time")).alias("p95_time"),
        F.when(slow & (F.col("avg_time") > config.SLOWEST_AVERAGE), "HIGH").otherwise("MEDIUM").alias("severity"),
    )


# Operation, average from which it is slow, and the advice.
ADVICE = (
    ("vector_retrieval", 0.5, "Vector retrieval is slow. Consider optimizing index parameters, increasing hardware resources, or implementing caching."),
    ("llm_generation", 2.0, "LLM generation is slow. Consider using a faster model, optimizing prompt length, or implementing streaming responses."),
    ("document_chunking", 1.0, "Document chunking is slow. Consider optimizing chunk size, parallelizing processing, or using more efficient chunking algorithms."),
)
# Heads of the panel's texts.
BOTTLENECKS_HEAD, ADVICE_HEAD = "⚠️ **Bottlenecks**:", "💡 **Recommendations**:"
VARIANCE_COUNT, VARIANCE_RATIO = 10, 3.0


def high_variance(found: DataFrame) -> DataFrame:
    """Operations with enough samples whose largest time is far over their average."""
    ratio = F.when(F.col("avg_time") > 0, F.col("max_time") / F.col("avg_time")).otherwise(0.0)
    return found.withColumn("ratio", ratio).filter((F.col("count") > VARIANCE_COUNT) & (F.col("ratio") > VARIANCE_RATIO))


def recommendations(found: DataFrame) -> DataFrame:
    """``position, operation, advice``: fixed rules first, then operations of high variance by name."""
    spark = found.sparkSession
    rules = spark.createDataFrame([(i, *a) for i, a in enumerate(ADVICE)], "place int, operation string, limit double, advice string")
    slow = found.join(small(rules), "operation").filter("avg_time > limit").select("place", "operation", "advice")
    varying = high_variance(found).select(
        F.lit(len(ADVICE)).alias("place"), "operation", F.concat(F.lit("High variance in "), "operation", F.lit(" response times. Investigate inconsistent performance patterns.")).alias("advice")
    )
    # one row for each operation at most, and one for each rule
    return slow.unionByName(varying).withColumn("position", F.row_number().over(Window.orderBy("place", "operation"))).select("position", "operation", "advice")


def top_texts(found: DataFrame) -> DataFrame:
    """``bottlenecks, recommendations``: the panel's texts with the first three of each, the slowest first."""
    slow = bottlenecks(found).withColumn("time", F.coalesce("avg_time", "p95_time")).orderBy(F.desc("time"), "operation").limit(3)
    line = F.concat(F.lit("\n- "), "operation", F.lit(": "), F.format_string("%.3f", "time"), F.lit("s ("), "severity", F.lit(")"))
    listed = lambda order, text: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order.alias("o"), text.alias("t")))), lambda x: x["t"]), "")  # noqa: E731  three rows
    first = slow.agg(listed(F.struct(-F.col("time"), F.col("operation")), line).alias("b"))
    advice = recommendations(found).filter("position <= 3").agg(listed(F.col("position"), F.concat(F.lit("\n"), F.col("position").cast("string"), F.lit(". "), F.col("advice"))).alias("r"))
    shown = lambda head, text, none: F.concat(F.lit(head), F.when(text == "", F.lit(none)).otherwise(text))
    return first.join(advice).select(shown(BOTTLENECKS_HEAD, F.col("b"), " None detected").alias("bottlenecks"), shown(ADVICE_HEAD, F.col("r"), " None available").alias("recommendations"))


def recent(metrics: DataFrame, n: int = 10) -> DataFrame:
    """The last ``n`` rows by time, ties by id."""
    return metrics.orderBy(F.desc("timestamp"), F.desc("metric_id")).limit(n)


def export_rows(metrics: DataFrame) -> DataFrame:
    """Rows of the CSV export: metadata as JSON, ``null`` if absent."""
    return metrics.select("operation", "duration", "timestamp", F.coalesce("metadata", F.lit("null")).alias("metadata"))


def export_csv(metrics: DataFrame, path: str) -> None:
    export_rows(metrics).write.option("header", True).csv(path)


def export_json(metrics: DataFrame) -> DataFrame:
    """The export as JSON lines: a head with totals, each measurement, each operation's statistics.

    Measurements stay rows of a distributed table; they are never gathered into one document.
    """
    head = metrics.agg(F.count(F.lit(1)).alias("total_measurements"), F.array_sort(F.collect_set("operation")).alias("operations_tracked"))
    parts = (("metadata", head), ("raw_metrics", metrics.select("operation", "duration", "timestamp", "metadata")), ("statistics", stats(metrics)))
    out = None
    for section, rows in parts:
        lines = rows.select(F.lit(section).alias("section"), F.to_json(F.struct("*")).alias("json"))
        out = lines if out is None else out.unionByName(lines)
    return out


MEASURED = "metric_id long, operation string, duration double, timestamp double, metadata string"


class Tracker:
    """Measures operations on the driver; ``frame`` hands the measurements to the operators above.

    With a ``path``, measurements are kept in a table there, which outlives the process: the driver holds those that came
    after the last ``flush`` only, which ``FLUSH_ROWS`` of them bring about at the next ``frame``, and then at most ``HELD_ROWS``.
    """

    FLUSH_ROWS, HELD_ROWS = 1000, 100_000

    def __init__(self, spark: SparkSession | None = None, path: str | None = None) -> None:
        self._rows: list[tuple[str, float, float, str | None]] = []
        self._lock = threading.Lock()
        self._spark, self._path = spark, path
        self._first = 0

    def record(self, operation: str, duration: float, metadata: dict[str, Any] | None = None) -> None:
        with self._lock:
            self._rows.append((operation, duration, time.time(), None if metadata is None else json.dumps(metadata)))
            full = self._path is not None and len(self._rows) >= self.HELD_ROWS
        if full:
            self.flush()

    @contextmanager
    def measure(self, operation: str, metadata: dict[str, Any] | None = None) -> Iterator[None]:
        """Records also when the body raises."""
        start = time.perf_counter()
        try:
            yield
        finally:
            self.record(operation, time.perf_counter() - start, metadata)

    def measure_query(self, query: str, expected: int | None = None):
        return self.measure("end_to_end_query", {"query": query, "expected_count": expected, "query_length": len(query)})

    def measured(self, operation: str) -> Callable:
        def wrap(f: Callable) -> Callable:
            @wraps(f)
            def inner(*args: Any, **kwargs: Any) -> Any:
                with self.measure(operation, {"function_name": f.__name__, "args_count": len(args), "kwargs_count": len(kwargs)}):
                    return f(*args, **kwargs)

            return inner

        return wrap

    def _there(self) -> DataFrame | None:
        """What has been flushed since the last reset."""
        try:
            return self._spark.read.schema(MEASURED).parquet(f"{self._path}/measured") if self._path is not None else None
        except AnalysisException as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return None

    def flush(self) -> None:
        """Moves what the driver holds into the table."""
        if self._path is None:
            return
        with self._lock:
            rows, self._rows = self._rows, []
            first, self._first = self._first, self._first + len(rows)
        if rows:
            own = self._spark.createDataFrame([(time.time_ns() // 1000 * 1000 + i, *r) for i, r in enumerate(rows, first)], MEASURED)
            own.coalesce(1).write.mode("append").parquet(f"{self._path}/measured")

    def reset(self) -> None:
        with self._lock:
            self._rows.clear()
        if self._path is not None:
            self._spark.createDataFrame([], MEASURED).write.mode("overwrite").parquet(f"{self._path}/measured")

    def frame(self, spark: SparkSession) -> DataFrame:
        with self._lock:
            full = self._path is not None and len(self._rows) >= self.FLUSH_ROWS
        if full:
            self.flush()
        with self._lock:
            rows = [((time.time_ns() if self._path else 0) + i, *r) for i, r in enumerate(self._rows)]
        held, there = spark.createDataFrame(rows, MEASURED), self._there()
        return held if there is None else there.unionByName(held)
