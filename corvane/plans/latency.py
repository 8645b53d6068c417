"""Latency queries over ``events``: its types stand for operations, its values (25 to a second) for durations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.operators import latency as L
from corvane.operators import rollups as U
from corvane.plans.registry import query, table
from corvane.storage import scratch

# Which operation an event type stands for.
OPERATIONS = (("click", "vector_retrieval"), ("view", "end_to_end_query"), ("purchase", "llm_generation"), ("signup", "document_chunking"), ("error", "agent_graph_execution"))


def metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.create_map(*(F.lit(x) for pair in OPERATIONS for x in pair))
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("metric_id"), F.coalesce(names[F.col("event_type")], "event_type").alias("operation"), (F.col("value") / 25).alias("duration"), F.col("ts").alias("timestamp"), F.col("props").alias("metadata")
    )


CASES = " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in OPERATIONS)
M = f"m AS (SELECT event_id AS metric_id, CASE event_type {CASES} ELSE event_type END AS operation, value / 25 AS duration, ts, props FROM events)"
S = f"""{M}, r AS (
  SELECT operation, duration, row_number() OVER (PARTITION BY operation ORDER BY duration) - 1 AS i, count(*) OVER (PARTITION BY operation) AS n FROM m
), s AS (
  SELECT operation, count(*) AS count, sum(duration) AS total_time, min(duration) AS min_time, max(duration) AS max_time, avg(duration) AS avg_time,
    (max(duration) FILTER (i = floor((n - 1) / 2.0::DOUBLE)) + max(duration) FILTER (i = floor(n / 2.0::DOUBLE))) / 2 AS median_time,
    max(duration) FILTER (i = floor(0.95::DOUBLE * (n - 1))) AS p95_time, max(duration) FILTER (i = floor(0.99::DOUBLE * (n - 1))) AS p99_time
  FROM r GROUP BY operation
)"""
COLUMNS = "operation, count, " + ", ".join(f"round({c}, 6) AS {c}" for c in ("total_time", "min_time", "max_time", "avg_time", "median_time", "p95_time", "p99_time"))


def rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, 6) for n in names})


def all_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.stats(metrics(spark, sf_dir))


TIMES = ("total_time", "min_time", "max_time", "avg_time", "median_time", "p95_time", "p99_time")


@query(f"WITH {S} SELECT {COLUMNS} FROM s")
def latency_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(all_stats(spark, sf_dir), *TIMES)


@query(f"WITH {S} SELECT {COLUMNS} FROM s")
def latency_stats_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same from sorted blocks that batches of measurements were added to, of which few are opened."""
    path, rows = scratch(spark, "blocks"), metrics(spark, sf_dir)
    for batch in (0, 1, 2):
        U.add(rows.filter(F.col("metric_id") % 3 == batch), path, f"b{batch}")
    return rounded(U.stats(spark.read.parquet(path)), *TIMES)


@query(f"WITH {S} SELECT {COLUMNS} FROM s WHERE operation = 'vector_retrieval'")
def latency_stats_one(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(L.stats(metrics(spark, sf_dir), "vector_retrieval"), *TIMES)


@query(
    f"""WITH {S}, o(operation, stage_order) AS (VALUES ('document_ingestion', 1), ('document_chunking', 2), ('vector_insertion', 3), ('vector_retrieval', 4),
  ('parent_store_operations', 5), ('agent_graph_execution', 6), ('llm_generation', 7), ('evaluation_pipeline', 8), ('end_to_end_query', 9))
SELECT s.operation AS operation, count, round(avg_time, 6) AS avg_time, round(p95_time, 6) AS p95_time, stage_order FROM s JOIN o ON s.operation = o.operation"""
)
def pipeline_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(L.breakdown(all_stats(spark, sf_dir)).select("operation", "count", "avg_time", "p95_time", "stage_order"), "avg_time", "p95_time")


BOTTLENECKS = """b AS (
  SELECT operation, CASE WHEN avg_time > 1.0 THEN avg_time END AS avg_time, CASE WHEN NOT avg_time > 1.0 THEN p95_time END AS p95_time,
    CASE WHEN avg_time > 5.0 THEN 'HIGH' ELSE 'MEDIUM' END AS severity FROM s WHERE avg_time > 1.0 OR p95_time > 2.0
)"""


@query(f"WITH {S}, {BOTTLENECKS} SELECT operation, round(avg_time, 6) AS avg_time, round(p95_time, 6) AS p95_time, severity FROM b")
def bottlenecks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(L.bottlenecks(all_stats(spark, sf_dir)), "avg_time", "p95_time")


@query(f"WITH {S}, {BOTTLENECKS} SELECT operation, round(coalesce(avg_time, p95_time), 6) AS slow_time, severity FROM b ORDER BY coalesce(avg_time, p95_time) DESC, operation LIMIT 3")
def top_bottlenecks(spark: SparkSession, sf_dir: str) -> DataFrame:
    slow = L.bottlenecks(all_stats(spark, sf_dir)).withColumn("slow_time", F.coalesce("avg_time", "p95_time"))
    return rounded(slow.orderBy(F.desc("slow_time"), "operation").limit(3).select("operation", "slow_time", "severity"), "slow_time")


ADVICE = ", ".join(f"({i}, '{o}', {t}, '{a}')" for i, (o, t, a) in enumerate(L.ADVICE))


RECOMMENDED = f"""a(place, operation, most, advice) AS (VALUES {ADVICE}), x AS (
  SELECT place, s.operation, advice FROM s JOIN a ON s.operation = a.operation WHERE avg_time > most
  UNION ALL SELECT 3, operation, 'High variance in ' || operation || ' response times. Investigate inconsistent performance patterns.' FROM s
  WHERE count > 10 AND CASE WHEN avg_time > 0 THEN max_time / avg_time ELSE 0 END > 3.0
), rec AS (SELECT (row_number() OVER (ORDER BY place, operation))::INT AS position, operation, advice FROM x)"""


@query(f"WITH {S}, {RECOMMENDED} SELECT position, operation, advice FROM rec")
def recommendations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.recommendations(all_stats(spark, sf_dir))


@query(f"WITH {S} SELECT operation, count, round(max_time / avg_time, 6) AS ratio FROM s WHERE count > 10 AND avg_time > 0 AND max_time / avg_time > 3.0")
def high_variance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(L.high_variance(all_stats(spark, sf_dir)).select("operation", "count", "ratio"), "ratio")


@query(
    f"""WITH {S}, {BOTTLENECKS}, {RECOMMENDED} SELECT (SELECT count(*) FROM m) AS total_measurements, (SELECT coalesce(string_agg(advice, chr(10) ORDER BY position), '') FROM rec) AS recommendations, (SELECT string_agg(operation, ',' ORDER BY operation) FROM s) AS operations,
  (SELECT string_agg(operation || ':' || severity, ',' ORDER BY operation) FROM b) AS bottlenecks,
  (SELECT count(*) FROM s WHERE operation IN ('document_ingestion', 'document_chunking', 'vector_insertion', 'vector_retrieval', 'parent_store_operations', 'agent_graph_execution', 'llm_generation', 'evaluation_pipeline', 'end_to_end_query')) AS n_stages"""
)
def performance_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = all_stats(spark, sf_dir)
    listed = lambda c: F.array_join(F.array_sort(F.collect_list(c)), ",")  # noqa: E731  a row for each operation
    advice = L.recommendations(found).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", "advice"))), lambda x: x["advice"]), chr(10)).alias("recommendations"))
    head = found.agg(F.sum("count").alias("total_measurements"), listed(F.col("operation")).alias("operations"))
    slow = L.bottlenecks(found).agg(listed(F.concat_ws(":", "operation", "severity")).alias("bottlenecks"))
    return head.join(slow).join(L.breakdown(found).agg(F.count(F.lit(1)).alias("n_stages"))).join(advice)  # one row each


@query(
    f"""WITH {S}, {BOTTLENECKS}, {RECOMMENDED}, t AS (SELECT *, coalesce(avg_time, p95_time) AS time FROM b ORDER BY coalesce(avg_time, p95_time) DESC, operation LIMIT 3)
SELECT '{L.BOTTLENECKS_HEAD}' || coalesce((SELECT string_agg(chr(10) || '- ' || operation || ': ' || printf('%.3f', time) || 's (' || severity || ')', '' ORDER BY time DESC, operation) FROM t), ' None detected') AS bottlenecks,
  '{L.ADVICE_HEAD}' || coalesce((SELECT string_agg(chr(10) || position || '. ' || advice, '' ORDER BY position) FROM rec WHERE position <= 3), ' None available') AS recommendations"""
)
def top_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.top_texts(all_stats(spark, sf_dir))


@query(f"WITH {M} SELECT metric_id, operation, round(duration, 6) AS duration FROM m ORDER BY ts DESC, metric_id DESC LIMIT 10")
def recent_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(L.recent(metrics(spark, sf_dir)).select("metric_id", "operation", "duration"), "duration")


@query(f"WITH {M} SELECT strftime(ts, '%H:%M:%S') AS time, operation, round(duration, 3) AS duration, props AS metadata FROM m ORDER BY ts DESC, metric_id DESC LIMIT 10")
def recent_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.recent(metrics(spark, sf_dir)).select(F.date_format("timestamp", "HH:mm:ss").alias("time"), "operation", F.round("duration", 3).alias("duration"), "metadata")


@query(f"WITH {M} SELECT count(*) AS measurements, count(DISTINCT operation) AS operations FROM m")
def dashboard_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics(spark, sf_dir).agg(F.count(F.lit(1)).alias("measurements"), F.countDistinct("operation").alias("operations"))


@query(f"WITH {M} SELECT round(coalesce(avg(a), 0), 6) AS mean_of_means FROM (SELECT avg(duration) AS a FROM m GROUP BY operation)")
def mean_of_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    means = metrics(spark, sf_dir).groupBy("operation").agg(F.avg("duration").alias("a"))
    return means.agg(F.round(F.coalesce(F.avg("a"), F.lit(0.0)), 6).alias("mean_of_means"))


@query(f"WITH {M}, r AS (SELECT duration, row_number() OVER (ORDER BY duration) - 1 AS i, count(*) OVER () AS n FROM m) SELECT round(max(duration), 6) AS global_p95 FROM r WHERE i = floor(0.95::DOUBLE * (n - 1))")
def global_p95(spark: SparkSession, sf_dir: str) -> DataFrame:
    pooled = metrics(spark, sf_dir).withColumn("all", F.lit(1))
    return L.nearest_ranks(pooled, "all", "duration", {"p95": L.RANKS["p95"]}).select(F.round("p95", 6).alias("global_p95"))


@query(
    f"WITH {S} SELECT operation AS stage, count, round(avg_time, 3) AS avg_time, round(p95_time, 3) AS p95_time, round(max_time, 3) AS max_time FROM s WHERE operation IN ('document_chunking', 'vector_retrieval', 'llm_generation', 'end_to_end_query')"
)
def stage_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    shown = all_stats(spark, sf_dir).filter(F.col("operation").isin("document_chunking", "vector_retrieval", "llm_generation", "end_to_end_query"))
    return shown.select(F.col("operation").alias("stage"), "count", *(F.round(c, 3).alias(c) for c in ("avg_time", "p95_time", "max_time")))


@query(f"WITH {M} SELECT operation, round(duration, 6) AS duration, epoch_us(ts) AS timestamp_us, coalesce(props, 'null') AS metadata FROM m")
def latency_export_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = L.export_rows(metrics(spark, sf_dir))
    return rows.select("operation", F.round("duration", 6).alias("duration"), F.unix_micros(F.col("timestamp").cast("timestamp")).alias("timestamp_us"), "metadata")


@query(
    f"""WITH {S} SELECT 'metadata' AS section, count(*) AS n, (SELECT string_agg(operation, ',' ORDER BY operation) FROM s) AS operation, NULL::DOUBLE AS duration, NULL::DOUBLE AS p95_time, NULL::VARCHAR AS metadata FROM m
UNION ALL SELECT 'raw_metrics', NULL, operation, round(duration, 6), NULL, props FROM m
UNION ALL SELECT 'statistics', count, operation, round(total_time, 6), round(p95_time, 6), NULL FROM s"""
)
def latency_export_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The export's lines, read back."""
    head = "total_measurements long, operations_tracked array<string>"
    line = F.from_json("json", f"{head}, operation string, duration double, metadata string, count long, total_time double, p95_time double").alias("x")
    rows = L.export_json(metrics(spark, sf_dir)).select("section", line).select("section", "x.*")
    return rows.select(
        "section",
        F.coalesce("total_measurements", "count").alias("n"),
        F.coalesce("operation", F.array_join("operations_tracked", ",")).alias("operation"),
        F.round(F.coalesce("duration", "total_time"), 6).alias("duration"),
        F.round("p95_time", 6).alias("p95_time"),
        "metadata",
    )
