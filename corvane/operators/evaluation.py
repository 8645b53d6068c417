"""Evaluation: graders' output, statuses, overall scores, reports.

Graders are pluggable columns; ``overlap_grade`` is the offline stand-in.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.functions import text as T

# The metrics and the titles that their texts show.
METRICS = ("groundedness", "relevance", "retrieval_accuracy")
TITLES = {"groundedness": "Groundedness", "relevance": "Relevance", "retrieval_accuracy": "Retrieval Accuracy"}
DOCUMENT_CHARS = 2000


def overlap(question: Column, document: Column) -> Column:
    """Share of the question's distinct words that the document has; 0 without words."""
    asked = F.array_distinct(T.tokens(question))
    return F.when(F.size(asked) > 0, F.size(F.array_intersect(asked, T.tokens(document))) / F.size(asked)).otherwise(0.0)


def overlap_grade(question: Column, document: Column, at_least: float = 0.5) -> Column:
    return overlap(question, document) >= at_least


def parse_grade(raw: Column, key: str = "result") -> Column:
    """The boolean of a grader's JSON, fenced or not; false if it can't be read."""
    text = T.strip(F.coalesce(raw, F.lit("")))
    fenced = text.startswith("```") & text.endswith("```")
    lines = F.split(text, "\n")
    inner = F.array_join(F.slice(lines, F.lit(2), F.greatest(F.lit(0), F.size(lines) - 2)), "\n")
    body = F.when(fenced, inner).otherwise(text)
    return F.coalesce(F.from_json(body, f"explanation STRING, {key} BOOLEAN")[key], F.lit(False))


def parse_correctness(raw: Column) -> Column:
    """Either ``correct`` or ``result`` is accepted, with an explanation."""
    found = F.from_json(raw, "explanation STRING, correct BOOLEAN, result BOOLEAN")
    return F.when(found["explanation"].isNotNull(), F.coalesce(found["correct"], found["result"], F.lit(False))).otherwise(False)


def status(score: Column) -> Column:
    """PASS, FAIL, or ERROR where there is no score."""
    return F.when(score.isNull(), "ERROR").when(score, "PASS").otherwise("FAIL")


def unpivot(results: DataFrame, key: str) -> DataFrame:
    """``key, metric, score, status`` of one boolean column for each metric."""
    long = results.unpivot([key], list(METRICS), "metric", "score")
    return long.withColumn("status", status(F.col("score")))


def overall(long: DataFrame, key: str) -> DataFrame:
    """``key, overall_score``: the share of PASS among PASS and FAIL, 0 without any."""
    score = F.avg(F.when(F.col("status") == "PASS", 1.0).when(F.col("status") == "FAIL", 0.0))
    return long.groupBy(key).agg(F.coalesce(score, F.lit(0.0)).alias("overall_score"))


def overall_of(results: DataFrame) -> Column:
    """The same from the metrics' columns of one row, without a shuffle."""
    n = sum((F.col(m).isNotNull().cast("int") for m in METRICS), F.lit(0))
    passed = sum((F.coalesce(F.col(m).cast("int"), F.lit(0)) for m in METRICS), F.lit(0))
    return F.when(n > 0, passed / n).otherwise(0.0)


def csv_rows(results: DataFrame) -> DataFrame:
    """The eleven columns of the evaluation report, from ``timestamp, question, answer, documents``, the metrics and ``overall_score``."""
    each = [c for m in METRICS for c in (F.coalesce(F.col(m), F.lit(False)).alias(f"{m}_score"), status(F.col(m)).alias(f"{m}_status"))]
    return results.select("timestamp", "question", "answer", "documents", *each, "overall_score")


def safe_join(documents: Column) -> Column:
    """Documents cut to 2000 characters, joined by blank lines; nulls are skipped."""
    return F.array_join(F.transform(F.filter(documents, lambda d: d.isNotNull()), lambda d: T.cut_to(d, DOCUMENT_CHARS)), "\n\n")


def percent(score: Column) -> Column:
    return F.format_string("%.2f%%", score * 100)


# The texts of the panel and of the report are fixed values.


def status_text(results: DataFrame) -> list[Column]:
    """Texts of the panel, one for each metric and one overall."""
    each = [F.when(F.coalesce(F.col(m), F.lit(False)), f"✅ {TITLES[m]}: PASS").otherwise(f"{TITLES[m]}: FAIL").alias(f"{m}_text") for m in METRICS]
    return [*each, F.concat(F.lit("📈 **Overall Score**: "), percent(overall_of(results))).alias("overall_text")]


def report(results: DataFrame, key: str) -> DataFrame:
    """``key, report``: a line for each metric and the overall score."""
    line = lambda m: F.concat(F.when(status(F.col(m)) == "PASS", "✅").when(status(F.col(m)) == "ERROR", "⚠️").otherwise(""), F.lit(f" **{m.title()}**: "), status(F.col(m)))
    head, tail = F.lit("📊 **Evaluation Results**"), F.concat(F.lit("📈 **Overall Score**: "), percent(overall_of(results)))
    return results.select(key, F.concat_ws("\n", head, F.lit(""), *map(line, METRICS), F.lit(""), tail).alias("report"))
