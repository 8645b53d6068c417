"""Evaluation queries: ``labels`` give grades of documents, ``benchmark`` gives questions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.operators import evaluation as E
from corvane.plans import retrieval as R
from corvane.plans.registry import query, table
from corvane.storage import cut, small

G = """g AS (SELECT d.doc_id, source, text, quality = 1 AS groundedness, toxic = 0 AS relevance, CASE WHEN n_chars >= 200 THEN n_chars < 5000 END AS retrieval_accuracy
  FROM documents d JOIN labels l ON d.doc_id = l.doc_id)"""


def graded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality stands for groundedness, absence of toxicity for relevance, size for retrieval accuracy (none below 200 characters)."""
    docs = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    size = F.when(F.col("n_chars") >= 200, F.col("n_chars") < 5000)
    return docs.select("doc_id", "source", "text", (F.col("quality") == 1).alias("groundedness"), (F.col("toxic") == 0).alias("relevance"), size.alias("retrieval_accuracy"))


LONG = f"""{G}, e AS (
  SELECT doc_id, 'groundedness' AS metric, groundedness AS score FROM g UNION ALL SELECT doc_id, 'relevance', relevance FROM g UNION ALL SELECT doc_id, 'retrieval_accuracy', retrieval_accuracy FROM g
), s AS (SELECT doc_id, metric, score, CASE WHEN score IS NULL THEN 'ERROR' WHEN score THEN 'PASS' ELSE 'FAIL' END AS status FROM e)"""


@query(f"WITH {LONG} SELECT doc_id, metric, score, status FROM s")
def evaluate_response(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.unpivot(graded(spark, sf_dir), "doc_id")


@query(f"WITH {LONG} SELECT doc_id, round(coalesce(avg(CASE status WHEN 'PASS' THEN 1.0 WHEN 'FAIL' THEN 0.0 END), 0.0), 6)::DOUBLE AS overall_score FROM s GROUP BY doc_id")
def overall_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.overall(E.unpivot(graded(spark, sf_dir), "doc_id"), "doc_id").withColumn("overall_score", F.round("overall_score", 6))


OVERALL = "(groundedness::INT + relevance::INT + coalesce(retrieval_accuracy::INT, 0)) / (2 + (retrieval_accuracy IS NOT NULL)::INT)"


@query(
    f"""WITH {G} SELECT doc_id, CASE WHEN groundedness THEN '✅ Groundedness: PASS' ELSE 'Groundedness: FAIL' END AS groundedness_text, CASE WHEN relevance THEN '✅ Relevance: PASS' ELSE 'Relevance: FAIL' END AS relevance_text,
  CASE WHEN retrieval_accuracy THEN '✅ Retrieval Accuracy: PASS' ELSE 'Retrieval Accuracy: FAIL' END AS retrieval_accuracy_text, '📈 **Overall Score**: ' || printf('%.2f%%', {OVERALL} * 100) AS overall_text FROM g"""
)
def eval_status_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = graded(spark, sf_dir)
    return rows.select("doc_id", *E.status_text(rows))


ICON = "CASE {0} WHEN 'PASS' THEN '✅' WHEN 'ERROR' THEN '⚠️' ELSE '' END || ' **{1}**: ' || {0}"
STATUS = "CASE WHEN {0} IS NULL THEN 'ERROR' WHEN {0} THEN 'PASS' ELSE 'FAIL' END"


@query(
    f"""WITH {G}, s AS (SELECT *, {STATUS.format("groundedness")} AS s1, {STATUS.format("relevance")} AS s2, {STATUS.format("retrieval_accuracy")} AS s3 FROM g)
SELECT doc_id, concat_ws(chr(10), '📊 **Evaluation Results**', '', {ICON.format("s1", "Groundedness")}, {ICON.format("s2", "Relevance")}, {ICON.format("s3", "Retrieval_Accuracy")}, '', '📈 **Overall Score**: ' || printf('%.2f%%', {OVERALL} * 100)) AS report FROM s"""
)
def eval_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.report(graded(spark, sf_dir), "doc_id")


@query(
    f"""WITH {G}, x AS (SELECT *, CASE WHEN retrieval_accuracy IS NULL THEN 'ERROR' WHEN retrieval_accuracy THEN 'PASS' ELSE 'FAIL' END AS r FROM g)
SELECT doc_id, source AS question, substr(text, 1, 100) AS answer, CASE WHEN length(text) > 2000 THEN substr(text, 1, 2000) || '...' ELSE text END AS documents,
  groundedness AS groundedness_score, CASE WHEN groundedness THEN 'PASS' ELSE 'FAIL' END AS groundedness_status, relevance AS relevance_score, CASE WHEN relevance THEN 'PASS' ELSE 'FAIL' END AS relevance_status,
  retrieval_accuracy AS retrieval_accuracy_score, r AS retrieval_accuracy_status, round({OVERALL}, 6) AS overall_score FROM x"""
)
def eval_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the evaluation table (without its time, which no two runs share)."""
    rows = graded(spark, sf_dir)
    own = [c for m in E.METRICS for c in (F.col(m).alias(f"{m}_score"), E.status(F.col(m)).alias(f"{m}_status"))]
    return rows.select("doc_id", F.col("source").alias("question"), F.substring("text", 1, 100).alias("answer"), E.safe_join(F.array("text")).alias("documents"), *own, F.round(E.overall_of(rows), 6).alias("overall_score"))


@query(
    f"""WITH {R.U_DOCS}, {R.hybrid_sql(3)}, h AS (SELECT qid, id, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS r FROM fused)
SELECT qid, string_agg(CASE WHEN length(text) > 2000 THEN substr(text, 1, 2000) || '...' ELSE text END, chr(10) || chr(10) ORDER BY r) AS documents FROM h JOIN documents ON id = doc_id WHERE r <= 3 GROUP BY qid"""
)
def safe_join_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corvane.operators import retrieval as search

    units = R.documents(spark, sf_dir)
    found = search.hybrid(units, R.questions(spark, sf_dir), 3, threshold_stage="none")
    best = units.join(small(cut(found, "hits")), "id").groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("rank", "text"))).alias("d"))
    return best.select("qid", E.safe_join(F.transform("d", lambda x: x["text"])).alias("documents"))


@query(f"WITH {R.U_DOCS}, {R.hybrid_sql(3)} SELECT item_id AS qid, count(f.id) AS n_hits, CASE WHEN count(f.id) > 0 THEN 'PASS' ELSE 'FAIL' END AS status FROM benchmark LEFT JOIN (SELECT * FROM fused WHERE score >= 0.7) f ON f.qid = item_id GROUP BY item_id")
def evaluate_retrieval(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corvane.operators import retrieval as search

    found = search.hybrid(R.documents(spark, sf_dir), R.questions(spark, sf_dir), 3)
    counted = R.questions(spark, sf_dir).select("qid").join(found, "qid", "left").groupBy("qid").agg(F.count("id").alias("n_hits"))
    return counted.withColumn("status", E.status(F.col("n_hits") > 0))


@query(
    f"""WITH d AS (SELECT doc_id, source || ' ' || lang || ' ' || substr(text, 1, 60) AS q, text FROM documents),
w AS (SELECT doc_id, list_distinct({R.TOKENS.replace("coalesce(text, '')", "q")}) AS a, {R.TOKENS} AS b FROM d)
SELECT doc_id, CASE WHEN len(a) > 0 THEN round(len(list_intersect(a, b)) / len(a), 6) ELSE 0.0 END AS overlap, len(a) > 0 AND len(list_intersect(a, b)) / len(a) >= 0.8 AS result FROM w"""
)
def overlap_grader(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = F.concat_ws(" ", "source", "lang", F.substring("text", 1, 60))
    return table(spark, sf_dir, "documents").select("doc_id", F.round(E.overlap(q, F.col("text")), 6).alias("overlap"), E.overlap_grade(q, F.col("text"), 0.8).alias("result"))


RAW = r"""CASE WHEN quality = 1 AND toxic = 0 THEN '```json' || chr(10) || '{"explanation": "x", "result": true}' || chr(10) || '```' WHEN quality = 1 THEN '{"explanation": "x", "correct": true, "result": true}'
  WHEN toxic = 1 THEN '```{"explanation": "x", "result": true}```' ELSE '{"explanation": "x"' END"""


@query("SELECT doc_id, quality = 1 AS result FROM labels")
def parse_grader(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fenced, plain, one-line fenced (nothing left to parse) and cut-off output."""
    return table(spark, sf_dir, "labels").select("doc_id", E.parse_grade(F.expr(RAW.replace("chr(10)", "char(10)"))).alias("result"))


@query("SELECT doc_id, quality = 1 AND toxic = 1 AS correct FROM labels")
def correctness_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "labels").select("doc_id", E.parse_correctness(F.expr(RAW.replace("chr(10)", "char(10)"))).alias("correct"))
