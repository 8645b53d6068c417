"""Retrieval queries: ``benchmark`` texts ask, ``documents`` (or their windows) answer; ``embeddings`` for vectors alone."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane import config
from corvane.functions import text as T
from corvane.operators import chunking as K
from corvane.operators import retrieval as R
from corvane.operators.cells import VectorIndex
from corvane.operators.index import HybridIndex
from corvane.operators.postings import PostingIndex
from corvane.plans.registry import query, table
from corvane.storage import cut, scratch, small


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), "text")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")


def windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = K.fixed_windows(table(spark, sf_dir, "documents").select("doc_id", "source", "text"), "text")
    return rows.select((F.col("doc_id") * 100000 + F.col("chunk_idx")).alias("id"), "doc_id", "source", F.col("content").alias("text"))


TOKENS = r"list_filter(string_split_regex(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '')"
U_DOCS = "u AS (SELECT doc_id AS id, text FROM documents)"
U_WINDOWS = "u AS (SELECT doc_id * 100000 + i AS id, doc_id, source, substr(text, i * 400 + 1, 500) AS text FROM documents, unnest(range(0, greatest(0, ceil((length(text) - 500) / 400.0))::BIGINT + 1)) t(i))"


def hybrid_sql(k: int, asked: str = "(SELECT item_id AS qid, text FROM benchmark)") -> str:
    """Ranks (from 0) of each kind as ``ranked``, and fused scores as ``fused``; over ``u(id, text)`` and ``asked`` (``qid, text``)."""
    return f"""ut AS (SELECT id, {TOKENS} AS w FROM u), qt AS (SELECT qid, {TOKENS} AS w FROM {asked}),
tf AS (SELECT id, len(w) AS l, t, count(*) AS tf FROM (SELECT id, w, unnest(w) AS t FROM ut) GROUP BY id, len(w), t),
qf AS (SELECT qid, t, count(*) AS tf FROM (SELECT qid, unnest(w) AS t FROM qt) GROUP BY qid, t),
sparse AS (SELECT qid, id, 'sparse' AS kind, round(sum(tf.tf * (1.2::DOUBLE + 1) / (tf.tf + 1.2::DOUBLE * (1 - 0.75::DOUBLE + 0.75::DOUBLE * l / 256))), 6) AS score FROM tf JOIN qf USING (t) GROUP BY qid, id),
ub AS (SELECT id, ('0x' || substr(md5(t), 1, 4))::INT % 256 AS b, sum(tf)::DOUBLE AS c FROM tf GROUP BY ALL), qb AS (SELECT qid, ('0x' || substr(md5(t), 1, 4))::INT % 256 AS b, sum(tf)::DOUBLE AS c FROM qf GROUP BY ALL),
un AS (SELECT id, sqrt(sum(c * c)) AS n FROM ub GROUP BY id), qn AS (SELECT qid, sqrt(sum(c * c)) AS n FROM qb GROUP BY qid),
dense AS (SELECT d.qid, d.id, 'dense' AS kind, round(d.p / (un.n * qn.n), 6) AS score FROM (SELECT qid, id, sum(ub.c * qb.c) AS p FROM ub JOIN qb USING (b) GROUP BY qid, id) d JOIN un USING (id) JOIN qn USING (qid)),
ranked AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid, kind ORDER BY score DESC, id) - 1 AS rank FROM (SELECT * FROM sparse UNION ALL SELECT * FROM dense) WHERE score > 0) WHERE rank < {k}),
fused AS (SELECT qid, id, round(sum(1::DOUBLE / (rank + 2)), 6) AS score FROM ranked GROUP BY qid, id)"""


@query(f"WITH {U_DOCS}, {hybrid_sql(config.TOP_K)} SELECT qid, id, score, (row_number() OVER (PARTITION BY qid ORDER BY score DESC, id))::INT AS rank FROM fused WHERE score >= 0.7")
def hybrid_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.hybrid(documents(spark, sf_dir), questions(spark, sf_dir))


@query(f"WITH {U_DOCS}, {hybrid_sql(config.TOP_K)} SELECT qid, id, rank::INT AS rank, score FROM ranked WHERE kind = 'sparse'")
def sparse_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.candidates(documents(spark, sf_dir), questions(spark, sf_dir), config.TOP_K).filter("kind = 'sparse'").select("qid", "id", "rank", "score")


@query(f"WITH {U_DOCS}, {hybrid_sql(config.TOP_K)} SELECT qid, id, rank::INT AS rank, score FROM ranked WHERE kind = 'sparse'")
def sparse_topk_indexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same rows from a stored inverted index of two segments; texts are read to build it only."""
    index, docs = PostingIndex(spark, scratch(spark, "postings")), documents(spark, sf_dir)
    for part in (0, 1):
        index.add(docs.filter(F.col("id") % 2 == part))
    return index.search(questions(spark, sf_dir), config.TOP_K).select("qid", "id", "rank", "score")


@query()
def sparse_index_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many posting blocks the index has, how many a question's words have, and how many are opened for it."""
    index = PostingIndex(spark, scratch(spark, "postings"))
    index.add(documents(spark, sf_dir))
    return index.report(questions(spark, sf_dir), config.TOP_K)


@query(f"WITH {U_DOCS}, {hybrid_sql(config.TOP_K)} SELECT qid, id, score, (row_number() OVER (PARTITION BY qid ORDER BY score DESC, id))::INT AS rank FROM fused WHERE score >= 0.7")
def hybrid_search_indexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same rows as ``hybrid_search`` from stored indexes of words and vectors."""
    index = HybridIndex(spark, scratch(spark, "hybrid"))
    index.add(documents(spark, sf_dir))
    return R.hybrid(None, questions(spark, sf_dir), search=index.candidates)


@query(f"WITH {U_DOCS}, {hybrid_sql(config.TOP_K)} SELECT qid, count(*) AS n_all, count(*) FILTER (score >= 0.7) AS n_passed FROM fused GROUP BY qid")
def threshold_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    fused = R.fuse(R.candidates(documents(spark, sf_dir), questions(spark, sf_dir), config.TOP_K))
    return fused.groupBy("qid").agg(F.count(F.lit(1)).alias("n_all"), F.count(F.when(F.col("score") >= config.SCORE_THRESHOLD, 1)).alias("n_passed"))


COSINE = "round(list_inner_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) / (sqrt(list_inner_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[])) * sqrt(list_inner_product(b.embedding::DOUBLE[], b.embedding::DOUBLE[]))), 6)"


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))


NEAREST = f"""SELECT qid, id, score, (row_number() OVER (PARTITION BY qid ORDER BY score DESC, id))::INT AS rank
FROM (SELECT a.vec_id AS qid, b.vec_id AS id, {COSINE} AS score FROM embeddings a JOIN embeddings b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id)
QUALIFY row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) <= 7"""


def vector_index(spark: SparkSession, sf_dir: str) -> tuple[VectorIndex, DataFrame]:
    index, rows = VectorIndex(spark, scratch(spark, "cells")), vectors(spark, sf_dir)
    index.add(rows)
    return index, rows.filter("id % 50 = 0").withColumnRenamed("id", "qid")


@query(NEAREST)
def dense_topk_indexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same rows as ``dense_topk_batch`` from a stored vector index."""
    index, asked = vector_index(spark, sf_dir)
    return index.search(asked, config.TOP_K)


@query()
def dense_index_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many rows the vector index has, and how many are compared with each query."""
    index, asked = vector_index(spark, sf_dir)
    return index.report(asked, config.TOP_K)


@query(NEAREST)
def dense_topk_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = vectors(spark, sf_dir)
    return R.exact_nearest(rows, rows.filter("id % 50 = 0"), config.TOP_K)


@query(f"WITH {U_DOCS}, ut AS (SELECT id, unnest({TOKENS}) AS t FROM u) SELECT id AS doc_id, (('0x' || substr(md5(t), 1, 4))::INT % 256)::INT AS bucket, count(*) AS n FROM ut GROUP BY ALL")
def hash_embed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.embed(table(spark, sf_dir, "documents"), "doc_id", "text")


@query(
    f"""WITH {U_DOCS}, ut AS (SELECT id, {TOKENS} AS w FROM u), tf AS (SELECT id, l, t, count(*) AS tf FROM (SELECT id, len(w) AS l, unnest(w) AS t FROM ut) GROUP BY ALL)
SELECT id AS doc_id, t AS token, round(tf * (1.2::DOUBLE + 1) / (tf + 1.2::DOUBLE * (1 - 0.75::DOUBLE + 0.75::DOUBLE * l / 256)), 6) AS weight FROM tf"""
)
def bm25_tf_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.term_weights(table(spark, sf_dir, "documents"), "doc_id", "text").withColumn("weight", F.round("weight", 6))


STRIP = r"regexp_replace(regexp_replace({0}, '^\s+', ''), '\s+$', '')"
HIT = "'Parent ID: doc' || doc_id || chr(10) || 'File Name: ' || source || chr(10) || 'Content: ' || " + STRIP.format("text")


def search_windows(spark: SparkSession, sf_dir: str, asked: DataFrame, k: int, threshold_stage: str = "fused") -> DataFrame:
    """``qid, rank, score, doc_id, source, text`` of the best windows for ``asked`` (``qid, text``).

    Hits are written; their texts are cut from the few documents that have any, without making all windows again.
    """
    found = cut(R.hybrid(windows(spark, sf_dir).select("id", "text"), asked, k, threshold_stage=threshold_stage), "hits")
    own = found.withColumns({"doc_id": F.floor(F.col("id") / 100000), "__at": F.col("id") % 100000}).drop("id")
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", F.col("text").alias("__text"))
    text = F.substring("__text", F.col("__at").cast("int") * (config.CHILD_SIZE - config.CHILD_OVERLAP) + 1, F.lit(config.CHILD_SIZE))
    return docs.join(small(own), "doc_id").select("qid", "rank", "score", "doc_id", "source", text.alias("text"))


def hits(spark: SparkSession, sf_dir: str, k: int, threshold_stage: str = "fused") -> DataFrame:
    return search_windows(spark, sf_dir, questions(spark, sf_dir), k, threshold_stage)


@query(
    f"""WITH {U_WINDOWS}, {hybrid_sql(3)}, h AS (SELECT qid, score, id FROM fused WHERE score >= 0.7)
SELECT item_id AS qid, coalesce((SELECT string_agg({HIT}, chr(10) || chr(10) ORDER BY score DESC, h.id) FROM h JOIN u ON h.id = u.id WHERE h.qid = item_id), 'NO_RELEVANT_CHUNKS') AS result FROM benchmark"""
)
def search_child_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = R.formatted(F.concat(F.lit("doc"), F.col("doc_id").cast("string")), F.col("source"), F.col("text"))
    found = hits(spark, sf_dir, 3).groupBy("qid").agg(R.joined_in_order(F.col("rank"), text).alias("result"))
    return questions(spark, sf_dir).select("qid").join(found, "qid", "left").withColumn("result", F.coalesce("result", F.lit(config.NO_CHUNKS)))


@query(
    f"""WITH {U_WINDOWS}, {hybrid_sql(3)}, h AS (SELECT qid, score, id, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS r FROM fused)
SELECT qid, string_agg({HIT}, chr(10) || chr(10) ORDER BY r) AS result FROM h JOIN u ON h.id = u.id WHERE r <= 3 GROUP BY qid"""
)
def format_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = R.formatted(F.concat(F.lit("doc"), F.col("doc_id").cast("string")), F.col("source"), F.col("text"))
    return hits(spark, sf_dir, 3, "none").groupBy("qid").agg(R.joined_in_order(F.col("rank"), text).alias("result"))


@query("SELECT doc_id, coalesce(source, 'Unknown') AS source, CASE WHEN length(text) > 500 THEN substr(text, 1, 500) || '...' ELSE text END AS preview FROM documents")
def chunk_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.coalesce("source", F.lit("Unknown")).alias("source"), T.cut_to(F.col("text"), 500).alias("preview"))


IDS = "i AS (SELECT DISTINCT CASE WHEN lang = 'es' THEN source ELSE source || '_parent_' || n_chars END AS parent_id FROM documents)"


def ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.when(F.col("lang") == "es", F.col("source")).otherwise(F.concat("source", F.lit("_parent_"), F.col("n_chars").cast("string"))).alias("parent_id"))


@query(f"WITH {IDS} SELECT parent_id, coalesce(TRY_CAST(regexp_extract(parent_id, '_parent_(\\d+)$', 1) AS BIGINT), 0) AS sort_key FROM i")
def parent_sort_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.parents_sorted(ids(spark, sf_dir))


@query(f"WITH {IDS}, k AS (SELECT parent_id, coalesce(TRY_CAST(regexp_extract(parent_id, '_parent_(\\d+)$', 1) AS BIGINT), 0) AS sort_key FROM i) SELECT parent_id, sort_key FROM k ORDER BY sort_key, parent_id")
def parent_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.parents_sorted(ids(spark, sf_dir)).orderBy("sort_key", "parent_id")


ONE = "'Parent ID: ' || coalesce(p.parent_id, 'n/a') || chr(10) || 'File Name: ' || coalesce(p.source, 'unknown') || chr(10) || 'Content: ' || " + STRIP.format("p.content")
PARENTS = "p AS (SELECT 'doc' || doc_id AS parent_id, source || '.pdf' AS source, text AS content FROM documents WHERE lang = 'en')"


def english_parents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").filter("lang = 'en'")
    return docs.select(F.concat(F.lit("doc"), F.col("doc_id").cast("string")).alias("parent_id"), F.concat("source", F.lit(".pdf")).alias("file"), F.col("text").alias("content"))


@query(f"WITH {PARENTS} SELECT d.doc_id AS doc_id, CASE WHEN p.parent_id IS NULL THEN 'NO_PARENT_DOCUMENT' ELSE md5({ONE}) END AS result FROM documents d LEFT JOIN p ON p.parent_id = 'doc' || d.doc_id")
def parent_fetch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parents are there for English documents only."""
    asked = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("doc"), F.col("doc_id").cast("string")).alias("parent_id"))
    found = asked.join(english_parents(spark, sf_dir).withColumnRenamed("parent_id", "__found"), F.col("parent_id") == F.col("__found"), "left")
    text = R.formatted(F.col("__found"), F.col("file"), F.col("content"))
    return found.select("doc_id", F.when(F.col("__found").isNull(), "NO_PARENT_DOCUMENT").otherwise(F.md5(text)).alias("result"))


EXPANDED = f"""{U_WINDOWS}, {hybrid_sql(3)}, h AS (SELECT qid, id, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS r FROM fused),
d AS (SELECT DISTINCT qid, doc_id FROM h JOIN u ON h.id = u.id WHERE r <= 3)"""


@query(f"WITH {EXPANDED}, p AS (SELECT qid, d.doc_id, 'doc' || d.doc_id AS parent_id, source || '.pdf' AS source, text AS content FROM d JOIN documents USING (doc_id)) SELECT qid, count(*) AS n_parents, string_agg({ONE}, chr(10) || chr(10) ORDER BY doc_id) AS result FROM p GROUP BY qid")
def parent_fetch_many(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole documents of each question's best windows, without repeats, by id."""
    wanted = cut(hits(spark, sf_dir, 3, "none").select("qid", "doc_id").distinct(), "wanted")
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", F.col("text").alias("content"))
    text = R.formatted(F.concat(F.lit("doc"), F.col("doc_id").cast("string")), F.concat("source", F.lit(".pdf")), F.col("content"))
    return docs.join(small(wanted), "doc_id").groupBy("qid").agg(F.count(F.lit(1)).alias("n_parents"), R.joined_in_order(F.col("doc_id"), text).alias("result"))
