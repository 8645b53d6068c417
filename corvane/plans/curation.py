"""Curation queries over ``documents``, ``embeddings`` and ``events``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.operators import bands as B
from corvane.operators import bitmaps as M
from corvane.operators import curation as C
from corvane.operators import delta as X
from corvane.operators import intervals as V
from corvane.plans.registry import query, table
from corvane.storage import cut, small


@query("SELECT sha256(text) AS sha, min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY 1")
def exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.exact_copies(table(spark, sf_dir, "documents"))


@query("SELECT sha256(text) AS sha, count(DISTINCT source) AS n_sources, count(*) AS copies FROM documents GROUP BY 1 HAVING count(DISTINCT source) > 1")
def cross_source_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.cross_source(table(spark, sf_dir, "documents"))


LINKS = """WITH RECURSIVE n AS (SELECT vec_id, embedding::DOUBLE[] AS v, sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS l FROM embeddings),
p AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM n a JOIN n b ON a.vec_id <> b.vec_id AND round(list_inner_product(a.v, b.v) / (a.l * b.l), 6) >= {0}),
c AS (SELECT vec_id AS node, vec_id AS root FROM n UNION SELECT p.b, c.root FROM c JOIN p ON p.a = c.node)
SELECT node AS vec_id, (SELECT count(*) FROM p WHERE p.a = node) AS n_links, min(root) AS class_id FROM c GROUP BY node"""


@query(LINKS.format(0.45))
def near_dup_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.semantic_links(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", 0.45)


@query(LINKS.format(0.9))
def near_dup_banded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of high cosine, by bands; at this threshold the tables' links are found whole."""
    return B.banded_links(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", 0.9)


@query(
    """WITH o AS (SELECT doc_id, text FROM documents WHERE lang <> 'fr'), n AS (SELECT doc_id, CASE lang WHEN 'de' THEN upper(text) ELSE text END AS text FROM documents WHERE source <> 'src3')
SELECT coalesce(o.doc_id, n.doc_id) AS doc_id, CASE WHEN o.doc_id IS NULL THEN 'new' WHEN n.doc_id IS NULL THEN 'removed' WHEN sha256(o.text) = sha256(n.text) THEN 'unchanged' ELSE 'changed' END AS status
FROM o FULL JOIN n ON o.doc_id = n.doc_id"""
)
def delta_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two snapshots: before without French documents, after without one source and with German texts in capitals."""
    docs = table(spark, sf_dir, "documents")
    after = docs.filter("source <> 'src3'").withColumn("text", F.when(F.col("lang") == "de", F.upper("text")).otherwise(F.col("text")))
    return C.delta(docs.filter("lang <> 'fr'"), after, "doc_id")


@query(
    """WITH h AS (SELECT doc_id, sha256(source || chr(9247) || text) AS h FROM documents)
SELECT doc_id, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-' || substr(h, 13, 4) || '-' || substr(h, 17, 4) || '-' || substr(h, 21, 12) AS stable_id FROM h"""
)
def stable_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", C.stable_id(F.col("source"), F.col("text")).alias("stable_id"))


@query(
    """WITH t AS (SELECT unnest([lang, source, CASE WHEN n_chars > 5000 THEN 'long' ELSE 'short' END]) AS tag, n_chars FROM documents)
SELECT tag, count(*) AS n_docs, sum(n_chars)::BIGINT AS chars FROM t GROUP BY tag"""
)
def metadata_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    meta = F.create_map(F.lit("lang"), F.col("lang"), F.lit("source"), F.col("source"), F.lit("size"), F.when(F.col("n_chars") > 5000, "long").otherwise("short"))
    tagged = table(spark, sf_dir, "documents").select(F.explode(F.map_values(meta)).alias("tag"), "n_chars")
    return tagged.groupBy("tag").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("n_chars").alias("chars"))


VERSIONS = "v AS (SELECT source || '_' || n_chars AS doc_key, doc_id, n_chars, (row_number() OVER (PARTITION BY source, n_chars ORDER BY doc_id))::INT AS version FROM documents)"


@query(f"WITH {VERSIONS} SELECT doc_key, doc_id, version FROM v")
def doc_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    docs = table(spark, sf_dir, "documents").select(F.expr("source || '_' || n_chars").alias("doc_key"), "doc_id")
    return docs.withColumn("version", F.row_number().over(Window.partitionBy("doc_key").orderBy("doc_id")))


@query("SELECT source || '_' || n_chars AS doc_key, max(doc_id) AS doc_id, max_by(md5(text), doc_id) AS text_md5 FROM documents WHERE doc_id <= (SELECT avg(doc_id) FROM documents) GROUP BY 1")
def version_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.expr("source || '_' || n_chars").alias("doc_key"), "doc_id", F.md5("text").alias("text_md5"))
    at = docs.agg(F.avg("doc_id").alias("__at"))  # one row
    joined = docs.join(small(at))
    return C.as_of(joined, "doc_key", "doc_id", F.col("__at")).select("doc_key", "doc_id", "text_md5")


@query("SELECT lang, source, count(*) AS n_docs, sum(n_chars)::BIGINT AS chars FROM documents GROUP BY GROUPING SETS ((lang, source), (lang), (source), ())")
def doc_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("lang", "source", "n_chars")
    return docs.cube("lang", "source").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("n_chars").alias("chars"))


@query("SELECT doc_id, source, n_chars FROM documents WHERE lang IN ('de', 'fr') AND n_chars >= 2000 AND source <> 'src0'")
def list_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.filter(F.col("lang").isin("de", "fr") & (F.col("n_chars") >= 2000) & (F.col("source") != "src0")).select("doc_id", "source", "n_chars")


@query("SELECT user_id, max_by(event_type, (ts, event_id)) AS status, count(*) AS n_changes, count(*) FILTER (event_type = 'error') AS n_errors FROM events GROUP BY user_id")
def registry_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a registry's log: the last status of each key, with its history's size and errors."""
    log = table(spark, sf_dir, "events")
    last = F.max_by("event_type", F.struct("ts", "event_id")).alias("status")
    return log.groupBy("user_id").agg(last, F.count(F.lit(1)).alias("n_changes"), F.count(F.when(F.col("event_type") == "error", 1)).alias("n_errors"))


@query()
def chunk_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two states of each document, before and after words are put into the middle of German ones: how many chunks stay, come and go."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    half = F.floor(F.length("text") / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), half), F.lit(" some words that were not there "), F.substring("text", half + 1, F.length("text")))
    before = X.chunks(docs, "doc_id", "text")
    after = X.chunks(docs.withColumn("text", F.when(F.col("lang") == "de", edited).otherwise(F.col("text"))), "doc_id", "text")
    found = X.chunk_delta(before, after, "doc_id")
    return found.groupBy("doc_id").agg(F.sum("n_kept").alias("n_kept"), F.sum("n_added").alias("n_added"), F.sum("n_removed").alias("n_removed"))


TAGGED = "(lang = 'de' OR lang = 'fr') AND NOT source = 'src0' AND NOT (lang = 'fr' AND CASE WHEN n_chars > 5000 THEN 'long' ELSE 'short' END = 'long')"


@query(f"SELECT doc_id, source, n_chars FROM documents WHERE {TAGGED}")
def list_by_bitmap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A listing by conjunction, disjunction and negation of tags, from a bitmap index; documents are read by number only."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("number"), "lang", "source", "n_chars")
    tags = F.create_map(F.lit("lang"), F.col("lang"), F.lit("source"), F.col("source"), F.lit("size"), F.when(F.col("n_chars") > 5000, "long").otherwise("short"))
    index = cut(M.build(docs.select("number", F.explode(tags).alias("tag", "value")), docs), "bitmaps")
    french = M.Has("lang", "fr")
    condition = M.And((M.Or((M.Has("lang", "de"), french)), M.Not(M.Has("source", "src0")), M.Not(M.And((french, M.Has("size", "long"))))))
    found = M.numbers(M.matching(index, condition))
    return docs.join(found, "number", "left_semi").select(F.col("number").alias("doc_id"), "source", "n_chars")


@query(
    """WITH q AS (SELECT event_id AS qid, user_id, ts + INTERVAL 30 MINUTE AS at FROM events WHERE event_type = 'error')
SELECT qid, q.user_id AS user_id, max_by(e.event_type, (e.ts, e.event_id)) AS status, max_by(e.event_id, (e.ts, e.event_id)) AS event_id FROM q JOIN events e ON e.user_id = q.user_id AND e.ts <= q.at GROUP BY qid, q.user_id"""
)
def status_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a registry's log: the status of each user half an hour after each of their errors, by validity intervals."""
    log = table(spark, sf_dir, "events")
    index = V.stored(log.select("user_id", "ts", "event_id", F.col("event_type").alias("status")), "user_id", "ts", "event_id").drop("ts")
    asked = log.filter("event_type = 'error'").select(F.col("event_id").alias("qid"), "user_id", (F.col("ts") + F.expr("INTERVAL 30 MINUTES")).alias("at"))
    return V.as_of(asked, index, "user_id", "at").select("qid", "user_id", "status", "event_id")
