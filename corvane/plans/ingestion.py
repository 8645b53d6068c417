"""Ingestion queries: a document's path is made from its source, size and language."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.functions import text as T
from corvane.plans.registry import query, table
from corvane.sources import documents as D
from corvane.sources.parents import ParentStore
from corvane.storage import scratch

EXT = "CASE lang WHEN 'en' THEN 'pdf' WHEN 'de' THEN 'DOCX' WHEN 'fr' THEN 'html' ELSE 'dat' END"
FILES = f"f AS (SELECT doc_id, text, lang, source, source || '/' || source || '_' || n_chars || '.' || {EXT} AS path, source || '_' || n_chars AS stem FROM documents)"


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").withColumn("path", F.expr(f"source || '/' || source || '_' || n_chars || '.' || {EXT}"))


def existing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spanish documents count as ingested before."""
    return files(spark, sf_dir).filter("lang = 'es'").select(T.stem_of(F.col("path")).alias("stem"))


@query(f"WITH {FILES} SELECT stem, min(doc_id) AS doc_id FROM f WHERE stem NOT IN (SELECT stem FROM f WHERE lang = 'es') GROUP BY stem")
def ingest_skip_existing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.skip_existing(files(spark, sf_dir), existing(spark, sf_dir), "doc_id")


@query(
    f"""WITH {FILES}, a AS (SELECT count(DISTINCT stem) AS added FROM f WHERE regexp_matches(text, '\\S') AND stem NOT IN (SELECT stem FROM f WHERE lang = 'es'))
SELECT added, (SELECT count(*) FROM f) - added AS skipped FROM a"""
)
def ingest_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.ingest_counts(files(spark, sf_dir), existing(spark, sf_dir), "doc_id", "text")


TO_TEXT = r"""trim(regexp_replace(replace(replace(replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(html,
  '(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<!--.*?-->', ' ', 'g'), '<[^>]*>', ' ', 'g'),
  '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&nbsp;', ' '), '&copy;', '©'), '&middot;', '·'), '&amp;', '&'), '\s+', ' ', 'g'))"""


@query(f"SELECT page_id, {TO_TEXT} AS text FROM pages")
def pages_to_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", T.html_to_text(F.col("html")).alias("text"))


@query("SELECT DISTINCT source || '_' || n_chars AS name FROM documents")
def list_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = files(spark, sf_dir).select(F.concat(T.stem_of(F.col("path")), F.lit(".md")).alias("name"))
    return stored.select(F.replace("name", F.lit(".md"), F.lit("")).alias("name")).distinct().orderBy("name")


@query(f"WITH {FILES} SELECT string_split(path, '.')[-1] AS file_type, count(*) AS file_count FROM f GROUP BY ALL")
def file_type_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files(spark, sf_dir).groupBy(T.extension_of(F.col("path")).alias("file_type")).agg(F.count(F.lit(1)).alias("file_count"))


@query(
    f"""WITH {FILES} SELECT doc_id AS id, CASE lower(string_split(path, '.')[-1]) WHEN 'pdf' THEN 'pdf' WHEN 'docx' THEN 'docx' WHEN 'html' THEN 'html' ELSE 'unknown' END AS format FROM f
UNION ALL SELECT page_id, CASE WHEN starts_with(lower(html), '<!doctype html') OR starts_with(lower(html), '<html') THEN 'html' ELSE 'unknown' END FROM pages"""
)
def detect_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = files(spark, sf_dir).select(F.col("doc_id").alias("id"), D.detect_format(F.col("path")).alias("format"))
    pages = table(spark, sf_dir, "pages")
    return docs.unionByName(pages.select(F.col("page_id").alias("id"), D.detect_format(F.lit("page"), F.col("html")).alias("format")))


STORE = "s AS (SELECT source || '_parent_' || n_chars // 400 AS parent_id, max(doc_id) AS doc_id, max_by(text, doc_id) AS content FROM documents GROUP BY ALL)"


def store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parents by source and size; English ones are there before, the others are written over them."""
    rows = table(spark, sf_dir, "documents").select(F.expr("source || '_parent_' || n_chars div 400").alias("parent_id"), "doc_id", F.col("text").alias("content"), "lang")
    part = lambda condition: rows.filter(condition).drop("lang")
    return D.upsert(part("lang = 'en'"), part("lang <> 'en' OR lang IS NULL"), "parent_id", "doc_id")


@query(f"WITH {STORE} SELECT parent_id, doc_id, md5(content) AS content_md5 FROM s")
def parent_store_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store(spark, sf_dir).select("parent_id", "doc_id", F.md5("content").alias("content_md5"))


ASKED = "a AS (SELECT DISTINCT source || '_parent_' || n_chars // 300 || CASE lang WHEN 'en' THEN '.JSON' WHEN 'de' THEN '.json' ELSE '' END AS asked FROM documents)"


LOOKUP = f"WITH {STORE}, {ASKED} SELECT asked, parent_id, md5(content) AS content_md5 FROM a JOIN s ON parent_id = regexp_replace(asked, '(?i)\\.json$', '')"


def asked_parents(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = table(spark, sf_dir, "documents").select(F.expr("source || '_parent_' || n_chars div 300 || CASE lang WHEN 'en' THEN '.JSON' WHEN 'de' THEN '.json' ELSE '' END").alias("asked")).distinct()
    return asked.withColumn("parent_id", D.parent_key(F.col("asked")))


@query(LOOKUP)
def parent_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = asked_parents(spark, sf_dir).join(store(spark, sf_dir), "parent_id")
    return found.select("asked", "parent_id", F.md5("content").alias("content_md5"))


@query(LOOKUP)
def parent_lookup_bucketed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same from a store in buckets, which isn't shuffled for it."""
    parents = ParentStore(spark, scratch(spark, "parents"))
    parents.write("parents", store(spark, sf_dir))
    return parents.fetch(asked_parents(spark, sf_dir)).select("asked", "parent_id", F.md5("content").alias("content_md5"))


@query(
    f"""WITH {STORE}, c AS (SELECT source || '_parent_' || n_chars // 400 AS parent_id, count(*) AS n_children, count(DISTINCT lang) AS n_langs FROM documents GROUP BY 1)
SELECT parent_id, n_children, n_langs, s.doc_id AS parent_doc_id, md5(s.content) AS content_md5 FROM c JOIN s USING (parent_id)"""
)
def children_with_parents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Children and parents of one bucketing: the join and the count of children need no shuffle."""
    own = ParentStore(spark, scratch(spark, "parents"))
    own.write("parents", store(spark, sf_dir))
    own.write("children", table(spark, sf_dir, "documents").select(F.expr("source || '_parent_' || n_chars div 400").alias("parent_id"), "lang"))
    counts = own.table("children").groupBy("parent_id").agg(F.count(F.lit(1)).alias("n_children"), F.count_distinct("lang").alias("n_langs"))
    own._tables["counts"] = counts
    found = own.with_parents("counts")
    return found.select("parent_id", "n_children", "n_langs", "parent_doc_id", F.md5("parent_content").alias("content_md5"))


@query(
    """WITH c AS (SELECT DISTINCT source, sha256(doc_id || ':' || i) AS chunk_id FROM documents, unnest(range(0, greatest(0, ceil((length(text) - 500) / 400.0))::BIGINT + 1)) t(i))
SELECT source, count(*) AS n_chunks, min(chunk_id) AS first_id FROM c GROUP BY source"""
)
def reingest_idempotent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Indexing all documents twice leaves each chunk once."""
    from corvane.operators.chunking import fixed_windows

    docs = table(spark, sf_dir, "documents")
    once = fixed_windows(docs.select("doc_id", "source", "text"), "text").select("source", D.chunk_id(F.col("doc_id").cast("string"), F.col("chunk_idx")).alias("chunk_id"))
    return once.unionByName(once).dropDuplicates(["chunk_id"]).groupBy("source").agg(F.count(F.lit(1)).alias("n_chunks"), F.min("chunk_id").alias("first_id"))
