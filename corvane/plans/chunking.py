"""Chunking queries. Markdown is made from all visible text of pages: the title, and each paragraph under a heading of its own."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.functions import tables
from corvane.functions import text as T
from corvane.operators import chunking as K
from corvane.plans.registry import query, table


def markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", T.html_to_markdown(F.col("html")).alias("md"))


def decoded(text: str) -> str:
    """SQL that replaces the named character references in a SQL expression."""
    for name, char in T.ENTITIES:
        text = f"replace({text}, '{name}', '{char.replace(chr(39), chr(39) * 2)}')"
    return text


def line(text: str) -> str:
    """SQL for one line of text that reads as no heading or fence."""
    return rf"regexp_replace(trim(regexp_replace({decoded(f'translate({text}, chr(2) || chr(3), {chr(39)}  {chr(39)})')}, '\s+', ' ', 'g')), '^(#|```|~~~)', '\\\1')"


#: Sections ``sec(page_id, idx, h1, h2, content)``; a title with nothing between it and the first paragraph is joined with that.
MD = rf"""t AS (
  SELECT page_id, string_split(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(translate(coalesce(html, ''), chr(1) || chr(2) || chr(3), '   '),
    '(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<!--.*?-->', ' ', 'g'), '(?i)<p(?:\s[^>]*)?>', chr(1), 'g'), '(?i)<h1(?:\s[^>]*)?>', chr(2), 'g'), '(?i)</h1\s*>', chr(3), 'g'), '<[^>]*>', ' ', 'g'), chr(1)) AS ps FROM pages
), h AS (
  SELECT page_id, ps, regexp_matches(ps[1], '\x02[^\x03]*\x03') AS titled, regexp_extract(ps[1], '\x02([^\x03]*)\x03', 1) AS raw FROM t
), d AS (
  SELECT page_id, ps, titled, trim(regexp_replace({decoded("raw")}, '\s+', ' ', 'g')) AS title,
    {line(r"CASE WHEN titled THEN regexp_extract(ps[1], '(?s)^([^\x02]*)\x02', 1) ELSE ps[1] END")} AS pre,
    CASE WHEN titled THEN {line(r"regexp_extract(ps[1], '(?s)\x02[^\x03]*\x03(.*)$', 1)")} ELSE '' END AS post FROM h
), parts AS (
  SELECT page_id, i - 1 AS part, {line("ps[i]")} AS body FROM d, unnest(range(2, len(ps) + 1)) x(i)
), raw_sec AS (
  SELECT page_id, -2::BIGINT AS part, NULL::VARCHAR AS h1, NULL::VARCHAR AS h2, pre AS content FROM d WHERE pre <> ''
  UNION ALL SELECT page_id, -1, title, NULL, rtrim('# ' || title) || CASE WHEN post <> '' THEN chr(10) || post ELSE '' END FROM d WHERE titled AND (post <> '' OR len(ps) = 1)
  UNION ALL SELECT p.page_id, part, CASE WHEN titled THEN title END, 'Part ' || part,
    CASE WHEN part = 1 AND titled AND post = '' THEN rtrim('# ' || title) || '  ' || chr(10) ELSE '' END || '## Part ' || part || CASE WHEN body <> '' THEN chr(10) || body ELSE '' END
    FROM parts p JOIN d ON p.page_id = d.page_id
), sec AS (
  SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY part) - 1 AS idx, h1, h2, content FROM raw_sec
)"""


@query(f"WITH {MD} SELECT page_id, idx::INT AS idx, h1, h2, md5(content) AS content_md5 FROM sec")
def md_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = K.sections(markdown(spark, sf_dir), "page_id", "md")
    return found.select("page_id", "idx", F.col("metadata")["H1"].alias("h1"), F.col("metadata")["H2"].alias("h2"), F.md5("content").alias("content_md5"))


FOLD = """, n AS (SELECT page_id, count(*) AS n FROM sec GROUP BY page_id), fold AS (
  SELECT page_id, 0::BIGINT AS i, 0::BIGINT AS emitted, NULL::VARCHAR AS open, NULL::VARCHAR AS done FROM n
  UNION ALL
  SELECT f.page_id, f.i + 1, CASE WHEN length(concat_ws(chr(10) || chr(10), CASE WHEN f.done IS NULL THEN f.open END, s.content)) >= 2000 THEN f.emitted + 1 ELSE f.emitted END,
    concat_ws(chr(10) || chr(10), CASE WHEN f.done IS NULL THEN f.open END, s.content),
    CASE WHEN length(concat_ws(chr(10) || chr(10), CASE WHEN f.done IS NULL THEN f.open END, s.content)) >= 2000 THEN 'x' END
  FROM fold f JOIN sec s ON s.page_id = f.page_id AND s.idx = f.i
), rows_ AS (
  SELECT f.page_id, f.i, f.open, f.done, f.emitted, n.n FROM fold f JOIN n USING (page_id)
), closed AS (
  SELECT page_id, emitted - 1 AS idx, open AS content FROM rows_ WHERE done IS NOT NULL
), tail AS (
  SELECT page_id, emitted, open AS content FROM rows_ WHERE i = n AND done IS NULL
)
SELECT c.page_id AS page_id, c.idx::INT AS idx, length(CASE WHEN t.emitted = c.idx + 1 THEN c.content || chr(10) || chr(10) || t.content ELSE c.content END)::INT AS n_chars,
  md5(CASE WHEN t.emitted = c.idx + 1 THEN c.content || chr(10) || chr(10) || t.content ELSE c.content END) AS content_md5
FROM closed c LEFT JOIN tail t ON t.page_id = c.page_id
UNION ALL SELECT page_id, 0, length(content)::INT, md5(content) FROM tail WHERE emitted = 0"""


@query(f"WITH RECURSIVE {MD}{FOLD}")
def merge_small_parents(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = K.merged_sections(markdown(spark, sf_dir), "page_id", "md")
    return found.select("page_id", "idx", F.length("content").alias("n_chars"), F.md5("content").alias("content_md5"))


@query(
    f"""WITH {MD}, c AS (
  SELECT page_id, idx, content, length(content) AS l, sum(length(content) + 2) OVER (PARTITION BY page_id ORDER BY idx) - 2 AS cum FROM sec
), f AS (
  SELECT page_id, min(idx) FILTER (cum >= 2000) AS first FROM c GROUP BY page_id
), g AS (
  SELECT c.page_id, c.idx, content, count(*) FILTER (c.idx > first AND l >= 2000) OVER (PARTITION BY c.page_id ORDER BY c.idx) AS grp FROM c JOIN f USING (page_id)
)
SELECT page_id, grp::INT AS idx, length(string_agg(content, chr(10) || chr(10) ORDER BY idx))::INT AS n_chars, md5(string_agg(content, chr(10) || chr(10) ORDER BY idx)) AS content_md5 FROM g GROUP BY page_id, grp"""
)
def clean_small_parents(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = K.cleaned_sections(markdown(spark, sf_dir), "page_id", "md")
    return found.select("page_id", "idx", F.length("content").alias("n_chars"), F.md5("content").alias("content_md5"))


@query("SELECT doc_id, 'H1=' || source || CASE WHEN lang = 'en' THEN ' -> en' ELSE '' END || ';H2=' || lang || ';H3=' || n_chars AS path FROM documents")
def metadata_path_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = F.create_map(F.lit("H1"), F.col("source"), F.lit("H2"), F.col("lang"))
    size = F.col("n_chars").cast("string")
    new = F.when(F.col("lang") == "en", F.create_map(F.lit("H1"), F.col("lang"), F.lit("H3"), size)).otherwise(F.create_map(F.lit("H3"), size))
    both = F.transform(F.array_sort(F.map_entries(T.merge_path(old, new))), lambda e: F.concat_ws("=", e["key"], e["value"]))
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(both, ";").alias("path"))


@query()
def split_large_parents(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = K.split_sections(table(spark, sf_dir, "documents"), "doc_id", "text")
    return found.select("doc_id", "idx", F.length("content").alias("n_chars"), F.md5("content").alias("content_md5"))


def document_parents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.parent_chunks(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id", "text", F.concat(F.lit("doc"), F.col("doc_id").cast("string")))


@query(
    f"""WITH {MD}, c AS (
  SELECT page_id, idx, sum(length(content) + 2) OVER (PARTITION BY page_id ORDER BY idx) - 2 AS cum, length(content) AS l FROM sec
), f AS (SELECT page_id, min(idx) FILTER (cum >= 2000) AS first FROM c GROUP BY page_id
), g AS (SELECT c.page_id, count(*) FILTER (c.idx > first AND l >= 2000) OVER (PARTITION BY c.page_id ORDER BY c.idx) AS grp FROM c JOIN f USING (page_id))
SELECT DISTINCT 'page' || page_id || '_parent_' || grp AS parent_id, 'page' || page_id || '.pdf' AS source FROM g"""
)
def parent_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = K.cleaned_sections(markdown(spark, sf_dir), "page_id", "md")
    stem = F.concat(F.lit("page"), F.col("page_id").cast("string"))
    return found.select(K.parent_id(stem, F.col("idx")).alias("parent_id"), F.concat(stem, F.lit(".pdf")).alias("source"))


@query()
def child_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    children = K.child_chunks(document_parents(spark, sf_dir))
    return children.select("parent_id", "child_idx", F.length("content").alias("n_chars"), F.md5("content").alias("content_md5"))


@query()
def child_chunks_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of ``child_chunks`` from SQL alone, by a table function."""
    tables.register(spark)
    rows = "SELECT parent_id, child.chunk_idx AS child_idx, length(child.content) AS n_chars, md5(child.content) AS content_md5 FROM {parents}, LATERAL chunks(content, 500, 100) AS child"
    return spark.sql(rows, parents=document_parents(spark, sf_dir).select("parent_id", "content"))


WINDOW_ROWS = "SELECT doc_id, i::INT AS chunk_idx, md5(substr(text, i * 400 + 1, 500)) AS content_md5 FROM documents, unnest(range(0, greatest(0, ceil((length(text) - 500) / 400.0))::BIGINT + 1)) t(i)"


@query(WINDOW_ROWS)
def window_chunks_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of ``fixed_window_chunks`` by a function of SQL alone."""
    tables.register(spark)
    return spark.sql("SELECT doc_id, chunk_idx, md5(content) AS content_md5 FROM {docs}, LATERAL windows(text, 500, 100)", docs=table(spark, sf_dir, "documents").select("doc_id", "text"))


@query(WINDOW_ROWS)
def fixed_window_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.fixed_windows(table(spark, sf_dir, "documents").select("doc_id", "text"), "text").select("doc_id", "chunk_idx", F.md5("content").alias("content_md5"))


@query()
def chunk_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Markdown of all pages to parents and children: one row for each child, with its parent's headers as JSON."""
    md = markdown(spark, sf_dir)
    rows = K.parent_chunks(md, "page_id", "md", F.concat(F.lit("page"), F.col("page_id").cast("string")))
    sorted_meta = F.to_json(F.map_from_entries(F.array_sort(F.map_entries("metadata"))))
    return K.child_chunks(rows).select("parent_id", "child_idx", "content", sorted_meta.alias("metadata"))
