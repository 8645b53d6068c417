"""The queries of this subpackage, and their SQL where DuckDB can express them.

Each query reads its rows through its operator; what a query returns beside the
operator's own output is derived from it.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm import ann, hardneg, lmscore, minhash, packing, pieces, pii, quality, spelling, tokenfile, toxicity, urlfilter, warc
from corvane.llm.common import scratch, table

# The rules of the URL query.
RULES = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/")]


def op1_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return ann.search(vectors, vectors.filter(F.col("vec_id") % 20 == 0), k=20)


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return urlfilter.judge(pages, RULES, urlfilter.refetched(pages))


def op3_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    good = table(spark, sf_dir, "labels").filter("quality = 1").select("doc_id")
    return lmscore.score(table(spark, sf_dir, "documents"), good)


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(table(spark, sf_dir, "documents"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op6_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.classes(table(spark, sf_dir, "documents"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.digest(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op10_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.digest(table(spark, sf_dir, "documents"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hardneg.mine(table(spark, sf_dir, "embeddings").withColumn("label", label), F.col("vec_id") % 100 == 0)


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(spelling.vocabulary(table(spark, sf_dir, "documents")))


def op13_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "tokens")
    tokenfile.write(table(spark, sf_dir, "documents"), path, public_tokenizers.path("word_bpe_49k.json"))
    return tokenfile.read(spark, path, binary=True).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (op1_ann, op2_url_filter, op3_lm_score, op4_pii, op5_packing, op6_minhash, op7_toxicity, op8_warc, op9_sentencepiece, op10_host_rules, op11_hard_negatives, op12_spelling, op13_token_ids)
    return {f.__name__: f for f in own}


URL_SQL = r"""
WITH u AS (
  SELECT page_id,
    coalesce(translate(regexp_extract(url, '://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path,
    CASE WHEN contains(url, '://') THEN array_to_string(list_filter(string_split(regexp_extract(url, '://[^?#]*\?([^#]*)', 1), '&'),
      lambda p: p <> '' AND NOT regexp_matches(p, '^(utm_[^=]*|ref|fbclid|gclid)(=|$)')), '&') END AS query
  FROM pages
), c AS (
  SELECT *, regexp_replace(host, '^www\.', '') || rtrim(path, '/') || CASE WHEN query <> '' THEN '?' || query ELSE '' END AS canonical FROM u
), listed AS (
  SELECT canonical FROM c WHERE query IS NOT NULL GROUP BY canonical HAVING count(*) > 1
), rules(kind, rule, domain, prefix) AS (
  VALUES ('allow', 'com/', 'com', '/'), ('block', 'example.com/en/', 'example.com', '/en/'), ('allow', 'www.example.com/en/', 'www.example.com', '/en/'),
         ('block', 'net/es/', 'net', '/es/'), ('block', 'net/fr/', 'net', '/fr/')
), fits AS (
  SELECT c.page_id, c.host, c.path, c.query, c.canonical,
    max_by(r.rule, length(r.rule)) AS rule, max_by(r.kind, length(r.rule)) AS kind
  FROM c LEFT JOIN rules r ON (c.host = r.domain OR ends_with(c.host, '.' || r.domain)) AND starts_with(c.path, r.prefix)
  GROUP BY ALL
)
SELECT page_id, host, path, rule,
  coalesce(kind, CASE WHEN query IS NOT NULL AND canonical IN (SELECT canonical FROM listed) THEN 'block' ELSE 'allow' END) AS verdict
FROM fits
"""

WARC_SQL = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html FROM pages
), d AS (
  SELECT page_id, strlen(html) AS payload_bytes, sha1(html) AS h, min(page_id) OVER (PARTITION BY html) AS first FROM p
)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    (1 + ((('0x' || substr(h, (1 + 10 * (i // 8))::INT, 10))::BIGINT >> (35 - 5 * (i % 8))::INT) & 31))::INT, 1)), '') AS payload_digest,
  CASE WHEN page_id > first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id > first THEN first END AS refers_to
FROM d
"""

QUALITY_SQL = r"""
WITH w AS (
  SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS text,
    list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls
  FROM documents
), win AS (
  SELECT rid, i, array_to_string(ws[i:i + 4], ' ') AS g FROM w, unnest(range(1, len(ws) - 3)) t(i)
), rep AS (
  SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS c FROM win) WHERE c > 1
), cov AS (
  SELECT rid, count(DISTINCT p) AS n FROM rep, unnest(range(i, i + 5)) t(p) GROUP BY rid
), s AS (
  SELECT w.rid, doc_id, source, len(ws)::BIGINT AS n_words, coalesce(length(array_to_string(ws, '')), 0)::BIGINT AS word_chars,
    (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
    len(ls)::BIGINT AS n_lines, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(cov.n, 0)::BIGINT AS n_repeat_words
  FROM w LEFT JOIN cov USING (rid)
), f AS (
  SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
    n_symbols > 0.3 * n_words OR n_dup_lines > 0.5 * n_lines AS soft, n_symbols > 0.1 * n_words OR n_dup_lines > 0.3 * n_lines AS strict
  FROM s
), hosts AS (
  SELECT source, count(*) AS n, count(*) FILTER (base_failed OR strict) AS bad FROM f GROUP BY source
), prior AS (
  SELECT sum(bad) / sum(n) AS m, var_pop(bad / n) AS v, avg(1 / n) AS inv FROM hosts
), strength AS (
  SELECT m, greatest(10.0, least(10000.0, CASE WHEN v - m * (1 - m) * inv > 0 THEN m * (1 - m) / (v - m * (1 - m) * inv) - 1 ELSE 10000.0 END)) AS k FROM prior
), verdict AS (
  SELECT source, (bad + m * k) / (n + k) >= 0.8 AS rejected, (bad + m * k) / (n + k) >= 2.0 * m AS watched FROM hosts, strength
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR rejected OR soft OR (watched AND strict)) AS kept
FROM f JOIN verdict ON f.source IS NOT DISTINCT FROM verdict.source
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_url_filter": URL_SQL, "op8_warc": WARC_SQL, "op10_host_rules": QUALITY_SQL}
