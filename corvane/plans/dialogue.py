"""Dialogue queries over ``conversations``, and question answering over ``benchmark`` and ``documents``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.operators import dialogue as D
from corvane.plans import retrieval as R
from corvane.plans.registry import query, table
from corvane.storage import scratch
from corvane.streaming import threads as X


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations")


@query("SELECT conv_id, count(*) AS n_messages, count(*) >= 4 AS summarise FROM conversations GROUP BY conv_id")
def history_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.history_gate(messages(spark, sf_dir))


HISTORY = """c AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations
), k AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r2 FROM c WHERE r > 1 AND n >= 4 AND role IN ('user', 'assistant')
), h AS (
  SELECT conv_id, 'Conversation history:' || chr(10) || string_agg(CASE role WHEN 'user' THEN 'User: ' ELSE 'Assistant: ' END || text || chr(10), '' ORDER BY turn) AS history FROM k WHERE r2 <= 6 GROUP BY conv_id
)"""


@query(f"WITH {HISTORY} SELECT conv_id, history FROM h")
def history_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.history_window(messages(spark, sf_dir))


STRIP = r"regexp_replace(regexp_replace({0}, '^\s+', ''), '\s+$', '')"
QUERIES = "l AS (SELECT conv_id, max_by(text, turn) AS query FROM conversations WHERE role = 'user' GROUP BY conv_id)"


@query(
    f"""WITH {HISTORY}, {QUERIES} SELECT l.conv_id AS conv_id, CASE WHEN h.history IS NOT NULL THEN 'Conversation Context:' || chr(10) || substr({STRIP.format("h.history")}, 1, 100) || chr(10) ELSE '' END
  || 'User Query:' || chr(10) || query || chr(10) AS prompt FROM l LEFT JOIN h ON h.conv_id = l.conv_id"""
)
def rewrite_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = messages(spark, sf_dir)
    both = D.last_user_message(rows).join(D.history_window(rows), "conv_id", "left")
    return both.select("conv_id", D.rewrite_context(D.stub_summary(F.col("history")), F.col("query")).alias("prompt"))


ANALYSED = rf"""{QUERIES}, a AS (
  SELECT conv_id, query, list_filter(list_transform(string_split_regex(query, '[.?!]'), lambda s: {STRIP.format("s")}), lambda s: len(string_split_regex(s, '\s+')) >= 3)[1:3] AS questions, length(query) >= 80 AS flag FROM l
)"""


def analysed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A query counts as clear if it has at least 80 characters."""
    return D.last_user_message(messages(spark, sf_dir)).select("conv_id", "query", D.stub_questions(F.col("query")).alias("questions"), (F.length("query") >= 80).alias("flag"))


@query(f"WITH {ANALYSED} SELECT conv_id, len(questions)::INT AS n_questions, len(questions) >= 1 AND flag AS is_clear FROM a")
def query_clear_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analysed(spark, sf_dir).select("conv_id", F.size("questions").alias("n_questions"), D.is_clear(F.col("questions"), F.col("flag")).alias("is_clear"))


@query(f"WITH {QUERIES} SELECT conv_id, CASE WHEN length({STRIP.format('substr(query, 1, 25)')}) > 10 THEN substr(query, 1, 25) ELSE 'I need more information to understand your question.' END AS clarification FROM l")
def clarification_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.last_user_message(messages(spark, sf_dir)).select("conv_id", D.clarification(F.substring("query", 1, 25)).alias("clarification"))


@query(f"WITH {ANALYSED} SELECT conv_id, (i - 1)::INT AS question_index, questions[i] AS question FROM a, unnest(range(1, len(questions) + 1)) t(i) WHERE flag")
def question_fanout(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = analysed(spark, sf_dir)
    return D.fan_out(rows.filter(D.is_clear(F.col("questions"), F.col("flag"))))


@query(r"SELECT conv_id, coalesce(max_by(text, turn) FILTER (role = 'assistant' AND regexp_matches(text, '\S')), 'Unable to generate an answer.') AS answer FROM conversations GROUP BY conv_id")
def final_answer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.final_answer(messages(spark, sf_dir))


@query(
    """SELECT conv_id, CASE WHEN bool_or(role = 'system') THEN '' ELSE coalesce(string_agg(turn::VARCHAR, ',' ORDER BY turn) FILTER (role = 'assistant'), '') END AS kept FROM conversations GROUP BY conv_id"""
)
def accumulate_or_reset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Assistant turns accumulate; a system turn resets."""
    item = F.struct(F.col("turn").alias("turn"), (F.col("role") == "system").alias("reset"))
    empty = F.filter(F.array(item), lambda x: F.lit(False))
    rows = messages(spark, sf_dir).select("conv_id", "role", item.alias("item"), empty.alias("empty"))
    lists = rows.groupBy("conv_id").agg(
        F.array_sort(F.collect_list(F.when(F.col("role") == "assistant", F.col("item")))).alias("old"), F.collect_list(F.when(F.col("role") == "system", F.col("item"))).alias("new")
    )
    kept = D.accumulate_or_reset(F.col("old"), F.col("new"))
    return lists.select("conv_id", F.array_join(F.transform(kept, lambda x: x["turn"].cast("string")), ",").alias("kept"))


@query(
    """WITH a AS (SELECT conv_id, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i FROM conversations WHERE role = 'assistant')
SELECT c.conv_id AS conv_id, coalesce((SELECT string_agg(chr(10) || 'Answer ' || i || ':' || chr(10) || text || chr(10), '' ORDER BY i) FROM a WHERE a.conv_id = c.conv_id), 'No answers were generated.') AS text
FROM (SELECT DISTINCT conv_id FROM conversations) c"""
)
def aggregate_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = messages(spark, sf_dir)
    answers = D.fan_in(rows.filter("role = 'assistant'").select("conv_id", F.col("turn").alias("index"), F.col("text").alias("answer")), "conv_id")
    return rows.select("conv_id").distinct().join(answers, "conv_id", "left").withColumn("text", F.coalesce("text", F.lit("No answers were generated.")))


@query(f"WITH {R.EXPANDED} SELECT qid, count(*) AS n_parents, string_agg('doc' || doc_id, ',' ORDER BY doc_id) AS parents FROM d GROUP BY qid")
def retrieve_then_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows first, then the documents they are from."""
    wanted = R.hits(spark, sf_dir, 3, "none").select("qid", "doc_id").distinct()
    names = F.transform(F.array_sort(F.collect_list("doc_id")), lambda d: F.concat(F.lit("doc"), d.cast("string")))
    return wanted.groupBy("qid").agg(F.count(F.lit(1)).alias("n_parents"), F.array_join(names, ",").alias("parents"))


GRAPH = rf"""{QUERIES}, qa AS (
  SELECT conv_id AS key, query, list_filter(list_transform(string_split_regex(query, '[.?!]'), lambda s: {STRIP.format("s")}), lambda s: len(string_split_regex(s, '\s+')) >= 3)[1:3] AS questions,
    length(query) >= 80 AS flag, substr(query, 1, 25) AS needed FROM l
), a AS (
  SELECT *, len(questions) >= 1 AND flag AS is_clear, CASE WHEN length({STRIP.format("needed")}) > 10 THEN needed ELSE 'I need more information to understand your question.' END AS clarification FROM qa
), parts AS (SELECT key, i - 1 AS i, questions[i] AS text, key * 3 + i - 1 AS qid FROM a, unnest(range(1, len(questions) + 1)) t(i) WHERE is_clear)"""


@query(
    f"""WITH {GRAPH}, {R.U_WINDOWS}, {R.hybrid_sql(3, "parts")}, h AS (SELECT qid, id, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS r FROM fused),
p AS (SELECT h.qid, u.doc_id, min(r) AS r FROM h JOIN u ON h.id = u.id WHERE r <= 3 GROUP BY h.qid, u.doc_id),
b AS (SELECT qid, min_by(doc_id, r) AS doc_id, count(*) AS n FROM p GROUP BY qid),
e AS (SELECT key, i, coalesce(n, 0) AS n, coalesce(CASE WHEN length(d.text) > 100 THEN substr(d.text, 1, 100) || '...' ELSE d.text END, 'Unable to generate an answer.') AS answer
  FROM parts LEFT JOIN b ON b.qid = parts.qid LEFT JOIN documents d ON d.doc_id = b.doc_id),
f AS (SELECT key, sum(n)::BIGINT AS n, string_agg(chr(10) || 'Answer ' || (i + 1) || ':' || chr(10) || answer || chr(10), '' ORDER BY i) AS text FROM e GROUP BY key)
SELECT a.key AS key, CASE WHEN is_clear THEN 'answered' ELSE 'needs_input' END AS status, len(questions)::INT AS n_questions, coalesce(f.n, 0) AS n_parents,
  CASE WHEN is_clear THEN coalesce(f.text, 'No answers were generated.') ELSE clarification END AS text FROM a LEFT JOIN f ON f.key = a.key"""
)
def qa_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole graph over the conversations: history, clarity, questions, windows, their documents, answers."""
    rows = messages(spark, sf_dir)
    asked = D.last_user_message(rows).join(D.history_window(rows), "conv_id", "left").select(F.col("conv_id").alias("key"), "query", "history")
    analysis = D.Analysis(is_clear=lambda query, context: F.length(query) >= 80, needed=lambda query, context: F.substring(query, 1, 25))
    units = R.windows(spark, sf_dir).select("id", F.col("doc_id").alias("parent_id"), "text")
    parents = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("parent_id"), F.col("text").alias("content"))
    return D.answer_all(asked, units, parents, analysis=analysis)


@query(
    """WITH r AS (SELECT conv_id, coalesce(max(turn) FILTER (role = 'system'), -1) AS reset_turn, count(*) AS n_messages FROM conversations GROUP BY conv_id)
SELECT r.conv_id AS conv_id, 'open' AS status, n_messages, reset_turn::BIGINT AS reset_turn, count(turn) AS n_answers, coalesce(string_agg(turn::VARCHAR, ',' ORDER BY turn), '') AS kept, max_by(text, turn) AS last_answer
FROM r LEFT JOIN conversations c ON c.conv_id = r.conv_id AND role = 'assistant' AND turn > reset_turn GROUP BY r.conv_id, n_messages, reset_turn"""
)
def thread_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations followed as a stream, whose state tells what a fold over each whole conversation does."""
    source = table(spark, sf_dir, "conversations")
    # a pattern, as the table may be one file or a folder of files
    stream = spark.readStream.schema(source.schema).option("maxFilesPerTrigger", 8).parquet(f"{sf_dir}/conversations.parque[t]")
    target = scratch(spark, "threads")
    X.track(stream, target, scratch(spark, "threads-checkpoint")).awaitTermination()
    return X.threads(spark, target)
