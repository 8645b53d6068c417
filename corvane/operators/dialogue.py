"""Multi-question dialogue as fan-out and fan-in over rows ``conv_id, turn, role, text``.

Language models are pluggable column functions with deterministic stand-ins
(``stub_summary``, ``stub_questions``): nothing here calls a model. ``answer_all`` is
the whole graph: summary, rewriting, the gate for unclear queries, fan-out,
search, parents, an answer for each question, fan-in.

A conversation's answers or messages become one text by definition, so that much
of one conversation meets in one row; everything else is aggregated.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane import config
from corvane.functions import text as T
from corvane.operators import retrieval
from corvane.storage import cut, small

#: Messages from which a history is summarised, and how many of them.
HISTORY_FROM, HISTORY_LAST = 4, 6
MOST_QUESTIONS = 3


def history_gate(messages: DataFrame) -> DataFrame:
    """``conv_id, n_messages, summarise``."""
    return messages.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n_messages")).withColumn("summarise", F.col("n_messages") >= HISTORY_FROM)


def history_window(messages: DataFrame) -> DataFrame:
    """``conv_id, history``: the last six user and assistant messages before the last message, of conversations with enough messages.

    The ranked filter is applied before the shuffle too, so a conversation sends at most seven rows from each task.
    """
    gate = history_gate(messages).filter("summarise").join(messages.groupBy("conv_id").agg(F.max("turn").alias("__last")), "conv_id")
    order = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    said = messages.filter(F.col("role").isin("user", "assistant"))
    recent = said.withColumn("__r", F.row_number().over(order)).filter(F.col("__r") <= HISTORY_LAST + 1)
    kept = recent.join(gate.select("conv_id", "__last"), "conv_id").filter(F.col("turn") < F.col("__last"))
    last = kept.withColumn("__r", F.row_number().over(order)).filter(F.col("__r") <= HISTORY_LAST)
    line = F.concat(F.when(F.col("role") == "user", "User: ").otherwise("Assistant: "), "text", F.lit("\n"))
    lines = F.transform(F.array_sort(F.collect_list(F.struct("turn", line.alias("line")))), lambda x: x["line"])
    return last.groupBy("conv_id").agg(F.concat(F.lit("Conversation history:\n"), F.array_join(lines, "")).alias("history"))


def last_user_message(messages: DataFrame) -> DataFrame:
    """``conv_id, query``."""
    return messages.filter("role = 'user'").groupBy("conv_id").agg(F.max_by("text", "turn").alias("query"))


def stub_summary(history: Column) -> Column:
    return F.substring(T.strip(history), 1, 100)


def rewrite_context(summary: Column, query: Column) -> Column:
    context = F.when(F.length(T.strip(F.coalesce(summary, F.lit("")))) > 0, F.concat(F.lit("Conversation Context:\n"), summary, F.lit("\n"))).otherwise("")
    return F.concat(context, F.lit("User Query:\n"), query, F.lit("\n"))


def stub_questions(query: Column) -> Column:
    """Up to three sentences of at least three words."""
    parts = F.filter(F.transform(F.split(query, r"[.?!]"), T.strip), lambda s: F.size(F.split(s, r"\s+")) >= 3)
    return F.slice(parts, 1, MOST_QUESTIONS)


def is_clear(questions: Column, flag: Column) -> Column:
    return (F.size(questions) >= 1) & F.coalesce(flag, F.lit(False))


def clarification(text: Column) -> Column:
    return F.when(F.length(T.strip(F.coalesce(text, F.lit("")))) > 10, text).otherwise(config.NEED_DETAIL)


def fan_out(analysed: DataFrame, key: str = "conv_id") -> DataFrame:
    """One row for each question: ``key, question_index, question``."""
    return analysed.select(key, F.posexplode("questions").alias("question_index", "question"))


def accumulate_or_reset(old: Column, new: Column) -> Column:
    """Answers (structs with ``reset``) joined, or none if any new one resets."""
    return F.when(F.exists(new, lambda x: x["reset"]), F.slice(old, 1, 0)).otherwise(F.concat(old, new))


def final_answer(messages: DataFrame) -> DataFrame:
    """``conv_id, answer``: the last assistant message with content, else a fixed sentence."""
    found = F.max_by("text", F.when((F.col("role") == "assistant") & (F.length(T.strip(F.coalesce("text", F.lit("")))) > 0), F.col("turn")))
    return messages.groupBy("conv_id").agg(F.coalesce(found, F.lit(config.NO_ANSWER)).alias("answer"))


def fan_in(answers: DataFrame, key: str) -> DataFrame:
    """``key, text`` of rows ``key, index, answer``: numbered from 1 in the order of their index."""
    ordered = F.array_sort(F.collect_list(F.struct("index", "answer")))
    text = F.array_join(F.transform(ordered, lambda a, i: F.concat(F.lit("\nAnswer "), (i + 1).cast("string"), F.lit(":\n"), a["answer"], F.lit("\n"))), "")
    return answers.groupBy(key).agg(F.coalesce(F.nullif(text, F.lit("")), F.lit(config.NO_ANSWERS)).alias("text"))


@dataclass
class Analysis:
    """What a language model would decide about a query, as columns made from ``query`` and ``context``, and its summary of a history."""

    summary: Callable[[Column], Column] = lambda history: stub_summary(history)
    questions: Callable[[Column, Column], Column] = lambda query, context: stub_questions(query)
    is_clear: Callable[[Column, Column], Column] = lambda query, context: F.lit(True)
    needed: Callable[[Column, Column], Column] = lambda query, context: F.lit(None).cast("string")
    #: Another wording of a question that has found nothing so far, or null to give up; ``rounds`` searches at most.
    retry: Callable[[Column, Column], Column] = lambda question, round: F.lit(None).cast("string")
    rounds: int = 3


def analyse(asked: DataFrame, analysis: Analysis) -> DataFrame:
    """``key, query, questions, is_clear, clarification`` of rows ``key, query, history`` (a null history: nothing to summarise)."""
    rows = asked.withColumn("context", rewrite_context(analysis.summary(F.col("history")), F.col("query")))
    query, context = F.col("query"), F.col("context")
    rows = rows.withColumn("questions", F.coalesce(analysis.questions(query, context), F.array().cast("array<string>")))
    return rows.select("key", "query", "questions", is_clear(F.col("questions"), analysis.is_clear(query, context)).alias("is_clear"), clarification(analysis.needed(query, context)).alias("clarification"))


def first_words(question: Column, content: Column) -> Column:
    """Offline stand-in for a language model: the best parent's beginning."""
    return T.cut_to(content, 100)


def answer_all(asked: DataFrame, units: DataFrame, parents: DataFrame, k: int = 3, analysis: Analysis | None = None, answer: Callable[[Column, Column], Column] = first_words, threshold_stage: str = "none", search: retrieval.Search | None = None) -> DataFrame:
    """The graph over many conversations at once: ``key, status, n_questions, n_parents, text``.

    ``asked`` has ``key, query, history``; ``units`` ``id, parent_id, text``; ``parents`` ``parent_id, content``. A query that
    isn't clear gets the status ``needs_input`` and the clarification as its text. The others are split into questions; each
    searches the ``k`` best units (by ``search``, an index's for instance, or else a pass over ``units``), then reads their
    parents, and is answered from the best one. A question that finds nothing is worded anew by ``analysis.retry`` and asked again. Analysis and hits are written.
    """
    analysed = cut(analyse(asked, analysis or Analysis()), "analysed")
    parts = fan_out(analysed.filter("is_clear"), "key").withColumn("qid", F.xxhash64("key", "question_index"))
    analysis = analysis or Analysis()
    found, asking = None, cut(parts.select("qid", F.col("question").alias("text")), "questions")
    for turn in range(1, analysis.rounds + 1):
        hits = cut(retrieval.hybrid(units.select("id", "text"), asking, k, threshold_stage=threshold_stage, search=search), "hits")
        found = hits if found is None else found.unionByName(hits)
        if turn < analysis.rounds:
            # what has found nothing is worded anew and asked again
            left = asking.join(hits.select(F.col("qid").alias("__q")).distinct(), F.col("qid") == F.col("__q"), "left_anti")
            asking = cut(left.select("qid", analysis.retry(F.col("text"), F.lit(turn)).alias("text")).filter("text IS NOT NULL"), "questions")
            if not asking.limit(1).count():
                break
    named = units.select("id", "parent_id").join(small(found), "id").groupBy("qid", "parent_id").agg(F.min("rank").alias("rank"))
    best = cut(named.groupBy("qid").agg(F.min_by("parent_id", "rank").alias("parent_id"), F.count(F.lit(1)).alias("n")), "parents")
    read = parents.join(small(best), "parent_id").select("qid", "n", F.col("content").alias("__content"))
    each = parts.join(read, "qid", "left").select(
        "key", F.col("question_index").alias("index"), F.coalesce("n", F.lit(0)).alias("n"), F.coalesce(answer(F.col("question"), F.col("__content")), F.lit(config.NO_ANSWER)).alias("answer")
    )
    each = cut(each, "answers")
    texts = fan_in(each, "key").join(each.groupBy("key").agg(F.sum("n").alias("n_parents")), "key")
    out = analysed.join(texts, "key", "left")
    return out.select(
        "key",
        F.when(F.col("is_clear"), "answered").otherwise("needs_input").alias("status"),
        F.size("questions").alias("n_questions"),
        F.coalesce("n_parents", F.lit(0)).alias("n_parents"),
        F.when(F.col("is_clear"), F.coalesce("text", F.lit(config.NO_ANSWERS))).otherwise(F.col("clarification")).alias("text"),
    )
