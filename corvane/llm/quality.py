"""Quality rules with host-level verdicts, in DataFrame functions only.

Each document is measured by built-in functions within its own row: nothing is
exploded and no text is shuffled. Rule failures are then aggregated by host
(partially before the shuffle, so a host that holds a third of all rows sends
one row from each task). A host's failure rate is shrunk towards the corpus by
a beta prior that is itself fitted to the hosts by the method of moments; the
verdicts of hosts are joined back to their documents.

A document is kept unless it fails a base rule, fails a soft rule (symbols,
repeated lines), or its host is rejected. Soft rules bind more strictly on
hosts whose shrunk failure rate stands out from the corpus.

Repeated 5-word windows are recognised by 64-bit hashes of the five words; two
different windows of one text share a hash with a probability below 1e-10 even
at 50,000 words.

Defined results: a null text has no words and fails the base rules; a null
host is a host of its own; repeated rows count as rows; an empty table gives no
rows; other columns are carried on untouched by ``judge``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import cut, small

SPACES = r"[\x20\x09-\x0D]+"
BLANKS = "\t\n\x0b\x0c\r"
WINDOW = 5
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
#: Soft rules: symbols for each word, and the share of lines that repeat an earlier one.
MAX_SYMBOLS, STRICT_SYMBOLS = 0.3, 0.1
MAX_DUP_LINES, STRICT_DUP_LINES = 0.5, 0.3
#: A host is rejected at this shrunk failure rate, and watched at this multiple of the corpus's rate.
REJECT_RATE, WATCH_TIMES = 0.8, 2.0

STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")


def _repeat_words(words: Column, size: Column) -> Column:
    """Words in windows of five that occur twice or more.

    Hashes of all windows are sorted; equal neighbours name the repeated ones. Only if there are any are their places
    sorted out: a place adds five words, or as many as lie beyond the place before.
    """
    hashes = F.transform(F.sequence(F.lit(0), size - WINDOW), lambda i: F.xxhash64(*(F.get(words, i + k) for k in range(WINDOW))))
    return F.when(size > WINDOW, hashes)


def with_stats(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the columns of ``STATS``, each prefixed by two underscores."""
    t = F.coalesce(F.col(text), F.lit(""))
    flat = F.translate(t, BLANKS, " " * len(BLANKS))
    lines = F.filter(F.split(t, "\n"), lambda x: F.length(F.trim(F.translate(x, BLANKS, " " * len(BLANKS)))) > 0)
    out = docs.withColumns({"__words": F.array_remove(F.split(flat, " "), ""), "__lines": lines})
    size = F.size("__words")
    out = out.withColumns({
        "__n_words": size.cast("long"),
        "__word_chars": F.length(F.array_join("__words", "")).cast("long"),
        "__n_symbols": (F.length(t) - F.length(F.regexp_replace(t, r"[#*$%&|<>]", ""))).cast("long"),
        "__n_lines": F.size("__lines").cast("long"),
        "__n_dup_lines": (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long"),
        "__hashes": _repeat_words(F.col("__words"), size),
    }).drop("__words", "__lines")
    # A text without a repeated window, the usual case, is done after one hash set.
    out = out.withColumn("__repeats", F.coalesce(F.size("__hashes") > F.size(F.array_distinct("__hashes")), F.lit(False)))
    out = out.withColumn("__placed", F.when(F.col("__repeats"), F.array_sort(F.transform("__hashes", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    same = lambda i: (F.col("__placed")[i]["h"] == F.get("__placed", i - 1)["h"]) | (F.col("__placed")[i]["h"] == F.get("__placed", i + 1)["h"])
    places = F.array_sort(F.transform(F.filter(F.transform("__placed", lambda p, i: F.struct(F.coalesce(same(i), F.lit(False)).alias("twice"), p["i"].alias("i"))), lambda p: p["twice"]), lambda p: p["i"]))
    out = out.withColumn("__places", places)
    covered = F.aggregate(
        "__places",
        F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("last")),
        lambda a, p: F.struct((a["n"] + F.least(F.lit(WINDOW), p - a["last"])).alias("n"), p.alias("last")),
        lambda a: a["n"],
    )
    return out.withColumn("__n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long")).drop("__hashes", "__repeats", "__placed", "__places")


def base_failed() -> Column:
    return (F.col("__n_words") < MIN_WORDS) | (100 * F.col("__n_repeat_words") > MAX_REPEAT_PERCENT * F.col("__n_words"))


def _soft(symbols: float, dup_lines: float) -> Column:
    return (F.col("__n_symbols") > symbols * F.col("__n_words")) | (F.col("__n_dup_lines") > dup_lines * F.col("__n_lines"))


def host_verdicts(stats: DataFrame, host: str) -> DataFrame:
    """``__host, __rate, __rejected, __watched`` for each host in ``stats``.

    The prior is a beta distribution with the mean and variance of the hosts' rates, less the variance that drawing
    documents alone brings; its strength is kept between 10 and 10,000 documents. All of it is aggregates: one row for
    each host, then one row in all.
    """
    failed = (base_failed() | _soft(STRICT_SYMBOLS, STRICT_DUP_LINES)).cast("long")
    hosts = stats.groupBy(F.col(host).alias("__host")).agg(F.count(F.lit(1)).alias("__n"), F.sum(failed).alias("__f"))
    rate = F.col("__f") / F.col("__n")
    prior = hosts.agg((F.sum("__f") / F.sum("__n")).alias("__m"), F.var_pop(rate).alias("__v"), F.avg(1 / F.col("__n")).alias("__inv")).first()  # one row
    mean = prior["__m"] or 0.0
    spread = mean * (1 - mean)
    extra = (prior["__v"] or 0.0) - spread * (prior["__inv"] or 0.0)
    strength = max(10.0, min(10000.0, spread / extra - 1 if extra > 0 else 10000.0))
    shrunk = (F.col("__f") + mean * strength) / (F.col("__n") + strength)
    return hosts.select("__host", shrunk.alias("__rate")).select("__host", "__rate", (F.col("__rate") >= REJECT_RATE).alias("__rejected"), (F.col("__rate") >= WATCH_TIMES * mean).alias("__watched"))


def judge(docs: DataFrame, text: str = "text", host: str = "source", keep: list[str] | None = None) -> DataFrame:
    """``docs`` (or the columns ``keep``) with ``STATS``, ``__base_failed`` and ``__kept``.

    Measures are written once to the shared folder, with the columns that are carried on, and read by both the
    aggregation over hosts and the join.
    """
    own = docs.select(*dict.fromkeys([*(keep or docs.columns), text, host]))
    measured = with_stats(own, text)
    names = keep or docs.columns
    measured = cut(measured.select(*names, F.col(host).alias("__own_host"), *(f"__{s}" for s in STATS)), "quality")
    hosts = cut(host_verdicts(measured, "__own_host").filter("__rejected OR __watched"), "hosts")
    out = measured.join(small(hosts), F.col("__own_host").eqNullSafe(F.col("__host")), "left")
    watched, rejected = F.coalesce("__watched", F.lit(False)), F.coalesce("__rejected", F.lit(False))
    bad = base_failed() | rejected | _soft(MAX_SYMBOLS, MAX_DUP_LINES) | (watched & _soft(STRICT_SYMBOLS, STRICT_DUP_LINES))
    return out.withColumns({"__base_failed": base_failed(), "__kept": ~bad}).drop("__host", "__rate", "__rejected", "__watched", "__own_host")


def digest(docs: DataFrame) -> DataFrame:
    """The measures and verdict of each document."""
    stats = [F.col(f"__{s}").alias(s) for s in STATS if s != "n_lines"]
    return judge(docs, keep=["doc_id"]).select("doc_id", *stats, F.col("__base_failed").alias("base_failed"), F.col("__kept").alias("kept"))


def kept(docs: DataFrame) -> DataFrame:
    """The documents that pass, with their columns as they were."""
    return judge(docs).filter("__kept").select(*docs.columns)
