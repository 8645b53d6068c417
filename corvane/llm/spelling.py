"""Spelling variants: words within one edit, by letter-parity masks in three bands.

A word's mask has a bit for each letter, set if the letter occurs an odd number of
times. One inserted or deleted letter flips one bit, one replaced letter two, so of three bands
at least one stays equal. Words meet by the number and value of a band and by
length (equal, or one more), and what meets is verified: masks that differ in at most two
bits, then one edit exactly. An edit also leaves the first or the last half of
the shorter word as it was, so the join's key holds that half as well: by bands
alone a word of half a gigabyte of text meets ten thousand others, and common
bands are hot keys. A pair counts in the first band, and half, in which it is equal.

Words are counted within tasks before they are shuffled; what is joined is the
vocabulary, each word once, so common words and repeated texts cost nothing there.

Defined results: a null text has no words, a null id is written as nothing; words may have any length, and
copies of a row count as rows; equal counts go to the word that comes first in code-point
order; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import batches_of, cut, plain

#: Bits of a mask: one for each of a-z, the others shared by all other letters.
BITS, BANDS = 60, 3
#: Of near words, one with so many times a word's count is its form.
TIMES = 10
#: Words that a task counts before it hands them on.
HELD_WORDS = 200_000
#: Texts handled together in a worker.
SLICE = 256

# Fixed values of the query: letters, the shortest word, and how often a letter is dropped.
LEAST_LENGTH, DROP_EVERY = 7, 31
#: Of each Latin-1 character: itself if it is a letter of a run, A-Z as a-z, else a space.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 192 else 32 for b in range(256))


def occurrences(docs: DataFrame, drop_every: int = DROP_EVERY, least: int = LEAST_LENGTH) -> DataFrame:
    """``word, n``: words of at least ``least`` letters, counted in each task only.

    Runs of Latin letters, A-Z lower-cased. A run whose checksum with its document's id is divisible by ``drop_every``
    loses a letter (0: none does), so that a corpus has misspellings of known origin.
    """

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, int] = {}

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array([w.decode("latin-1") for w in held], pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "n"])
            held.clear()
            return out

        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                for i, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    # what isn't Latin-1 becomes a question mark, which is no letter either
                    runs = Counter(w for w in (text or "").encode("latin-1", "replace").translate(_FOLD).split() if len(w) >= least)
                    start = zlib.crc32(f"{'' if i is None else i}:".encode())
                    for run, n in runs.items():
                        if drop_every:
                            h = zlib.crc32(run if run.isascii() else run.decode("latin-1").encode(), start)
                            if not h % drop_every:
                                k = h % len(run)
                                run = run[:k] + run[k + 1 :]
                                if len(run) < least:
                                    continue
                        held[run] = held.get(run, 0) + n
                if len(held) >= HELD_WORDS:
                    yield flush()
            pa.default_memory_pool().release_unused()
        yield flush()

    return docs.select(F.col("doc_id").cast("string").alias("doc_id"), plain(F.col("text")).alias("text")).mapInArrow(each, "word string, n long")


def masks(words: list[str]) -> np.ndarray:
    """Letter-parity masks."""
    sizes = np.array([len(w) for w in words], np.int64)
    flat = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
    bit = np.where((flat >= 97) & (flat <= 122), flat - 97, 26 + flat % (BITS - 26))
    odd = np.zeros((len(words), BITS), np.int64)
    np.add.at(odd, (np.repeat(np.arange(len(words)), sizes), bit), 1)
    return ((odd & 1) << np.arange(BITS)).sum(1)


def _masked(words: DataFrame) -> DataFrame:
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(masks(batch.column(0).to_pylist()), pa.int64())], ["word", "n", "mask"])

    return words.select("word", "n").mapInArrow(each, "word string, n long, mask long")


def _band(j: int) -> int:
    """The bits of band ``j``: every third, so that common letters are spread."""
    return sum(1 << b for b in range(j, BITS, BANDS))


def links(words: DataFrame) -> DataFrame:
    """``a, n_a, b, n_b``: each pair of ``words`` (``word, n``, each once) that one edit turns into each other, once, the shorter first or the smaller of equal length."""
    rows = cut(_masked(words).withColumn("size", F.length("word")), "masked")

    def keyed(longer: bool) -> DataFrame:
        """Rows with the keys by which they meet words of the size ``of``; a longer one lacks the letter in the middle."""
        of = F.col("size") - int(longer)
        half = F.floor(of / 2).cast("int")
        halves = [(0, F.substring("word", F.lit(1), half)), (1, F.substring("word", half + 1 + int(longer), of - half))]
        keys = [F.struct(F.lit(j).alias("band"), F.lit(side).alias("side"), F.xxhash64(F.lit(j), F.col("mask").bitwiseAND(F.lit(_band(j))), of, F.lit(side), part).alias("key")) for j in range(BANDS) for side, part in halves]
        return rows.select("word", "n", "mask", "size", F.explode(F.array(*keys)).alias("k")).select("word", "n", "mask", "size", "k.*")

    left = keyed(False).select("key", "band", "side", *(F.col(c).alias(f"{c}_a") for c in ("word", "n", "mask", "size")))
    right = keyed(False).unionByName(keyed(True)).select("key", *(F.col(c).alias(f"{c}_b") for c in ("word", "n", "mask", "size")))
    differs = F.col("mask_a").bitwiseXOR(F.col("mask_b"))
    equal = lambda j: differs.bitwiseAND(F.lit(_band(j))) == 0
    band = F.when(equal(0), 0).when(equal(1), 1).otherwise(2)
    half = F.floor(F.col("size_a") / 2).cast("int")
    first = F.substring("word_a", F.lit(1), half) == F.substring("word_b", F.lit(1), half)
    near = (
        ((F.col("size_b") > F.col("size_a")) | (F.col("word_a") < F.col("word_b")))
        & (F.bit_count(differs) <= 2)
        & (F.col("band") == band)
        & (first == (F.col("side") == 0))
        & (F.levenshtein("word_a", "word_b", 1) == 1)
    )
    return left.join(right, (left["key"] == right["key"]) & near).select(F.col("word_a").alias("a"), F.col("n_a"), F.col("word_b").alias("b"), F.col("n_b"))


def roots(forms: DataFrame) -> DataFrame:
    """``word, root``: where ``forms`` (``word, form``, without circles) lead to in the end; each round doubles the steps."""
    reached = cut(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        on = reached.select(F.col("word").alias("__at"), F.col("root").alias("__on"))
        moved = cut(reached.join(on, F.col("root") == F.col("__at"), "left").select("word", F.coalesce("__on", "root").alias("root"), F.col("__on").isNotNull().alias("__moved")), "roots")
        reached = moved.select("word", "root")
        if not moved.filter("__moved").limit(1).count():
            return reached


def variants(words: DataFrame, times: int = TIMES) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` of ``words`` (``word, n``, each once).

    A word's form is its commonest near word, if that is at least ``times`` as common; its root is what forms lead to.
    """
    pairs = cut(links(words), "links")
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("n_b").alias("n_a"), F.col("a").alias("b"), F.col("n_a").alias("n_b")))
    best = F.min(F.struct((-F.col("n_b")).alias("m"), F.col("b").alias("w"))).alias("best")
    near = both.groupBy(F.col("a").alias("__word")).agg(F.count(F.lit(1)).alias("n_near"), best)
    is_form = -F.col("best.m") >= times * F.col("n")
    given: dict[str, Column] = {"form": F.when(is_form, F.col("best.w")), "form_n": F.when(is_form, -F.col("best.m"))}
    found = cut(words.join(near, F.col("word") == F.col("__word"), "left").withColumns(given).select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), "form", "form_n"), "forms")
    ends = roots(found.filter("form IS NOT NULL")).withColumnRenamed("word", "__of")
    return found.join(ends, F.col("word") == F.col("__of"), "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def vocabulary(docs: DataFrame, least_n: int = 2, drop_every: int = DROP_EVERY, least: int = LEAST_LENGTH) -> DataFrame:
    """``word, n`` of the words that all texts together have at least ``least_n`` times."""
    with batches_of(docs.sparkSession, 512):
        return cut(occurrences(docs, drop_every, least).groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least_n), "vocabulary")
