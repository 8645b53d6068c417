"""Toxicity by class-conditional Kneser-Ney models.

Two interpolated bigram models, one of toxic and one of ordinary text, share a
vocabulary and their backoff counts. All counts are continuation counts: a word
counts once for each word that it follows, a pair once for each word that stands
before it, so a passage that near copies repeat counts little. With ``n`` for
counts, ``D`` for ``DISCOUNT``, ``c`` for a class, and no index for both classes
together:

* ``u(w)``, words of both classes, absolutely discounted towards equal shares;
* ``p_c(w) = (max(n_c(w) - D, 0) + sum_v min(n_c(v), D) * u(w)) / n_c``;
* ``s(w|h)``, pairs of both classes, discounted towards ``u(w)``;
* ``p_c(w|h) = (max(n_c(h,w) - D, 0) + sum_v min(n_c(h,v), D) * b_c(w|h)) / n_c(h)``,
  where ``b_c(w|h)`` is ``s(w|h) * p_c(w) / u(w)`` divided by its sum over ``w``.

So each ``p_c(.|h)`` sums to one, an expression that is rare in a class takes its
probability from the counts that both classes share, and what is rare in both
tells nothing. A text's evidence is the difference of both log-likelihoods,
normalised by length: over the whole text, and the largest over its windows of
``WINDOWS`` words, so that one insult in a long text is still seen. A logistic
function, fitted on labelled texts that the counts never saw, turns it into a score.

The models are fitted on a bounded sample of labelled rows: ``TOXIC_ROWS`` and
``ORDINARY_ROWS`` rows and ``SAMPLE_BYTES`` of text of each class, in the order of a
hash of the id; a row that doesn't fit any more is passed over. Of a labelled text longer than
``LEARNED_CHARS`` the beginning is learned from, so a few very long ones
don't take the room of all others. Every document is scored, whole.

Defined results: a null or empty text has no evidence and gets the score of
that, and a very long one is scored like any other; a score of exactly ``THRESHOLD`` counts as toxic; without training rows of both classes every score is 0; rows of ``labels``
with a null mark are ignored; equal labelled texts count once; repeated rows are
scored each; an empty table gives no rows; other columns are ignored, and kept by ``ordinary``, which adds none.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import bound_batches, plain

#: Bounds of the labelled sample: rows of each class, and bytes of text of each.
TOXIC_ROWS, ORDINARY_ROWS, SAMPLE_BYTES = 1500, 3000, 16 << 20
#: Characters of a labelled text that are learned from, at most (a sixteenth of the bytes, whatever the letters).
LEARNED_CHARS = 1 << 18
#: Contexts that an expression of a class must exceed to bring counts of its own.
DISCOUNT = 3.0
#: Discount of the words of both classes.
SHARED_DISCOUNT = 0.75
WINDOWS = (1, 2, 4)
THRESHOLD = 0.3
#: Texts handled together in a worker.
SLICE = 64

_WORD = re.compile(r"\w+")
#: Word numbers: what stands before a text's first word, and all words that the models don't know.
START, UNKNOWN, FIRST = 0, 1, 2


def words(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


@dataclass
class Pairs:
    """Discounted pairs ``h * size + w`` in order, with ``max(n - D, 0) / n(h)``; and by ``h`` the mass that is left to the backoff."""

    keys: np.ndarray
    mass: np.ndarray
    left: np.ndarray

    def of(self, keys: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.zeros(len(keys))
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.mass[at], 0.0)


def _pairs(keys: np.ndarray, n: np.ndarray, size: int) -> Pairs:
    """From pairs and their counts; a context that was never seen leaves all to the backoff."""
    h = keys // size
    total = np.bincount(h, weights=n, minlength=size)
    left = np.divide(np.bincount(h, weights=np.minimum(n, DISCOUNT), minlength=size), total, out=np.ones(size), where=total > 0)
    kept = n > DISCOUNT
    return Pairs(keys[kept], (n[kept] - DISCOUNT) / total[h[kept]], left)


def _words(n: np.ndarray, discount: float, backoff: np.ndarray) -> np.ndarray:
    return (np.maximum(n - discount, 0) + np.minimum(n, discount).sum() * backoff) / max(n.sum(), 1e-300) if n.sum() else backoff


@dataclass
class KneserNey:
    """Both models, in class order ordinary, toxic."""

    numbers: dict[str, int]
    shared_words: np.ndarray
    shared: Pairs
    #: By class: ``p_c(w) / u(w)``, the pairs, and by context the sum that ``b_c`` is divided by.
    ratio: list[np.ndarray]
    own: list[Pairs]
    sums: list[np.ndarray]

    def log_prob(self, c: int, h: np.ndarray, w: np.ndarray) -> np.ndarray:
        """``log p_c(w|h)`` by word numbers; the unknown words have one number together."""
        keys = h * len(self.shared_words) + w
        backoff = (self.shared.of(keys) + self.shared.left[h] * self.shared_words[w]) * self.ratio[c][w] / self.sums[c][h]
        return np.log(self.own[c].of(keys) + self.own[c].left[h] * backoff)


def count(texts: Iterable[tuple[list[str], int]]) -> KneserNey:
    """Count the models over texts, given as their words and class."""
    numbers: dict[str, int] = {}
    parts: list[list[np.ndarray]] = [[], []]
    for w, c in texts:
        parts[c].append(np.fromiter((START, START, *(numbers.setdefault(x, len(numbers) + FIRST) for x in w)), np.int64, len(w) + 2))
    size = len(numbers) + FIRST
    # a pair with the word before it, as one number; words before pairs are told apart as far as 63 bits reach (all of them up to 2 million words)
    room = min(size, (1 << 63) // size**2)
    seen = [np.unique(np.concatenate([(p[1:-1] * size + p[2:]) * room + p[:-2] % room for p in own] or [np.zeros(0, np.int64)])) for own in parts]
    parts.clear()
    both = np.unique(np.concatenate(seen))
    pairs = [np.unique(x // room, return_counts=True) for x in (both, *seen)]
    follows = [np.bincount(keys % size, minlength=size).astype(float) for keys, _ in pairs]
    equal = np.full(size, 1.0 / (size - 1))
    equal[START] = 0
    u = _words(follows[0], SHARED_DISCOUNT, equal)
    shared = _pairs(*pairs[0], size)
    ratio = [np.divide(_words(n, DISCOUNT, u), u, out=np.ones(size), where=u > 0) for n in follows[1:]]
    own = [_pairs(*p, size) for p in pairs[1:]]
    sums = [np.bincount(shared.keys // size, weights=shared.mass * r[shared.keys % size], minlength=size) + shared.left for r in ratio]
    return KneserNey(numbers, u, shared, ratio, own, sums)


class _Numbers(dict):
    def __missing__(self, word: str) -> int:
        return UNKNOWN


class Evidence:
    """What scoring needs of both models: ``log p_toxic(w|h) - log p_ordinary(w|h)``.

    Where no class has counts of a pair of its own the shared backoff cancels out, and the difference is a sum of a part
    by the word and a part by the context. Words of which both parts are those of unknown words are dropped.
    """

    def __init__(self, models: KneserNey):
        size = len(models.shared_words)
        word = np.log(models.ratio[1]) - np.log(models.ratio[0])
        left = [np.log(models.own[c].left) - np.log(models.sums[c]) for c in (0, 1)]
        context = left[1] - left[0]
        keys = np.union1d(models.own[0].keys, models.own[1].keys)
        h, w = keys // size, keys % size
        value = models.log_prob(1, h, w) - models.log_prob(0, h, w)
        keep = (np.abs(word - word[UNKNOWN]) > 1e-12) | (np.abs(context - context[UNKNOWN]) > 1e-12)
        keep[[START, UNKNOWN, *h, *w]] = True
        number = np.cumsum(keep) - 1
        self.numbers = _Numbers((x, int(number[i])) for x, i in models.numbers.items() if keep[i])
        self.word, self.context = word[keep], context[keep]
        self.keys, self.value = number[h] * len(self.word) + number[w], value

    def of(self, numbers: np.ndarray, first: np.ndarray) -> np.ndarray:
        """The difference at each word; ``first`` marks the words that begin a text."""
        h = np.concatenate([[START], numbers[:-1]])
        h[first] = START
        out = self.word[numbers] + self.context[h]
        if len(self.keys):
            keys = h * len(self.word) + numbers
            at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
            out = np.where(self.keys[at] == keys, self.value[at], out)
        return out


@dataclass
class Model:
    evidence: Evidence
    #: Weights of the features, their bias last.
    weights: np.ndarray

    def scores(self, texts: list[str | None]) -> np.ndarray:
        x = features(self.evidence, texts)
        return 1 / (1 + np.exp(-np.clip(x @ self.weights[:-1] + self.weights[-1], -30, 30)))


def features(evidence: Evidence, texts: list[str | None]) -> np.ndarray:
    """Of each text: the difference of log-likelihoods by length, of the whole and of the most toxic window of each size."""
    own = [words(t) for t in texts]
    sizes = np.array([len(w) for w in own], np.int64)
    out = np.zeros((len(texts), 1 + len(WINDOWS)))
    if not sizes.sum():
        return out
    numbers = np.fromiter((i for w in own for i in map(evidence.numbers.__getitem__, w)), np.int64, int(sizes.sum()))
    full = sizes > 0
    ends = np.cumsum(sizes)[full]
    starts = ends - sizes[full]
    each = evidence.of(numbers, starts)
    total = np.concatenate([[0.0], np.cumsum(each)])
    out[full, 0] = (total[ends] - total[starts]) / sizes[full]
    begin = np.repeat(starts, sizes[full])
    for k, window in enumerate(WINDOWS):  # windows that end at each word; one that would begin before the text is shorter
        from_ = np.maximum(np.arange(len(each)) + 1 - window, begin)
        out[full, 1 + k] = np.maximum.reduceat((total[1:] - total[from_]) / window, starts)
    return out


def _logistic(x: np.ndarray, y: np.ndarray, w: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """Weights and bias by Newton's method with a small ridge."""
    x = np.hstack([x, np.ones((len(x), 1))])
    beta = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        grad = x.T @ (w * (y - p)) - ridge * beta
        step = np.linalg.solve((x * (w * p * (1 - p) + 1e-9)[:, None]).T @ x + ridge * np.eye(x.shape[1]), grad)
        beta += step
        if np.abs(step).max() < 1e-8:
            break
    return beta


def fit(texts: list[str], toxic: list[int], rate: float) -> Model | None:
    """Fit on labelled texts; ``rate`` is the share of toxic rows among all labelled ones. Equal texts count once.

    Two thirds give the counts, one third the logistic function.
    """
    rows = sorted({(t, int(y)) for t, y in zip(texts, toxic, strict=True) if t})
    counted, held = [], []
    for t, y in rows:
        (counted if zlib.crc32(t.encode("utf-8", "surrogatepass")) % 3 else held).append((t, y))
    if len({y for _, y in counted}) < 2 or len({y for _, y in held}) < 2:
        return None
    evidence = Evidence(count((words(t), y) for t, y in counted))
    x = np.concatenate([features(evidence, [t for t, _ in held[i : i + SLICE]]) for i in range(0, len(held), SLICE)])
    y = np.array([float(t) for _, t in held])
    share = y.mean()
    return Model(evidence, _logistic(x, y, np.where(y > 0, rate / share, (1 - rate) / (1 - share))))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def sample(docs: DataFrame, labels: DataFrame, toxic_rows: int = TOXIC_ROWS, ordinary_rows: int = ORDINARY_ROWS, most_bytes: int = SAMPLE_BYTES, learned_chars: int = LEARNED_CHARS) -> tuple[list[str], list[int], float] | None:
    """Texts and marks of the labelled sample, none of them held out, and the share of toxic rows among all labelled ones.

    Which rows it holds is decided by hashes of ids and texts, so each run gets the same. Only rows' keys and sizes, of
    a bounded number (32 bytes each), and then at most ``2 * most_bytes`` of texts reach the driver.
    """
    rows = labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & ~held_out(F.col("doc_id"))).select("doc_id", F.col("toxic").alias("__toxic"))
    number = {r["__toxic"]: r["n"] for r in rows.groupBy("__toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(number) < 2:
        return None
    marked = None
    for mark, bound in ((1, toxic_rows), (0, ordinary_rows)):
        part = rows.filter(F.col("__toxic") == mark).distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound)
        marked = part if marked is None else marked.unionByName(part)
    own = docs.select("doc_id", plain(F.col("text")).alias("text")).filter("text <> ''")
    # at most toxic_rows + ordinary_rows ids, whatever the input's size
    sized = own.join(F.broadcast(marked), "doc_id").select("doc_id", "__toxic", F.xxhash64("text").alias("__of"), F.octet_length(F.substring("text", 1, learned_chars)).alias("__size")).distinct()
    taken: set[tuple[int, int]] = set()
    for mark, bound in ((1, toxic_rows), (0, ordinary_rows)):
        left = most_bytes
        for r in sized.filter(F.col("__toxic") == mark).orderBy(F.xxhash64("doc_id"), "doc_id", "__of").limit(bound).collect():
            if r["__size"] <= left:
                left -= r["__size"]
                taken.add((r["doc_id"], r["__of"], mark))
    keys = docs.sparkSession.createDataFrame(sorted(taken), "__id long, __of long, __toxic long")
    found = own.join(F.broadcast(keys), (F.col("doc_id") == F.col("__id")) & (F.xxhash64("text") == F.col("__of"))).select(F.substring("text", 1, learned_chars).alias("text"), "__toxic").distinct().collect()
    return [r[0] for r in found], [r[1] for r in found], number[1] / (number[0] + number[1])


def train(docs: DataFrame, labels: DataFrame, toxic_rows: int = TOXIC_ROWS, ordinary_rows: int = ORDINARY_ROWS, most_bytes: int = SAMPLE_BYTES) -> Model | None:
    """Fit on at most so many labelled rows and bytes of each class, none of them held out."""
    found = sample(docs, labels, toxic_rows, ordinary_rows, most_bytes)
    return None if found is None else fit(*found)


def score(text: Column, model: Model | None) -> Column:
    """Score of a text, from 0 to 1."""
    if model is None:
        return F.lit(0.0)

    @F.arrow_udf("double")
    def udf(texts: pa.Array) -> pa.Array:
        out = [model.scores(texts[i : i + SLICE].to_pylist()) for i in range(0, len(texts), SLICE)]
        pa.default_memory_pool().release_unused()
        return pa.array(np.concatenate(out) if out else [], pa.float64())

    return udf(plain(text))


def scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of each document."""
    bound_batches(docs.sparkSession)
    out = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), score(F.col("text"), train(docs, labels)).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def ordinary(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that aren't predicted to be toxic, with their columns as they were."""
    bound_batches(docs.sparkSession)
    return docs.withColumn("__score", score(F.col("text"), train(docs, labels))).filter(F.col("__score") < THRESHOLD).drop("__score")
