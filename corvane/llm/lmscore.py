"""Scoring by cross-entropy difference between two matched n-gram models.

Both models are bigram models over the same words (all words of the corpus),
with the same smoothing by their unigram models and the same tokens; one is
counted over target documents, the other over all documents. A document's score
is the mean, over its tokens, of target loss minus background loss, in nats: the
lower, the nearer to the target. No document is scored by counts of its own: they
are taken off each model that counted it before its losses are formed.

All documents and all words are counted; nothing that grows with the corpus is
collected or broadcast. Documents are cut into chunks of about ``CHUNK_TOKENS``
tokens. Each chunk sends its distinct words and word pairs, with their counts in
it, to the partitions that own them; a partition sums the counts over all chunks
and answers each chunk for what it sent. A chunk then has all counts that its
documents' losses are made of. A word or pair costs one entry for each chunk
that has it, however common it is, and never more than one row: a chunk sends a row only to
parts that own some of its words, so entries, rows and steps grow with the tokens. The key range has one part for each
``MOST_ENTRIES`` tokens. Up to ``MOST_PARTITIONS`` each is a partition of its own; beyond that a
partition is handed several, in order, and holds one at a time. Words and pairs are told apart by 64-bit hashes.

Defined results: a null or empty text has no tokens, null losses and a null
score; a very long text is a chunk of its own; repeated rows count as rows, so a row's copies stay counted when it is scored; equal scores are
equal, there is no ranking; without target documents both models are
the background, and every score is 0; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import batches_of, cut, plain, small

#: Tokens that the unigram model weighs in a bigram's context.
PRIOR = 20.0
SLICE = 64
CHUNK_TOKENS, CHUNK_ROWS = 300_000, 4096
#: Words and pairs that a partition is to be sent: at least, as long as there are few partitions, and at most.
LEAST_ENTRIES, MOST_ENTRIES, FEW_PARTITIONS = 100_000, 1_000_000, 48
#: Partitions that the parts are dealt to, at most.
MOST_PARTITIONS = 20_000
#: Distinct words whose hash a worker keeps; beyond it the table is begun anew.
CACHE_WORDS = 60_000
#: Rows that a worker is handed at once where a row holds a chunk or its share of a partition.
CHUNKS_AT_ONCE, SHARES_AT_ONCE = 4, 16

_WORD = re.compile(r"\w+")
_U = np.uint64
#: The context of a text's first word; the largest number, so that it stays last in order.
_START = _U(0xFFFFFFFFFFFFFFFF)


class _Hashes(dict):
    def __missing__(self, word: str) -> int:
        value = xxhash.xxh3_64_intdigest(word)
        if len(word) <= 64:
            if len(self) >= CACHE_WORDS:
                self.clear()
            self[word] = value
        return value


_hashes = _Hashes()


def _pack(columns: list[np.ndarray]) -> bytes:
    """Counts of the same length, each column in as few bytes as its largest needs; all lowest bytes come first and all highest, mostly zeros, last."""
    narrow = [c.astype(np.min_scalar_type(int(c.max(initial=0)))) for c in columns]
    return bytes(c.itemsize for c in narrow) + b"".join(c.view(np.uint8).reshape(len(c), c.itemsize).T.tobytes() for c in narrow)


def _unpack(data: bytes, columns: int) -> list[np.ndarray]:
    out, at, n = [], columns, (len(data) - columns) // max(sum(data[:columns]), 1)
    for width in data[:columns]:
        out.append(np.frombuffer(data, np.uint8, n * width, at).reshape(width, n).T.copy().view(f"<u{width}").reshape(n))
        at += n * width
    return out


def _chunked(docs: DataFrame) -> DataFrame:
    """Chunks of ``doc_id, text, target``: the ids, sizes and target marks of their documents, their distinct words' hashes in order, and all tokens as places in these."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, rows, tokens, held = TaskContext.get().partitionId() << 32, 0, 0, []

        def chunk() -> pa.RecordBatch:
            ids, marks, sizes, flat = (pa.concat_arrays([h[0] for h in held]), *(np.concatenate([h[k] for h in held]) for k in (1, 2, 3)))
            words, stream = np.unique(flat, return_inverse=True)
            values = [number, ids.to_pylist(), marks.tobytes(), _pack([sizes]), words.tobytes(), _pack([stream]), len(flat)]
            return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(values, schema, strict=True)], schema=schema)

        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                words = [_WORD.findall((t or "").lower()) for t in part.column(1).to_pylist()]
                sizes = np.array([len(w) for w in words], np.int64)
                flat = np.fromiter((h for w in words for h in map(_hashes.__getitem__, w)), np.uint64, int(sizes.sum()))
                held.append((part.column(0), np.array(part.column(2).to_pylist(), bool), sizes, flat))
                rows, tokens = rows + part.num_rows, tokens + len(flat)
                if tokens >= CHUNK_TOKENS or rows >= CHUNK_ROWS:
                    yield chunk()
                    number, rows, tokens, held = number + 1, 0, 0, []
            pa.default_memory_pool().release_unused()
        if held:
            yield chunk()

    schema = pa.schema([("chunk", pa.int64()), ("ids", pa.list_(pa.int64())), ("marks", pa.binary()), ("sizes", pa.binary()), ("words", pa.binary()), ("stream", pa.binary()), ("n", pa.int64())])
    return docs.mapInArrow(each, "chunk long, ids array<long>, marks binary, sizes binary, words binary, stream binary, n long")


class _Chunk:
    """A chunk's tokens: ``context`` and ``stream`` are places in ``words`` (the last of which is the start), ``pair`` in ``pairs``."""

    def __init__(self, sizes: bytes, words: bytes, stream: bytes) -> None:
        self.sizes = _unpack(sizes, 1)[0].astype(np.int64)
        self.words = np.append(np.frombuffer(words, "<u8"), _START)
        self.stream = _unpack(stream, 1)[0].astype(np.int64)
        start = len(self.words) - 1
        self.context = np.concatenate([[start], self.stream[:-1]]) if len(self.stream) else self.stream
        self.context[(np.cumsum(self.sizes) - self.sizes)[self.sizes > 0]] = start
        key = self.words[self.context] * _U(0x9E3779B97F4A7C15) + self.words[self.stream]
        key = (key ^ (key >> _U(32))) * _U(0xD6E8FEB86659FD93)
        self.pairs, self.pair = np.unique(key ^ (key >> _U(32)), return_inverse=True)


#: Counts of a word: as a word and as a context, over all documents and over the target's; and of a pair.
_COLUMNS = (4, 2)


def _sent(chunks: DataFrame, partitions: int) -> DataFrame:
    """``part, chunk, kind, keys, counts`` (kind 0: words, 1: pairs; keys in order, as differences): what each chunk sends to each partition."""
    bounds = np.array([(p << 64) // partitions for p in range(partitions)], np.uint64)
    names = ["part", "chunk", "kind", "keys", "counts"]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                c = _Chunk(row["sizes"], row["words"], row["stream"])
                marked = np.repeat(np.frombuffer(row["marks"], bool), c.sizes)
                count = lambda places, n: [np.bincount(x, minlength=n) for x in (places, places[marked])]  # noqa: B023, E731
                n = len(c.words)
                for kind, keys, columns in ((0, c.words, [*count(c.stream, n), *count(c.context, n)]), (1, c.pairs, count(c.pair, len(c.pairs)))):
                    # only parts that own some of the keys are visited; keys are in order
                    part = np.searchsorted(bounds, keys, side="right") - 1
                    first = np.flatnonzero(np.diff(part, prepend=-1))
                    spans = list(zip(part[first].tolist(), first.tolist(), [*first[1:].tolist(), len(keys)], strict=True))
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([p for p, _, _ in spans], pa.int64()),
                            pa.array([row["chunk"]] * len(spans), pa.int64()),
                            pa.array([kind] * len(spans), pa.int32()),
                            pa.array([_pack([np.diff(keys[i:j], prepend=_U(0))]) for _, i, j in spans], pa.binary()),
                            pa.array([_pack([x[i:j] for x in columns]) for _, i, j in spans], pa.binary()),
                        ],
                        names,
                    )
            pa.default_memory_pool().release_unused()

    return chunks.select("chunk", "marks", "sizes", "words", "stream").mapInArrow(each, "part long, chunk long, kind int, keys binary, counts binary")


def _answered(sent: DataFrame) -> DataFrame:
    """``chunk, kind, part, counts``: the sums over all chunks for what each sent; rows without a chunk give numbers of distinct words and of tokens."""
    names = ["chunk", "kind", "part", "counts", "distinct", "tokens", "target_tokens"]
    schema = "chunk long, kind int, part long, counts binary, distinct long, tokens long, target_tokens long"

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[list, list] = ([], [])
        now = None
        for batch in batches:
            for row in batch.to_pylist():
                if row["part"] != now:
                    yield from answers(held)
                    held, now = ([], []), row["part"]
                held[row["kind"]].append((row["chunk"], row["part"], np.cumsum(_unpack(row["keys"], 1)[0], dtype=np.uint64), row["counts"]))
        yield from answers(held)

    def answers(held: tuple[list, list]) -> Iterator[pa.RecordBatch]:
        """Of one part."""
        for kind, rows in enumerate(held):
            if not rows:
                continue
            keys, at = np.unique(np.concatenate([k for _, _, k, _ in rows]), return_inverse=True)
            columns = list(zip(*(_unpack(c, _COLUMNS[kind]) for _, _, _, c in rows), strict=True))
            sums = [np.bincount(at, weights=np.concatenate(x), minlength=len(keys)).astype(np.int64) for x in columns]
            if kind == 0:
                totals = [int((sums[0] > 0).sum()), int(sums[0].sum()), int(sums[1].sum())]
                yield pa.RecordBatch.from_arrays([pa.array([None], pa.int64()), pa.array([0], pa.int32()), pa.array([None], pa.int64()), pa.array([None], pa.binary()), *(pa.array([t], pa.int64()) for t in totals)], names)
            edge = np.cumsum([0, *(len(k) for _, _, k, _ in rows)])
            for first in range(0, len(rows), SHARES_AT_ONCE):
                own = range(first, min(first + SHARES_AT_ONCE, len(rows)))
                none = pa.nulls(len(own), pa.int64())
                packed = [_pack([s[at[edge[i] : edge[i + 1]]] for s in sums]) for i in own]
                yield pa.RecordBatch.from_arrays([pa.array([rows[i][0] for i in own], pa.int64()), pa.array([kind] * len(own), pa.int32()), pa.array([rows[i][1] for i in own], pa.int64()), pa.array(packed, pa.binary()), none, none, none], names)

    return sent.mapInArrow(each, schema)


def _own(own: np.ndarray, places: np.ndarray, n: int) -> np.ndarray:
    """Of each token, how often its document has what stands at its place."""
    _, at, count = np.unique(own * n + places, return_inverse=True, return_counts=True)
    return count[at]


def _loss(word: np.ndarray, context: np.ndarray, pair: np.ndarray, tokens: np.ndarray, words: int) -> np.ndarray:
    """``-log p(word | context)`` of each token from its counts: bigrams smoothed by the unigram model, that by half a count for each word."""
    unigram = (word + 0.5) / (tokens + 0.5 * words)
    return -np.log((pair + PRIOR * unigram) / (context + PRIOR))


RESULT = "doc_id long, n_tokens long, target_loss double, background_loss double, score double"


def score(docs: DataFrame, target_ids: DataFrame) -> DataFrame:
    """Losses and score of every document; ``target_ids`` has the ``doc_id`` of target documents."""
    spark = docs.sparkSession
    marked = small(target_ids.select(F.col("doc_id").alias("__id")).filter("__id IS NOT NULL").distinct())
    joined = docs.select("doc_id", "text").join(marked, F.col("doc_id") == F.col("__id"), "left")
    with batches_of(spark, 512):
        chunks = cut(_chunked(joined.select(F.col("doc_id").cast("long").alias("doc_id"), plain(F.col("text")).alias("text"), F.col("__id").isNotNull().alias("__target"))), "chunks")
    n_chunks, n = chunks.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    partitions = max(1, min(FEW_PARTITIONS, n // LEAST_ENTRIES), n // MOST_ENTRIES)
    with batches_of(spark, CHUNKS_AT_ONCE):
        # each part has a partition of its own; by a hash of its number some would hold several at once
        each = -(-partitions // MOST_PARTITIONS)
        sent = _sent(chunks, partitions).repartitionById(-(-partitions // each), F.floor(F.col("part") / each).cast("int"))
        if each > 1:
            sent = sent.sortWithinPartitions("part")
        answers = cut(_answered(sent), "answers")
    # the 1 is the class of words that the corpus doesn't have
    words, tokens, target_tokens = (x or 0 for x in answers.filter("chunk IS NULL").agg(F.sum("distinct"), F.sum("tokens"), F.sum("target_tokens")).first())
    with batches_of(spark, SHARES_AT_ONCE):
        return cut(_scored(chunks, answers.filter("chunk IS NOT NULL"), n_chunks, words + 1, tokens, target_tokens), "scores")


def _scored(chunks: DataFrame, answers: DataFrame, n_chunks: int, words: int, tokens: int, target_tokens: int) -> DataFrame:
    """Each chunk is met after the answers to it, words before pairs, in the order of their partitions."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got: tuple[list, list] = ([], [])
        for batch in batches:
            for row in batch.to_pylist():
                if row["kind"] < 2:
                    got[row["kind"]].append(_unpack(row["counts"], _COLUMNS[row["kind"]]))
                    continue
                c = _Chunk(row["sizes"], row["words"], row["stream"])
                u, u_target, x, x_target, p, p_target = (np.concatenate(k) if k else np.zeros(0) for kind in (0, 1) for k in (zip(*got[kind], strict=True) if got[kind] else [()] * _COLUMNS[kind]))
                got = ([], [])
                own = np.repeat(np.arange(len(c.sizes)), c.sizes)
                counted = np.repeat(np.frombuffer(row["marks"], bool), c.sizes)
                places = (c.stream, c.context, c.pair)
                minus = [*(_own(own, at, n) for at, n in zip(places, (len(c.words), len(c.words), len(c.pairs)), strict=True)), c.sizes[own]]
                background = _loss(*(k[at] - m for k, at, m in zip((u, x, p), places, minus, strict=False)), tokens - minus[3], words)
                target = background
                if target_tokens:
                    target = _loss(*(k[at] - m * counted for k, at, m in zip((u_target, x_target, p_target), places, minus, strict=False)), target_tokens - minus[3] * counted, words)
                means = [np.bincount(own, weights=t, minlength=len(c.sizes)) / np.maximum(c.sizes, 1) for t in (target, background)]
                columns = [pa.array(m, pa.float64(), mask=c.sizes == 0) for m in (*means, means[0] - means[1])]
                yield pa.RecordBatch.from_arrays([pa.array(row["ids"], pa.int64()), pa.array(c.sizes), *columns], ["doc_id", "n_tokens", "target_loss", "background_loss", "score"])
            pa.default_memory_pool().release_unused()

    rows = answers.select("chunk", "kind", "part", "counts").unionByName(chunks.select("chunk", F.lit(2).alias("kind"), "ids", "marks", "sizes", "words", "stream"), allowMissingColumns=True)
    by_chunk = rows.repartition(max(1, min(n_chunks, 2 * chunks.sparkSession.sparkContext.defaultParallelism), n_chunks // 16), "chunk").sortWithinPartitions("chunk", "kind", "part")
    return by_chunk.mapInArrow(each, RESULT)
