"""Packing of token pieces into sequences: first-fit decreasing on a tournament tree.

Each document becomes its token ids plus an end id, cut into pieces of at most
``capacity`` ids (whole sequences first, then the remainder). A document is one
row until it is packed: its size and its pieces' checksums. Documents are dealt
at random into groups of about ``group_rows``; the remainders of each group are
packed on their own by first-fit decreasing, where a tournament tree over the
bins' free room gives the leftmost bin that fits in logarithmic time. A group has
one remainder for each of its documents, however long they are; token ids
themselves aren't shuffled.

Defined results: a null or empty text is one piece that holds the end id only;
repeated rows are packed separately, equal lengths in the order of their rows' places; a text may have any length, and
many sequences; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import itertools
import json
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import bound_batches, cut, plain

CAPACITY = 4096
END_ID = 2
#: Documents in a randomised group, on average.
GROUP_ROWS = 2048
#: Words whose ids a worker keeps, of each kind; beyond it the table is begun anew.
CACHE_WORDS = 200_000
# Fixed value: how a token that ends a word is marked in the vocabulary.
WORD_END = "</w>"
#: Longer words are merged by the vocabulary's own library, whose time grows less with their length.
LONGEST = 200
#: Texts handled together in a worker.
SLICE = 128

# The vocabulary's pre-tokenizer for lower-case Latin-1 text, where its classes are these characters.
_LETTER, _NUMBER, _SPACE = "a-z\xaa\xb5\xba\xdf-\xf6\xf8-\xff", "0-9\xb2\xb3\xb9\xbc-\xbe", " \t\n\x0b\x0c\r"
_PIECES = re.compile(f"[{_LETTER}]+|'(?:s|t|re|ve|m|ll|d)|[{_NUMBER}]|[^{_SPACE}{_LETTER}{_NUMBER}]+").findall
#: Latin-1 characters but control characters and rare spaces.
_PLAIN = bytes(b for b in range(256) if 9 <= b <= 13 or 32 <= b <= 126 or b >= 161)
#: How special tokens begin.
_SPECIAL = "<|"

_cached: dict[str, tuple] = {}


def _is_other(word: str) -> bool:
    try:
        return bool(word.encode("latin-1").translate(None, _PLAIN)) or _SPECIAL in word
    except UnicodeEncodeError:
        return True


class WordIds:
    """Ids of whole texts by a tokenizer whose tokens never reach over a space or line end.

    Both characters are white space that the vocabulary's pre-tokenizer drops, so a text may be cut there. What is
    Latin-1, where lower case and composed forms are plain, is cut into words at white space; their ids are kept, and
    those of new words are found together, by cutting them with one pattern and merging by rank with
    another library's core. Words with other characters are left to the vocabulary's own library.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a worker has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.latin = LatinWords(json.loads(self.tokenizer.to_str())["model"])
        #: Words whose ids are kept, of each kind.
        self.most = CACHE_WORDS
        self.words: dict[str, bytes] = {}
        self.plain: dict[str, bytes] = {}

    def encode(self, texts: list[str], end_id: int) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text, with the end id."""
        tail = np.uint32(end_id).astype("<u4").tobytes()
        parts = [[(False, t)] if not _is_other(t) else [(k, " ".join(g)) for k, g in itertools.groupby(t.replace("\n", " ").split(" "), _is_other)] for t in texts]
        self._learn({w for p in parts for other, run in p if other for w in run.split(" ") if len(w) <= LONGEST} - self.words.keys())
        cut = [[(other, run.split(" ") if other else run.lower().split()) for other, run in p] for p in parts]
        if len(self.plain) > self.most:
            self.plain = {}
        long = self._learn_plain(set().union(*(ws for p in cut for other, ws in p if not other)).difference(self.plain))
        latin = self.plain.__getitem__ if not long else lambda w: long[w] if w in long else self.plain[w]
        return [b"".join([*(b"".join(map(self._other if other else latin, ws)) for other, ws in p), tail]) for p in cut]

    def forget(self) -> None:
        """Gives the memory of kept ids back; a worker lives on after its task."""
        self.words, self.plain = {}, {}

    def _other(self, word: str) -> bytes:
        return self.words[word] if len(word) <= LONGEST else self._library(word)

    def _learn_plain(self, new: set[str]) -> dict[str, bytes]:
        """Adds the ids of Latin-1 words; gives those of long words, which aren't kept."""
        short = [w for w in new if len(w) <= LONGEST]
        self.plain.update(zip(short, self.latin.encode_each(list(map(_PIECES, short))), strict=True))
        return {w: self._long(_PIECES(w)) for w in new if len(w) > LONGEST}

    def _long(self, pieces: list[str]) -> bytes:
        runs = itertools.groupby(pieces, lambda w: len(w) > LONGEST)
        return b"".join(x for long, run in runs for x in (map(self._library, run) if long else [self.latin.encode(list(run))]))

    def _library(self, word: str) -> bytes:
        return np.array(self.tokenizer.encode(word, add_special_tokens=False).ids, "<u4").tobytes()

    def _learn(self, new: set[str]) -> None:
        """Adds the ids of words; what was known before may be forgotten."""
        if len(self.words) > self.most:
            self.words = _Forgotten(self._library)
        for part in itertools.batched(new, 4096):
            for w, e in zip(part, self.tokenizer.encode_batch_fast(list(part), add_special_tokens=False), strict=True):
                self.words[w] = np.array(e.ids, "<u4").tobytes()


class _Forgotten(dict):
    """Words that are encoded again when they are asked for."""

    def __init__(self, encode):
        super().__init__()
        self.encode = encode

    def __missing__(self, word: str) -> bytes:
        self[word] = self.encode(word)
        return self[word]


class LatinWords:
    """Ids of words by the rank-based merging of another library, several times faster.

    Merging the adjacent pair whose joint token was learned first is the same as applying the merges in their order. A
    line end follows each word and is merged with the word's last byte before all else, which gives the symbol of a byte
    that ends a word.
    """

    def __init__(self, model: dict):
        import tiktoken

        if model["type"] != "BPE" or model["end_of_word_suffix"] != WORD_END or model["ignore_merges"]:
            raise ValueError("only merge vocabularies with word ends")
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves in the vocabulary
        byte = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in plain)}

        def raw(token: str) -> bytes:
            end = token.endswith(WORD_END)
            return bytes(byte[c] for c in (token[: -len(WORD_END)] if end else token)) + b"\n" * end

        ranks = {bytes([i]): i for i in range(256)} | {bytes([i, 10]): 256 + i for i in range(256)}
        first = len(ranks)
        self.ids = np.zeros(first + len(model["merges"]), "<u4")
        for token, i in model["vocab"].items():
            if len(token.removesuffix(WORD_END)) == 1:
                self.ids[ranks[raw(token)]] = i
        for r, pair in enumerate(model["merges"]):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            ranks[raw(left + right)] = first + r
            self.ids[first + r] = model["vocab"][left + right]
        self.ends = np.zeros(len(self.ids), bool)  # of tokens with the line end
        self.ends[[r for token, r in ranks.items() if token.endswith(b"\n") and r < len(self.ids)]] = True
        self.encoding = tiktoken.Encoding("words", pat_str=r"[^\n]*\n", mergeable_ranks=ranks, special_tokens={})

    def encode(self, words: list[str]) -> bytes:
        return self.ids[self.encoding.encode_to_numpy("\n".join(words) + "\n")].tobytes() if words else b""

    def encode_each(self, groups: list[list[str]]) -> list[bytes]:
        """The ids of each group of words, all found at once."""
        words = [w for g in groups for w in g]
        if not words:
            return [b""] * len(groups)
        found = self.encoding.encode_to_numpy("\n".join(words) + "\n")
        data = self.ids[found].tobytes()
        edge = np.concatenate([[0], 4 * (np.flatnonzero(self.ends[found]) + 1)])[np.cumsum([0, *map(len, groups)])].tolist()
        return [data[i:j] for i, j in itertools.pairwise(edge)]


def encoder(path: str) -> WordIds:
    if path not in _cached:
        _cached.clear()
        _cached[path] = WordIds(path)
    return _cached[path]


DEALT = "doc_id long, doc_tokens long, key long, crcs array<long>"


def dealt(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """``DEALT`` of each document: the checksums of its pieces, and a key of its own; ``with_ids`` adds the ids as ``array<int>``.

    The key is the row's place in its partition, the same when a lost task runs again.
    """
    bound_batches(docs.sparkSession)
    names = [c.split()[0] for c in DEALT.split(", ")] + ["ids"] * with_ids

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, key = encoder(tokenizer_path), TaskContext.get().partitionId() << 40
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                found = own.encode([t or "" for t in part.column(1).to_pylist()], end_id)
                columns = [
                    part.column(0),
                    pa.array([len(d) // 4 for d in found], pa.int64()),
                    pa.array(range(key, key + len(found)), pa.int64()),
                    pa.array([[zlib.crc32(d[i : i + 4 * capacity]) for i in range(0, len(d), 4 * capacity)] for d in found], pa.list_(pa.int64())),
                ]
                if with_ids:
                    columns.append(pa.array([np.frombuffer(d, "<u4").astype("<i4") for d in found], pa.list_(pa.int32())))
                key += len(found)
                yield pa.RecordBatch.from_arrays(columns, names)
            pa.default_memory_pool().release_unused()
        own.forget()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), plain(F.col("text")).alias("text"))
    return rows.mapInArrow(each, DEALT + (", ids array<int>" if with_ids else ""))


def first_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each length, longest first, ties in the order given.

    ``tree[1]`` holds the largest free room of all bins; each inner node that of its two halves. A search goes down
    to the leftmost bin with room enough.
    """
    n = len(lengths)
    leaves = 1
    while leaves < n:
        leaves *= 2
    tree = [capacity] * (2 * leaves)
    bins, offsets = np.zeros(n, np.int64), np.zeros(n, np.int64)
    for i in np.argsort(-lengths, kind="stable"):
        need, node = int(lengths[i]), 1
        while node < leaves:
            node = 2 * node if tree[2 * node] >= need else 2 * node + 1
        bins[i], offsets[i] = node - leaves, capacity - tree[node]
        tree[node] -= need
        while node > 1:
            node //= 2
            tree[node] = max(tree[2 * node], tree[2 * node + 1])
    return bins, offsets


PACKED = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def assign(rows: DataFrame, groups: int, capacity: int = CAPACITY, with_key: bool = False) -> DataFrame:
    """``PACKED`` of the pieces of ``dealt`` rows; ``groups`` random groups are packed on their own. ``with_key`` keeps the document's key."""

    def pack(key: tuple, own: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values("key", kind="stable").reset_index(drop=True)
        tokens = own["doc_tokens"].to_numpy()
        whole, rest = tokens // capacity, tokens % capacity
        packed = np.flatnonzero(rest)
        bins, offsets = first_fit_decreasing(rest[packed], capacity)
        used = int(bins.max()) + 1 if len(bins) else 0
        # each whole piece is a sequence, numbered after those of the remainders
        n = whole + (rest > 0)
        doc = np.repeat(np.arange(len(own)), n)
        place = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
        is_whole = place < whole[doc]
        sequence, offset = np.zeros(len(doc), np.int64), np.zeros(len(doc), np.int64)
        sequence[is_whole] = used + np.arange(int(is_whole.sum()))
        sequence[~is_whole], offset[~is_whole] = bins, offsets
        out = {
            "doc_id": own["doc_id"].take(doc).array,
            "start": place * capacity,
            "length": np.where(is_whole, capacity, rest[doc]),
            "ids_crc32": np.concatenate(own["crcs"].to_list()),
            "doc_tokens": tokens[doc],
            "sequence_id": (int(key[0]) << 32) + sequence,
            "offset": offset,
        }
        return pd.DataFrame(out | {"key": own["key"].to_numpy()[doc]} if with_key else out)

    group = F.pmod(F.xxhash64("key"), F.lit(groups)).alias("__group")
    return rows.select("doc_id", "doc_tokens", "key", "crcs", group).groupBy("__group").applyInPandas(pack, PACKED + (", key long" if with_key else ""))


def _groups(docs: DataFrame, group_rows: int) -> int:
    """As many as the number of documents asks for (read from file footers where it can be)."""
    return max(1, -(-docs.count() // group_rows))


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID, group_rows: int = GROUP_ROWS) -> DataFrame:
    """Pieces of all ``docs`` with the sequence and offset where each lies."""
    return assign(dealt(docs, tokenizer_path, capacity, end_id), _groups(docs, group_rows), capacity)


def sequences(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID, pad_id: int = 0, group_rows: int = GROUP_ROWS) -> DataFrame:
    """The packed sequences themselves: ``sequence_id, ids array<int>, n_ids``, numbered as ``pack`` does.

    A sequence is padded to ``capacity`` unless its length is a power of two. Only here do ids move: each to its sequence.
    """
    rows = cut(dealt(docs, tokenizer_path, capacity, end_id, with_ids=True), "ids")
    placed = assign(rows, _groups(docs, group_rows), capacity, with_key=True).select("key", "start", "length", "sequence_id", "offset")
    of = rows.select(F.col("key").alias("__key"), "ids")
    pieces = placed.join(of, F.col("key") == F.col("__key")).select("sequence_id", "offset", F.slice("ids", (F.col("start") + 1).cast("int"), F.col("length").cast("int")).alias("ids"))
    joined = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("offset", "ids"))), lambda x: x["ids"]))  # at most ``capacity`` ids
    n = F.size("ids")
    padded = F.when(n.bitwiseAND(n - 1) == 0, F.col("ids")).otherwise(F.concat("ids", F.array_repeat(F.lit(pad_id), capacity - n)))
    return pieces.groupBy("sequence_id").agg(joined.alias("ids")).select("sequence_id", padded.alias("ids"), n.alias("n_ids"))
