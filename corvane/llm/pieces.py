"""Encoding and decoding with a merge-type SentencePiece vocabulary, by backtracking.

A merge-type encoding is the only sequence of tokens in which every adjacent
pair is compatible, that is, in which re-merging two neighbours alone would
leave them as they are. So a text is encoded from left to right: Aho-Corasick
gives the vocabulary's matches at each position, the longest is tried first, it
must be compatible with its left neighbour, and a bitfield remembers positions
from which no encoding goes on. No merge queue is run over the text.

The vocabulary file is read here; the sentencepiece library itself is used in
tests only. Supported are vocabularies with identity normalisation, a dummy
prefix, kept white space and byte fallback; others raise ``ValueError``.

Runs of two or more spaces have tokens of one and the same score, for which
compatibility of neighbours doesn't determine the encoding; a piece of text
that begins with such a run is merged directly.

Defined results: a null or empty text has no ids and decodes to the empty
text; repeated rows each get their result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import re
import struct

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import bound_batches, plain

SPACE = "▁"
#: Distinct pieces of text whose encoding a worker keeps; beyond it the table is begun anew.
CACHE_WORDS = 700_000
#: Longer pieces are encoded each time.
CACHE_LENGTH = 64
CACHE_PAIRS = 300_000
#: Texts handled together in a worker.
SLICE = 64

_NORMAL, _BYTE = 1, 6
_SPACED = re.compile(f"{SPACE}+[^{SPACE}\n]*|[^{SPACE}\n]+|\n")


def _fields(data: bytes):
    """Field number and value of a protocol buffer message: an int, 4 or 8 bytes, or the bytes of a string or message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            b = data[at]
            at += 1
            value |= (b & 127) << shift
            shift += 7
            if b < 128:
                return value

    while at < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
            continue
        size = 8 if kind == 1 else 4 if kind == 5 else varint()
        yield key >> 3, data[at : at + size]
        at += size


#: Ids joined by commas, their number, decoded text.
Entry = tuple[str, int, str]


#: A token's length and id.
Match = tuple[int, int]


class _Entries(dict):
    """Entries of pieces met before. When half of the room is full, what is met again moves on and the rest goes."""

    def __init__(self, vocabulary: Vocabulary):
        super().__init__({"": ("", 0, "")})
        self.vocabulary = vocabulary
        self.older: dict[str, Entry] = {}

    def __missing__(self, piece: str) -> Entry:
        e = self.older.get(piece)
        if e is None:
            e = self.vocabulary.entry(piece)
        if len(piece) <= CACHE_LENGTH:
            if len(self) >= CACHE_WORDS // 2:
                self.older = dict(self)
                self.clear()
                self[""] = ("", 0, "")
            self[piece] = e
        return e


class Vocabulary:
    """Tokens, their merge ranks and splits, and the automaton over the tokens that merging can reach."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            data = f.read()
        self.surface: list[str] = []
        self.kind: list[int] = []
        scores: list[float] = []
        settings: dict[int, object] = {}
        for number, value in _fields(data):
            if number == 1:
                piece = dict(_fields(value))
                self.surface.append(piece.get(1, b"").decode())
                scores.append(struct.unpack("<f", piece[2])[0] if 2 in piece else 0.0)
                self.kind.append(piece.get(3, _NORMAL))
            elif number == 2:
                trainer = dict(_fields(value))
            elif number == 3:
                settings = dict(_fields(value))
        if trainer.get(3) != 2 or not trainer.get(35) or settings.get(2) or settings.get(3, 1) != 1 or settings.get(4, 1) != 0:
            raise ValueError("only merge-type vocabularies with byte fallback, identity normalisation, a dummy prefix and kept spaces")
        self.ids = {s: i for i, s in enumerate(self.surface) if self.kind[i] == _NORMAL}
        self.bytes = {int(self.surface[i][3:5], 16): i for i, k in enumerate(self.kind) if k == _BYTE}
        self.score = scores
        self.chars = {c for s in self.ids for c in s}
        if "\n" in self.chars or any(SPACE in s.lstrip(SPACE) for s in self.ids):
            raise ValueError("a token reaches over a space or line end")
        order = sorted((-scores[i], i) for i in self.ids.values())
        self.rank = {i: r for r, (_, i) in enumerate(order)}
        self.split: dict[int, tuple[int, int]] = {}
        self.auto = ahocorasick.Automaton()
        for s, i in self.ids.items():
            if len(s) == 1:
                self.rank[i] = -1
                self.auto.add_word(s, (1, i))
            elif s.strip(SPACE):
                merged, last = self.merge(s)
                if merged == [i]:
                    self.split[i] = last
                    self.auto.add_word(s, (len(s), i))
        self.auto.make_automaton()
        #: The longest token that a token begins with, beside itself.
        self.shorter: list[Match | None] = [None] * len(self.surface)
        reached = {s: i for s, i in self.ids.items() if len(s) == 1 or i in self.split}
        for s, i in reached.items():
            self.shorter[i] = next(((n, reached[s[:n]]) for n in range(len(s) - 1, 0, -1) if s[:n] in reached), None)
        self.digits = [str(i) for i in range(len(self.surface))]
        self.spelled = [s.replace(SPACE, " ") if k == _NORMAL else None for s, k in zip(self.surface, self.kind, strict=True)]
        self.pairs: dict[int, bool] = {}
        #: Neighbouring characters that some token holds; no token reaches over any others.
        self.joints = {s[i : i + 2] for s in self.ids for i in range(len(s) - 1)}
        self.known = _Entries(self)

    def merge(self, text: str) -> tuple[list[int], tuple[int, int]]:
        """Merging as defined: the best-scored pair first, the leftmost of equals. Also the last merge's two sides."""
        parts: list[str | None] = list(text)
        n = len(parts)
        left, right = list(range(-1, n - 1)), list(range(1, n + 1))
        queue: list[tuple[float, int, str, int]] = []
        last = (-1, -1)

        def offer(a: int, b: int) -> None:
            if a >= 0 and b < n and (i := self.ids.get(both := parts[a] + parts[b])) is not None:
                heapq.heappush(queue, (-self.score[i], a, both, b))

        for k in range(n - 1):
            offer(k, k + 1)
        while queue:
            _, a, both, b = heapq.heappop(queue)
            if parts[a] is None or parts[b] is None or right[a] != b or parts[a] + parts[b] != both:
                continue
            last = (self.ids.get(parts[a], -1), self.ids.get(parts[b], -1))
            parts[a], parts[b] = both, None
            right[a] = right[b]
            if right[b] < n:
                left[right[b]] = a
            offer(left[a], a)
            offer(a, right[a])
        out: list[int] = []
        for p in parts:
            if p is not None:
                out += [self.ids[p]] if p in self.ids else [self.bytes[x] for x in p.encode()]
        return out, last

    def compatible(self, a: int, b: int) -> bool:
        """Whether merging the text of both leaves ``a, b``: their last merges are undone, the latest first, and no pair that faces the border may have merged before."""
        key = a << 20 | b
        if (known := self.pairs.get(key)) is not None:
            return known
        rank, ids, surface, split = self.rank, self.ids, self.surface, self.split
        x, y, limit, ok = a, b, 1 << 30, True
        while True:
            joint = ids.get(surface[x] + surface[y])
            if joint is not None and rank[joint] < limit:
                ok = False
                break
            rx, ry = rank[x], rank[y]
            if rx < 0 and ry < 0:
                break
            if rx > ry:
                limit, x = rx, split[x][1]
            else:
                limit, y = ry + 1, split[y][0]
        if len(self.pairs) >= CACHE_PAIRS:
            self.pairs.clear()
        self.pairs[key] = ok
        return ok

    def _backtrack(self, text: str) -> list[int]:
        """Ids of a text whose characters are all in the vocabulary."""
        if (whole := self.ids.get(text)) is not None and (whole in self.split or len(text) == 1):
            return [whole]
        n = len(text)
        longest: list[Match | None] = [None] * n
        for end, match in self.auto.iter(text):
            longest[end + 1 - match[0]] = match  # the last one met at a place is its longest
        pairs, shorter = self.pairs, self.shorter
        failed = bytearray(n + 1)
        out: list[int] = []
        sizes: list[int] = []
        pos, last, match = 0, -1, longest[0]
        while pos < n:
            while match is not None:
                size, token = match
                if not failed[pos + size]:
                    if last < 0:
                        break
                    ok = pairs.get(last << 20 | token)
                    if ok or ok is None and self.compatible(last, token):
                        break
                match = shorter[token]
            if match is None:
                failed[pos] = 1
                token = out.pop()
                pos -= sizes.pop()
                last = out[-1] if out else -1
                match = shorter[token]
            else:
                out.append(token)
                sizes.append(size)
                pos += size
                last = token
                match = longest[pos] if pos < n else None
        return out

    def entry(self, piece: str) -> Entry:
        """The entry of a piece, from those of its parts between which no token reaches."""
        if not piece.startswith(SPACE * 2):
            joints = self.joints
            cuts = [i for i in range(1, len(piece)) if piece[i - 1 : i + 1] not in joints]
            if cuts:
                parts = [self.known[piece[a:b]] for a, b in zip([0, *cuts], [*cuts, len(piece)], strict=True)]
                return ",".join([e[0] for e in parts]), sum([e[1] for e in parts]), "".join([e[2] for e in parts])
        ids = self._backtrack(piece) if len(piece) > 1 and self.chars.issuperset(piece) and piece[1] != SPACE else self.ids_of(piece)
        digits = self.digits
        return ",".join([digits[i] for i in ids]), len(ids), self.text_of(ids)

    def ids_of(self, piece: str) -> list[int]:
        """Ids of a piece of text that no token reaches over."""
        if piece.startswith(SPACE * 2):
            return self.merge(piece)[0]
        if self.chars.issuperset(piece):
            return self._backtrack(piece)
        out: list[int] = []
        for known, part in _runs(piece, self.chars):
            out += self._backtrack(part) if known else [self.bytes[x] for x in part.encode()]
        return out

    def text_of(self, ids: list[int]) -> str:
        """The library's decoding, without the removal of the dummy prefix."""
        spelled = [self.spelled[i] for i in ids]
        if None not in spelled:
            return "".join(spelled)
        out, raw = [], bytearray()
        for i in ids:
            if self.kind[i] == _BYTE:
                raw.append(int(self.surface[i][3:5], 16))
                continue
            if raw:
                out.append(raw.decode(errors="replace"))
                raw.clear()
            if self.kind[i] == _NORMAL:
                out.append(self.spelled[i])
        if raw:
            out.append(raw.decode(errors="replace"))
        return "".join(out)

    def parts(self, text: str) -> list[str]:
        """Pieces of the prepared text that no token reaches over: before each run of spaces, and around line ends."""
        if not text:
            return []
        ready = SPACE + text.replace(" ", SPACE)
        if SPACE * 2 in ready:
            return _SPACED.findall(ready)
        return ready.replace(SPACE, f" {SPACE}").replace("\n", " \n ").split(" ")

    def entries(self, text: str) -> list[Entry]:
        """Of each piece of the text: ids joined by commas, their number, decoded text."""
        return [e for e in map(self.known.__getitem__, self.parts(text)) if e[1]]

    def encode(self, text: str | None) -> list[int]:
        return [int(i) for e in self.entries(text or "") for i in e[0].split(",")]

    def decode(self, ids: list[int]) -> str:
        text = self.text_of(ids)
        return text[1:] if text.startswith(" ") else text


def _runs(text: str, chars: set[str]):
    start = 0
    for i in range(1, len(text) + 1):
        if i == len(text) or (text[i] in chars) != (text[start] in chars):
            yield text[start] in chars, text[start:i]
            start = i


_loaded: dict[str, Vocabulary] = {}


def vocabulary(path: str) -> Vocabulary:
    """Loaded once in each worker process."""
    if path not in _loaded:
        _loaded.clear()
        _loaded[path] = Vocabulary(path)
    return _loaded[path]


def encoded(text: Column, model_path: str) -> Column:
    """Ids of the text as ``array<int>``; null and empty texts give an empty array."""

    @F.arrow_udf("array<int>")
    def udf(texts: pa.Array) -> pa.Array:
        v = vocabulary(model_path)
        return pa.array([v.encode(t.as_py()) for t in texts], pa.list_(pa.int32()))

    return udf(plain(text))


def decoded(ids: Column, model_path: str) -> Column:
    """Text of ``array<int>`` ids; a null array gives the empty text."""

    @F.arrow_udf("string")
    def udf(rows: pa.Array) -> pa.Array:
        v = vocabulary(model_path)
        return pa.array([v.decode(r.as_py() or []) for r in rows], pa.string())

    return udf(ids)


_DIGEST = pa.struct([("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])


def digest(docs: DataFrame, model_path: str) -> DataFrame:
    """Per document: number of ids, hash of the ids joined by commas, hash of the text decoded from them."""
    bound_batches(docs.sparkSession)

    @F.arrow_udf("n_tokens long, ids_sha256 string, decoded_sha256 string")
    def udf(texts: pa.Array) -> pa.Array:
        v, rows = vocabulary(model_path), []
        for at in range(0, len(texts), SLICE):
            for t in texts[at : at + SLICE].to_pylist():
                entries = v.entries(t or "")
                text = "".join([e[2] for e in entries])
                rows.append({
                    "n_tokens": sum([e[1] for e in entries]),
                    "ids_sha256": hashlib.sha256(",".join([e[0] for e in entries]).encode()).hexdigest(),
                    "decoded_sha256": hashlib.sha256((text[1:] if text.startswith(" ") else text).encode()).hexdigest(),
                })
        return pa.array(rows, _DIGEST)

    return docs.select("doc_id", udf(plain(F.col("text"))).alias("__d")).select("doc_id", "__d.*")
