"""Near-duplicate documents by DartMinHash and banded joining.

A document is the weighted set of its runs of five words, each weighted by how
often it occurs. Similarity is the weighted Jaccard similarity of these sets.

Signature: darts are thrown, by hashing, into regions (element, weight, rank)
of one unit of area each. A document is hit by the darts below its weights; it
looks only at ranks below a bound that yields about ``k ln k + 2k`` hits, deals
the hits to ``k`` coordinates and keeps the earliest dart of each. If a
coordinate stays empty, the bound is doubled. Two documents agree in a
coordinate with a probability equal to their similarity.

Joining: copies with equal words are first reduced to one, known by a hash of
its words, so that neither a missing id nor one id of several texts matters. The coordinates are cut into bands; documents that share a band
are candidates. No band's pairs are all made: each member is linked with the
band's hub, the member with most company; links are verified on the exact
sets, and components are formed. Only where a band still holds several
components are pairs across components compared, if their sketches agree enough
and if the weight that they can share at all allows the similarity (``_across``). So
every pair that shares a band ends in one component, has been compared or is
ruled out, and large groups of copies cost a link for each member.

Defined results: null texts count as empty; texts with equal words (empty ones
too) are copies of one another; texts of fewer than five words have no other
near-duplicates; repeated rows share their class; rows whose id is null take
part, and name a class only if nothing else does; unrelated texts with one id
are classes of their own, even if that id names both; an empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import itertools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvane.llm.common import batches_of, bound_batches, cut, plain, small
from corvane.operators.graph import components

WORDS = 5
SIMILARITY = 0.8
BANDS, ROWS = 36, 7
COORDINATES = BANDS * ROWS
#: Coordinates of the finer sketches that pairs across components are chosen by.
FINE_COORDINATES = 1024
SLICE = 32
#: Rows that a worker is handed at once: some megabytes of texts or of weighted sets.
BATCH = 512
#: Distinct words whose hash a worker keeps; beyond it the table is begun anew.
CACHE_WORDS = 60_000

_U = np.uint64
_EMPTY = _U(0xFFFFFFFFFFFFFFFF)
_POISSON = np.cumsum(np.exp(-1.0) / np.cumprod([1.0, *range(1, 13)]))


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads each bit over all others."""
    x = x ^ (x >> _U(32))
    x = x * _U(0xD6E8FEB86659FD93)
    x = x ^ (x >> _U(32))
    x = x * _U(0xD6E8FEB86659FD93)
    return x ^ (x >> _U(32))


class _Hashes(dict):
    def __missing__(self, word: str) -> int:
        value = xxhash.xxh3_64_intdigest(word)
        if len(word) <= 64:
            if len(self) >= CACHE_WORDS:
                self.clear()
            self[word] = value
        return value


_hashes = _Hashes()


def elements(words: list[list[str]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of all texts: text number, hash and count of each distinct run of five words, ordered by text and hash."""
    sizes = np.array([len(w) for w in words], np.int64)
    n = int(sizes.sum())
    h = np.fromiter(map(_hashes.__getitem__, itertools.chain.from_iterable(words)), np.uint64, n)
    own = np.repeat(np.arange(len(words)), sizes)
    if n < WORDS:
        return own[:0], h[:0], own[:0]
    run = np.zeros(n - WORDS + 1, np.uint64)
    for i in range(WORDS):
        run = run * _U(0x9E3779B97F4A7C15) + h[i : i + len(run)]
    whole = own[: len(run)] == own[WORDS - 1 :]
    run, own = _mix(run[whole]), own[: len(run)][whole]
    order = np.lexsort((run, own))
    run, own = run[order], own[order]
    first = np.flatnonzero(np.concatenate([[True], (run[1:] != run[:-1]) | (own[1:] != own[:-1])])) if len(run) else np.zeros(0, np.int64)
    return own[first], run[first], np.diff(np.concatenate([first, [len(run)]]))


def signatures(own: np.ndarray, element: np.ndarray, count: np.ndarray, texts: int, k: int = COORDINATES) -> np.ndarray:
    """``[texts, k]`` 64-bit numbers: of each coordinate the earliest dart, as its rank and a part of its hash. A text without elements keeps all bits set."""
    out = np.full((texts, k), _EMPTY)
    weight = np.bincount(own, weights=count, minlength=texts)
    bound = np.divide(k * np.log(k) + 2 * k, weight, out=np.zeros(texts), where=weight > 0)
    todo = weight > 0
    while todo.any():
        keep = todo[own]
        _throw(out, own[keep], element[keep], count[keep], bound, k)
        todo &= (out == _EMPTY).any(1)
        bound = bound * 2
    return out


def _throw(out: np.ndarray, own: np.ndarray, element: np.ndarray, count: np.ndarray, bound: np.ndarray, k: int) -> None:
    """Lower ``out`` to the darts that hit. Weights from ``2**level - 1`` on form a region ``2**level`` wide, cut into ranks of ``2**-level``."""
    level = 0
    while len(own):
        wide = float(1 << level)
        strips = np.ceil(bound[own] * wide).astype(np.int64)
        ends = np.cumsum(strips)
        at = np.repeat(np.arange(len(own)), strips)
        strip = np.arange(int(ends[-1])) - np.repeat(ends - strips, strips)
        cell = _mix(element[at] + strip.astype(np.uint64) * _U(0xA24BAED4963EE407) + _U((level * 0x9FB21C651E98DF25) & 0xFFFFFFFFFFFFFFFF))
        darts = np.searchsorted(_POISSON, (cell >> _U(11)).astype(np.float64) * 2.0**-53, side="right")
        cells = np.repeat(np.arange(len(cell)), darts)
        which = np.arange(len(cells)) - np.repeat(np.cumsum(darts) - darts, darts)
        dart = _mix(cell[cells] + (which.astype(np.uint64) + _U(1)) * _U(0x9E3779B97F4A7C15))
        place = _mix(dart ^ _U(0x94D049BB133111EB))
        text = own[at[cells]]
        rank = (strip[cells] + (dart >> _U(11)).astype(np.float64) * 2.0**-53) / wide
        hit = rank < bound[text]
        if level:
            hit &= (wide - 1) + wide * ((place >> _U(32)).astype(np.float64) * 2.0**-32) < count[at[cells]]
        text, rank, dart, place = text[hit], rank[hit], dart[hit], place[hit]
        packed = rank.astype(np.float32).view(np.uint32).astype(np.uint64) << _U(32) | dart & _U(0xFFFFFFFF)
        np.minimum.at(out.reshape(-1), text * k + (place & _U(0xFFFFFFFF)).astype(np.int64) % k, packed)
        level += 1
        more = count > (1 << level) - 1
        own, element, count = own[more], element[more], count[more]


def band_keys(sig: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """``[texts, bands]`` hashes, each of a band's coordinates and its number."""
    key = np.tile(np.arange(1, bands + 1, dtype=np.uint64), (len(sig), 1))
    for r in range(rows):
        key = _mix(key * _U(0x9E3779B97F4A7C15) + sig[:, r::rows][:, :bands])
    return key.view(np.int64)


def sketches(sig: np.ndarray) -> np.ndarray:
    """Two bits of each coordinate, 32 coordinates to a number."""
    bits = _mix(sig) & _U(3)
    n = -(-sig.shape[1] // 32)
    bits = np.pad(bits, ((0, 0), (0, 32 * n - sig.shape[1]))).reshape(len(sig), n, 32)
    return (bits << (_U(2) * np.arange(32, dtype=np.uint64))).sum(2, dtype=np.uint64).view(np.int64)


def similarity(a: bytes, b: bytes) -> float:
    """Weighted Jaccard similarity of two documents as ``weigh`` stores them."""
    (x, m), (y, n) = _unpack(a), _unpack(b)
    _, i, j = np.intersect1d(x, y, assume_unique=True, return_indices=True)
    both = int(np.minimum(m[i], n[j]).sum())
    either = int(m.sum() + n.sum()) - both
    return both / either if either else 1.0


def _pack(element: np.ndarray, count: np.ndarray) -> bytes:
    return element.astype("<u8").tobytes() + count.astype("<u4").tobytes()


def _unpack(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = len(data) // 12
    return np.frombuffer(data, "<u8", n), np.frombuffer(data, "<u4", n, 8 * n).astype(np.int64)


def _words(texts: list[str | None]) -> list[list[str]]:
    """Runs without ASCII white space."""
    return [list(filter(None, _BLANK.sub(" ", t or "").split(" "))) for t in texts]


_BLANK = re.compile(r"[\t-\r]")


def _copy(words: list[str]) -> int:
    """A 63-bit hash of a text's words."""
    return int.from_bytes(hashlib.md5(" ".join(words).encode()).digest()[:8], "little") >> 1


def signed(docs: DataFrame) -> DataFrame:
    """``doc_id, copy`` (a hash of the words), ``bands, sketch`` of each row; texts of fewer than five words have no bands."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                words = _words(part.column(1).to_pylist())
                sig = signatures(*elements(words), len(words))
                keys, marks = band_keys(sig), sketches(sig)
                short = [len(w) < WORDS for w in words]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        pa.array([_copy(w) for w in words], pa.int64()),
                        pa.array([[] if s else list(r) for s, r in zip(short, keys, strict=True)], pa.list_(pa.int64())),
                        pa.array([[] if s else list(r) for s, r in zip(short, marks, strict=True)], pa.list_(pa.int64())),
                    ],
                    ["doc_id", "copy", "bands", "sketch"],
                )
            pa.default_memory_pool().release_unused()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), plain(F.col("text")).alias("text")).mapInArrow(each, "doc_id long, copy long, bands array<long>, sketch array<long>")


def weigh(docs: DataFrame) -> DataFrame:
    """``id, weights``: the hash of each row's words, and its exact weighted set as bytes."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                words = _words(part.column(0).to_pylist())
                own, element, count = elements(words)
                edge = np.searchsorted(own, np.arange(part.num_rows + 1))
                packed = [_pack(element[i:j], count[i:j]) for i, j in zip(edge[:-1], edge[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array([_copy(w) for w in words], pa.int64()), pa.array(packed, pa.binary())], ["id", "weights"])
            pa.default_memory_pool().release_unused()

    return docs.select(plain(F.col("text")).alias("text")).mapInArrow(each, "id long, weights binary")


def _may_reach(a: str, b: str, at_least: float, coordinates: int) -> Column:
    """Whether two sketches (two bits a coordinate) agree as much as documents of that similarity do, less four standard deviations."""
    n = -(-coordinates // 32)
    differ = " + ".join(f"bit_count((({a}[{i}] ^ {b}[{i}]) | shiftrightunsigned({a}[{i}] ^ {b}[{i}], 1)) & 6148914691236517205L)" for i in range(n))
    share = at_least + (1 - at_least) / 4
    return F.expr(differ) <= int(coordinates * (1 - share) + 4 * (coordinates * share * (1 - share)) ** 0.5)


def verified(pairs: DataFrame, weights: DataFrame, at_least: float = SIMILARITY) -> DataFrame:
    """Pairs ``a, b`` whose exact similarity reaches ``at_least``."""

    @F.arrow_udf("double")
    def exact(x: pa.Array, y: pa.Array) -> pa.Array:
        return pa.array([similarity(p.as_py(), q.as_py()) for p, q in zip(x, y, strict=True)], pa.float64())

    both = pairs.join(weights.select(F.col("id").alias("b"), F.col("weights").alias("__y")), "b").join(weights.select(F.col("id").alias("a"), F.col("weights").alias("__x")), "a")
    return both.filter(exact("__x", "__y") >= at_least).select("a", "b")


def classes(docs: DataFrame, at_least: float = SIMILARITY, sketched: bool = True) -> DataFrame:
    """``doc_id, class_id`` of each row; a class is named by its smallest id.

    Without ``sketched``, pairs that share a band are compared whatever their sketches say.
    """
    with batches_of(docs.sparkSession, BATCH):
        return _classes(docs, at_least, sketched).select("doc_id", "class_id")


def _classes(docs: DataFrame, at_least: float, sketched: bool = True) -> DataFrame:
    """``doc_id, copy, root, class_id`` of each row; rows of one class have one ``root``."""
    rows = cut(signed(docs), "signed")
    reps = cut(rows.groupBy(F.col("copy").alias("rep")).agg(F.min("doc_id").alias("doc_id"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch")), "reps")
    exploded = reps.select("rep", F.explode("bands").alias("band"))
    # what is joined by band is written before, so that the join meets two plain tables and a band with many members can be split
    shared = cut(exploded.groupBy("band").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "shared", narrow=True)
    entries = cut(exploded.join(small(shared), "band"), "entries", narrow=True)
    company = entries.groupBy("rep").agg(F.sum("n").alias("company"))
    hubs = cut(entries.join(company, "rep").groupBy("band").agg(F.max_by("rep", F.struct("company", -F.col("rep"))).alias("hub")), "hubs", narrow=True)
    stars = entries.select("band", "rep").join(small(hubs), "band").filter("rep <> hub").select(F.least("rep", "hub").alias("a"), F.greatest("rep", "hub").alias("b")).distinct()
    sketch = lambda name: reps.select(F.col("rep").alias(name), F.col("sketch").alias(f"__{name}"))
    likely = stars.join(sketch("b"), "b").join(sketch("a"), "a").filter(_may_reach("__a", "__b", at_least, COORDINATES)).select("a", "b") if sketched else stars
    known = cut(entries.select(F.col("rep").alias("__rep")).distinct(), "known", narrow=True)
    ids = small(reps.join(known, F.col("rep") == F.col("__rep"), "left_semi").select(F.col("doc_id").alias("__id")).filter("__id IS NOT NULL").distinct())
    texts = docs.select("doc_id", "text").join(ids, F.col("doc_id") == F.col("__id"), "left_semi").unionByName(docs.select("doc_id", "text").filter("doc_id IS NULL"))
    weights = cut(weigh(texts).join(small(known), F.col("id") == F.col("__rep"), "left_semi").dropDuplicates(["id"]), "weights")
    edges = cut(verified(likely, weights, at_least), "links", narrow=True)
    labels = components(edges)
    placed = cut(entries.select("band", "rep").join(labels.select(F.col("node").alias("rep"), "root"), "rep", "left").withColumn("root", F.coalesce("root", "rep")), "placed", narrow=True)
    across = _across(placed, reps.select("rep", "bands"), weights, at_least, sketched)
    more = cut(verified(across, weights, at_least), "links", narrow=True)
    if more.limit(1).count():
        labels = components(edges.unionByName(more))
    linked = cut(labels.select(F.col("node").alias("rep"), "root").join(reps.select("rep", "doc_id"), "rep"), "linked", narrow=True)
    names = cut(linked.groupBy("root").agg(F.min("doc_id").alias("class_id")), "names", narrow=True)
    members = cut(linked.select("rep", "root").join(small(names), "root"), "members", narrow=True)  # only texts with near-duplicates
    named = reps.select("rep", "doc_id").join(small(members), "rep", "left")
    named = named.select(F.col("rep").alias("copy"), F.coalesce("root", "rep").alias("root"), F.when(F.col("root").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"))
    return rows.select("doc_id", "copy").join(named, "copy").select("doc_id", "copy", "root", "class_id")


def _own_weight(weights: DataFrame) -> DataFrame:
    """``id, size, common``: a document's total weight, and that of its elements which others of ``weights`` have too."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                element, count = _unpack(data)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(element), k)), pa.array(element.view(np.int64)), pa.array(count)], ["id", "element", "n"])

    rows = weights.select("id", "weights").mapInArrow(each, "id long, element long, n long")
    alone = rows.groupBy("element").agg(F.count(F.lit(1)).alias("docs"), F.min("id").alias("id"), F.min("n").alias("n")).filter("docs = 1")
    unshared = alone.groupBy("id").agg(F.sum("n").alias("alone"))
    total = rows.groupBy("id").agg(F.sum("n").alias("size"))
    return total.join(unshared, "id", "left").select("id", "size", (F.col("size") - F.coalesce("alone", F.lit(0))).alias("common"))


def _fine_sketches(weights: DataFrame) -> DataFrame:
    """``rep, fine``: sketches of ``FINE_COORDINATES``, of the few documents whose band isn't settled."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 8):
                part = batch.slice(at, 8)
                sets = [_unpack(d) for d in part.column(1).to_pylist()]
                own = np.repeat(np.arange(len(sets)), [len(e) for e, _ in sets])
                sig = signatures(own, np.concatenate([e for e, _ in sets]), np.concatenate([n for _, n in sets]), len(sets), FINE_COORDINATES)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(list(sketches(sig)), pa.list_(pa.int64()))], ["rep", "fine"])

    return weights.select("id", "weights").mapInArrow(each, "rep long, fine array<long>")


#: Sizes are compared in classes of two per cent.
SIZE_STEP = 1.02


def _across(placed: DataFrame, marks: DataFrame, weights: DataFrame, at_least: float, sketched: bool) -> DataFrame:
    """Pairs ``a, b`` of different components that share a band and may reach the similarity.

    Of two documents of weights ``s`` and ``t``, elements that no other document has can't be shared, so the shared weight is
    at most the smaller ``common``; it must be ``at_least / (1 + at_least)`` of ``s + t``. That bounds the sizes of a
    document's possible partners, and copies with edits of their own mostly have none. In each band all but the members of
    its largest component look for partners among those of the sizes in question. A pair that is asked from both sides is
    one pair after ``distinct``.
    """
    split = cut(placed.groupBy("band").agg(F.min("root").alias("__lo"), F.max("root").alias("__hi")).filter("__lo < __hi").select("band"), "split", narrow=True)
    inside = cut(placed.join(small(split), "band"), "open", narrow=True)
    reps = inside.select(F.col("rep").alias("id")).distinct()
    share = cut(_own_weight(weights.join(reps, "id", "left_semi")), "shares", narrow=True).filter(F.col("common") >= at_least * F.col("size") - 1e-9)
    able = weights.join(share.select("id"), "id", "left_semi")
    fine = cut(_fine_sketches(able), "fine", narrow=True)
    member = inside.join(share.select(F.col("id").alias("rep"), "size", "common"), "rep").join(marks, "rep").join(fine, "rep")
    member = cut(member.withColumn("step", F.floor(F.log("size") / float(np.log(SIZE_STEP))).cast("int")), "members", narrow=True)
    # written, so that the join by band meets two plain tables and a band with many members can be split
    largest = cut(member.groupBy("band", "root").agg(F.count(F.lit(1)).alias("n")).groupBy("band").agg(F.max_by("root", F.struct("n", "root")).alias("main")), "largest", narrow=True)
    step = lambda size: F.floor(F.log(size) / float(np.log(SIZE_STEP))).cast("int")
    least, most = at_least * F.col("size"), (1 + at_least) / at_least * F.col("common") - F.col("size")
    asking = member.join(small(largest), "band").filter((F.col("root") != F.col("main")) & (most >= least)).withColumn("asked", F.explode(F.sequence(step(least) - 1, step(most) + 1)))
    l, r = asking.alias("l"), member.alias("r")
    fits = F.least("l.common", "r.common") >= at_least / (1 + at_least) * (F.col("l.size") + F.col("r.size")) - 1e-6
    on = (F.col("l.band") == F.col("r.band")) & (F.col("l.asked") == F.col("r.step")) & (F.col("l.root") != F.col("r.root")) & fits
    if sketched:
        on = on & _may_reach("l.fine", "r.fine", at_least, FINE_COORDINATES)
    once = F.array_min(F.array_intersect("l.bands", "r.bands")) == F.col("l.band")  # only in the first band that both share
    return l.join(r, on & once).select(F.least("l.rep", "r.rep").alias("a"), F.greatest("l.rep", "r.rep").alias("b")).distinct()


@F.arrow_udf(T.LongType())
def _copies(text: pa.Array) -> pa.Array:
    return pa.array([_copy(w) for w in _words(text.to_pylist())], pa.int64())


def deduplicated(docs: DataFrame, at_least: float = SIMILARITY, sketched: bool = True) -> DataFrame:
    """One row of each class, that with the smallest id; columns as they were. Rows without an id stay.

    A row is known by its id and the hash of its words, as one id may have several texts.
    """
    with batches_of(docs.sparkSession, BATCH):
        found = cut(_classes(docs, at_least, sketched), "classes", narrow=True).filter("doc_id IS NOT NULL")
    each = cut(found.groupBy("root", "doc_id", "copy").agg(F.count(F.lit(1)).alias("n")), "each", narrow=True)
    first = cut(each.groupBy("root").agg(F.min(F.struct("doc_id", "copy", "n")).alias("first")), "first", narrow=True)
    keys = cut(each.join(small(first), "root").select(F.col("doc_id").alias("__id"), F.col("copy").alias("__of"), (F.struct("doc_id", "copy", "n") != F.col("first")).alias("gone"), "n"), "rows", narrow=True)
    gone, twice = (keys.filter(c).select("__id", "__of") for c in ("gone", "NOT gone AND n > 1"))
    bound_batches(docs.sparkSession, BATCH)
    out = docs.withColumn("__copy", _copies(plain(F.col("text"))))
    on = (F.col("doc_id") == F.col("__id")) & (F.col("__copy") == F.col("__of"))
    left = out.join(small(gone), on, "left_anti")
    if twice.limit(1).count():
        again = left.join(small(twice), on, "left_semi").dropDuplicates(["doc_id", "__copy"])
        left = left.join(small(twice), on, "left_anti").unionByName(again)
    return left.drop("__copy")
