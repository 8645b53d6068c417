"""Approximate nearest neighbours by multi-index hashing of learned binary codes.

Codes: vectors are brought to one length (a coordinate more makes up for what a
vector lacks to the longest one, so that the largest inner product is the
smallest angle). A bounded sample gives a mean and, by alternating least
squares, several rotations that lose least when coordinates become signs; each
rotation gives one bit for each dimension.

Index: a code is cut into substrings of 16 bits; in each block of rows every
substring has a table from value to rows. Search: if two codes differ in at
most ``R = m * a + b`` of all bits, some of the first ``b + 1`` of the ``m``
substrings differ in at most ``a`` bits or some other in at most ``a - 1``
(pigeonhole), so probing those values retrieves every code within the radius
``R``; the codes found are compared, and those within the radius are reranked by
inner product of the original vectors.

Radius: how far codes lie apart is measured, by cosine, on pairs of the sample. A
query's ``k``-th best inner product within the sample bounds that of its ``k``
nearest from below; its radius is the one within which all but ``MISSED`` of the
pairs of that cosine lie. Smaller radii are tried before, and end the search of a
block that has ``k`` rows so near. So the radius follows from the codes and the data and
not from the table's size, and the share of the ``k`` nearest that is missed
stays below ``MISSED``. Near neighbours that stand out give small radii, which few
rows are within; among vectors without any structure a radius that reaches the
nearest takes in a few per cent of all rows, and pigeonhole probing can't pass
over many more.

Rows and queries are dealt into blocks of bounded size by a hash of the id, and
each pair of blocks is one task: no block grows with the data, a vector that
many rows share only adds rows to each block, and each task returns at most
``k`` rows a query.

Defined results: vectors that are null, empty, zero, of another dimension than
the commonest in the sample, or hold null or non-finite components take no part;
of rows with one id the first by vector counts; ties go to the smaller id; with
fewer than ``k`` candidates all are returned; empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows that the codes are learned from and radii are measured on, at most, and bytes of them; and of them those that are paired with all others.
SAMPLE_ROWS, SAMPLE_BYTES, PAIRED_ROWS = 10_000, 64 << 20, 500
BITS, SUBSTRING = 512, 16
#: Share of the ``k`` nearest that a radius may miss.
MISSED = 0.02
#: Rows of a block of the index and of queries, at most on average; at least so many blocks, for parallel work.
BLOCK_ROWS, QUERY_ROWS, LEAST_BLOCKS, LEAST_ROWS = 65_536, 32_768, 16, 8192
#: Steps of cosine that distances are measured in, and pairs that a step needs to be judged by itself.
STEP, LEAST_PAIRS = 0.01, 100

_VALUES = np.arange(1 << SUBSTRING, dtype=np.uint16)
_BY_DISTANCE = np.argsort(np.bitwise_count(_VALUES), kind="stable").astype(np.uint16)
_WITHIN = np.cumsum(np.bincount(np.bitwise_count(_VALUES), minlength=SUBSTRING + 1))


def lengths(x: np.ndarray) -> np.ndarray:
    """Euclidean lengths, without overflow."""
    most = np.abs(x).max(1, initial=0.0, keepdims=True)
    return most[:, 0] * np.sqrt(((x / np.where(most > 0, most, 1)) ** 2).sum(1))


@dataclass
class Codes:
    longest: float
    mean: np.ndarray
    rotations: np.ndarray
    #: By step of cosine, from -1 on, the distance within which all but a share of the pairs lie.
    radii: np.ndarray

    def level(self, x: np.ndarray, query: bool = False) -> np.ndarray:
        """Unit vectors of one dimension more; queries have none of it."""
        x = x / (lengths(x)[:, None] if query else self.longest)
        more = np.zeros(len(x)) if query else np.sqrt(np.maximum(0.0, 1 - (x**2).sum(1)))
        return np.hstack([x, more[:, None]])

    def encode(self, x: np.ndarray, query: bool = False) -> np.ndarray:
        """Codes as 64-bit words, one row each."""
        return np.packbits((self.level(x, query) - self.mean) @ self.rotations > 0, axis=1, bitorder="little").view(np.uint64)

    def radius(self, cosine: np.ndarray) -> np.ndarray:
        """The radius for a cosine; all bits where there is no bound."""
        step = np.floor((np.maximum(cosine, -1.0) + 1) / STEP).astype(np.int64)
        return np.where(np.isfinite(cosine), self.radii[np.clip(step, 0, len(self.radii) - 1)], self.rotations.shape[1])


def _rotations(x: np.ndarray, bits: int, rounds: int, seed: int) -> np.ndarray:
    """Columns of rotations whose signs lose least."""
    dim, rng, out = x.shape[1], np.random.default_rng(seed), []
    for _ in range(-(-bits // dim)):
        r = np.linalg.qr(rng.normal(size=(dim, dim)))[0]
        for _ in range(rounds):
            u, _, w = np.linalg.svd(np.sign(x @ r).T @ x)
            r = (u @ w).T
        out.append(r)
    return np.hstack(out)[:, :bits]


def learn(sample: np.ndarray, longest: float, bits: int = BITS, missed: float = MISSED, rounds: int = 15, seed: int = 7) -> Codes:
    """Codes of ``bits`` bits, a multiple of 64, and their radii."""
    codes = Codes(longest, np.zeros(0), np.zeros(0), np.zeros(0))
    x = np.unique(codes.level(sample), axis=0)
    codes.mean = x.mean(0)
    codes.rotations = _rotations(x - codes.mean, bits, rounds, seed)
    some = np.random.default_rng(seed).permutation(len(sample))[:PAIRED_ROWS]
    own = codes.encode(sample)
    cosine = codes.level(sample[some], True) @ codes.level(sample).T
    apart = np.stack([np.bitwise_count(own ^ q).sum(1, dtype=np.int64) for q in codes.encode(sample[some], True)])
    cosine[np.arange(len(some)), some] = np.nan  # a row isn't its own neighbour
    step, apart = np.floor((cosine[~np.isnan(cosine)] + 1) / STEP).astype(np.int64), apart[~np.isnan(cosine)]
    # from the widest angles on; a step of few pairs takes over the radius of the one before, which is larger
    radii, last = np.full(int(2 / STEP) + 1, bits), bits
    order = np.argsort(step, kind="stable")
    edge = np.searchsorted(step[order], np.arange(len(radii) + 1))
    for s in range(len(radii)):
        pairs = apart[order[edge[s] : edge[s + 1]]]
        if len(pairs) >= LEAST_PAIRS:
            last = min(last, int(np.ceil(np.quantile(pairs, 1 - missed))))
        radii[s] = last
    codes.radii = radii
    return codes


class Block:
    """The tables of one block, from the value of each substring to rows."""

    def __init__(self, codes: np.ndarray):
        self.codes, self.n = codes, len(codes)
        self.parts = np.ascontiguousarray(codes.view(np.uint16).T)
        self.m = len(self.parts)
        self.order = [np.argsort(p, kind="stable").astype(np.int32) for p in self.parts]
        self.bounds = [np.concatenate([[0], np.cumsum(np.bincount(p, minlength=1 << SUBSTRING))]).astype(np.int32) for p in self.parts]

    def probe(self, s: int, value: int, radius: int) -> np.ndarray:
        """Rows whose substring ``s`` differs from ``value`` in at most ``radius`` bits; where these are more values than there are rows, rows are looked through."""
        if not radius:
            return self.order[s][self.bounds[s][value] : self.bounds[s][value + 1]]
        if _WITHIN[min(radius, SUBSTRING)] > self.n:
            return np.flatnonzero(np.bitwise_count(self.parts[s] ^ np.uint16(value)) <= radius)
        values = _BY_DISTANCE[: _WITHIN[min(radius, SUBSTRING)]] ^ np.uint16(value)
        begin, end = self.bounds[s][values], self.bounds[s][values.astype(np.int64) + 1]
        some = end > begin
        begin, n = begin[some], (end - begin)[some]
        at = np.arange(int(n.sum())) + np.repeat(begin - np.cumsum(n) + n, n)
        return self.order[s][at]

    def within(self, code: np.ndarray, radius: int) -> tuple[np.ndarray, int]:
        """All rows whose code differs in at most ``radius`` bits, and how many codes were compared for it.

        Once more than half of all rows are hit, comparing the rest as well costs less than probing on; it finds the same.
        """
        a, b = divmod(radius, self.m)
        hit, own = np.zeros(self.n, bool), code.view(np.uint16)
        for s in range(self.m):
            r = a if s <= b else a - 1
            if r >= 0:
                hit[self.probe(s, int(own[s]), r)] = True
                if 2 * np.count_nonzero(hit) > self.n:
                    hit[:] = True
                    break
        rows = np.flatnonzero(hit)
        return rows[np.bitwise_count(self.codes[rows] ^ code).sum(1, dtype=np.int64) <= radius], len(rows)


def floors(sample_ids: np.ndarray, sample: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, k: int) -> np.ndarray:
    """Of each query the ``k``-th best inner product within the sample, its own row left out; minus infinity with fewer rows."""
    out = np.full(len(queries), -np.inf)
    for at in range(0, len(queries), 256):
        near = queries[at : at + 256] @ sample.T
        near[query_ids[at : at + 256, None] == sample_ids[None]] = -np.inf
        if near.shape[1] >= k:
            out[at : at + 256] = -np.partition(-near, k - 1, axis=1)[:, k - 1]
    return out


def search_block(index_ids: np.ndarray, index: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, codes: Codes, floor: np.ndarray, k: int, at_least: int = 0, tally: list | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The nearest rows that the block gives to each query: query ids, row ids, scores.

    A radius that gives a query fewer than ``at_least`` rows is widened. ``tally`` gets the numbers of rows compared and reranked.
    """
    block, query_codes = Block(codes.encode(index)), codes.encode(queries, True)
    scale = lengths(queries) * codes.longest
    radii = codes.radius(floor / scale)
    # from the smallest radius that was measured on, four times as far while that stays below half the query's own
    first = max(1, int(codes.radii[-1])) << np.arange(0, 10, 2)
    found: list[tuple[np.ndarray, ...]] = []
    for q, x, code, size, radius, bound in zip(query_ids, queries, query_codes, scale, radii, floor, strict=True):
        steps = [*first[2 * first <= radius].tolist(), int(radius)]
        while steps:
            r = steps.pop(0)
            rows, compared = block.within(code, r)
            if tally is not None:
                tally.append((compared, len(rows)))
            rows = rows[index_ids[rows] != q]
            near, least = index[rows] @ x, -np.inf
            if len(rows) >= k:
                least = np.partition(near, len(near) - k)[len(near) - k]
                if codes.radius(np.array([max(bound, least) / size]))[0] <= r:
                    break
            if not steps and len(rows) < at_least and r < codes.rotations.shape[1]:
                steps.append(r + r // 8 + 8)
        if len(rows) > k:  # the fast product finds what may be among the nearest; that is then summed in one fixed order
            rows = rows[near >= least - 1e-9 * max(1.0, abs(least))]
        exact = (index[rows] * x).sum(1)
        best = np.lexsort((index_ids[rows], -exact))[:k]
        found.append((np.full(len(best), q), index_ids[rows[best]], exact[best]))
    return tuple(np.concatenate(c) for c in zip(*found, strict=True)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))


def usable(vector: Column, dim: int | None = None) -> Column:
    """Whether a vector takes part."""
    fine = (F.size(vector) > 0) & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(vector, lambda x: x != 0)
    return F.coalesce(fine if dim is None else fine & (F.size(vector) == dim), F.lit(False))


def _stack(ids: np.ndarray, vectors: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids and vectors, sorted by id, and their places; of rows with one id the first by vector."""
    ids, x = np.asarray(ids, np.int64), np.stack(vectors).astype(np.float64)
    order = np.lexsort((*x.T[::-1], ids))
    order = order[np.concatenate([[True], ids[order][1:] != ids[order][:-1]])]
    return ids[order], x[order], order


FOUND = "query_id long, vec_id long, score double"


def search(vectors: DataFrame, queries: DataFrame, k: int = 20, sample_rows: int = SAMPLE_ROWS, bits: int = BITS, missed: float = MISSED) -> DataFrame:
    """The ``k`` nearest rows found for each query: ``query_id, rank, vec_id, score``.

    Both tables have ``vec_id`` and ``embedding``; a row with the query's own id is no candidate. At least ``1 - missed``
    of the nearest are found, as far as the sample can tell.
    """
    pick = lambda df, dim=None: df.filter(usable(F.col("embedding"), dim) & F.col("vec_id").isNotNull()).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").alias("__v"))
    spark = vectors.sparkSession
    widest = pick(vectors).agg(F.max(F.size("__v"))).first()[0] or 1
    sample_rows = max(1, min(sample_rows, SAMPLE_BYTES // (8 * widest)))
    taken = pick(vectors).orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample_rows).collect()
    if not taken:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if len(taken) == sample_rows:  # rows of the last id may have been cut off
        taken = [r for r in taken if r["vec_id"] != taken[-1]["vec_id"]] or taken[:1]
    sizes = [len(r["__v"]) for r in taken]
    dim = max(set(sizes), key=lambda n: (sizes.count(n), n))
    *sample, _ = _stack([r["vec_id"] for r in taken if len(r["__v"]) == dim], [r["__v"] for r in taken if len(r["__v"]) == dim])
    rows, asked = pick(vectors, dim), pick(queries, dim)
    most = F.array_max(F.transform("__v", lambda x: F.abs(x.cast("double"))))
    scaled = F.sqrt(F.aggregate("__v", F.lit(0.0), lambda t, x: t + (x / most) * (x / most)))
    n, longest = rows.agg(F.count(F.lit(1)), F.max(most * scaled)).first()
    codes = learn(sample[1], longest * (1 + 1e-12), bits, missed)
    blocks = max(-(-n // BLOCK_ROWS), min(LEAST_BLOCKS, -(-n // LEAST_ROWS)), 1)
    query_blocks = max(1, -(-asked.count() // QUERY_ROWS))
    shipped = spark.sparkContext.broadcast((codes, *sample))  # at most ``sample_rows`` vectors

    def bounded(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        _, ids, some = shipped.value
        for part in parts:
            if len(part):
                yield part.assign(__f=floors(ids, some, part["vec_id"].to_numpy(), np.stack(part["__v"].to_list()).astype(np.float64), k))

    def each(index: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        if index.empty or own.empty:
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        ids, x, _ = _stack(index["vec_id"].to_numpy(), index["__v"].to_list())
        query_ids, q, at = _stack(own["vec_id"].to_numpy(), own["__v"].to_list())
        found = search_block(ids, x, query_ids, q, shipped.value[0], own["__f"].to_numpy()[at], k, -(-k // blocks))
        return pd.DataFrame(dict(zip(("query_id", "vec_id", "score"), found, strict=True)))

    deal = lambda df, n_own, own, n_other, other: df.withColumn(own, F.pmod(F.xxhash64("vec_id"), F.lit(n_own)).cast("int")).withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(n_other - 1))))
    left = deal(rows, blocks, "__b", query_blocks, "__q").groupBy("__b", "__q")
    asked = asked.mapInPandas(bounded, T.StructType([*asked.schema.fields, T.StructField("__f", T.DoubleType())]))
    right = deal(asked, query_blocks, "__q", blocks, "__b").groupBy("__b", "__q")
    found = left.cogroup(right).applyInPandas(each, FOUND)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
