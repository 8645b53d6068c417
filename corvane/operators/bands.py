"""Semantic near-duplicates by random-projection signatures in bands: links of high cosine without comparing every row with every other.

A signature has ``BITS * BANDS`` bits, the signs of random projections; two unit vectors at an angle ``t`` agree in a bit
with probability ``1 - t / pi``. Rows that agree in all ``BITS`` bits of one of the ``BANDS`` bands are compared exactly. With the
defaults a link at a cosine of exactly 0.9 is found with a probability of 0.94, one at 0.95 of 0.999; ``recall`` computes it for others. What is
compared is exact, so there are no false links.

Equal vectors are one row while links are sought, whatever their number. Most band values have a few vectors: these are compared run by run in sorted partitions. A band
value that many distinct vectors share is cut into blocks, and each pair of
blocks is one matrix product. Either way a row gets one count and one smallest key back: neither pairs nor a group's links are rows
of a table, and no large group meets in one task. A pair counts in the first band in which it agrees.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.operators.cells import usable
from corvane.operators.graph import components
from corvane.storage import batches_of, cut

BITS, BANDS = 16, 32
#: Rows of a block of one band value, on average; rows, and pairs of them, that are compared at once.
BLOCK_ROWS, RUN_ROWS, PAIRS = 2048, 4096, 1 << 16
SEED = 5


def recall(cosine: float, bits: int = BITS, bands: int = BANDS) -> float:
    """The probability that a link of that cosine is found."""
    return 1 - (1 - (1 - math.acos(min(1.0, cosine)) / math.pi) ** bits) ** bands


def unit(vectors: list) -> np.ndarray:
    x = np.stack([np.asarray(v, np.float64) for v in vectors])
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def signatures(x: np.ndarray, bits: int, bands: int) -> np.ndarray:
    """The value of each band, one row each; projections follow from the dimension alone."""
    directions = np.random.default_rng(SEED).normal(size=(x.shape[1], bits * bands))
    signs = (x @ directions > 0).reshape(len(x), bands, bits)
    return (signs << np.arange(bits)).sum(2)


def within_runs(rep: np.ndarray, band: np.ndarray, value: np.ndarray, n: np.ndarray, x: np.ndarray, values: np.ndarray, at_least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``id, n, root`` of rows in the order of band and value, each compared with the others of its run."""
    places, total, root = np.arange(len(rep)), np.zeros(len(rep)), rep.copy()
    start = np.flatnonzero(np.concatenate([[True], (band[1:] != band[:-1]) | (value[1:] != value[:-1])]))
    sizes = np.diff(np.append(start, len(rep)))
    after = np.repeat(start + sizes, sizes) - places - 1  # rows of the run behind each
    part = (np.cumsum(after) - after) // PAIRS
    for rows in np.split(places, np.flatnonzero(np.diff(part)) + 1):
        k = after[rows]
        i = np.repeat(rows, k)
        j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(k) - k, k)
        near = np.round((x[i] * x[j]).sum(1), 6) >= at_least
        i, j = i[near], j[near]
        earlier = ((values[i] == values[j]) & (np.arange(values.shape[1])[None] < band[i][:, None])).any(1)  # an earlier band has the pair
        i, j = i[~earlier], j[~earlier]
        total += np.bincount(i, weights=n[j], minlength=len(rep)) + np.bincount(j, weights=n[i], minlength=len(rep))
        np.minimum.at(root, i, rep[j])
        np.minimum.at(root, j, rep[i])
    found = total > 0
    return rep[found], total[found].astype(np.int64), root[found]


def _run_links(rows: DataFrame, at_least: float) -> DataFrame:
    """``id, n, root`` of ``rep, band, value, n, v, values``, whose runs of one band and value have a block's rows at most."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def compared(own: list[tuple]) -> Iterator[pa.RecordBatch]:
            for dim in sorted({len(r[4]) for r in own}):
                some = [r for r in own if len(r[4]) == dim]
                rep, band, value, n = (np.array(c, np.int64) for c in list(zip(*some, strict=True))[:4])
                found = within_runs(rep, band, value, n, unit([r[4] for r in some]), np.array([r[5] for r in some], np.int64), at_least)
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in found], ["id", "n", "root"])

        for batch in batches:
            held += zip(*(c.to_pylist() for c in batch.columns), strict=True)
            if len(held) >= RUN_ROWS:
                last = next((k for k in range(len(held) - 1, 0, -1) if held[k - 1][1:3] != held[k][1:3]), 0)
                if last:
                    yield from compared(held[:last])
                    held = held[last:]
        if held:
            yield from compared(held)

    sorted_rows = rows.select("rep", "band", "value", "n", "v", "values").repartition("band", "value").sortWithinPartitions("band", "value")
    return sorted_rows.mapInArrow(each, "id long, n long, root long")


def banded_links(vectors: DataFrame, key: str, vector: str, at_least: float = 0.9, bits: int = BITS, bands: int = BANDS) -> DataFrame:
    """``key, n_links, class_id`` as ``curation.semantic_links`` gives them, for links that share a band.

    Rows whose vector is null, zero or not finite have no links and are a class of their own; rows of one dimension are compared.
    """
    rows = cut(vectors.filter(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("id"), F.when(usable(F.col(vector)), F.col(vector).cast("array<double>")).alias("v")), "rows")
    same = rows.filter("v IS NOT NULL").groupBy("v").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("n"))

    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(0).to_pylist()
            values = np.zeros((len(lists), bands), np.int64)
            for dim in {len(v) for v in lists}:
                at = np.array([i for i, v in enumerate(lists) if len(v) == dim])
                values[at] = signatures(unit([lists[i] for i in at]), bits, bands) + (dim << bits)  # vectors of other dimensions never meet
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.ListArray.from_arrays(np.arange(len(lists) + 1, dtype=np.int32) * bands, pa.array(values.ravel()))], ["v", "rep", "n", "values"])

    distinct = cut(same.mapInArrow(signed, "v array<double>, rep long, n long, values array<long>"), "signatures")
    keys = distinct.select("rep", F.posexplode("values").alias("band", "value"))
    groups = cut(keys.groupBy(F.col("band").alias("__band"), F.col("value").alias("__value")).agg(F.ceil(F.count(F.lit(1)) / BLOCK_ROWS).alias("blocks"), F.count(F.lit(1)).alias("__n")).filter("__n > 1").drop("__n"), "groups")
    members = keys.join(groups, (F.col("band") == F.col("__band")) & (F.col("value") == F.col("__value"))).select("rep", "band", "value", "blocks", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int").alias("own"))
    every = members.join(distinct.withColumnRenamed("rep", "__rep"), F.col("rep") == F.col("__rep")).drop("__rep")
    met = every.filter("blocks > 1")
    left = met.withColumn("other", F.explode(F.sequence(F.col("own"), (F.col("blocks") - 1).cast("int")))).withColumnRenamed("own", "a").withColumnRenamed("other", "b")
    right = met.withColumnRenamed("own", "b").withColumn("a", F.explode(F.sequence(F.lit(0), F.col("b"))))
    right = right.select(*(F.col(c).alias(c) for c in left.columns))  # columns of its own

    def linked(key: tuple, one: pd.DataFrame, other: pd.DataFrame) -> pd.DataFrame:
        if one.empty or other.empty:
            return pd.DataFrame({"id": [], "n": [], "root": []})
        band, same_block = key[0], key[2] == key[3]
        ids, others = one["rep"].to_numpy(), other["rep"].to_numpy()
        mine, theirs = np.stack(one["values"].to_list()), np.stack(other["values"].to_list())
        y, counts = unit(other["v"].to_list()).T, other["n"].to_numpy()
        x, n, column_n, column_root = unit(one["v"].to_list()), np.zeros(len(ids), np.int64), np.zeros(len(others), np.int64), others.copy()
        root = ids.copy()
        for at in range(0, len(ids), 512):
            i, j = np.nonzero(np.round(x[at : at + 512] @ y, 6) >= at_least)
            i = i + at
            new = (ids[i] != others[j]) & ~(mine[i, :band] == theirs[j, :band]).any(1)  # else an earlier band has the pair
            i, j = i[new], j[new]
            n += np.bincount(i, weights=counts[j], minlength=len(ids)).astype(np.int64)
            np.minimum.at(root, i, others[j])
            if not same_block:
                column_n += np.bincount(j, weights=one["n"].to_numpy()[i], minlength=len(others)).astype(np.int64)
                np.minimum.at(column_root, j, ids[i])
        out = [pd.DataFrame({"id": ids, "n": n, "root": root})] + ([] if same_block else [pd.DataFrame({"id": others, "n": column_n, "root": column_root})])
        out = pd.concat(out)
        return out[out["n"] > 0]

    group = ["band", "value", "a", "b"]
    blocked = left.groupBy(*group).cogroup(right.groupBy(*group)).applyInPandas(linked, "id long, n long, root long")
    with batches_of(rows.sparkSession, 1024):
        found = cut(_run_links(every.filter("blocks = 1"), at_least).unionByName(blocked), "linked")
    classes = components(found.select(F.col("id").alias("a"), F.col("root").alias("b")).distinct())
    counts = found.groupBy("id").agg(F.sum("n").alias("links"))
    of = cut(distinct.select("v", "rep", "n").join(counts, F.col("rep") == F.col("id"), "left").drop("id").join(classes, F.col("rep") == F.col("node"), "left").select(F.col("v").alias("__v"), (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("links"), F.coalesce("root", "rep").alias("root")), "classes")
    out = rows.join(of, F.col("v") == F.col("__v"), "left")
    return out.select(F.col("id").alias(key), F.coalesce("links", F.lit(0).cast("long")).alias("n_links"), F.coalesce("root", "id").alias("class_id"))
