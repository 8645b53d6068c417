"""Curation: exact copies, semantic links, changes, versions, statistics, registry."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.operators.graph import components
from corvane.storage import cut

#: Rows of a block of vectors, on average.
BLOCK_ROWS = 4096


def content_hash(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256)


def exact_copies(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``sha, doc_id, copies``: the smallest id of each text and how many rows have it."""
    return docs.groupBy(content_hash(F.col(text)).alias("sha")).agg(F.min(key).alias(key), F.count(F.lit(1)).alias("copies"))


def cross_source(docs: DataFrame) -> DataFrame:
    """Texts that come from several sources. Sources are reduced to one row each before the shuffle by text."""
    each = docs.groupBy(content_hash(F.col("text")).alias("sha"), "source").agg(F.count(F.lit(1)).alias("__n"))
    return each.groupBy("sha").agg(F.count(F.lit(1)).alias("n_sources"), F.sum("__n").alias("copies")).filter("n_sources > 1")


def delta(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """``key, status``: new, changed, unchanged or removed, by content hash; both tables have ``text``."""
    side = lambda df, name: df.select(F.col(key), content_hash(F.col("text")).alias(name))
    both = side(old, "__old").join(side(new, "__new"), key, "full_outer")
    status = F.when(F.col("__old").isNull(), "new").when(F.col("__new").isNull(), "removed").when(F.col("__old") == F.col("__new"), "unchanged").otherwise("changed")
    return both.select(key, status.alias("status"))


def stable_id(*parts: Column) -> Column:
    """An id in UUID form that the content gives."""
    h = F.sha2(F.concat_ws("␟", *parts).cast("binary"), 256)
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.substring(h, 13, 4), F.substring(h, 17, 4), F.substring(h, 21, 12))


def as_of(versions: DataFrame, key: str, order: str, at: Column) -> DataFrame:
    """The last version of each key that isn't later than ``at``."""
    rest = [c for c in versions.columns if c != key]
    return versions.filter(F.col(order) <= at).groupBy(key).agg(F.max_by(F.struct(*rest), order).alias("__v")).select(key, "__v.*")


def semantic_links(vectors: DataFrame, key: str, vector: str, at_least: float) -> DataFrame:
    """``key, n_links, class_id``: with how many other rows each row has a cosine (to six places) of ``at_least``, and the smallest key of its class.

    Rows are dealt into blocks; each unordered pair of blocks is one matrix product that returns, for each row of both, one
    count and the smallest key that it is linked to within the pair, directly or by others. So neither pairs nor a large
    group's links are ever rows of a table, and no link is lost to the classes. Every row meets every other: the work grows
    with the square of the table, since at any threshold that random vectors reach no hashing finds all links.
    """
    rows = vectors.filter(F.col(vector).isNotNull()).select(F.col(key).cast("long").alias("__id"), F.col(vector).cast("array<double>").alias("__v"))
    blocks = max(1, -(-rows.count() // BLOCK_ROWS))
    dealt = rows.withColumn("__a", F.pmod(F.xxhash64("__id"), F.lit(blocks)).cast("int"))
    left = dealt.withColumn("__b", F.explode(F.sequence(F.col("__a"), F.lit(blocks - 1))))
    right = dealt.select("__id", "__v", F.col("__a").alias("__b"), F.explode(F.sequence(F.lit(0), F.col("__a"))).alias("__a"))

    def unit(part: pd.DataFrame) -> np.ndarray:
        x = np.stack(part["__v"].to_list())
        return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)

    def linked(key: tuple, one: pd.DataFrame, other: pd.DataFrame) -> pd.DataFrame:
        if one.empty or other.empty:
            return pd.DataFrame({"id": [], "n": [], "root": []})
        ids, others = one["__id"].to_numpy(), other["__id"].to_numpy()
        y, most = unit(other).T, np.iinfo(np.int64).max
        near = np.concatenate([np.round(part @ y, 6) >= at_least for part in np.array_split(unit(one), max(1, len(one) // 1024))])
        same = near & (ids[:, None] == others[None])
        row, column = ids.copy(), np.where(near, ids[:, None], most).min(0)
        while True:  # labels go over to the columns and back until none falls
            new = np.minimum(row, np.where(near, np.minimum(column, others)[None], most).min(1))
            column = np.minimum(column, np.where(near, new[:, None], most).min(0))
            if np.array_equal(new, row):
                break
            row = new
        out = [pd.DataFrame({"id": ids, "n": near.sum(1) - same.sum(1), "root": row})]
        if key[0] != key[1]:
            out.append(pd.DataFrame({"id": others, "n": near.sum(0) - same.sum(0), "root": np.minimum(column, others)}))
        return pd.concat(out)

    found = cut(left.groupBy("__a", "__b").cogroup(right.groupBy("__a", "__b")).applyInPandas(linked, "id long, n long, root long"), "linked")
    classes = components(found.select(F.col("id").alias("a"), F.col("root").alias("b")))
    counts = found.groupBy("id").agg(F.sum("n").alias("n_links"))
    return counts.join(classes, F.col("id") == F.col("node")).select(F.col("id").alias(key), "n_links", F.col("root").alias("class_id"))
