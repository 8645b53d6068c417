"""Hard negatives by a two-dimensional block matrix product.

Components become integers, ``floor(scale * x)``, so that scores are exact. Rows
and anchors are dealt into blocks and vectors are cut into chunks of dimensions.
A panel is one block's share of a chunk. Each anchor panel meets each row panel of
the same chunk in a cell of its own, as in SUMMA; the cell's product is a partial
tile of 64-bit scores (sent in as few bytes as it needs). Partial tiles are
shuffled by their place and added over the chunks. From a whole tile only each
anchor's best are kept, and these are reduced over ``TILES_AT_ONCE`` tiles before
they leave the task.

Two such products are formed: anchors with the rows of their label give each
anchor's positives; anchors with all rows give, for each anchor and positive, the
best rows of other labels whose score lies in the window that the positive's
score sets. Rows meet the first product in groups of labels, and a label that many
rows have is split into blocks like any other group. The work is the product of
the numbers of anchors and rows, by definition; no block, tile or partition grows with either.

Defined results: rows with a null id or label, a null vector, or a null or
non-finite component take no part; rows of one id count once, the first by label
and vector; a shorter vector counts as padded with zeros; scores are exact within
64 bits and wrap beyond (components are cut to 2^62); ties go to the smaller id; an anchor
without rows of its label has no positives, and a negative positive score no negatives;
an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.llm.common import batches_of, cut, small

#: Rows and values of a row block, at most on average; anchors of an anchor block; anchors of a tile.
BLOCK_ROWS, BLOCK_VALUES, ANCHOR_ROWS, TILE_ANCHORS = 8192, 1 << 22, 1024, 64
#: Dimensions of a chunk at most, and chunks at least (each costs a shuffle of all tiles).
CHUNK_DIMS, LEAST_CHUNKS = 512, 2
#: Row blocks whose tiles are reduced in one place.
TILES_AT_ONCE = 8
#: Cells, or tiles, that a worker is handed at once.
CELLS_AT_ONCE = 4

_I8 = np.dtype("<i8")


def _pack(x: np.ndarray) -> bytes:
    """Integers in as few bytes as the largest needs, which the first byte tells."""
    low, high = int(x.min(initial=0)), int(x.max(initial=0))
    width = next(w for w in (1, 2, 4, 8) if -(1 << (8 * w - 1)) <= low and high < 1 << (8 * w - 1))
    return bytes([width]) + x.astype(f"<i{width}").tobytes()


def _unpack(data: bytes) -> np.ndarray:
    return np.frombuffer(data, f"<i{data[0]}", offset=1).astype(np.int64)


def whole(vectors: np.ndarray, scale: float) -> np.ndarray:
    """Components as integers."""
    x = np.floor(scale * vectors.astype(np.float64))
    return np.clip(x, -(2.0**62), 2.0**62).astype(np.int64)


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``a @ b.T`` of integers; through floats where no sum can leave the range in which they are exact."""
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1]
    return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64) if most < 2.0**53 else a @ b.T


def top(scores: np.ndarray, allowed: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` largest among the allowed; of equal ones the first."""
    at = np.flatnonzero(allowed)
    if len(at) <= k:
        return at
    own = scores[at]
    least = np.partition(own, len(own) - k)[len(own) - k]
    above = at[own > least]
    return np.concatenate([above, at[own == least][: k - len(above)]])


PANEL = "g long, own int, n_own int, n_other int, chunk int, ids binary, labels binary, wanted binary, data binary"


def _panels(rows: DataFrame, dim: int, chunks: int, scale: float) -> DataFrame:
    """``PANEL`` rows: a block's ids (in order), labels, what each asks for, and its share of each chunk.

    ``rows`` has ``g, own, n_own, n_other, vec_id, label, v, positive_ids, positive_scores``.
    """
    edges = [dim * c // chunks for c in range(chunks + 1)]

    def each(key: tuple, block: pa.Table) -> pa.Table:
        block = block.take(np.argsort(block["vec_id"].to_numpy(), kind="stable")).combine_chunks()
        lists = block["v"].combine_chunks()
        sizes = np.diff(lists.offsets.to_numpy())
        flat = lists.flatten().to_numpy(zero_copy_only=False)
        x = np.zeros((len(sizes), dim), np.int64)
        x[np.arange(dim)[None] < sizes[:, None]] = whole(flat, scale)
        asked = block["positive_ids"].combine_chunks()
        n = np.diff(asked.offsets.to_numpy()).astype(np.int64)
        wanted = np.concatenate([n, asked.flatten().to_numpy(zero_copy_only=False), block["positive_scores"].combine_chunks().flatten().to_numpy(zero_copy_only=False)]).astype(_I8).tobytes()
        meta = [block["vec_id"].to_numpy().astype(_I8).tobytes(), block["label"].to_numpy().astype(_I8).tobytes(), wanted]
        g, own = (k.as_py() for k in key)
        sides = [block["n_own"][0].as_py(), block["n_other"][0].as_py()]
        # what isn't a share of the vectors travels with the first chunk only
        made = [(g, own, *sides, c, *(meta if c == 0 else [None] * 3), _pack(x[:, edges[c] : edges[c + 1]])) for c in range(chunks)]
        kinds = [pa.int64(), *[pa.int32()] * 4, *[pa.binary()] * 4]
        return pa.Table.from_arrays([pa.array(v, t) for v, t in zip(zip(*made, strict=True), kinds, strict=True)], [c.split()[0] for c in PANEL.split(", ")])

    return rows.groupBy("g", "own").applyInArrow(each, PANEL)


TILE = "g long, a int, slice int, b int, chunk int, a_ids binary, a_labels binary, wanted binary, b_ids binary, b_labels binary, width int, tile binary"


def _tiles(rows: DataFrame, anchors: DataFrame, dim: int, chunks: int, scale: float) -> DataFrame:
    """``TILE`` rows: the partial tiles of all cells, some anchors of a block by all rows of a block in each."""
    left = _panels(anchors, dim, chunks, scale).select("g", F.col("own").alias("a"), F.explode(F.sequence(F.lit(0), F.col("n_other") - 1)).alias("b"), "chunk", F.col("ids").alias("a_ids"), F.col("labels").alias("a_labels"), "wanted", F.col("data").alias("a_data"))
    right = _panels(rows, dim, chunks, scale).select("g", F.col("own").alias("b"), F.explode(F.sequence(F.lit(0), F.col("n_other") - 1)).alias("a"), "chunk", F.col("ids").alias("b_ids"), F.col("labels").alias("b_labels"), F.col("data").alias("b_data"))
    edges = [dim * c // chunks for c in range(chunks + 1)]
    schema = pa.schema([(n, {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}[t]) for n, t in (c.split() for c in TILE.split(", "))])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                dims = edges[row["chunk"] + 1] - edges[row["chunk"]]
                if not dims:
                    continue
                a, b = (_unpack(row[c]).reshape(-1, dims) for c in ("a_data", "b_data"))
                head = [None if row[c] is None else np.frombuffer(row[c], _I8) for c in ("a_ids", "a_labels", "wanted")]
                for at in range(0, len(a), TILE_ANCHORS):
                    meta: list[bytes | None] = [None] * 5
                    if head[0] is not None:
                        n = head[2][: len(a)]
                        lists = head[2][len(a) :].reshape(2, -1)
                        begin, end = int(n[:at].sum()), int(n[: at + TILE_ANCHORS].sum())
                        own = np.concatenate([n[at : at + TILE_ANCHORS], lists[0, begin:end], lists[1, begin:end]])
                        meta = [*(h[at : at + TILE_ANCHORS].tobytes() for h in head[:2]), own.tobytes(), row["b_ids"], row["b_labels"]]
                    values = [row["g"], row["a"], at // TILE_ANCHORS, row["b"], row["chunk"], *meta, len(b), _pack(product(a[at : at + TILE_ANCHORS], b))]
                    yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(values, schema, strict=True)], schema=schema)
            pa.default_memory_pool().release_unused()

    return left.join(right, ["g", "a", "b", "chunk"]).mapInArrow(each, TILE)


#: Of a whole tile: anchor's label, its positives' scores, and a tile's row; gives for each thing asked the places of the best rows.
Choose = Callable[[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray, int], list[np.ndarray]]
FOUND = "anchor_id long, positive_id long, positive_score long, vec_id long, score long"


def _reduced(tiles: DataFrame, k: int, choose: Choose) -> DataFrame:
    """``FOUND``: partial tiles added up, and the best of each anchor (or anchor and positive) in each group of tiles."""
    names = [c.split()[0] for c in FOUND.split(", ")]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place: tuple | None = None  # of the tile that is being added up
        tile, meta = np.zeros((0, 0), np.int64), {}
        best: dict[tuple, tuple[np.ndarray, np.ndarray]] = {}

        def close() -> None:
            """Takes the best of the whole tile."""
            a_ids, a_labels, b_ids, b_labels, wanted = (np.frombuffer(meta[c], _I8) for c in ("a_ids", "a_labels", "b_ids", "b_labels", "wanted"))
            n, (ids, scores) = wanted[: len(a_ids)], wanted[len(a_ids) :].reshape(2, -1)
            edge = np.concatenate([[0], np.cumsum(n)])
            for i, anchor in enumerate(a_ids.tolist()):
                own = slice(edge[i], edge[i + 1])
                asked = list(zip(ids[own].tolist(), scores[own].tolist(), strict=True)) or [(None, None)]
                for (positive, score), at in zip(asked, choose(anchor, a_labels[i], scores[own], tile[i], b_ids, b_labels), strict=True):
                    if len(at):
                        key, new = (anchor, positive, score), (tile[i][at], b_ids[at])
                        if key in best:
                            new = tuple(np.concatenate(x) for x in zip(best[key], new, strict=True))
                            order = np.lexsort((new[1], -new[0]))[:k]
                            new = (new[0][order], new[1][order])
                        best[key] = new

        def result() -> pa.RecordBatch:
            keys = [key for key, (s, _) in best.items() for _ in range(len(s))]
            columns = [pa.array([key[i] for key in keys], pa.int64()) for i in range(3)]
            columns += [pa.array(np.concatenate([v[i] for v in best.values()] or [np.zeros(0, np.int64)]), pa.int64()) for i in (1, 0)]
            best.clear()
            return pa.RecordBatch.from_arrays(columns, names)

        for batch in batches:
            for row in batch.to_pylist():
                now = (row["g"], row["a"], row["slice"], row["b"] // TILES_AT_ONCE, row["b"])
                part = _unpack(row["tile"]).reshape(-1, row["width"])
                if now == place:
                    tile += part
                    continue
                if place is not None:
                    close()
                    if now[:4] != place[:4]:
                        yield result()
                place, tile, meta = now, part, row | {"tile": None}
            pa.default_memory_pool().release_unused()
        if place is not None:
            close()
            yield result()

    group = F.floor(F.col("b") / TILES_AT_ONCE)
    return tiles.repartition("g", "a", "slice", group).sortWithinPartitions("g", "a", "slice", "b", "chunk").mapInArrow(each, FOUND)


def _dealt(rows: DataFrame, own: str, other: str) -> DataFrame:
    """Rows with their block among ``own`` many; ``other`` many blocks are met."""
    return rows.select("g", F.pmod(F.xxhash64("vec_id"), F.col(own)).cast("int").alias("own"), F.col(own).cast("int").alias("n_own"), F.col(other).cast("int").alias("n_other"), "vec_id", "label", "v", "positive_ids", "positive_scores")


RESULT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def mine(vectors: DataFrame, anchors: Column, n_positives: int = 5, n_negatives: int = 10, low: int = 30, high: int = 90, scale: float = 256.0, block_rows: int = BLOCK_ROWS, anchor_rows: int = ANCHOR_ROWS) -> DataFrame:
    """``RESULT``: for each anchor and positive its hardest negatives, ranked from 1.

    ``vectors`` has ``vec_id, embedding, label`` (whole numbers); ``anchors`` tells by ``vec_id`` or ``label`` which rows are anchors.
    Positives are an anchor's best ``n_positives`` other rows of its label. Negatives are the best ``n_negatives`` rows of other
    labels with a score from ``low`` to ``high`` per cent of the positive's.
    """
    spark = vectors.sparkSession
    v = F.col("embedding").cast("array<double>")
    fine = F.coalesce(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))
    rows = vectors.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & fine).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col("embedding").alias("v"))
    rows = rows.groupBy("vec_id").agg(F.min(F.struct("label", "v")).alias("r")).select("vec_id", "r.*")
    none = F.array().cast("array<long>")
    rows = cut(rows.withColumns({"anchor": F.coalesce(anchors, F.lit(False)), "positive_ids": none, "positive_scores": none}), "rows")
    n, n_anchors, dim = rows.agg(F.count(F.lit(1)), F.count_if("anchor"), F.max(F.size("v"))).first()
    if not n_anchors:
        return spark.createDataFrame([], RESULT)
    chunks = max(LEAST_CHUNKS, -(-dim // CHUNK_DIMS))
    block_rows = max(1, min(block_rows, BLOCK_VALUES // max(dim, 1)))

    # rows of a label meet the anchors of that label, in groups of labels that are split where they are large
    grouped = rows.withColumn("g", F.pmod(F.xxhash64("label"), F.lit(-(-n // block_rows))))
    sizes = cut(grouped.groupBy(F.col("g").alias("__g")).agg(F.ceil(F.count(F.lit(1)) / block_rows).alias("nb"), F.ceil(F.count_if("anchor") / anchor_rows).alias("na")).filter("na > 0"), "sizes")
    own = grouped.join(small(sizes), F.col("g") == F.col("__g"))

    def same(anchor: int, label: int, _: np.ndarray, scores: np.ndarray, ids: np.ndarray, labels: np.ndarray) -> list[np.ndarray]:
        return [top(scores, (labels == label) & (ids != anchor), n_positives)]

    with batches_of(spark, CELLS_AT_ONCE):
        found = cut(_reduced(_tiles(_dealt(own, "nb", "na"), _dealt(own.filter("anchor"), "na", "nb"), dim, chunks, scale), n_positives, same), "positives")
    order = Window.partitionBy("anchor_id").orderBy(F.desc("score"), "vec_id")
    first = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= n_positives)
    lists = first.groupBy(F.col("anchor_id").alias("__id")).agg(F.sort_array(F.collect_list(F.struct("rank", "vec_id", "score"))).alias("p"))  # at most ``n_positives``
    asked = rows.filter("anchor").drop("positive_ids", "positive_scores").join(lists, F.col("vec_id") == F.col("__id")).withColumns({"positive_ids": F.col("p")["vec_id"], "positive_scores": F.col("p")["score"]})

    def hardest(anchor: int, label: int, positives: np.ndarray, scores: np.ndarray, ids: np.ndarray, labels: np.ndarray) -> list[np.ndarray]:
        other = labels != label
        return [top(scores, other & (scores >= -(-low * p // 100)) & (scores <= high * p // 100), n_negatives) for p in positives.tolist()]

    blocks = {"g": F.lit(0).cast("long"), "nb": F.lit(-(-n // block_rows)), "na": F.lit(-(-n_anchors // anchor_rows))}
    with batches_of(spark, CELLS_AT_ONCE):
        found = cut(_reduced(_tiles(_dealt(rows.withColumns(blocks), "nb", "na"), _dealt(asked.withColumns(blocks), "na", "nb"), dim, chunks, scale), n_negatives, hardest), "negatives")
    order = Window.partitionBy("anchor_id", "positive_id").orderBy(F.desc("score"), "vec_id")
    best = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= n_negatives)
    return best.select("anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
