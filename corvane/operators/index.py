"""A stored index for hybrid search: posting blocks for words and vector cells for embeddings, side by side."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.operators import retrieval
from corvane.operators.cells import VectorIndex
from corvane.operators.postings import PostingIndex

#: Segments of one level; when there are more, ``add`` merges them into one of the next.
MOST_SEGMENTS = 8


class HybridIndex:
    """Units (``id, text``) under ``path``; ``embed`` makes a column of vectors from one of texts."""

    def __init__(self, spark: SparkSession, path: str, embed: retrieval.Embed = retrieval.hashed):
        self.spark, self.embed = spark, embed
        self.postings, self.vectors = PostingIndex(spark, f"{path}/postings"), VectorIndex(spark, f"{path}/vectors")

    def add(self, units: DataFrame, name: str | None = None) -> None:
        """Indexes ``units``; what is added again under its name takes the place of the former."""
        self.postings.add(units.select("id", "text"), name)
        self.vectors.add(units.select("id", self.embed(F.col("text")).alias("vector")), name)
        while crowded := self.postings.segments.crowded(MOST_SEGMENTS):
            self.postings.merge(names=crowded)
        while crowded := self.vectors.segments.crowded(MOST_SEGMENTS):
            self.vectors.merge(names=crowded)

    def merge(self, without: DataFrame | None = None) -> None:
        self.postings.merge(without)
        self.vectors.merge(without)

    def clear(self) -> None:
        self.postings.segments.commit([])
        self.vectors.segments.commit([])

    def candidates(self, queries: DataFrame, k: int, without: DataFrame | None = None) -> DataFrame:
        """``qid, kind, rank, id, score``: what ``retrieval.candidates`` finds among all units, without reading these."""
        sparse = self.postings.search(queries, k, without).select("qid", F.lit("sparse").alias("kind"), "rank", "id", "score")
        asked = queries.select("qid", self.embed(F.col("text")).alias("vector"))
        dense = self.vectors.search(asked, k, without, same_ids=False).filter("score > 0").select("qid", F.lit("dense").alias("kind"), (F.col("rank") - 1).alias("rank"), "id", "score")
        return dense.unionByName(sparse)
