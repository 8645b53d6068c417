"""Parents as a table bucketed and sorted by their id: a lookup reads one bucket, and children of the same buckets meet their parents without a shuffle."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.sources import documents as D

#: Buckets of a store; enough that a bucket's rows fit a task.
BUCKETS = 16


class ParentStore:
    """Tables of one bucketing under ``path``: ``parents`` (``parent_id`` and any columns), and others that refer to them by ``parent_id``."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS):
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets
        self._tables: dict[str, DataFrame] = {}

    def write(self, name: str, rows: DataFrame) -> DataFrame:
        """Writes a table, one sorted file for each bucket, and gives it as it is read back."""
        own = f"corvane_{uuid.uuid4().hex}"
        dealt = rows.repartition(self.buckets, "parent_id").sortWithinPartitions("parent_id")
        # a table is the only form in which the bucketing is known when it is read; its entry in the catalog isn't needed after that
        dealt.write.mode("overwrite").bucketBy(self.buckets, "parent_id").sortBy("parent_id").option("path", f"{self.path}/{name}").saveAsTable(own)
        self._tables[name] = self.spark.table(own)
        self.spark.sql(f"DROP TABLE {own}")
        return self._tables[name]

    def put(self, rows: DataFrame, order: str) -> DataFrame:
        """Writes parents over those of the same id that are there; the row with the largest ``order`` stays. Only ``rows`` are shuffled, and the table is written anew."""
        if "parents" not in self._tables:
            kept = D.upsert(rows, rows.limit(0), "parent_id", order)
            return self.write("parents", kept.select(*rows.columns))
        generation = f"parents-{uuid.uuid4().hex}"
        kept = D.upsert(self._tables["parents"], rows, "parent_id", order).select(*rows.columns)
        self._tables["parents"] = self.write(generation, kept)
        return self._tables["parents"]

    def table(self, name: str = "parents") -> DataFrame:
        return self._tables[name]

    def lookup(self, ids: list[str]) -> DataFrame:
        """Parents of a few ids, with or without ``.json``, from their buckets alone."""
        asked = [i[:-5] if i.lower().endswith(".json") else i for i in ids]
        return self.table().filter(F.col("parent_id").isin(asked))

    def fetch(self, asked: DataFrame) -> DataFrame:
        """Rows of ``asked`` (``parent_id``, any columns) with their parents; ``asked`` alone is shuffled, to the buckets."""
        return asked.repartition(self.buckets, "parent_id").join(self.table().hint("merge"), "parent_id")

    def with_parents(self, name: str, suffix: str = "parent_") -> DataFrame:
        """Rows of another table of the store with the columns of their parents; nothing is shuffled."""
        parents = self.table()
        renamed = parents.select("parent_id", *(F.col(c).alias(f"{suffix}{c}") for c in parents.columns if c != "parent_id"))
        return self.table(name).join(renamed.hint("merge"), "parent_id")
