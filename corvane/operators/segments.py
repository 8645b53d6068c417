"""Stored indexes are made of segments: folders of files that never change, and a manifest that tells which of them hold."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession


class Segments:
    """The segments of one index under ``path``. Each change writes a new manifest; the last one counts."""

    def __init__(self, spark: SparkSession, path: str, schemas: dict[str, str]):
        self.spark, self.path, self.schemas = spark, path.rstrip("/"), schemas
        self._known: tuple[str, list[str]] = ("", [])

    def _last(self) -> str:
        """The folder of the last whole manifest, if there is any."""
        own = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/manifest/*/_SUCCESS")
        found = own.getFileSystem(self.spark._jsc.hadoopConfiguration()).globStatus(own)
        return max((x.getPath().getParent().toString() for x in found or []), default="")

    def names(self) -> list[str]:
        """The segments that hold; few, as merging keeps them."""
        last = self._last()
        if last and last != self._known[0]:
            self._known = (last, sorted(r["value"] for r in self.spark.read.text(last).collect() if r["value"]))
        return list(self._known[1]) if last else []

    def commit(self, names: list[str]) -> None:
        """Lets exactly these segments hold."""
        number = int((self._last() or "/0").rpartition("/")[2]) + 1
        self.spark.createDataFrame([(n,) for n in sorted(set(names))] or [("",)], "value string").coalesce(1).write.mode("overwrite").text(f"{self.path}/manifest/{number:010d}")

    def place(self, name: str, kind: str) -> str:
        return f"{self.path}/{kind}/segment={name}"

    def read(self, kind: str, names: list[str] | None = None) -> DataFrame:
        """The rows of some segments, or of all that hold, of one kind of table."""
        paths = [self.place(n, kind) for n in (self.names() if names is None else names)]
        if not paths:
            return self.spark.createDataFrame([], self.schemas[kind])
        return self.spark.read.schema(self.schemas[kind]).option("basePath", f"{self.path}/{kind}").parquet(*paths).drop("segment")

    @staticmethod
    def fresh(level: int = 0) -> str:
        """A new name; a segment made of others by merging is one level above the highest of them."""
        return f"m{level}-{uuid.uuid4().hex}"

    @staticmethod
    def level(name: str) -> int:
        found = re.match(r"m(\d+)-", name)
        return int(found[1]) if found else 0

    def crowded(self, most: int) -> list[str]:
        """The segments of the lowest level that has more than ``most``; merging level by level, each row is written again as often as there are levels."""
        by: dict[int, list[str]] = {}
        for name in self.names():
            by.setdefault(self.level(name), []).append(name)
        return next((by[n] for n in sorted(by) if len(by[n]) > most), [])
