"""A stream of files gives what one batch gives, also when it is killed between any two tables and started again."""

import pytest
from pyspark.sql import functions as F

from corvane.session import SCHEMAS, Engine
from corvane.streaming.ingestion import ingest

SCHEMA = "path string, text string"
FIRST = [("a/one.md", "# Head\n" + "one word after the other " * 120), ("a/two.md", "# Two\nshort"), ("b/two.md", "# Again\nthe same stem"), ("a/empty.md", " \n")]
SECOND = [("c/one.md", "# Late\nthe stem is there"), ("c/three.html", "<html><h1>Three</h1><p>bread &amp; salt</p></html>"), ("c/four.md", "# Four\nfish")]
#: What a clock or a batch's name gives.
VARIES = {"at", "batch"}


def tables(engine):
    return {n: sorted(map(repr, engine.table(n).drop(*VARIES).collect())) for n in ("documents", "parents", "children", "versions", "stems", "registry")}


def found(engine):
    return [(r["parent_id"], r["rank"], r["score"]) for r in engine.search("bread and fish", 5, threshold_stage="none").collect()]


@pytest.fixture(scope="module")
def whole(spark, tmp_path_factory):
    engine = Engine(spark, str(tmp_path_factory.mktemp("whole") / "tables"))
    assert engine.add(spark.createDataFrame(FIRST, SCHEMA)) == (2, 2)
    assert engine.add(spark.createDataFrame(SECOND, SCHEMA)) == (2, 1)
    return tables(engine), found(engine)


def test_stream_like_batches(spark, tmp_path, whole, monkeypatch):
    """The first batch is killed before its children, the second before its stems."""
    source, checkpoint = str(tmp_path / "in"), str(tmp_path / "cp")
    stop: list[str] = []
    usual = Engine._add

    def add(self, name, rows, batch):
        if name in stop:
            raise RuntimeError("killed")
        usual(self, name, rows, batch)

    monkeypatch.setattr(Engine, "_add", add)
    for part, at in ((FIRST, "children"), (SECOND, "stems")):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(source)
        for stop[:] in ([at], []):
            engine = Engine(spark, str(tmp_path / "tables"))  # as a new process would
            query = ingest(engine, spark.readStream.schema(SCHEMA).parquet(source), checkpoint)
            if stop:
                with pytest.raises(Exception, match="killed"):
                    query.awaitTermination()
            else:
                query.awaitTermination()
    assert (tables(engine), found(engine)) == whole
    assert {r["batch"] for r in engine.table("documents").select("batch").distinct().collect()} == {"stream-0000000000", "stream-0000000001"}


def test_stems_are_read_by_bucket(spark, tmp_path):
    engine = Engine(spark, str(tmp_path / "tables"))
    engine.add(spark.createDataFrame(FIRST, SCHEMA))
    plan = engine.table("stems").filter(F.col("bucket").isin([3]))._jdf.queryExecution().toString()
    assert "PartitionFilters" in plan and "bucket" in plan.split("PartitionFilters: [")[1].split("]")[0]
    assert set(SCHEMAS) >= {"stems"} and engine.table("stems").count() == 2


@pytest.mark.parametrize("at", ["documents", "stems"])
def test_failed_batch_leaves_nothing(spark, tmp_path, whole, monkeypatch, at):
    """A batch without a name that fails is taken back, so that trying again gives what one try gives."""
    engine = Engine(spark, str(tmp_path / "tables"))
    usual = Engine._add

    def add(self, name, rows, batch):
        if name == at:
            raise RuntimeError("failed")
        usual(self, name, rows, batch)

    monkeypatch.setattr(Engine, "_add", add)
    with pytest.raises(RuntimeError, match="failed"):
        engine.add(spark.createDataFrame(FIRST, SCHEMA))
    assert all(engine.table(n).count() == 0 for n in ("parents", "children", "documents", "stems")) and engine.index.postings.segments.names() == []
    monkeypatch.setattr(Engine, "_add", usual)
    engine.add(spark.createDataFrame(FIRST, SCHEMA))
    engine.add(spark.createDataFrame(SECOND, SCHEMA))
    assert (tables(engine), found(engine)) == whole
