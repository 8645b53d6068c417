"""Statistics from sorted blocks equal those from all rows, and open few blocks; questions are asked again; progress and metadata."""

import random

from pyspark.sql import functions as F

from corvane.operators import dialogue as D
from corvane.operators import latency as L
from corvane.operators import rollups as U
from corvane.session import Engine

SCHEMA = "operation string, duration double"


def table(rows):
    return sorted((repr(r["operation"]), r["count"], *(round(r[c], 6) for c in L.STATS.split(", ")[2:])) for r in rows.collect())


def test_blocks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(U, "SHARE", 3000)
    monkeypatch.setattr(U, "BLOCK", 64)
    rng = random.Random(4)
    rows = [("hot" if rng.random() < 0.6 else rng.choice(["a", "b", None]), rng.choice([rng.random(), rng.paretovariate(1), 5.0])) for _ in range(20_000)] + [("one", 3.0), ("two", 1.0), ("two", 2.0), ("nothing", None)]
    path = str(tmp_path / "blocks")
    for i in range(4):
        U.add(spark.createDataFrame(rows[i::4], SCHEMA), path, f"h{i}")
    U.add(spark.createDataFrame(rows[0::4], SCHEMA), path, "h0")  # again
    kept = spark.read.parquet(path)
    every = spark.createDataFrame([r for r in rows if r[1] is not None], SCHEMA)
    assert table(U.stats(kept)) == table(L.stats(every))
    n_all, n_read = U.values_read(kept).first()
    assert n_all == 20_003 and n_read < 0.6 * n_all
    plan = kept.select("operation", "low", "high", "n")._jdf.queryExecution().toString()
    assert "data" not in plan.split("ReadSchema")[-1]


def test_questions_are_asked_again(spark):
    units = spark.createDataFrame([(1, "p1", "copper conducts heat"), (2, "p2", "bread is made of flour")], "id long, parent_id string, text string")
    parents = spark.createDataFrame([("p1", "all about copper"), ("p2", "all about bread")], "parent_id string, content string")
    asked = spark.createDataFrame([(1, "what about cuprum here", None), (2, "what about unheard things", None)], "key long, query string, history string")
    turns = []

    def retry(question, turn):
        turns.append(turn)
        return F.when(F.contains(question, F.lit("cuprum")), F.lit("copper")).when(F.contains(question, F.lit("unheard")), F.lit("still unheard"))

    once = {r["key"]: r["text"] for r in D.answer_all(asked, units, parents).collect()}
    assert "Unable" in once[1] and "Unable" in once[2]
    again = {r["key"]: r["text"] for r in D.answer_all(asked, units, parents, analysis=D.Analysis(retry=retry)).collect()}
    assert "all about copper" in again[1] and "Unable" in again[2] and len(turns) == 2


def test_progress_and_metadata(spark, tmp_path):
    (tmp_path / "a.md").write_text("# Iron\nIron rusts.")
    engine, heard = Engine(spark, str(tmp_path / "tables")), []
    assert engine.add_documents(str(tmp_path / "a.md"), progress=lambda done, what: heard.append((done, what))) == (1, 0)
    assert [d for d, _ in heard] == sorted(d for d, _ in heard) and heard[0][0] == 0.0 and heard[-1] == (1.0, "1 added")
    assert engine.add_web_page("http://x.org/iron-page", "<html><p>Iron melts.</p></html>", {"topic": "metal"})[0]
    assert [r["stem"] for r in engine.find(topic="metal").collect()] == ["iron-page"]
    assert [r["tags"]["url"] for r in engine.find(url="http://x.org/iron-page").collect()] == ["http://x.org/iron-page"]
