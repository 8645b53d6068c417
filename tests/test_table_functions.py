"""Table functions in SQL."""

import pytest

import __spark_entry__ as entry
from corvane.functions import tables
from corvane.operators.chunking import split_text
from corvane.session import Engine

SF = "/root/testdata/sf0.001"


def test_same_as_child_chunks(spark):
    rows = [sorted(map(tuple, entry.queries()[n](spark, SF).collect())) for n in ("child_chunks", "child_chunks_sql")]
    assert rows[0] == rows[1] and rows[0]


def test_functions(spark):
    tables.register(spark)
    text = "one two three four. " * 12
    spark.createDataFrame([(1, text, "x"), (2, None, "y"), (3, "", "z")], "id int, body string, extra string").createOrReplaceTempView("some_docs")
    want = [(1, i, c) for i, c in enumerate(split_text(text, 50, 10))]
    assert [tuple(r) for r in spark.sql("SELECT id, c.* FROM some_docs, LATERAL chunks(body, 50, 10) c ORDER BY 1, 2").collect()] == want
    assert spark.sql("SELECT * FROM some_docs, LATERAL chunks(body)").count() == len(split_text(text, 500, 100))
    found = spark.sql("SELECT * FROM chunk_rows(TABLE(some_docs), 'body', 50, 10) ORDER BY id, chunk_idx")
    assert found.columns == ["id", "extra", "chunk_idx", "content"]
    assert [(r["id"], r["chunk_idx"], r["content"]) for r in found.collect()] == want
    assert [tuple(r) for r in spark.sql("SELECT id, w.* FROM some_docs, LATERAL windows(body, 200, 100) w ORDER BY 1, 2").collect()] == [(1, 0, text[:200]), (1, 1, text[100:300]), (2, 0, None), (3, 0, "")]
    for bad in ("chunks('x', 10, 10)", "chunks('x', 10, -1)", "chunk_rows(TABLE(some_docs), 'id')", "chunk_rows(TABLE(some_docs), 'none')", "chunk_rows(TABLE(SELECT body, 1 AS content FROM some_docs), 'body')"):
        with pytest.raises(Exception, match="doesn't fit|no column|of its own"):
            spark.sql(f"SELECT * FROM {bad}").collect()


def test_engine_in_sql(spark, tmp_path):
    engine = Engine(spark, str(tmp_path / "tables"))
    engine.add(spark.createDataFrame([("a/rivers.md", "# Rivers\nThe Oder flows to the sea.")], "path string, text string"))
    tables.register_engine(engine)
    (parent,) = spark.sql("SELECT * FROM parent_of('rivers_parent_0.JSON')").collect()
    assert "Oder" in parent["content"]
    assert [r["child_idx"] for r in spark.sql("SELECT c.child_idx FROM parents p, LATERAL children_of(p.parent_id) c").collect()] == [0]
