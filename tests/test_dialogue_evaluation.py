"""Dialogue and evaluation columns on hand-made rows."""

from pyspark.sql import functions as F

from corvane.operators import dialogue as D
from corvane.operators import evaluation as E
from corvane.operators import retrieval as R
from corvane.sources import documents as S


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_history_gate(spark):
    rows = spark.createDataFrame([(c, t, "user", "x") for c, n in ((1, 3), (2, 4)) for t in range(n)], "conv_id long, turn long, role string, text string")
    assert {r["conv_id"]: r["summarise"] for r in D.history_gate(rows).collect()} == {1: False, 2: True}
    assert D.history_window(rows).collect()[0]["history"] == "Conversation history:\n" + "User: x\n" * 3


def test_clarification(spark):
    assert one(spark, D.clarification(F.lit("a" * 10))) == "I need more information to understand your question."
    assert one(spark, D.clarification(F.lit("a" * 11))) == "a" * 11


def test_reset(spark):
    item = "array<struct<v:int,reset:boolean>>"
    old = F.from_json(F.lit('[{"v":1,"reset":false}]'), item)
    new = F.from_json(F.lit('[{"v":0,"reset":true},{"v":2,"reset":false}]'), item)
    assert one(spark, F.size(D.accumulate_or_reset(old, new))) == 0
    assert one(spark, F.size(D.accumulate_or_reset(old, old))) == 2


def test_fan_in(spark):
    rows = spark.createDataFrame([(1, 1, "b"), (1, 0, "a")], "k long, index int, answer string")
    assert D.fan_in(rows, "k").first()["text"] == "\nAnswer 1:\na\n\nAnswer 2:\nb\n"


def test_parse_grade(spark):
    cases = {'```json\n{"explanation":"x","result":true}\n```': True, '```{"result":true}```': False, '{"explanation":"x"}': False, "[1]": False, "no": False, ' {"result":true} ': True}
    for raw, want in cases.items():
        assert one(spark, E.parse_grade(F.lit(raw))) is want, raw
    assert one(spark, E.parse_grade(F.lit(None).cast("string"))) is False
    assert one(spark, E.parse_correctness(F.lit('{"explanation":"x","result":true}'))) is True


def test_overall(spark):
    rows = spark.createDataFrame([(1, True, False, None), (2, None, None, None)], "k long, groundedness boolean, relevance boolean, retrieval_accuracy boolean")
    assert {r["k"]: r["overall_score"] for r in E.overall(E.unpivot(rows, "k"), "k").collect()} == {1: 0.5, 2: 0.0}
    assert [r["x"] for r in rows.select(E.overall_of(rows).alias("x")).collect()] == [0.5, 0.0]


def test_safe_join(spark):
    docs = F.array(F.lit("a" * 2000), F.lit("b" * 2001), F.lit(None))
    assert one(spark, E.safe_join(docs)) == "a" * 2000 + "\n\n" + "b" * 2000 + "..."


def test_parents(spark):
    ids = spark.createDataFrame([("a_parent_10",), ("a_parent_2",), ("a_parent_2",), ("plain",)], "parent_id string")
    assert [r["parent_id"] for r in R.parents_sorted(ids).orderBy("sort_key", "parent_id").collect()] == ["plain", "a_parent_2", "a_parent_10"]


def test_ingest_twice(spark):
    files = spark.createDataFrame([(1, "x/a.pdf", "t"), (2, "y/a.docx", "t"), (3, "b.md", " ")], "doc_id long, path string, text string")
    none = spark.createDataFrame([], "stem string")
    assert {(r["stem"], r["doc_id"]) for r in S.skip_existing(files, none, "doc_id").collect()} == {("a", 1), ("b", 3)}
    assert tuple(S.ingest_counts(files, none, "doc_id", "text").first()) == (1, 2)
    again = S.skip_existing(files, S.skip_existing(files, none, "doc_id"), "doc_id")
    assert again.count() == 0
