"""Bucketed parents: what the plans read and shuffle."""

import pytest
from pyspark.sql import functions as F

from corvane.sources.parents import ParentStore


@pytest.fixture
def store(spark, tmp_path):
    own = ParentStore(spark, str(tmp_path / "store"))
    own.put(spark.createDataFrame([(f"d{i}_parent_{i}", i, f"text {i}") for i in range(200)], "parent_id string, version int, content string"), "version")
    return own


def plan(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def test_lookup_reads_one_bucket(spark, store):
    assert [r["content"] for r in store.lookup(["d7_parent_7.JSON"]).collect()] == ["text 7"]
    assert store.lookup(["d7_parent_7", "none", "d8_parent_8.json"]).count() == 2
    name = "spark.sql.sources.bucketing.autoBucketedScan.enabled"
    spark.conf.set(name, "false")  # files are pruned by bucket in any case; without this the plan doesn't say so
    try:
        assert "SelectedBucketsCount: 1 out of 16" in plan(store.lookup(["d7_parent_7"]))
    finally:
        spark.conf.unset(name)


def test_joins_without_shuffle(spark, store):
    children = spark.createDataFrame([(f"d{i % 250}_parent_{i % 250}", i) for i in range(1000)], "parent_id string, child_idx int")
    store.write("children", children)
    joined = store.with_parents("children")
    assert "Exchange" not in plan(joined) and joined.count() == 800
    counted = store.table("children").groupBy("parent_id").agg(F.count(F.lit(1)).alias("n"))
    assert "Exchange" not in plan(counted)
    fetched = store.fetch(spark.createDataFrame([("d3_parent_3", 1), ("none", 2)], "parent_id string, qid int"))
    assert plan(fetched).split("== Initial Plan ==")[0].count("Exchange hash") == 1 and [r["content"] for r in fetched.collect()] == ["text 3"]


def test_put_replaces(spark, store):
    store.put(spark.createDataFrame([("d3_parent_3", 99, "new"), ("d4_parent_4", 1, "older"), ("e_parent_0", 1, "more")], "parent_id string, version int, content string"), "version")
    found = {r["parent_id"]: r["content"] for r in store.lookup(["d3_parent_3", "d4_parent_4", "e_parent_0", "d5_parent_5"]).collect()}
    assert found == {"d3_parent_3": "new", "d4_parent_4": "text 4", "e_parent_0": "more", "d5_parent_5": "text 5"}
    assert store.table().count() == 201
