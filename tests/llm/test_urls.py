"""Canonical forms, the Bloom filter's two promises, and rules."""

import pytest

pytest.importorskip("corvane.llm")

from pyspark.sql import functions as F

from corvane.llm import urlfilter as U


def test_canonical(spark):
    cases = {
        "https://www.A.com/x/": "a.com/x",
        "http://a.com/x?utm_source=f": "a.com/x",
        "http://a.com/x?page=2&ref=y#top": "a.com/x?page=2",
        "http://a.com": "a.com",
        "ftp://a.com/?ref": "a.com",
        "http://a.com/x?refresh=1": "a.com/x?refresh=1",
        "a.com/x": None,
        None: None,
    }
    rows = spark.createDataFrame([(u,) for u in cases], "url string").select("url", U.canonical(F.col("url")).alias("c")).collect()
    assert {r["url"]: r["c"] for r in rows} == cases


def test_bloom(spark):
    """No listed key is missed, and few others pass."""
    listed = spark.range(20000).select(F.concat(F.lit("in"), "id").alias("k"))
    blocks = 2048
    table = U.bloom(listed, "k", blocks)
    assert table.count() <= blocks
    asked = listed.withColumn("there", F.lit(True)).unionByName(spark.range(20000).select(F.concat(F.lit("out"), "id").alias("k"), F.lit(False).alias("there")))
    probed = asked.withColumn("at", U._block(F.col("k"), blocks)).join(table, F.col("at") == F.col("__block"), "left")
    passes = F.col("__block").isNotNull()
    for i, m in enumerate(U._masks(F.col("k"))):
        passes = passes & (F.col(f"__w{i}").bitwiseAND(m) == m)
    found = {r["there"]: r["p"] for r in probed.groupBy("there").agg(F.avg(F.coalesce(passes, F.lit(False)).cast("int")).alias("p")).collect()}
    assert found[True] == 1.0 and found[False] < 0.02


def test_longest_rule_wins(spark):
    rules = [("allow", "com/"), ("block", "a.com/en/"), ("allow", "www.a.com/en/")]
    rows = [("http://www.a.com/en/1", "www.a.com/en/", "allow"), ("http://b.a.com/en/1", "a.com/en/", "block"), ("http://a.com/en", "com/", "allow"), ("http://xa.com/en/", "com/", "allow"), ("http://com/", "com/", "allow"), ("http://a.org/", None, None)]
    df = spark.createDataFrame(rows, "url string, rule string, verdict string")
    rule, verdict = U.rule_of(rules, U.host(F.col("url")), U.path(F.col("url")))
    assert df.filter(~(rule.eqNullSafe(F.col("rule")) & verdict.eqNullSafe(F.col("verdict")))).count() == 0


def test_more_rules_than_one_expression_holds(spark):
    rules = [("block", f"h{i}.org/") for i in range(U.MOST_RULES + 1)] + [("allow", "www.h5.org/")]
    pages = spark.createDataFrame([(1, "http://h5.org/a"), (2, "http://www.h5.org/a"), (3, "http://h5000.org/"), (4, None)], "page_id long, url string")
    got = {r["page_id"]: (r["rule"], r["verdict"]) for r in U.judge(pages, rules, spark.createDataFrame([], "url string")).collect()}
    assert got == {1: ("h5.org/", "block"), 2: ("www.h5.org/", "allow"), 3: (None, "allow"), 4: (None, "allow")}


def test_very_long_url(spark):
    """Canonical form, rules and list see all of it."""
    long = "http://www.Long.com/" + "a" * 200_000
    pages = spark.createDataFrame([(1, long + "?b=1"), (2, long), (3, long + "x")], "page_id long, url string")
    listed = spark.createDataFrame([("long.com/" + "a" * 200_000,)], "url string")
    got = {r["page_id"]: (r["host"], len(r["path"]), r["verdict"]) for r in U.judge(pages, [("allow", "org/")], listed).collect()}
    assert got[2] == ("www.long.com", 200_001, "block") and got[3] == ("www.long.com", 200_002, "allow") and got[1][2] == "allow"
