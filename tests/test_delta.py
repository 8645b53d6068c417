"""Content-defined chunks against a plain rolling hash; edits leave other chunks; bitmaps against sets."""

import random

from pyspark.sql import functions as F

import __spark_entry__ as entry
from corvane.operators import bitmaps as M
from corvane.operators import delta as X
from corvane.operators import retrieval as R

SF = "/root/testdata/sf0.001"
MASK = (1 << 64) - 1


def plain_borders(text, least=X.LEAST, most=X.MOST):
    """Character by character."""
    def mix(c):
        v = c * 0x9E3779B97F4A7C15 & MASK
        return v ^ v >> 29

    out, at = [], 0
    for i in range(len(text)):
        h = sum(mix(ord(text[i - j])) * pow(0xD6E8FEB86659FD93, j, 1 << 64) for j in range(X.WINDOW) if i - j >= 0) & MASK
        if (i + 1 - at >= least and h >> 56 == 0 and len(text) - at > least) or i + 1 - at == most:
            out.append(i + 1)
            at = i + 1
    return out + ([len(text)] if at < len(text) else [])


def prose(seed, n):
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("abcdefghijklmnopé日") for _ in range(rng.randrange(2, 9))) for _ in range(n))


def test_borders():
    for text in (prose(1, 600), "", "a", "a" * 5000, prose(2, 20), "x" * 128, "x" * 129, "x" * 2048 + "y"):
        assert X.borders(text) == plain_borders(text)


def test_an_edit_stays_local(spark):
    text = prose(5, 4000)
    edited = text[:9000] + " put in " + text[9000:]
    frame = lambda t: X.chunks(spark.createDataFrame([("d", t), ("none", None), ("empty", "")], "doc string, text string"), "doc", "text")
    old, new = frame(text), frame(edited)
    assert "".join(r["content"] for r in new.orderBy("chunk_idx").collect()) == edited
    found = X.chunk_delta(old, new, "doc").agg(F.sum("n_kept"), F.sum("n_added"), F.sum("n_removed")).first()
    assert found[0] >= old.count() - 3 and 1 <= found[1] <= 3 and 1 <= found[2] <= 3
    weighed = X.weigh(old, None)
    again = X.weigh(new, weighed)
    want = R.term_weights(new.select("chunk_id", "content").distinct(), "chunk_id", "content")
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, want.collect()))
    assert X.unknown(new, old).count() == found[1]


def test_delta_query(spark):
    docs = {r["doc_id"]: (r["lang"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in entry.queries()["chunk_delta"](spark, SF).collect():
        lang, text = docs[r["doc_id"]]
        cut = lambda t: [t[a:b] for e in [X.borders(t)] for a, b in zip([0, *e], e)]
        if lang != "de":
            assert (r["n_kept"], r["n_added"], r["n_removed"]) == (len(cut(text)), 0, 0)
        else:
            half = len(text) // 2
            after = cut(text[:half] + " some words that were not there " + text[half:])
            assert r["n_kept"] + r["n_added"] == len(after) and r["n_kept"] + r["n_removed"] == len(cut(text))


def test_bitmaps(spark):
    rng = random.Random(9)
    docs = {i: {"lang": rng.choice(["a", "b", None]), "kind": rng.choice("xyz")} for i in rng.sample(range(200_000), 500)}
    docs[7] = {"lang": "a", "kind": "only"}
    tags = spark.createDataFrame([(i, t, v) for i, d in docs.items() for t, v in d.items()] + [(7, "lang", "b")], "number long, tag string, value string")
    index = M.build(tags, spark.createDataFrame([(i,) for i in docs], "number long"))
    has = lambda t, v: {i for i, d in docs.items() if d[t] == v} | ({7} if (t, v) == ("lang", "b") else set())
    a, b, x = M.Has("lang", "a"), M.Has("lang", "b"), M.Has("kind", "x")
    cases = [(a, has("lang", "a")), (M.And((a, b)), {7}), (M.Or((a, x)), has("lang", "a") | has("kind", "x")), (M.Not(a), docs.keys() - has("lang", "a")), (M.And((M.Not(x), M.Or((a, b)))), (has("lang", "a") | has("lang", "b")) - has("kind", "x")),
             (M.Has("lang", "zz"), set()), (M.And(()), set(docs)), (M.Or(()), set()), (M.Not(M.Or(())), set(docs))]
    for condition, want in cases:
        found = M.matching(index, condition)
        assert {r["number"] for r in M.numbers(found).collect()} == want
        assert (found.agg(F.sum("n")).first()[0] or 0) == len(want)
