"""Retrieval and links in many blocks, against plain Python; broadcasts by bytes."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from corvane import storage
from corvane.operators import curation as C
from corvane.operators import retrieval as R

WORDS = [f"w{i}" for i in range(60)]


def test_nothing_in_common(spark):
    units = spark.createDataFrame([(1, "a b"), (2, "")], "id long, text string").repartition(2, "id")
    assert R.candidates(units, spark.createDataFrame([(1, "x y"), (2, "")], "qid long, text string"), 3).filter("kind = 'sparse'").count() == 0


def brute(units, queries, k):
    out = set()
    for qid, q in queries:
        asked = R.words(q)
        for kind in ("dense", "sparse"):
            scores = []
            for i, t in units:
                own = R.words(t)
                if kind == "sparse":
                    s = sum(f * 2.2 / (f + 1.2 * (0.25 + 0.75 * len(own) / 256)) for w in set(asked) if (f := own.count(w)))
                else:
                    a, b = (np.bincount([R.bucket(w) for w in x] or [0], minlength=256) * bool(x) for x in (own, asked))
                    n = math.sqrt((a**2).sum() * (b**2).sum())
                    s = (a @ b) / n if n else 0
                if round(s, 6) > 0:
                    scores.append((-round(s, 6), i))
            out |= {(qid, kind, r, i, -s) for r, (s, i) in enumerate(sorted(scores)[:k])}
    return out


@pytest.mark.parametrize("block", [2000, 3])
def test_candidates(spark, monkeypatch, block):
    monkeypatch.setattr(R, "BLOCK_QUERIES", block)
    monkeypatch.setattr(R, "BLOCKS_AT_ONCE", 2)
    monkeypatch.setattr(R, "KEPT_TIMES", 1)
    rng = random.Random(1)
    text = lambda n: " ".join(rng.choice(WORDS) for _ in range(n))
    units = [(i, text(rng.randrange(1, 30))) for i in range(300)] + [(900, ""), (901, None)]
    queries = [(i, text(4)) for i in range(20)] + [(50, ""), (51, "nothing known")]
    got = R.candidates(spark.createDataFrame(units, "id long, text string"), spark.createDataFrame(queries, "qid long, text string"), 5).collect()
    want = brute(units, queries, 5)
    assert {(r["qid"], r["kind"], r["rank"], r["id"]) for r in got} == {w[:4] for w in want} and len(got) == len(want)


@pytest.mark.parametrize("block", [4096, 20])
def test_semantic_links(spark, monkeypatch, block):
    monkeypatch.setattr(C, "BLOCK_ROWS", block)
    x = np.random.default_rng(3).normal(size=(90, 6))
    x[70:] = x[5]
    got = {r["k"]: (r["n_links"], r["class_id"]) for r in C.semantic_links(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "k long, v array<double>"), "k", "v", 0.9).collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = np.round(u @ u.T, 6) >= 0.9
    root = np.arange(90)
    for _ in range(90):
        root = np.array([root[n].min() for n in near])
    assert got == {i: (int(near[i].sum()) - 1, int(root[i])) for i in range(90)}


def test_broadcast_by_bytes(spark):
    """A side of few rows but many bytes is joined by a shuffle, with the same result."""
    rows = spark.range(100).select("id", F.repeat(F.lit("x"), 1000).alias("t"), F.array(F.lit(1), F.lit(2)).alias("a"), F.create_map(F.lit("k"), F.lit("v")).alias("m"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for most, kind in ((1 << 20, True), (50_000, False)):
            joined = spark.range(200).join(storage.small(rows, most), "id")
            assert joined.count() == 100 and ("Broadcast" in joined._jdf.queryExecution().executedPlan().toString()) is kind
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_inverse_document_frequency(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, "a"), (3, "a")], "k long, t string")
    got = {(r["k"], r["token"]): r["weight"] for r in R.term_weights(docs, "k", "t", idf=True).collect()}
    plain = {(r["k"], r["token"]): r["weight"] for r in R.term_weights(docs, "k", "t").collect()}
    assert got[1, "b"] == pytest.approx(plain[1, "b"] * math.log(1 + 2.5 / 1.5)) and got[2, "a"] == pytest.approx(plain[2, "a"] * math.log(1 + 0.5 / 3.5))


def test_bounds_pass_over_nothing_that_counts(monkeypatch):
    """The pass gives what scoring every pair gives, for queries on both sides of ``SHORT_WORDS``, and makes few scores exactly."""
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(400)]
    text = lambda n: " ".join(rng.choice(vocabulary[: rng.choice((5, 50, 400))]) for _ in range(n))
    asked = [*enumerate([text(n) for n in (1, 2, 3, 11, 11, 12, 63, 64, 65, 200)]), (10, ""), (11, None), (12, "w1 w1 w1"), (13, "unknown")]
    units = [text(rng.randrange(0, 90)) for _ in range(700)] + [None, "", "w1"] + [text(5000)]
    queries = R._Queries(asked)
    best, made = {kind: R._Best(len(asked), 3) for kind in ("dense", "sparse")}, 0
    for at in range(0, len(units), 64):
        for kind, (unit, q, scores) in R._pairs(queries, R._Codes(queries.numbers), units[at : at + 64], {kind: own.least for kind, own in best.items()}):
            made += len(q)
            best[kind].add(q[scores > 0], unit[scores > 0] + at, scores[scores > 0])
        for own in best.values():
            own.result()
    assert made < 0.5 * 2 * len(asked) * len(units)

    def dense(a, b):
        x, y = (np.bincount([R.bucket(w) for w in R.words(t)], minlength=256).astype(float) for t in (a, b))
        return round(float(x @ y / max(np.sqrt((x**2).sum()) * np.sqrt((y**2).sum()), 1e-300)), 6)

    def sparse(a, b):
        own = R.words(b)
        return round(sum(own.count(w) * 2.2 / (own.count(w) + 1.2 * (0.25 + 0.75 * len(own) / 256)) for w in dict.fromkeys(R.words(a))), 6)

    for kind, score in (("dense", dense), ("sparse", sparse)):
        q, ids, scores = best[kind].result()
        for i, t in asked:
            want = sorted((-s, j) for j, u in enumerate(units) if (s := score(t, u)) > 0)[:3]
            found = list(zip((-scores[q == i]).tolist(), ids[q == i].tolist(), strict=True))
            assert [j for _, j in found] == [j for _, j in want] and np.allclose([s for s, _ in found], [s for s, _ in want], atol=2e-6)


@pytest.mark.parametrize(("pass_bytes", "rows_at_once", "products"), [(8 << 20, 512, 1 << 18), (300, 7, 11)])
def test_nearest_sends_queries_to_the_rows(spark, monkeypatch, pass_bytes, rows_at_once, products):
    """All rows against all queries, negative cosines, zeros and ties among them; rows and queries aren't dealt into pairs of blocks."""
    for name, value in (("PASS_BYTES", pass_bytes), ("NEAREST_ROWS", rows_at_once), ("PRODUCTS", products)):
        monkeypatch.setattr(R, name, value)
    x = np.random.default_rng(4).integers(-2, 3, (60, 3)).astype(float)
    rows = [*enumerate(x.tolist()), (60, None), (61, [None, 1.0, 1.0]), (62, [math.nan, 1.0, 1.0])]
    df = spark.createDataFrame(rows, "id long, vector array<double>").repartition(3)
    found = R.exact_nearest(df, df.filter("id % 4 = 0"), 70)
    assert "CoGroup" not in found._jdf.queryExecution().toString()
    norm = np.maximum(np.linalg.norm(x, axis=1), 1e-300)
    unit = x / norm[:, None]
    for q in range(0, 60, 4):
        own = found.filter(f"qid = {q}").orderBy("rank").collect() if q < 9 else None
        if own is not None:
            scores = np.round(unit @ unit[q], 6)
            assert [r["id"] for r in own] == [i for _, i in sorted((-scores[i], i) for i in range(60) if i != q)]


def test_least_scores_are_known_before_most_units(spark, monkeypatch):
    """Each share of the units is read with the least scores of those before; the rows are those of every pair."""
    rng = random.Random(6)
    text = lambda n: " ".join(f"w{rng.choice((rng.randrange(9), rng.randrange(60), rng.randrange(900)))}" for _ in range(n))
    asked, units = [(q, text(rng.randrange(1, 30))) for q in range(-40, 40)] + [(90, text(80)), (91, ""), (92, None)], [(i * 7, text(rng.randrange(0, 90))) for i in range(600)]
    queries = R._Queries(asked)
    least, made = {kind: np.zeros(len(asked)) for kind in ("dense", "sparse")}, 0
    monkeypatch.setattr(R, "RUN", 128)
    guess = {kind: R._Best(len(asked), 3) for kind in least}
    for kind, (unit, q, scores) in R._pairs(queries, R._Codes(queries.numbers), [t for _, t in units], least, 3):
        made += len(q)
        guess[kind].add(q, unit, scores)
    for kind in least:
        guess[kind].result()
    assert made < 0.1 * 2 * len(asked) * len(units) and np.count_nonzero(guess["dense"].least) == len(asked) - 2

    df = lambda rows, names: spark.createDataFrame(rows, names)
    ask, search = df(asked, "qid long, text string"), df(units, "id long, text string")
    plain = {tuple(r) for r in R.candidates(search, ask, 3).collect()}
    known, shares = R._pass, []
    monkeypatch.setattr(R, "_pass", lambda rows, shipped, k, least=None: shares.append((rows.count(), least)) or known(rows, shipped, k, least))
    monkeypatch.setattr(R, "SEEDED", 1)
    monkeypatch.setattr(R, "FIRST_UNITS", 16)
    monkeypatch.setattr(R, "UNITS", 64)
    assert {tuple(r) for r in R.candidates(search, ask, 3).collect()} == plain
    assert [least is None for _, least in shares] == [True] + [False] * 2 * R.PARTS and sum(n for n, _ in shares) == len(units)
    for kind, own in shares[-1][1].items():
        place = {q: i for i, q in enumerate(queries.ids.tolist())}
        last = {r[0]: r[4] for r in plain if r[1] == kind and r[2] == 2}
        assert np.count_nonzero(own) >= 60 and all(own[place[q]] <= score for q, score in last.items())
    # and every pair scored gives the same
    every = R._pairs(queries, R._Codes(queries.numbers), [t for _, t in units], {kind: np.zeros(len(asked)) for kind in least})
    best = {kind: R._Best(len(asked), 3) for kind in least}
    for kind, (unit, q, scores) in every:
        best[kind].add(q, 7 * unit, scores)
    for kind, own in best.items():
        q, ids, scores = own.result()
        assert {(int(queries.ids[a]), kind, int(b), float(c)) for a, b, c in zip(q, ids, scores, strict=True)} == {(r[0], r[1], r[3], r[4]) for r in plain if r[1] == kind}
