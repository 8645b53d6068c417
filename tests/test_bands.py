"""Links by bands against every pair."""

import math

import numpy as np

from corvane.operators import bands as B
from corvane.operators import curation as C

SCHEMA = "id long, v array<double>"


def test_recall(spark):
    """At 0.9 and over, at least nine tenths of all links; classes and counts of those found are exact. A third of all rows is one vector, a dense cluster fills several blocks."""
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(40, 24))
    x = np.repeat(centres, 25, axis=0) + 0.22 * rng.normal(size=(1000, 24))
    same = np.tile(rng.normal(size=24), (600, 1))
    dense = rng.normal(size=24) + 0.02 * rng.normal(size=(500, 24))
    every = np.vstack([x, same, dense])
    rows = [(i, v.tolist()) for i, v in enumerate(every)] + [(5000, None), (5001, [0.0] * 24), (5002, [float("nan")] * 24), (5003, [1.0, 2.0]), (5004, [2.0, 4.0])]
    df = spark.createDataFrame(rows, SCHEMA)
    got = {r["id"]: (r["n_links"], r["class_id"]) for r in B.banded_links(df, "id", "v", 0.9).collect()}
    assert len(got) == len(rows)
    u = every / np.linalg.norm(every, axis=1, keepdims=True)
    near = np.round(u @ u.T, 6) >= 0.9
    np.fill_diagonal(near, False)
    true = near.sum(1)
    found = np.array([got[i][0] for i in range(len(every))])
    assert (found <= true).all() and found.sum() >= 0.9 * true.sum()
    assert found[:1000].sum() >= 0.9 * true[:1000].sum()
    assert {got[i] for i in range(1000, 1600)} == {(599, 1000)}
    assert len({got[i][1] for i in range(1600, 2100)}) == 1 and (found[1600:] == 499).all()
    assert [got[i] for i in (5000, 5001, 5002, 5003, 5004)] == [(0, 5000), (0, 5001), (0, 5002), (1, 5003), (1, 5003)]


def test_small_blocks(spark, monkeypatch):
    """Blocks of a few rows give what one block gives."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=8) + 0.1 * rng.normal(size=(60, 8))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], SCHEMA)
    want = sorted(map(tuple, B.banded_links(df, "id", "v", 0.95).collect()))
    monkeypatch.setattr(B, "BLOCK_ROWS", 7)
    assert sorted(map(tuple, B.banded_links(df, "id", "v", 0.95).collect())) == want
    exact = {r["id"]: r["n_links"] for r in C.semantic_links(df, "id", "v", 0.95).collect()}
    assert sum(n for _, n, _ in want) >= 0.9 * sum(exact.values())
    assert B.banded_links(df.limit(0), "id", "v").count() == 0


def test_stated_recall():
    """What the docstring states, by simulation."""
    assert abs(B.recall(0.9) - 0.94) < 0.01 and B.recall(0.95) > 0.99
    rng = np.random.default_rng(1)
    a = rng.normal(size=(2000, 32))
    b = rng.normal(size=(2000, 32))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b -= (a * b).sum(1, keepdims=True) * a
    b /= np.linalg.norm(b, axis=1, keepdims=True)
    other = 0.9 * a + math.sqrt(1 - 0.81) * b
    agree = (B.signatures(a, B.BITS, B.BANDS) == B.signatures(other, B.BITS, B.BANDS)).any(1).mean()
    assert abs(agree - B.recall(0.9)) < 0.03
