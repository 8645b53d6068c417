"""Hard negatives, spelling variants and token files against brute force, and their edge cases."""

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

pytest.importorskip("corvane.llm")

import public_tokenizers
from tokenizers import Tokenizer

from corvane.llm import hardneg, queries, spelling, tokenfile

SF = "/root/testdata/sf0.001"
BPE = public_tokenizers.path("word_bpe_49k.json")


def negatives(rows, anchor, n_positives=5, n_negatives=10):
    """``rows``: id, label, whole components; plain Python numbers."""
    out = []
    for i, label, x in rows:
        if not anchor(i):
            continue
        score = {j: sum(a * b for a, b in zip(x, y)) for j, _, y in rows}
        order = sorted((j for j, _, _ in rows if j != i), key=lambda j: (-score[j], j))
        of = {j: m for j, m, _ in rows}
        for p in [j for j in order if of[j] == label][:n_positives]:
            own = [j for j in order if of[j] != label and 30 * score[p] <= 100 * score[j] <= 90 * score[p]][:n_negatives]
            out += [(i, p, k, j, score[p], score[j]) for k, j in enumerate(own, 1)]
    return sorted(out)


@pytest.mark.parametrize(("block_rows", "anchor_rows"), [(8192, 1024), (7, 3), (1, 1)])
def test_negatives(spark, block_rows, anchor_rows):
    rng = random.Random(5)
    rows = [(i, 0 if i % 3 else rng.randrange(4), [rng.choice([-1.0, 0.25, 0.7, 1.0]) for _ in range(9)]) for i in range(60)]
    rows += [(100 + i, i % 2, [0.5] * 9) for i in range(30)]  # ties
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>")
    got = hardneg.mine(df, F.col("vec_id") % 10 == 0, block_rows=block_rows, anchor_rows=anchor_rows)
    whole = [(i, label, [int(np.floor(256 * float(np.float32(x)))) for x in v]) for i, label, v in rows]
    assert sorted(map(tuple, got.collect())) == negatives(whole, lambda i: i % 10 == 0)


def test_negatives_query(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").collect()
    whole = [(r["vec_id"], (r["label"] + 1) % 10 if r["vec_id"] % 7 == 0 else r["label"], [int(np.floor(256 * float(x))) for x in r["embedding"]]) for r in rows]
    assert sorted(map(tuple, queries.op11_hard_negatives(spark, SF).collect())) == negatives(whole, lambda i: i % 100 == 0)


def test_negatives_edges(spark):
    rows = [
        (0, 1, [1.0, 1.0]), (0, 1, [1.0, 1.0]), (0, 2, [9.0, 9.0]), (1, 1, [1.0]), (2, 2, [0.5, 0.0, 0.0]), (3, 1, None), (4, None, [1.0, 1.0]), (5, 2, [None, 1.0]),
        (6, 2, [float("nan"), 1.0]), (7, 2, [float("inf"), 1.0]), (None, 2, [0.5, 0.5]), (8, 2, []), (10, 9, [1.0, 1.0]), (20, 1, [-1.0, 0.0]),
    ]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>").withColumns({c: F.lit("x") for c in ("rank", "score", "g", "own", "v", "anchor", "tile")})
    # 0 has label 1 once; 1 is its positive (65536), 2 half of that, 8 nothing; 20 points the other way, so has no negatives
    assert sorted(map(tuple, hardneg.mine(df, F.col("vec_id") % 10 == 0).collect())) == [(0, 1, 1, 2, 65536, 32768)]
    assert hardneg.mine(df.limit(0), F.col("vec_id") % 10 == 0).count() == 0
    assert hardneg.mine(df, F.col("vec_id") == 999).count() == 0
    assert hardneg.mine(df.withColumn("embedding", F.lit(None).cast("array<double>")), F.col("vec_id") == 0).count() == 0


def test_product_of_large_numbers():
    a, b = np.array([[1 << 40, 3]]), np.array([[1 << 21, 5], [-(1 << 20), 7]])
    assert hardneg.product(a, b).tolist() == [[(1 << 61) + 15, -(1 << 60) + 21]]


def plain_variants(rows, drop_every=31, least=7, least_n=2):
    """``rows``: id, text."""
    fold = {i: i + 32 for i in range(65, 91)}
    n = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            word = run.translate(fold)
            h = zlib.crc32(f"{'' if i is None else i}:{word}".encode())
            if drop_every and h % drop_every == 0:
                k = h % len(word)
                word = word[:k] + word[k + 1 :]
            if len(word) >= least:
                n[word] += 1
    n = {w: c for w, c in n.items() if c >= least_n}
    near = defaultdict(set)
    for a in n:
        for b in n:
            if a != b and abs(len(a) - len(b)) <= 1 and one_edit(a, b):
                near[a].add(b)
    form = {}
    for w in n:
        if near[w]:
            best = min(near[w], key=lambda x: (-n[x], x))
            if n[best] >= 10 * n[w]:
                form[w] = best

    def root(w):
        return root(form[w]) if w in form else w

    return {(w, form.get(w), root(w), c, len(near[w]), n.get(form.get(w))) for w, c in n.items()}


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    i = next((i for i in range(len(a)) if a[i] != b[i]), len(a))
    return a[i + 1 :] == b[i + 1 :] if len(a) == len(b) else a[i:] == b[i + 1 :]


def test_variants(spark):
    """Chains of forms, ties, letters beyond a-z, long words, copies of rows."""
    rng = random.Random(3)
    bases = ["".join(rng.choice("abcdé") for _ in range(rng.randrange(7, 11))) for _ in range(12)]
    words = []
    for base in bases:
        words += [base] * 40
        for _ in range(25):
            k, c = rng.randrange(len(base)), rng.choice("abcdzÿ")
            words += [rng.choice([base[:k] + base[k + 1 :], base[:k] + c + base[k:], base[:k] + c + base[k + 1 :]])] * rng.choice([1, 2, 3, 4])
    words += ["chainings"] * 2000 + ["chaiinings"] * 150 + ["chaiiinings"] * 10 + ["chaiiiinings"]
    words += ["tieswords"] * 20 + ["tieswordt"] * 20 + ["tieswordz"] * 2
    words += ["q" * 3000] * 30 + ["q" * 2999] * 3 + ["q" * 3001] * 2
    rng.shuffle(words)
    texts = [(i, " ".join(words[at : at + 50])) for i, at in enumerate(range(0, len(words), 50))]
    texts += [(None, "nullified NULLIFIED"), (7, None), (8, ""), texts[0], texts[0], (9, "日本 мир ﬁligree ×÷×÷×÷×÷ \x00 Straße")]
    df = spark.createDataFrame(texts, "doc_id long, text string").withColumns({c: F.lit("x") for c in ("word", "n", "key", "band", "mask", "size")})
    for drop_every in (0, 31, 3):
        got = spelling.variants(spelling.vocabulary(df, drop_every=drop_every)).collect()
        own = {tuple(r) for r in got}
        assert len(got) == len(own)
        assert own == plain_variants(texts, drop_every)
        if not drop_every:
            by = {r["word"]: r for r in got}
            assert (by["chaiiinings"]["form"], by["chaiiinings"]["root"]) == ("chaiinings", "chainings")
            assert by["tieswordz"]["form"] == "tieswords"
    assert spelling.variants(spelling.vocabulary(df.limit(0))).count() == 0


def test_variants_query(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    assert {tuple(r) for r in queries.op12_spelling(spark, SF).collect()} == plain_variants(rows)


@settings(max_examples=200, deadline=None)
@given(word=st.text(alphabet="abcxyzéÿß", min_size=1, max_size=12), k=st.integers(0, 11), c=st.sampled_from("abzéÿ"))
def test_masks(word, k, c):
    """One edit leaves two bands of three as they were, or one, and at most two bits differ."""
    k %= len(word)
    for other in (word[:k] + word[k + 1 :], word[:k] + c + word[k:], word[:k] + c + word[k + 1 :]):
        a, b = spelling.masks([word, other])
        assert (int(a) ^ int(b)).bit_count() <= 2
        assert any((int(a) ^ int(b)) & spelling._band(j) == 0 for j in range(spelling.BANDS))


@settings(max_examples=150, deadline=None)
@given(data=st.data())
def test_blocks(data):
    n, most = data.draw(st.integers(1, 700)), data.draw(st.sampled_from([0, 1, 5, 255, 49407, (1 << 32) - 1]))
    rng = np.random.default_rng(data.draw(st.integers(0, 1000)))
    ids = rng.integers(0, most + 1, n).astype(np.uint32)
    ids[rng.random(n) < data.draw(st.sampled_from([0, 0.02, 0.3]))] = (1 << 32) - 1
    packed, sizes = tokenfile.pack(ids)
    assert sizes.sum() == len(packed)
    assert (tokenfile.unpack(np.frombuffer(packed, np.uint8), np.cumsum(sizes) - sizes)[:n] == ids).all()


def test_blocks_are_small_and_patched():
    ids = np.arange(5000, 5128, dtype=np.uint32)
    ids[[7, 90]] = 4_000_000_000
    packed, _ = tokenfile.pack(ids)
    head = np.frombuffer(packed[:6], tokenfile._HEAD)[0]
    assert (head["low"], head["width"], head["patches"]) == (5000, 7, 2)
    assert len(packed) == 6 + 16 * 7 + 2 * 5


def expected_tokens(rows, end=1):
    """``rows`` in order; id, start, count, checksum."""
    tokenizer, out, at = Tokenizer.from_file(BPE), [], 0
    for i, text in rows:
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, end], "<u4")
        out.append((i, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    return out


def test_tokens_query(spark):
    rows = sorted((r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect())
    assert sorted(map(tuple, queries.op13_token_ids(spark, SF).collect())) == expected_tokens(rows)


def test_token_files(spark, tmp_path, monkeypatch):
    """Edge cases, several files and blocks, predicates, appended tables, and what a lost task leaves behind."""
    rng = random.Random(1)
    rows = [(i, " ".join(rng.choice(["the", "mill", "quiet", "x1y", "日本"]) for _ in range(rng.randrange(200)))) for i in range(-20, 80)]
    rows += [(5, "again"), (5, "again"), (5, None), (None, "nobody"), (200, ""), (201, "word " * 60000), (202, "x" * 5000), (203, "<|endoftext|> a\x00b")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("x") for c in ("ids", "start", "n_tokens", "length")}).repartition(5)
    path = str(tmp_path / "tokens")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # several files for little data
    try:
        tokenfile.write(df, path, BPE)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    (tmp_path / "tokens" / "_part-000000-001-lost.pfor.tmp").write_bytes(b"half")
    (tmp_path / "tokens" / "part-000000-001-never-committed.pfor").write_bytes(b"PFOR0001")
    own = tokenfile.read(spark, path, binary=True).withColumn("crc", F.crc32("ids"))
    got = sorted(map(tuple, own.select("start", "doc_id", "n_tokens", "crc").collect()))
    assert [r[0] for r in got] == np.cumsum([0, *(r[2] for r in got)])[:-1].tolist()
    assert [r[1] for r in got] == sorted((i for i, _ in rows), key=lambda i: (i is not None, i))
    assert sorted((repr(i), n, c) for i, _, n, c in expected_tokens(rows)) == sorted((repr(i), n, c) for _, i, n, c in got)
    assert len({x["file"] for x in tokenfile.manifest(path)}) > 1
    array = {r["start"]: r for r in tokenfile.read(spark, path).filter("doc_id BETWEEN 3 AND 6 OR doc_id IS NULL").collect()}
    assert sorted(repr(r["doc_id"]) for r in array.values()) == sorted(map(repr, [3, 4, 5, 5, 5, 5, 6, None]))
    for clause, wanted in (("doc_id = 201", {201}), ("doc_id IN (3, 79, 1000)", {3, 79}), ("doc_id > 78 AND doc_id <= 200", {79, 200}), ("doc_id < -18", {-20, -19}), ("doc_id = 1000", set())):
        part = tokenfile.read(spark, path, binary=True).filter(clause)
        assert {r["doc_id"] for r in part.collect()} == wanted
        assert sorted(map(tuple, part.select("start", F.crc32("ids")).collect())) == [(r[0], r[3]) for r in got if r[1] in wanted]
    tokenfile.write(df.filter("doc_id = 79"), path, BPE)
    again = tokenfile.read(spark, path).filter("doc_id = 79").orderBy("start").collect()
    assert [r["start"] for r in again][1] == got[-1][0] + got[-1][2] and again[0]["ids"] == again[1]["ids"]
    tokenfile.write(df.limit(0), str(tmp_path / "none"), BPE)
    assert tokenfile.read(spark, str(tmp_path / "none")).count() == 0


def test_reads_only_wanted_blocks(spark, tmp_path):
    rows = [(i, "quiet mill " * 300) for i in range(60)]
    path = str(tmp_path / "tokens")
    tokenfile.write(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), path, BPE)

    class Counted:
        def __init__(self, f):
            self.f, self.n = f, 0

        def read(self, n):
            self.n += n
            return self.f.read(n)

        def __getattr__(self, name):
            return getattr(self.f, name)

    for x in tokenfile.manifest(path):
        name = f"{path}/{x['file']}"
        system, own = tokenfile.open_path(name)
        with system.open_input_file(own) as f:
            counted = Counted(f)
            wanted = (x["first"] + x["last"]) // 2
            (found,) = tokenfile.documents(counted, tokenfile.Bounds(wanted, wanted))
            assert found[0].tolist() == [wanted] and found[2].tolist() == [601] and len(found[3]) == 601
            whole = sum(n for _, n in [(0, f.size())])
            index = 8 * -(-x["n_ids"] // tokenfile.BLOCK) + 16 * x["n_docs"] + 48
            assert counted.n - index < max(1400, (whole - index) // 3)
