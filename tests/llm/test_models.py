"""Kneser-Ney probabilities, archives that aren't well formed, many rules, long documents, texts that aren't UTF-8: small cases against plain Python."""

import functools
import gzip
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

pytest.importorskip("corvane.llm")

import public_tokenizers
from tokenizers import Tokenizer

from corvane.llm import lmscore, minhash, packing, pieces, pii, quality, toxicity, urlfilter, warc

BPE, PIECES = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("piece_bpe_32k.model")


def corpus(seed):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(12)]
    return [([rng.choice(words[: 8 + 4 * c]) for _ in range(rng.randrange(1, 40))], c) for c in (0, 1) for _ in range(25)]


def plain_models(texts):
    """The definition in the module's docstring with dictionaries; ``None`` stands for all unknown words, ``^`` for a text's start."""
    triples = [{((["^", "^", *w])[i], (["^", *w])[i], w[i]) for w, c in texts if c == k for i in range(len(w))} for k in (0, 1)]
    both = triples[0] | triples[1]
    vocabulary = [*sorted({w for t in texts for w in t[0]}), None]
    d, d0 = toxicity.DISCOUNT, toxicity.SHARED_DISCOUNT

    def counts(found):
        pairs = Counter((h, w) for _, h, w in found)
        return pairs, Counter(w for _, w in pairs)

    pairs, n = counts(both)
    total = sum(n.values())
    u = {w: (max(n[w] - d0, 0) + sum(min(x, d0) for x in n.values()) / len(vocabulary)) / total for w in vocabulary}

    def by_context(p):
        out = defaultdict(dict)
        for (h, w), x in p.items():
            out[h][w] = x
        return out

    shared = by_context(pairs)

    def discounted(seen, backoff):
        t = sum(seen.values())
        return {w: (max(seen.get(w, 0) - d, 0) + sum(min(x, d) for x in seen.values()) * backoff[w]) / t for w in vocabulary} if t else dict(backoff)

    def model(k):
        own, m = counts(triples[k])
        p = discounted(m, u)
        contexts = by_context(own)

        def prob(h):
            s = discounted(shared.get(h, {}), u)
            b = {w: s[w] * p[w] / u[w] for w in vocabulary}
            z = sum(b.values())
            return discounted(contexts.get(h, {}), {w: x / z for w, x in b.items()})

        return prob

    return vocabulary, [model(0), model(1)]


@pytest.mark.parametrize("seed", [1, 2])
def test_kneser_ney(seed):
    texts = corpus(seed)
    models = toxicity.count(texts)
    vocabulary, plain = plain_models(texts)
    number = models.numbers | {None: toxicity.UNKNOWN, "^": toxicity.START}
    w = np.array([number[x] for x in vocabulary])
    for h in [*vocabulary, "^"]:
        for c in (0, 1):
            got = models.log_prob(c, np.full(len(w), number[h]), w)
            assert np.exp(got).sum() == pytest.approx(1)
            want = plain[c](h)
            assert np.allclose(got, [math.log(want[x]) for x in vocabulary])
    evidence = toxicity.Evidence(models)
    text = [random.Random(seed).choice([*vocabulary[:-1], "new"]) for _ in range(200)]
    own = np.array([number.get(x, toxicity.UNKNOWN) for x in text])
    before = np.concatenate([[toxicity.START], own[:-1]])
    want = models.log_prob(1, before, own) - models.log_prob(0, before, own)
    got = evidence.of(np.array([evidence.numbers[x] for x in text]), np.array([0]))
    assert np.allclose(got, want)
    x = toxicity.features(evidence, [" ".join(text), "", None])
    assert x[0, 0] == pytest.approx(want.mean()) and x[0, 2] == pytest.approx(max(want[0] / 2, *(want[:-1] + want[1:]) / 2)) and not x[1:].any()


def test_toxicity_sample(spark):
    """Bounded in rows and bytes, and the same whatever the order of rows."""
    docs = [(i, f"text {i} " * 20) for i in range(200)] + [(7, "another text of the same id"), (8, ""), (9, None)]
    labels = [(i, i % 2) for i in range(200)] * 2
    frame = lambda rows, seed: spark.createDataFrame(random.Random(seed).sample(rows, len(rows)), "doc_id long, text string" if len(rows[0]) == 2 and rows is docs else "doc_id long, toxic int")
    one, other = (sorted(zip(*toxicity.sample(frame(docs, s), frame(labels, s), 30, 20, 3000)[:2], strict=True)) for s in (1, 2))
    assert one == other and 0 < len(one) <= 50
    for mark in (0, 1):
        assert sum(len(t) for t, m in one if m == mark) <= 3000


def test_long_labelled_texts(spark):
    """A text over the bound is cut for learning, and one that doesn't fit any more doesn't end the sample."""
    labels = spark.createDataFrame([(i, i % 2) for i in range(400)], "doc_id long, toxic int")
    first = next(r["doc_id"] for r in labels.filter("toxic = 1 AND crc32(cast(doc_id AS string)) % 4 <> 2").orderBy(F.xxhash64("doc_id")).collect())
    texts = [(i, f"vile{i % 5} words number {i}" if i % 2 else f"kind{i % 5} words number {i}") for i in range(400)]
    plain = spark.createDataFrame(texts, "doc_id long, text string")
    long = spark.createDataFrame([(i, "vile1 " * 5000 if i == first else t) for i, t in texts], "doc_id long, text string")
    usual, marks, _ = toxicity.sample(plain, labels, 300, 300, 20_000)
    got, got_marks, _ = toxicity.sample(long, labels, 300, 300, 20_000)
    assert set(zip(usual, marks, strict=True)) - set(zip(got, got_marks, strict=True)) == {(dict(texts)[first], 1)}  # too long for the bytes: passed over
    cut, cut_marks, _ = toxicity.sample(long, labels, 300, 300, 20_000, learned_chars=600)
    assert len(cut) == len(usual) and ("vile1 " * 100, 1) in set(zip(cut, cut_marks, strict=True))
    assert toxicity.train(long, labels, 300, 300, 20_000) is not None


def test_fit_and_score_plainly(spark):
    """The fitted weights are those of the best logistic function, over features of the plain models; scores follow from both."""
    rng = random.Random(4)
    texts = [(i, " ".join(rng.choice(["grim", "foul", "vile"] if i % 3 == 0 and rng.random() < 0.4 else ["mill", "path", "calm", "blue"]) for _ in range(rng.randrange(1, 25)))) for i in range(500)] + [(500, ""), (501, None)]
    docs, labels = spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(500)], "doc_id long, toxic int")
    found, marks, rate = toxicity.sample(docs, labels)
    rows = sorted(set(zip(found, marks, strict=True)))
    counted = [(toxicity.words(t), y) for t, y in rows if zlib.crc32(t.encode()) % 3]
    held = [(t, y) for t, y in rows if not zlib.crc32(t.encode()) % 3]
    vocabulary, models = plain_models(counted)
    prob = {c: functools.cache(models[c]) for c in (0, 1)}

    def plain_features(text):
        w = [x if x in vocabulary else None for x in toxicity.words(text)]
        each = [math.log(prob[1](h)[x]) - math.log(prob[0](h)[x]) for h, x in zip(["^", *w], w)]
        return [sum(each) / len(each), *(max(sum(each[max(0, i + 1 - k) : i + 1]) / k for i in range(len(each))) for k in toxicity.WINDOWS), 1.0] if each else [0.0] * (1 + len(toxicity.WINDOWS)) + [1.0]

    weights = toxicity.train(docs, labels).weights
    sigma = lambda x: 1 / (1 + math.exp(-sum(a * b for a, b in zip(x, weights, strict=True))))
    share = sum(y for _, y in held) / len(held)
    slope = [-1e-2 * b for b in weights]
    for t, y in held:
        x = plain_features(t)
        for k in range(len(slope)):
            slope[k] += (rate / share if y else (1 - rate) / (1 - share)) * (y - sigma(x)) * x[k]
    assert max(map(abs, slope)) < 1e-4
    for r in toxicity.scored(docs, labels).collect():
        own = sigma(plain_features(dict(texts)[r["doc_id"]]))
        assert r["score"] == pytest.approx(own, abs=1e-6) and r["predicted"] == int(r["score"] >= 0.3)


def test_bad_lengths(tmp_path):
    """Records without a length, or with one that is no number, end where the next begins; nothing raises."""
    good = warc.record({"record_id": "a", "record_type": "response", "payload": b"one"})
    for bad in (b"Content-Length: many", b"Content-Length: -1", b"X: y", b"Content-Length: 9" + b"9" * 30):
        head, _, block = good.partition(b"\r\n\r\n")
        lines = [line for line in head.split(b"\r\n") if not line.startswith(b"Content-Length")]
        odd = b"\r\n".join([*lines, bad]).replace(b"<a>", b"<b>") + b"\r\n\r\n" + block
        (tmp_path / "x.warc").write_bytes(odd + good + odd)
        (tmp_path / "y.warc.gz").write_bytes(warc.member(odd) + gzip.compress(odd) + warc.member(good))
        for name in ("x.warc", "y.warc.gz"):
            for plan in (warc.Plan(), warc.Plan(payload=False)):
                rows = list(warc.records(str(tmp_path / name), plan))
                assert [r["record_id"] for r in rows] == (["b", "a", "b"] if name == "x.warc" else ["b", "b", "a"])
                assert all(r["http_length"] == 3 and r["payload"] == (b"one" if plan.payload else None) for r in rows)
                assert {r["content_length"] for r in rows if r["record_id"] == "b"} == {None}


def test_headers_only_need_no_payload(tmp_path):
    """Without payloads, what follows the HTTP headers may hold anything."""
    data = warc.record({"record_id": "a", "record_type": "response", "payload": random.Random(1).randbytes(300000)})
    broken = bytearray(warc.member(data))
    broken[-1000:-8] = b"\0" * 992
    (tmp_path / "x.warc.gz").write_bytes(bytes(broken) * 2)
    rows = list(warc.records(str(tmp_path / "x.warc.gz"), warc.Plan(payload=False)))
    assert [r["http_length"] for r in rows] == [300000, 300000]


def test_round_trip_reads_by_kind(spark):
    pages = spark.createDataFrame([(i, "u", "x" * (i % 3)) for i in range(30)], "page_id long, url string, html string")
    back = warc.round_trip(pages)
    assert back.filter("record_type = 'revisit'").count() == 27
    assert not any("Filter" in line and ("revisit" in line or "response" in line) for line in back._jdf.queryExecution().executedPlan().toString().split("\n"))  # left to the source


def test_many_rules(spark, monkeypatch):
    """Rules that are joined by domain judge like those in one expression."""
    rng = random.Random(2)
    name = lambda: ".".join(rng.choice(["a", "b", "com", "net", ""]) for _ in range(rng.randrange(1, 4)))
    rules = [(rng.choice(["allow", "block"]), f"{name()}/{rng.choice(['', 'x/', 'x/y', 'z'])}") for _ in range(60)]
    rules = list({r: (k, r) for k, r in rules}.values())
    rows = [(i, f"http://{name()}{rng.choice(['', '/', '/x/', '/x/yy?q', '/z#f'])}") for i in range(400)] + [(400, None), (401, "none")]
    pages, listed = spark.createDataFrame(rows, "page_id long, url string"), spark.createDataFrame([("a.com/x",), ("b",)], "url string")
    want = sorted(map(repr, urlfilter.judge(pages, rules, listed).collect()))
    monkeypatch.setattr(urlfilter, "MOST_RULES", 10)
    assert sorted(map(repr, urlfilter.judge(pages, rules, listed).collect())) == want


def test_filter_without_broadcast(spark, monkeypatch):
    """Long URLs, and tables too large to broadcast."""
    rows = [(i, f"http://h{i % 7}.org/{'p' * (i % 50)}{'y' * 20000 if i % 10 == 0 else ''}") for i in range(200)]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    listed = pages.filter("page_id % 3 = 0").select(urlfilter.canonical(F.col("url")).alias("url"))
    want = sorted(map(repr, urlfilter.judge(pages, [("allow", "h1.org/")], listed).collect()))
    monkeypatch.setattr(urlfilter, "small", lambda df: df)
    assert sorted(map(repr, urlfilter.judge(pages, [("allow", "h1.org/")], listed).collect())) == want
    keys = {r["url"] for r in listed.collect()}
    for row, (i, url) in zip(sorted(urlfilter.judge(pages, [], listed).collect()), rows, strict=True):
        assert row["page_id"] == i and (row["verdict"] == "block") == (url.removeprefix("http://").rstrip("/") in keys)


def test_long_documents(spark):
    """Documents of many sequences, other alphabets, words of any length: ids as the library gives them, each once, and small groups."""
    rng = random.Random(3)
    texts = [" ".join(rng.choice(["river", "mill", "été", "日本", "x" * 300, "it's", "№5", "don't!?"]) for _ in range(n)) for n in (0, 1, 9000, 40, 3000)] + ["ab" * 30000]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    tokenizer = Tokenizer.from_file(BPE)
    for group_rows in (1, 100):
        by = defaultdict(list)
        for r in packing.sequences(df, BPE, group_rows=group_rows).collect():
            by[r["sequence_id"]] = r["ids"][: r["n_ids"]]
        got = defaultdict(list)
        placed = packing.pack(df, BPE, group_rows=group_rows).collect()
        for r in sorted(placed, key=lambda r: r["start"]):
            got[r["doc_id"]] += by[r["sequence_id"]][r["offset"] : r["offset"] + r["length"]]
        for i, t in enumerate(texts):
            assert got[i] == [*tokenizer.encode(t, add_special_tokens=False).ids, 2]
        assert sum(map(len, by.values())) == sum(r["length"] for r in placed)


def test_unsketched_classes(spark):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(200)]
    rows = [(g * 10 + i, " ".join([rng.choice(words) for _ in range(3)] + words[g * 30 : g * 30 + 90 - i])) for g in range(3) for i in range(4)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(repr, minhash.classes(df, sketched=False).collect())) == sorted(map(repr, minhash.classes(df).collect()))


def test_bytes_that_are_no_text(spark):
    """Each operator reads the text without them."""
    bad = spark.range(3).select(F.col("id").alias("doc_id"), F.expr("cast(concat(cast('one two ' as binary), X'FFC3', cast('three four five six' as binary)) as string)").alias("text"), F.lit("h").alias("source"))
    good = bad.withColumn("text", F.lit("one two three four five six"))
    labels = spark.createDataFrame([(0, 1)], "doc_id long, toxic int")
    for op in (minhash.classes, pii.digest, pii.clean, lambda d: packing.pack(d, BPE), lambda d: pieces.digest(d, PIECES), lambda d: lmscore.score(d, labels.select("doc_id")), lambda d: toxicity.scored(d, labels)):
        assert sorted(map(repr, op(bad).collect())) == sorted(map(repr, op(good).collect()))
    assert quality.digest(bad).count() == 3
