"""Every operator and stage on empty tables, null columns, empty and very long texts, repeated rows and clashing extra columns."""

import pytest
from pyspark.sql import functions as F

pytest.importorskip("corvane.llm")

import public_tokenizers

import corpus_pipeline
from corvane.llm import ann, lmscore, minhash, packing, pieces, pii, quality, toxicity, urlfilter, warc
from corvane.llm.queries import RULES

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
BPE, PIECES = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("piece_bpe_32k.model")
PROSE = "the river runs past the old mill and the quiet fields where nobody walks at night because the path is long"
LONG = " ".join(f"word{i}" for i in range(30000))
ROWS = [
    (1, PROSE, "en", "a", 1),
    (1, PROSE, "en", "a", 1),
    (2, None, None, None, None),
    (3, "", "en", "a", 0),
    (None, PROSE + " again", "en", None, 1),
    (4, LONG, "en", "b", 1),
    (5, "x" * 50000, "en", "b", 1),
    (6, "\n \t\x0b", "en", "b", 1),
    (7, "mail a@b.co 1.2.3.4 😀 ﬁ <|endoftext|>", "de", "b", 1),
]
#: Names that operators use inside or return.
CLASHES = ["class_id", "score", "rank", "copy", "band", "rep", "root", "sketch", "kept", "spans", "length", "start", "node", "host", "path", "rule", "word", "id", "a", "b", "n", "hub"]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, DOCS)


@pytest.fixture(scope="module")
def clashing(docs):
    return docs.withColumns({c: F.lit("other") for c in CLASHES})


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def labels(spark):
    rows = [(i, i % 2, i % 2) for i in range(1, 8)] + [(None, 1, 1), (2, None, None)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


OPERATORS = {
    "lm": lambda d, l: lmscore.score(d, l.filter("quality = 1")),
    "pii": lambda d, l: pii.digest(d),
    "packing": lambda d, l: packing.pack(d, BPE),
    "minhash": lambda d, l: minhash.classes(d),
    "toxicity": lambda d, l: toxicity.scored(d, l),
    "pieces": lambda d, l: pieces.digest(d, PIECES),
    "quality": lambda d, l: quality.digest(d),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_all_rows_come_back(docs, clashing, none, labels, name):
    op = OPERATORS[name]
    own = sorted(map(repr, op(docs, labels).collect()))
    if name != "packing":
        assert len(own) == len(ROWS)
    assert sorted(map(repr, op(clashing, labels).collect())) == own
    assert op(none, labels).count() == 0
    assert op(docs, labels.limit(0)).count() == len(own)


def test_toxic_without_labels(docs, labels):
    assert {r["score"] for r in toxicity.scored(docs, labels.limit(0)).collect()} == {0.0}


def test_values(docs, labels):
    by = {r["doc_id"]: r for r in quality.digest(docs).collect()}
    assert by[2]["n_words"] == 0 and by[2]["base_failed"] and not by[2]["kept"]
    assert by[4]["n_words"] == 30000 and by[4]["kept"] and by[6]["n_words"] == 0
    classes = {(r["doc_id"], r["class_id"]) for r in minhash.classes(docs).collect()}
    assert {(2, 2), (3, 2), (6, 2), (1, 1), (4, 4), (5, 5), (7, 7)} <= classes
    spans = {r["doc_id"]: r for r in pii.digest(docs).collect()}
    assert (spans[7]["n_email"], spans[7]["n_ip"], spans[2]["spans"], spans[3]["n_card"]) == (1, 1, "", 0)
    lm = {r["doc_id"]: r for r in lmscore.score(docs, labels.filter("quality = 1")).collect()}
    assert lm[2]["score"] is None and lm[2]["n_tokens"] == 0 and lm[4]["score"] is not None


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages(spark, docs, clashing, none, tmp_path, name, labels):
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    stage = dict(corpus_pipeline.STAGES)[name]
    out = stage(spark, docs, str(tmp_path))
    wide = stage(spark, clashing, str(tmp_path))
    if name != "packing":
        assert out.columns == docs.columns and wide.columns == clashing.columns
    assert wide.count() == out.count()
    assert stage(spark, none, str(tmp_path)).count() == 0


def test_deduplicated_keeps_one(docs):
    rows = minhash.deduplicated(docs).collect()
    ids = [r["doc_id"] for r in rows]
    assert sorted(i for i in ids if i is not None) == [1, 2, 4, 5, 7]


def test_urls(spark):
    rows = [(1, None), (2, ""), (3, "no scheme"), (4, "http://A.Com"), (5, "http://a.com/"), (5, "http://a.com/"), (6, "x://b.net/es/?utm_source=1"), (None, "http://b.org/p#f"), (7, "http://www.b.org/p/"), (8, "://")]
    pages = spark.createDataFrame(rows, "page_id long, url string").withColumns({"rule": F.lit("x"), "verdict": F.lit("x"), "host": F.lit("x")})
    listed = spark.createDataFrame([("b.org/p",), ("b.org/p",), (None,)], "url string")
    got = {(r["page_id"], r["host"], r["path"], r["rule"], r["verdict"]) for r in urlfilter.judge(pages, RULES, listed).collect()}
    assert (1, "", "", None, "allow") in got and (4, "a.com", "", None, "allow") in got and (5, "a.com", "/", "com/", "allow") in got
    assert (6, "b.net", "/es/", "net/es/", "block") in got and (None, "b.org", "/p", None, "block") in got and (7, "www.b.org", "/p/", None, "block") in got
    assert urlfilter.judge(pages, RULES, listed).count() == len(rows)
    assert urlfilter.judge(pages.limit(0), RULES, listed.limit(0)).count() == 0


def test_warc(spark):
    rows = [(1, "http://a/\nb", "x"), (2, None, "x"), (3, "u", None), (4, "u", ""), (4, "u", ""), (None, "u", "é" * 100000), (5, "u", "x\r\n\r\ny")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"payload": F.lit("x"), "record_type": F.lit("x")})
    got = {(r["page_id"], r["payload_bytes"], r["record_type"], r["refers_to"]) for r in warc.round_trip(pages).collect()}
    assert got == {(1, 1, "response", None), (2, 1, "revisit", 1), (3, 0, "response", None), (4, 0, "revisit", 3), (None, 200000, "response", None), (5, 6, "response", None)}
    assert warc.round_trip(pages.limit(0)).count() == 0
    assert {r["record_type"] for r in warc.round_trip(pages, least_bytes=2).collect()} == {"response"}


def test_vectors(spark):
    good = [[float((i * j) % 7 - 3) for j in range(1, 9)] for i in range(1, 40)]
    rows = [(i, v) for i, v in enumerate(good)] + [(50, None), (51, []), (52, [0.0] * 8), (53, [1.0, None] * 4), (54, [float("nan")] * 8), (55, [float("inf")] * 8), (56, [1.0, 2.0]), (0, good[0]), (None, good[1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumns({"rank": F.lit(1), "score": F.lit(1), "query_id": F.lit(1)})
    got = ann.search(df, df.filter("vec_id % 20 = 0"), k=100).collect()
    assert {r["query_id"] for r in got} == {0, 20} and len(got) == 2 * 38
    assert {r["vec_id"] for r in got} <= set(range(39))
    assert ann.search(df.limit(0), df.limit(0)).count() == 0


def test_deduplicated_by_row(spark):
    """Rows without an id all stay, unrelated texts of one id too, and a class whose first row's id also names a dropped row keeps that first row."""
    texts = [" ".join(f"{c}{i}" for i in range(40)) for c in "abcd"]
    rows = [(None, texts[0]), (None, texts[1]), (None, texts[1] + " more"), (7, texts[2]), (7, texts[2]), (7, texts[3]), (5, texts[3] + " more"), (8, texts[2] + " more"), (9, texts[1])]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n", F.lit(1))
    left = minhash.deduplicated(df)
    assert left.columns == ["doc_id", "text", "n"]
    assert sorted(map(repr, left.select("doc_id", "text").collect())) == sorted(map(repr, spark.createDataFrame([rows[i] for i in (0, 1, 2, 3, 6, 8)], df.select("doc_id", "text").schema).collect()))


def test_classes_without_ids(spark):
    """A near copy without an id has the class of its group."""
    df = spark.createDataFrame([(3, PROSE + " here"), (None, PROSE), (4, PROSE + " there"), (None, "alone and without an id at all")], "doc_id long, text string")
    assert sorted(map(repr, minhash.classes(df).collect())) == sorted(["Row(doc_id=3, class_id=3)", "Row(doc_id=None, class_id=3)", "Row(doc_id=4, class_id=3)", "Row(doc_id=None, class_id=None)"])
