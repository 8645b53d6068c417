"""Chunking folds and splitters on hand-made and random texts."""

import hashlib
import json
import re

from hypothesis import given
from hypothesis import strategies as st

from corvane.operators import chunking as K

SF = "/root/testdata/sf0.001"


def chunk(n, **meta):
    return "x" * n, meta


def lengths(chunks):
    return [len(c) for c, _ in chunks]


def test_merge_small():
    assert lengths(K.merge_small([chunk(1000), chunk(1500), chunk(300)])) == [2804]
    assert lengths(K.merge_small([chunk(300)])) == [300]
    assert K.merge_small([]) == []


def test_clean_small():
    assert K.clean_small([("a" * 500, {}), ("b" * 3000, {})]) == [("a" * 500 + "\n\n" + "b" * 3000, {})]
    assert K.clean_small([("a" * 3000, {}), ("b" * 500, {})]) == [("a" * 3000 + "\n\n" + "b" * 500, {})]
    assert lengths(K.clean_small([chunk(10)])) == [10]


def test_metadata():
    assert K.join_meta({"H1": "A", "H2": "B"}, {"H2": "C", "H3": "D"}) == {"H1": "A", "H2": "B -> C", "H3": "D"}


def test_headers():
    found = K.split_headers("intro\n\n# A\n## B\ntext\n\n### C\nmore\n# D\nend")
    assert [m for _, m in found] == [{}, {"H1": "A", "H2": "B"}, {"H1": "A", "H2": "B", "H3": "C"}, {"H1": "D"}]
    assert found[1][0] == "# A  \n## B\ntext"


def test_fence_suspends_headers():
    found = K.split_headers("# A\n```\n# no header\n```\ntext")
    assert found == [("# A\n```\n# no header\n```\ntext", {"H1": "A"})]


def test_none_and_empty():
    assert K.split_headers(None) == [] == K.split_headers("")
    assert K.parents("") == []


texts = st.text(alphabet="ab \n", max_size=400)


@given(texts, st.integers(5, 40), st.integers(0, 4))
def test_split_text(text, size, overlap):
    parts = K.split_text(text, size, overlap) if text else []
    assert all(0 < len(p) <= size for p in parts)
    squeezed = "".join(text.split())
    if overlap == 0:
        assert "".join("".join(p.split()) for p in parts) == squeezed


@given(st.lists(st.integers(1, 3000), max_size=12))
def test_folds_lose_nothing(sizes):
    chunks = [(chr(97 + i) * n, {}) for i, n in enumerate(sizes)]
    for fold in (K.merge_small, K.clean_small):
        assert "".join(c for c, _ in fold(chunks)).replace("\n\n", "") == "".join(c for c, _ in chunks)


def test_frames(spark):
    docs = spark.createDataFrame([(1, "word " * 3000, "x"), (2, None, "y"), (3, "", "z")], "doc_id long, text string, content string")
    from pyspark.sql import functions as F

    parents = K.parent_chunks(docs.select("doc_id", "text"), "doc_id", "text", F.concat(F.lit("d"), F.col("doc_id").cast("string")))
    rows = sorted(parents.collect(), key=lambda r: r["idx"])
    assert [r["parent_id"] for r in rows] == [f"d1_parent_{i}" for i in range(len(rows))] and len(rows) == 2
    assert rows[0]["metadata"]["source"] == "d1.pdf"
    children = K.child_chunks(parents).collect()
    assert all(len(c["content"]) <= 500 for c in children) and {c["parent_id"] for c in children} == {r["parent_id"] for r in rows}


def spec_split(text, size, overlap, separators=("\n\n", "\n", " ", "")):
    """The specification of recursive splitting, word for word: pieces keep their separator in front; small ones are merged."""
    used = next(s for s in separators if s == "" or s in text)
    rest = separators[separators.index(used) + 1 :]
    if used:
        starts = [0] + [m.start() for m in re.finditer(re.escape(used), text)]
        pieces = [p for p in (text[a:b] for a, b in zip(starts, starts[1:] + [len(text)], strict=True)) if p]
    else:
        pieces = list(text)
    chunks, window = [], []

    def emit():
        if joined := "".join(window).strip():
            chunks.append(joined)

    for piece in pieces:
        if len(piece) >= size and rest:
            emit()
            window.clear()
            chunks += spec_split(piece, size, overlap, rest)
            continue
        if window and len("".join(window)) + len(piece) > size:
            emit()
            while window and (len("".join(window)) > overlap or len("".join(window)) + len(piece) > size):
                del window[0]
        window.append(piece)
    emit()
    return chunks


@given(st.text(alphabet="ab \n", max_size=300), st.integers(5, 40), st.integers(0, 4))
def test_split_like_specification(text, size, overlap):
    assert K.split_text(text, size, overlap) == spec_split(text, size, overlap) if text else True


def spec_sections(text):
    """Paragraphs with their headers; neighbours with equal headers, and a lone header with what is deeper, are joined."""
    found, path, own, fence = [], {}, [], None

    def end():
        if own:
            found.append(["\n".join(own), dict(path)])
            own.clear()

    for raw in text.split("\n"):
        line = "".join(filter(str.isprintable, raw.strip()))
        if fence:
            own.append(line)
            fence = None if line.startswith(fence) else fence
        elif m := re.match(r"(```|~~~)(?!.*\1)", line):
            fence = m[1]
            own.append(line)
        elif m := re.match(r"(#{1,3})(?: |$)(.*)", line):
            end()
            path = {k: v for k, v in path.items() if k < f"H{len(m[1])}"} | {f"H{len(m[1])}": m[2].strip()}
            own.append(line)
        elif line:
            own.append(line)
        else:
            end()
    end()
    out = []
    for content, meta in found:
        if out and (out[-1][1] == meta or (len(out[-1][1]) < len(meta) and out[-1][0].split("\n")[-1][:1] == "#")):
            out[-1] = [f"{out[-1][0]}  \n{content}", meta]
        else:
            out.append([content, meta])
    return out


def spec_parents(text):
    def glue(a, b):
        return [a[0] + "\n\n" + b[0], {k: " -> ".join(m[k] for m in (a[1], b[1]) if k in m) for k in sorted(a[1].keys() | b[1].keys())}]

    merged, held = [], None
    for c in spec_sections(text):
        held = glue(held, c) if held else c
        if len(held[0]) >= 2000:
            merged.append(held)
            held = None
    if held:
        merged[-1:] = [glue(merged[-1], held)] if merged else [held]
    split = [[part, c[1]] for c in merged for part in (spec_split(c[0], 10000, 100) if len(c[0]) > 10000 else [c[0]])]
    out = []
    for i, c in enumerate(split):
        if len(c[0]) >= 2000 or not (out or i + 1 < len(split)):
            out.append(c)
        elif out:
            out[-1] = glue(out[-1], c)
        else:
            split[i + 1] = glue(c, split[i + 1])
    return out


def test_queries_without_sql(spark):
    """Every row of the three queries that SQL can't state."""
    from corvane.plans import chunking as plans

    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    md5 = lambda t: hashlib.md5(t.encode()).hexdigest()
    large = {(d, i, len(p), md5(p)) for d, t in texts.items() for i, p in enumerate([x for c, _ in spec_sections(t or "") for x in (spec_split(c, 10000, 100) if len(c) > 10000 else [c])])}
    rows = plans.split_large_parents(spark, SF).collect()
    assert {tuple(r) for r in rows} == large and len(rows) == len(large)
    want = {(f"doc{d}_parent_{i}", j, len(c), md5(c)) for d, t in texts.items() for i, (p, _) in enumerate(spec_parents(t or "")) for j, c in enumerate(spec_split(p, 500, 100))}
    rows = plans.child_chunks(spark, SF).collect()
    assert {tuple(r) for r in rows} == want and len(rows) == len(want)
    pages = {r["page_id"]: r["md"] for r in plans.markdown(spark, SF).collect()}
    want = {
        (f"page{d}_parent_{i}", j, c, json.dumps(dict(sorted((m | {"source": f"page{d}.pdf", "parent_id": f"page{d}_parent_{i}"}).items())), separators=(",", ":"), ensure_ascii=False))
        for d, t in pages.items() for i, (p, m) in enumerate(spec_parents(t)) for j, c in enumerate(spec_split(p, 500, 100))
    }
    rows = plans.chunk_pipeline(spark, SF).collect()
    assert {tuple(r) for r in rows} == want and len(rows) == len(want)


def test_markdown_of_pages(spark):
    """No text of a page is lost, nothing in it reads as markup, and references of all kinds are decoded."""
    from pyspark.sql import functions as F

    from corvane.functions import text as T

    rows = [
        (1, "<title>t</title><nav>n</nav><h1 class=x>A &amp; B</h1><div>after</div><P>one <b>two</b>&#10;&#x41;&#8364;&#0;&#xD800;</p><p class='y'># no heading</p><pre>kept</pre>"),
        (2, "no tags"),
        (3, None),
        (4, "<h1></h1><p>x"),
    ]
    df = spark.createDataFrame(rows, "page_id long, html string")
    got = {r["page_id"]: r["md"] for r in df.select("page_id", T.html_to_markdown(F.col("html")).alias("md")).collect()}
    assert got[1] == "t n\n\n# A & B\nafter\n\n## Part 1\none two A€&#0;&#xD800;\n\n## Part 2\n\\# no heading kept"
    assert got[2] == "no tags" and got[3] == "" and got[4] == "\n\n# \n\n\n## Part 1\nx"
    assert df.select(T.html_to_text(F.lit("&#x1F600;&amp;#65; &#99999999;")).alias("t")).first()["t"] == "😀&#65; &#99999999;"


def test_bytes_that_are_no_text(spark):
    from pyspark.sql import functions as F

    docs = spark.range(1).select(F.col("id").alias("doc_id"), F.expr("cast(concat(cast('# a b' as binary), X'FF', cast(' c' as binary)) as string)").alias("text"))
    assert [r["content"] for r in K.sections(docs, "doc_id", "text").collect()] == ["# a b c"]
