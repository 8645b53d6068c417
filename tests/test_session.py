"""The engine object from files to answers."""

import zipfile
import zlib

import pytest

from corvane.operators.dialogue import Analysis
from corvane.session import Engine
from corvane.sources import parsers

TEXT = "# Rivers\nThe river Oder rises in the mountains and flows to the sea.\n\n# Lakes\nLakes are still waters between hills."


def make_pdf(lines, deflate=False, cmap=None):
    """A PDF of one page."""
    shown = b" ".join(b"<%s> Tj T*" % t.encode("utf-16-be").hex().encode() if cmap else b"(%s) Tj T*" % t.encode("cp1252") for t in lines)
    content = b"BT /F1 12 Tf 72 700 Td 14 TL " + shown + b" [(spa) -50 (ced) -400 (out)] TJ ET"
    if deflate:
        content = zlib.compress(content)
    font = b"<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica %s >>" % (b"/ToUnicode 6 0 R" if cmap else b"")
    objects = [
        b"<< /Type /Catalog /Pages 2 0 R >>",
        b"<< /Type /Pages /Kids [3 0 R] /Count 1 /Resources << /Font << /F1 5 0 R >> >> >>",
        b"<< /Type /Page /Parent 2 0 R /Contents 4 0 R >>",
        b"<< /Length %d %s >>\nstream\n%s\nendstream" % (len(content), b"/Filter /FlateDecode" if deflate else b"", content),
        font,
        b"<< /Length 99 >>\nstream\n1 begincodespacerange <0000> <ffff> endcodespacerange 1 beginbfrange <0020> <00ff> <0020> endbfrange\nendstream",
    ]
    return b"%PDF-1.4\n" + b"\n".join(b"%d 0 obj\n%s\nendobj" % (i + 1, o) for i, o in enumerate(objects)) + b"\ntrailer << /Root 1 0 R >>\n%%EOF"


def archive(path, members):
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for name, data in members.items():
            z.writestr(name, data)


W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
DOCX = f'<w:document {W}><w:body><w:p><w:pPr><w:pStyle w:val="Heading1"/></w:pPr><w:r><w:t>Stones</w:t></w:r></w:p><w:p><w:r><w:t>Granite is </w:t></w:r><w:r><w:t>hard.</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>a</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>b</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>'


def test_parsers(tmp_path):
    for deflate in (False, True):
        assert parsers.parse(make_pdf(["Caf\xe9 is open", "second (line)".replace("(", "").replace(")", "")], deflate), "pdf") == ("pdf", "Café is open\nsecond line\nspaced out")
    assert parsers.parse(make_pdf(["Mapped text"], True, True), "pdf")[1].startswith("Mapped text")
    archive(tmp_path / "a.docx", {"word/document.xml": DOCX})
    assert parsers.parse((tmp_path / "a.docx").read_bytes(), "unknown") == ("docx", "# Stones\n\nGranite is hard.\n\na | b")
    sheet = '<worksheet><sheetData><row><c t="s"><v>0</v></c><c><v>7</v></c></row></sheetData></worksheet>'
    archive(tmp_path / "a.xlsx", {"xl/workbook.xml": "<workbook/>", "xl/sharedStrings.xml": "<sst><si><t>price</t></si></sst>", "xl/worksheets/sheet1.xml": sheet})
    assert parsers.parse((tmp_path / "a.xlsx").read_bytes(), "excel") == ("excel", "## Sheet 1\nprice | 7")
    archive(tmp_path / "a.pptx", {"ppt/presentation.xml": "<p/>", "ppt/slides/slide2.xml": "<s><p><t>two</t></p></s>", "ppt/slides/slide1.xml": "<s><p><t>one</t></p></s>"})
    assert parsers.parse((tmp_path / "a.pptx").read_bytes(), "powerpoint")[1] == "## Slide 1\none\n\n## Slide 2\ntwo"
    assert parsers.parse(b"a,\"b,c\"\n1,2\n", "csv") == ("csv", "a | b,c\n1 | 2")
    assert parsers.parse(b"<html><h1>T</h1><script>x</script><p>a &eacute;&#8364;<br>b</p></html>", "unknown") == ("html", "# T\n\na é€\nb")
    assert parsers.parse(b"bad \xff byte", "text") == ("text", "bad  byte")
    for content, name in ((b"%PDF-1.4 /Encrypt", "pdf"), (b"%PDF-1.4 nothing", "pdf"), (b"PK\x03\x04junk", "docx"), (b"no pdf", "pdf"), (b"\x89PNG\r\n\x1a\n", "image"), (b"\0\xff", "unknown"), (b"", "unknown")):
        with pytest.raises(ValueError):
            parsers.parse(content, name)


def test_engine(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    (src / "rivers.md").write_text(TEXT)
    (src / "empty.txt").write_text(" \n")
    (src / "page.html").write_text("<html><h1>Bread</h1><p>Bread is made of flour &amp; water.</p></html>")
    (src / "metals.pdf").write_bytes(make_pdf(["Copper conducts well."], True))
    (src / "broken.pdf").write_bytes(b"%PDF-1.4 \xff\xfe")
    (src / "notes.txt").write_bytes(b"Salt \xff dissolves in water.")
    (src / "data.bin").write_bytes(b"\0\1\2")
    archive(src / "stones.docx", {"word/document.xml": DOCX})
    engine = Engine(spark, str(tmp_path / "tables"))
    assert engine.documents().count() == 0 and engine.search_child_chunks("river") == "NO_RELEVANT_CHUNKS"
    added, skipped, found = engine.add_directory(str(src))
    assert (added, skipped) == (5, 3) and found["by_status"] == {"added": 5, "failed": 2, "empty": 1}
    assert sorted(p.rsplit("/", 1)[1] for p, _ in found["errors"]) == ["broken.pdf", "data.bin"]
    once = engine.table("children").collect()
    before = sorted(map(repr, once))
    assert engine.add_directory(str(src))[:2] == (0, 8)
    assert sorted(map(repr, engine.table("children").collect())) == before
    engine.create_collection()
    engine.rebuild_collection()
    assert sorted(repr(r[:-1]) for r in engine.table("children").collect()) == sorted(repr(r[:-1]) for r in once)
    engine.delete_collection()
    assert engine.search_child_chunks("river") == "NO_RELEVANT_CHUNKS" and engine.documents().count() == 5
    engine.rebuild_collection()
    assert engine.add_documents([]) == (0, 0) and engine.add_documents([str(src / "rivers.md"), str(src / "nowhere.md")]) == (0, 1)
    assert engine.add_documents(str(src / "nowhere.md")) == (0, 0) and engine.add_directory(str(src / "nowhere"))[:2] == (0, 0)
    assert engine.add_web_page("http://a.b/wine", "<p>Wine is made of grapes.</p>") == (True, "added")
    assert [r["stem"] for r in engine.documents().collect()] == ["metals", "notes", "page", "rivers", "stones", "wine"]
    assert {r["format"]: r["n_documents"] for r in engine.statistics().collect()} == {"html": 2, "markdown": 1, "pdf": 1, "text": 1, "docx": 1}
    state = {r["stem"]: (r["status"], r["n_seen"], r["n_failed"]) for r in engine.registry().collect()}
    assert state["rivers"] == ("exists", 3, 0) and state["broken"] == ("failed", 2, 2)
    hits = engine.search("Where does the river Oder rise?", threshold_stage="none").collect()
    assert hits[0]["parent_id"] == "rivers_parent_0" and hits[0]["source"] == "rivers.pdf"
    assert engine.search_child_chunks("river Oder", threshold_stage="none").startswith("Parent ID: rivers_parent_0\nFile Name: rivers.pdf\nContent: # Rivers")
    assert engine.search_child_chunks("river", threshold_stage="no such stage").startswith("RETRIEVAL_ERROR: ")
    assert engine.retrieve_parents(["rivers_parent_0.JSON", "rivers_parent_0"]).count("Parent ID") == 1
    assert engine.retrieve_parents(["rivers_parent_0", "nothing"]).startswith("PARENT_RETRIEVAL_ERROR: ") and engine.retrieve_parents([]) == "NO_PARENT_DOCUMENTS"
    with pytest.raises(KeyError):
        engine.load_parents(["nothing"])
    out = engine.query("Is bread made of flour and water?")
    assert "flour & water" in out["answer"] and out["status"] == "answered" and engine.table("evaluations").count() == 1
    assert out["latency_metrics"]["agent_graph_execution"]["count"] == 1 and set(out["evaluation"]) == {"groundedness", "relevance", "retrieval_accuracy", "overall_score"}
    report = spark.read.option("header", True).option("escape", '"').option("multiLine", True).csv(str(tmp_path / "tables" / "evaluations_csv"))
    assert len(report.columns) == 11 and report.first()["question"] == "Is bread made of flour and water?"
    operations = {r["operation"] for r in engine.latency().collect()}
    assert {"document_ingestion", "document_chunking", "vector_insertion", "vector_retrieval", "end_to_end_query", "evaluation_pipeline"} <= operations
    engine.export_latency(str(tmp_path / "csv"))
    engine.export_latency(str(tmp_path / "json"), "json")
    with pytest.raises(ValueError):
        engine.export_latency(str(tmp_path / "x"), "xml")
    engine.clear_all()
    assert engine.documents().count() == 0


def test_conversation(spark, tmp_path):
    """Unclear queries gather history; a clear one is split, answered and ends it."""
    engine = Engine(spark, str(tmp_path / "tables"), analysis=Analysis(is_clear=lambda query, context: ~query.contains("hm")))
    engine.add(spark.createDataFrame([("salt.md", "Salt dissolves in water."), ("gold.md", "Gold is a soft metal.")], "path string, text string"))
    assert engine.evaluate_last() is False
    assert engine.chat(" hm hm hm? ") == "I need more information to understand your question."
    assert [(r["role"], r["content"]) for r in engine.messages().orderBy("seq").collect()] == [("user", "hm hm hm?"), ("assistant", "I need more information to understand your question.")]
    thread = engine.thread_id
    answer = engine.chat("Does salt dissolve in water? Is gold a soft metal?")
    assert answer == "\nAnswer 1:\nSalt dissolves in water.\n\nAnswer 2:\nGold is a soft metal.\n"
    assert [r["role"] for r in engine.messages().collect()] == ["assistant"]
    assert engine.evaluate_last() and engine.last_evaluation["overall_score"] > 0 and engine.last_chunks
    engine.clear_session()
    assert engine.thread_id != thread and engine.messages().count() == 0 and engine.messages(thread).count() == 0 and engine.last_answer is None
    engine.chat("hm one two")
    other = Engine(spark, str(tmp_path / "tables"))
    other.resume(engine.thread_id)
    assert other.messages().count() == 2
    engine.answer = lambda question, content: 1 / 0
    assert engine.chat("Is gold a soft metal?").startswith("Error: ")


def test_versions_and_tags(spark, tmp_path):
    (tmp_path / "a.md").write_text("Iron rusts in rain.")
    (tmp_path / "b.txt").write_text("Tin is light.")
    engine = Engine(spark, str(tmp_path / "tables"))
    both = [str(tmp_path / "a.md"), str(tmp_path / "b.txt")]
    assert engine.add_documents(both) == (2, 0)
    (tmp_path / "a.md").write_text("Iron melts in fire.")
    assert engine.add_documents(both) == (0, 2) and engine.update_documents(both) == (1, 1) and engine.update_documents(both) == (0, 2)
    shown = lambda: [r["content"] for r in engine.search("iron", threshold_stage="none").collect()]
    assert shown() == ["Iron melts in fire."]
    engine.rollback("a", 1)
    assert shown() == ["Iron rusts in rain."] and engine.load_parents(["a_parent_0"])[0]["content"] == "Iron rusts in rain."
    assert [r["version"] for r in engine.history("a").collect()] == [1, 2, 1]
    assert engine.update_documents(both) == (1, 1) and shown() == ["Iron melts in fire."]
    with pytest.raises(KeyError):
        engine.rollback("a", 9)
    engine.tag("a", topic="metal", year="1")
    engine.tag("a", year="2")
    assert [(r["stem"], r["version"], r["tags"]) for r in engine.find(topic="metal").collect()] == [("a", 3, {"topic": "metal", "year": "2"})]
    assert engine.find(year="1").count() == 0 and [r["stem"] for r in engine.find(format="text").collect()] == ["b"]


def test_sweep(spark):
    from corvane import storage

    kept = storage.cut(spark.range(3), "swept")
    assert kept.count() == 3 and storage.sweep(spark) >= 1 and storage.sweep(spark) == 0
