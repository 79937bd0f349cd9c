"""Files of every format, built here; the API; DataFrames and streams of files."""

import io
import json
import zipfile

import pytest
from lexiloom import api
from lexiloom.operators.documents import chunk_files, owner
from lexiloom.operators.rows import containing, numbered
from lexiloom.sources.formats import ParseError, UnsupportedFormat, decode, load, render_record, split_mbox
from lexiloom.streaming import arriving_chunks, write_available

W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
A = 'xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main" xmlns:p="http://schemas.openxmlformats.org/presentationml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
REL = '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">{}</Relationships>'


def package(**parts: str) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in parts.items():
            z.writestr(name, text)
    return out.getvalue()


def docx() -> bytes:
    p = lambda text, more="": f"<w:p><w:pPr>{more}</w:pPr><w:r><w:t>{text}</w:t></w:r></w:p>"
    table = "<w:tbl><w:tr><w:tc><w:p><w:r><w:t>a</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>b</w:t></w:r></w:p></w:tc></w:tr></w:tbl>"
    body = p("Title", '<w:pStyle w:val="Heading1"/>') + p("A paragraph of text.") + p("one", '<w:pStyle w:val="ListParagraph"/>') + table
    return package(**{"word/document.xml": f"<w:document {W}><w:body>{body}</w:body></w:document>"})


def xlsx() -> bytes:
    cell = lambda ref, v: f'<c r="{ref}" t="inlineStr"><is><t>{v}</t></is></c>'
    sheet = f'<worksheet><sheetData><row r="1">{cell("A1", "Name")}{cell("B1", "N")}</row><row r="3">{cell("A3", "x")}<c r="B3"><v>1.5</v></c></row><row r="4">{cell("A4", "y")}<c r="B4"><v>42000</v></c></row></sheetData></worksheet>'
    book = '<workbook xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="S" r:id="r1"/></sheets></workbook>'
    return package(**{"xl/workbook.xml": book, "xl/_rels/workbook.xml.rels": REL.format('<Relationship Id="r1" Target="worksheets/sheet1.xml"/>'), "xl/worksheets/sheet1.xml": sheet})


def pptx() -> bytes:
    shape = lambda kind, text: f'<p:sp><p:nvSpPr><p:nvPr><p:ph type="{kind}"/></p:nvPr></p:nvSpPr><p:txBody><a:p><a:r><a:t>{text}</a:t></a:r></a:p></p:txBody></p:sp>'
    slide = f"<p:sld {A}><p:cSld><p:spTree>{shape('title', 'Hello')}{shape('body', 'Some text')}{shape('sldNum', '7')}</p:spTree></p:cSld></p:sld>"
    deck = f'<p:presentation {A}><p:sldIdLst><p:sldId id="256" r:id="r1"/></p:sldIdLst></p:presentation>'
    return package(**{"ppt/presentation.xml": deck, "ppt/_rels/presentation.xml.rels": REL.format('<Relationship Id="r1" Target="slides/slide1.xml"/>'), "ppt/slides/slide1.xml": slide})


def test_diagrams_charts_and_sections_of_decks():
    rel = lambda **t: REL.format("".join(f'<Relationship Id="{k}" Target="{v}"/>' for k, v in t.items()))
    slide = f'<p:sld {A} xmlns:dgm="d" xmlns:c="c"><p:graphicFrame><dgm:relIds r:dm="r1" r:lo="r9"/></p:graphicFrame><p:graphicFrame><c:chart r:id="r2"/></p:graphicFrame></p:sld>'
    pts = lambda tag, **v: f"<c:{tag}><c:x>" + "".join(f'<c:pt idx="{k[1:]}"><c:v>{x}</c:v></c:pt>' for k, x in v.items()) + f"</c:x></c:{tag}>"
    chart = f'<c:chartSpace xmlns:c="c"><c:ser>{pts("tx", i0="R&amp;D")}{pts("cat", i0="2020", i1="2021")}{pts("val", i0="8.200000000000001", i1="3")}</c:ser><c:ser>{pts("tx", i0="R&amp;D")}{pts("val", i1="-0.0000001")}</c:ser><c:ser>{pts("val")}</c:ser></c:chartSpace>'
    diagram = f'<dgm:dataModel xmlns:dgm="d" {A}><dgm:pt><dgm:t><a:p><a:r><a:t>First </a:t></a:r><a:r><a:t>step</a:t></a:r></a:p></dgm:t></dgm:pt><dgm:pt type="pres"><dgm:t><a:p><a:r><a:t>shape</a:t></a:r></a:p></dgm:t></dgm:pt></dgm:dataModel>'
    deck = f'<p:presentation {A}><p:sldIdLst><p:sldId id="256" r:id="r1"/><p:sldId id="257" r:id="r2"/></p:sldIdLst><p:sectionLst><p:section name="Intro"><p:sldIdLst><p:sldId id="257"/></p:sldIdLst></p:section></p:sectionLst></p:presentation>'
    parts = {"ppt/presentation.xml": deck, "ppt/_rels/presentation.xml.rels": rel(r1="slides/slide1.xml", r2="slides/slide2.xml"), "ppt/slides/slide1.xml": f"<p:sld {A}/>", "ppt/slides/slide2.xml": slide}
    doc = load("a.pptx", package(**parts, **{"ppt/slides/_rels/slide2.xml.rels": rel(r1="../diagrams/data1.xml", r2="../charts/chart1.xml"), "ppt/diagrams/data1.xml": diagram, "ppt/charts/chart1.xml": chart}))
    assert [b.content for b in doc.blocks] == ["Slide 1", "Slide 2", "First step", "Chart", "Category | R&D (1) | R&D (2) | Series 3\n2020 | 8.2 |  | \n2021 | 3 | 0 | "]
    assert [(f["slide_number"], f["section_heading"]) for _, f in doc.starts] == [(1, None), (2, "Intro")]


def odt() -> bytes:
    ns = 'xmlns:office="o" xmlns:text="t" xmlns:table="b"'
    body = '<text:h text:outline-level="2">Head</text:h><text:p>Words here.</text:p><text:list><text:list-item><text:p>item</text:p></text:list-item></text:list><table:table table:name="T"><table:table-row><table:table-cell><text:p>c</text:p></table:table-cell></table:table-row></table:table>'
    return package(**{"content.xml": f"<office:document-content {ns}><office:body><office:text>{body}</office:text></office:body></office:document-content>"})


def ods() -> bytes:
    ns = 'xmlns:office="o" xmlns:text="t" xmlns:table="b"'
    row = lambda *c: "<table:table-row>" + "".join(f"<table:table-cell><text:p>{x}</text:p></table:table-cell>" for x in c) + "</table:table-row>"
    return package(**{"content.xml": f'<office:document-content {ns}><office:body><office:spreadsheet><table:table table:name="S">{row("Name", "N")}{row("x", "1")}</table:table></office:spreadsheet></office:body></office:document-content>'})


def epub() -> bytes:
    opf = '<package version="3.0"><metadata><title>Book</title></metadata><manifest><item id="c1" href="c1.xhtml"/><item id="n" href="nav.xhtml" properties="nav"/></manifest><spine><itemref idref="c1"/><itemref idref="n"/><itemref idref="gone"/></spine></package>'
    return package(**{"META-INF/container.xml": '<container><rootfiles><rootfile full-path="OEBPS/b.opf"/></rootfiles></container>', "OEBPS/b.opf": opf, "OEBPS/c1.xhtml": "<html><body><h1>Chapter</h1><p>Text.</p></body></html>", "OEBPS/nav.xhtml": "<html><body><p>toc</p></body></html>"})


EML = b"From: Ann <a@x.org>\r\nTo: b@x.org\r\nSubject: Hi there\r\nDate: Mon, 05 Jan 2026 10:00:00 +0000\r\nMessage-ID: <1@x>\r\nContent-Type: text/plain; charset=utf-8\r\n\r\nBody of the mail.\r\n"
NOTEBOOK = json.dumps({"nbformat": 4, "nbformat_minor": 5, "metadata": {"kernelspec": {"language": "python", "name": "k"}}, "cells": [{"cell_type": "markdown", "source": ["# T\n", "text"]}, {"cell_type": "code", "source": "x = 1", "outputs": [{"text": "\x1b[31mred\x1b[0m"}]}]}).encode()

FILES = {
    "a.txt": (b"A TITLE HERE\n\nSome words.", "Some words."), "a.md": (b"# T\n\nSome *words*.", "Some words."), "a.html": (b"<h1>T</h1><p>Some words.", "Some words."), "a.csv": (b"name,n\nx,1\ny,22\n", "name: x"), "a.tsv": (b"name\tn\nx\t1\nyy\t22\n", "name: x"),
    "a.json": (b'{"meta": 1, "items": [{"b": 1, "a": [1, 2]}, {"b": 2}]}', "- b: 1"), "a.jsonl": (b'{"b": 1}\nbroken line\n', "broken line"), "a.eml": (EML, "Body of the mail."), "a.mbox": (b"From ann Mon Jan  5 10:00:00 2026\n" + EML.replace(b"\r\n", b"\n") + b">From quoted\n", "From quoted"),
    "a.ipynb": (NOTEBOOK, "red"), "a.docx": (docx(), "A paragraph of text."), "a.xlsx": (xlsx(), "Name: y | N: 42000"), "a.pptx": (pptx(), "Some text"), "a.odt": (odt(), "Words here."), "a.ods": (ods(), "Name: x | N: 1"), "a.epub": (epub(), "Text."),
    "a.rtf": (rb"{\rtf1\ansi{\fonttbl{\f0 Arial;}}{\info{\title Doc}}Caf\'e9 \u8364? text.\par Next.}", "Café € text."),
}


@pytest.mark.parametrize("name", FILES)
def test_every_mode_of_every_format(name):
    data, known = FILES[name]
    for mode in ("default", "structural", "section", "semantic", "sentence", "sliding_window", "page_aware"):
        out = api.get_chunks(data, filename=name, mode=mode)
        assert out and all(set(c) == {"content_type", "content", "metadata"} and c["content"] for c in out), mode
        json.dumps(out)
    text = "\n".join(c["content"] for c in api.get_chunks(data, filename=name)).replace("**", "")
    assert known in text
    assert api.get_markdown(data, filename=name).strip()


def test_records_messages_and_slides_keep_their_facts():
    assert [c["metadata"]["record_range"] for c in api.get_chunks(FILES["a.json"][0], filename="a.json") if "record_range" in c["metadata"]] == [[1, 1], [2, 2]]
    assert api.get_chunks(FILES["a.json"][0], filename="a.json")[0]["metadata"]["document_metadata"]["envelope_key"] == "items"
    assert api.get_chunks(FILES["a.mbox"][0], filename="a.mbox")[0]["metadata"]["message_subject"] == "Hi there"
    assert api.get_chunks(pptx(), filename="a.pptx")[0]["metadata"]["slide_title"] == "Hello"
    facts = api.get_chunks(epub(), filename="a.epub")[0]["metadata"]
    assert facts["spine_index"] == 0 and facts["document_metadata"]["skipped_spine_items"] == ["gone"]


def test_records_render_nested():
    assert render_record({"a": {"b": [1, None]}, "c": [{"d": "x"}]}) == "- **a:**\n  - **b:** 1, null\n- **c:**\n  - **[0]:**\n    - **d:** x"
    assert len(split_mbox(b"From a 2026\nSubject: x\n\n>From b\nFrom here on\n\nFrom c 2026\nTo: y\n\nz")) == 2


@pytest.mark.parametrize(("data", "text"), [(b"\xef\xbb\xbfa\r\nb\rc", "a\nb\nc"), ("añ".encode("utf-16"), "añ"), ("plain text".encode("utf-16-le"), "plain text"), (b"caf\xe9", "café"), (b"", "")])
def test_decoding(data, text):
    assert decode(data) == text


def test_decoding_as_a_column(spark):
    from lexiloom.functions.text import decode_text
    from pyspark.sql import functions as F

    cases = [b"\xef\xbb\xbfa\r\nb\rc", "añ".encode("utf-16"), "plain text".encode("utf-16-le"), b"caf\xe9", b"", None, "é語".encode()]
    rows = spark.createDataFrame([(i, bytearray(c) if c is not None else None) for i, c in enumerate(cases)], "i int, d binary").select("i", decode_text(F.col("d")).alias("t")).collect()
    assert {r["i"]: r["t"] for r in rows} == {i: decode(c) if c is not None else None for i, c in enumerate(cases)}


def test_errors():
    for name in ("a.exe", "a.xyz", "noext"):
        with pytest.raises(UnsupportedFormat):
            load(name, b"x")
    for name in ("a.docx", "a.json", "a.ipynb", "a.rtf"):
        with pytest.raises(ParseError):
            load(name, b"not that")
    with pytest.raises(ValueError, match="overlap must be less than window_size"):
        api.get_chunks(b"x", filename="a.txt", window_size=2, overlap=2)
    with pytest.raises(ValueError, match="window_size must be greater than 0"):
        api.get_chunks(b"x", filename="a.txt", window_size=0)
    with pytest.raises(ValueError, match="empty"):
        api.get_chunks(b"", filename="a.txt")
    assert api.get_chunks(b" \n", filename="a.txt") == []


def test_sources(tmp_path):
    path = tmp_path / "a.txt"
    path.write_bytes(b"Some words.")
    want = api.get_chunks(b"Some words.", filename="a.txt")
    upload = type("U", (), {"filename": "a.txt", "file": io.BytesIO(b"Some words.")})()
    assert api.get_chunks(path) == api.get_chunks(io.StringIO("Some words."), filename="a.txt") == api.get_chunks(upload) == list(api.stream_chunks(str(path))) == want
    with pytest.raises(ValueError, match="http"):
        api.get_chunks_from_s3_presigned_url("file:///etc/passwd")


def test_files_as_a_dataframe_and_as_a_stream(spark, tmp_path):
    for name, (data, _) in FILES.items():
        (tmp_path / "in").mkdir(exist_ok=True)
        (tmp_path / "in" / name).write_bytes(data)
    (tmp_path / "in" / "broken.docx").write_bytes(b"no package")
    got = api.read_chunks(spark, str(tmp_path / "in")).collect()
    assert [r["path"].rpartition("/")[2] for r in got if r["parse_error"]] == ["broken.docx"]
    by = lambda rows: sorted((r["path"].rpartition("/")[2], r["chunk_index"], r["content"], r["metadata"]) for r in rows if not r["parse_error"])
    assert {r[0] for r in by(got)} == set(FILES)
    write_available(arriving_chunks(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination(120)
    assert by(spark.read.parquet(str(tmp_path / "out")).collect()) == by(got)
    assert api.markdown_folder(spark, str(tmp_path / "in"), "*.csv").first()["markdown"].startswith("| name | n |")


def test_null_and_empty_files(spark):
    files = spark.createDataFrame([("a.txt", None), ("b.txt", bytearray()), ("c.txt", bytearray(b"x"))], "path string, content binary")
    assert [r["path"] for r in chunk_files(files).collect()] == ["c.txt"]
    assert chunk_files(files.limit(0)).collect() == []


def test_numbering_and_containment(spark):
    df = spark.range(1000).selectExpr("id", "if(id % 3 = 0, null, id % 2) as g").repartition(7)
    rows = numbered(df, ["id"]).collect()
    assert all(r["idx"] == r["id"] for r in rows)
    groups: dict = {}
    for r in numbered(df, ["id"], ["g"]).collect():
        groups.setdefault(r["g"], []).append((r["id"], r["idx"]))
    assert all([i for _, i in sorted(v)] == list(range(len(v))) for v in groups.values()) and len(groups) == 3
    ranges = spark.createDataFrame([(0, 10, "a"), (5, 20, "b"), (30, 31, "c")], "lo int, hi int, band string")
    points = spark.range(40).selectExpr("cast(id as int) as x")
    want = {i: "a" if i <= 10 else "b" if i <= 20 else "c" if i in (30, 31) else None for i in range(40)}
    for most in (100, 1):
        assert {r["x"]: r["band"] for r in containing(ranges, points, "lo", "hi", "x", "band", most).collect()} == want
    assert [owner([0, 3, 5], b) for b in (0, 2, 3, 9)] == [0, 0, 1, 2] and owner([2], 1) == -1
