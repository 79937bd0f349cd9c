"""Word-processor files: pages, notes, tables, lists and the structural mode."""

import io
import zipfile

import pytest
from lexiloom import api
from lexiloom.operators.documents import markdown_of
from lexiloom.sources.formats import load
from lexiloom.sources.word import heading_level, paragraph_type

W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships" xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main" xmlns:wp="x"'
PAGE = '<w:r><w:br w:type="page"/></w:r>'
TITLE = '<w:pStyle w:val="Heading1"/>'


def p(text: str, about: str = "", more: str = "") -> str:
    return f"<w:p><w:pPr>{about}</w:pPr><w:r><w:t>{text}</w:t></w:r>{more}</w:p>"


def item(text: str, number: int = 1, level: int = 0) -> str:
    return p(text, f'<w:numPr><w:ilvl w:val="{level}"/><w:numId w:val="{number}"/></w:numPr>')


def tc(text: str, about: str = "") -> str:
    return f"<w:tc><w:tcPr>{about}</w:tcPr>{text if text.startswith('<') else p(text)}</w:tc>"


def table(*rows: str) -> str:
    return "<w:tbl>" + "".join(f"<w:tr>{r}</w:tr>" for r in rows) + "</w:tbl>"


def word(body: str, **parts: str) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f"<w:document {W}><w:body>{body}</w:body></w:document>")
        for name, inner in parts.items():
            z.writestr({"rels": "word/_rels/document.xml.rels", "page": "word/page.html"}.get(name, f"word/{name}.xml"), inner if name in ("rels", "page") else f"<w:{name} {W}>{inner}</w:{name}>")
    return out.getvalue()


def chunks(body: str, mode: str = "default", **parts: str) -> list[dict]:
    return api.get_chunks(word(body, **parts), filename="x.docx", mode=mode)


NOTE = '<w:r><w:footnoteReference w:id="{}"/></w:r>'
FOOTNOTES = '<w:footnote w:id="0" w:type="separator">' + p("sep") + '</w:footnote><w:footnote w:id="2">' + p("A note.") + "</w:footnote>"


def test_a_section_is_one_chunk_with_its_short_paragraphs_last():
    whole = "This paragraph is a whole sentence."
    found = chunks(p("Intro words are here too.") + p("Title", TITLE, PAGE) + p("short one") + item("a") + item("b") + p(whole, "", NOTE.format(2) + NOTE.format(9)) + p("short two"), footnotes=FOOTNOTES, header1=p("Head"))
    assert [(c["content_type"], c["content"]) for c in found] == [("plain_paragraph", "Intro words are here too."), ("mixed_content", f"Title\na\nb\n{whole}\nshort one short two")]
    assert found[1]["metadata"] == {"footnotes": [{"id": "2", "text": "A note."}], "endnotes": [], "page_number": 1, "section_heading": "Title", "section_heading_level": 1, "document_metadata": {"header_text": "Head", "footer_text": None, "image_count": 0}}


def test_tables_and_code_end_a_section_and_short_paragraphs_pool():
    found = chunks(p("Only", TITLE, PAGE) + table(tc("h")) + p("one") + p("two") + item("a") + item("b") + p("x = 1", '<w:pStyle w:val="Code"/>') + p("Cap", '<w:pStyle w:val="Caption"/>') + p("three"))
    kinds = [(c["content_type"], c["content"], c["metadata"]["page_number"]) for c in found]
    assert kinds == [("heading", "Only", 1), ("table", "| h |\n| --- |", 2), ("short_disconnected_paragraph", "one two", 2), ("bullet_list", "a\nb", 2), ("code_block", "x = 1", 2), ("short_disconnected_paragraph", "three", 2)]


def test_long_paragraphs_are_cut_with_notes_on_the_first_piece():
    text = " ".join(f"Sentence number {i} of a long paragraph." for i in range(60))
    found = chunks(p(text, "", NOTE.format(2)), footnotes=FOOTNOTES)
    assert {c["content_type"] for c in found} == {"long_single_paragraph"} and " ".join(c["content"] for c in found) == text
    assert all(len(c["content"]) <= 900 for c in found) and [len(c["metadata"]["footnotes"]) for c in found] == [1] + [0] * (len(found) - 1)


def test_long_tables_and_sections_are_cut():
    rows = [tc("Name") + tc("Text")] + [tc(f"row {i}") + tc("x" * 100) for i in range(200)]
    found = chunks(table(*rows))
    assert len(found) > 2 and all(c["content"].startswith("| Name | Text |\n| --- | --- |\n| row") and len(c["content"]) <= 6000 for c in found)
    section = chunks(p("Title", TITLE) + "".join(p(f"This is the whole sentence number {i} of it.") for i in range(100)))
    assert len(section) > 2 and {c["metadata"]["section_heading"] for c in section} == {"Title"} and all(len(c["content"]) <= 1200 for c in section)


def test_cells_that_span_go_on_and_hold_tables():
    inner = table(tc("a") + tc("b"), tc("c") + tc("d"))
    body = table(tc("wide", '<w:gridSpan w:val="2"/>') + tc("x"), tc("up", '<w:vMerge w:val="restart"/>') + tc("p|q") + tc("y"), tc("", "<w:vMerge/>") + tc(inner) + tc("z"))
    assert chunks(body)[0]["content"].split("\n") == ["| wide | wide | x |", "| --- | --- | --- |", "| up | p\\|q | y |", "| up | a \\| b; c \\| d | z |"]


def test_breaks_in_a_paragraph_boxes_controls_and_imports():
    body = "<w:sdt><w:sdtContent>" + p("In a control, whole sentence.") + "</w:sdtContent></w:sdt>"
    body += "<w:p><w:r><w:t>First line of words.</w:t><w:br/><w:t>Second line of words.</w:t></w:r></w:p>"
    body += '<w:p><w:r><mc:AlternateContent xmlns:mc="m"><mc:Choice><w:t>Chosen words of a box.</w:t></mc:Choice><mc:Fallback><w:t>again</w:t></mc:Fallback></mc:AlternateContent></w:r></w:p><w:altChunk r:id="r1"/>'
    found = chunks(body, rels='<R><Relationship Id="r1" Target="page.html"/></R>', page="<p>Imported from a page.</p>")
    assert [c["content"] for c in found] == ["In a control, whole sentence.", "First line of words.", "Second line of words.", "Chosen words of a box.", "Imported from a page."]


def test_pictures():
    picture = '<w:r><w:drawing><wp:docPr descr="A cat"/><a:blip r:embed="r1"/></w:drawing></w:r>'
    found = chunks(p("", "", picture) + p("Words and a picture.", "", picture.replace("A cat", "")))
    assert [(c["content_type"], c["content"]) for c in found] == [("image", "[Image: A cat]"), ("image", "Words and a picture.\n[Image]")]


NUMBERING = '<w:abstractNum w:abstractNumId="7"><w:lvl w:ilvl="0"><w:numFmt w:val="decimal"/></w:lvl><w:lvl w:ilvl="1"><w:numFmt w:val="bullet"/></w:lvl></w:abstractNum><w:num w:numId="1"><w:abstractNumId w:val="7"/></w:num>'


def test_markdown_counts_items_and_lists_notes():
    body = p("Title", TITLE) + item("a") + item("b") + item("in", level=1) + item("c") + p("Between.", "", NOTE.format(2) + PAGE) + item("d") + item("e", 5)
    text = markdown_of(word(body, footnotes=FOOTNOTES, numbering=NUMBERING), "x.docx")
    assert text.split("\n\n") == ["# Title", "1. a\n2. b\n  - in\n3. c", "Between.[^2]", "---", "1. d\n- e", "---", "[^2]: A note."]


def test_levels_and_types():
    assert [heading_level(*x) for x in (("Heading2", None), ("Titre", None), ("Überschrift3", None), ("Title", "4"), ("Normal", "2"), ("Normal", None), ("heading0", None))] == [2, 1, 3, 1, 3, None, 1]
    assert paragraph_type("A whole sentence here.”", "", False, False) == "plain_paragraph" and paragraph_type("No end", "", False, False) == "short_disconnected_paragraph"
    assert paragraph_type("x" * 501, "", False, False) == "long_single_paragraph" and paragraph_type("```", "", False, False) == "code_block"


@pytest.mark.parametrize("mode", ["section", "semantic", "sentence", "sliding_window", "page_aware"])
def test_other_modes_keep_everything(mode):
    joined = "\n".join(c["content"] for c in chunks(p("Title", TITLE) + p("A paragraph of text.") + item("one") + table(tc("a") + tc("b")), mode))
    assert all(x in joined for x in ("A paragraph of text.", "one", "| a | b |"))


def test_empty():
    assert chunks("") == [] and load("x.docx", word(p(""))).blocks == []
