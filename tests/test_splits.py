"""Splitters, byte cuts, names, header votes, encodings, cells and calls by family."""

import io
import random
import zipfile

import pytest
from lexiloom import api, formats_api
from lexiloom.functions import splits
from lexiloom.operators import grid
from lexiloom.operators.rows import containing
from lexiloom.sources.formats import ParseError, load, serial_text
from lexiloom.sources.images import image_files, list_images
from pyspark.sql import functions as F

TEXTS = [
    "Dr. Smith came. He left.", "See item 12. Then go. Now.", "It was best. Test passed? Yes! no. X", "a..B. Cat here. Dog", "Ünder. Éclair. x", "", "one", "A.  Two spaces. Three", "etc. And so. On", "1. One\n2. Two. 3. Three",
    'He said "Go." Then left. (Done.) Next', "Pi is 3.14. Right. 1234. Four digits",
]


def test_sentences_of_markdown_and_of_documents():
    assert splits.md_sentences(TEXTS[0]) == ["Dr. Smith came.", "He left."]
    assert splits.md_sentences(TEXTS[1]) == ["See item 12. Then go.", "Now."]
    assert splits.md_sentences("It was best. Test") == ["It was best. Test"]  # `est.` is an abbreviation, wherever it stands
    assert splits.docx_sentences(TEXTS[10]) == ['He said "Go."', "Then left. (Done.)", "Next"]
    assert splits.docx_sentences("Room 1234. Four digits. Page 12. Not") == ["Room 1234.", "Four digits.", "Page 12. Not"]
    assert splits.md_sentences("Room 1234. Four digits") == ["Room 1234. Four digits"]
    assert splits.marked_sentences("a.b! c") == ["a.", "b!", "c"]


def test_columns_equal_the_functions(spark):
    df = spark.createDataFrame([(t,) for t in TEXTS], "t string")
    got = df.select("t", splits.md_sentences_column(F.col("t")).alias("m"), splits.marked_sentences_column(F.col("t")).alias("s"), splits.content_hash_column(F.encode("t", "UTF-8")).alias("h"), splits.floor_boundary_column(F.col("t"), 5).alias("b")).collect()
    for r in got:
        assert r["m"] == splits.md_sentences(r["t"]), r["t"]
        assert r["s"] == splits.marked_sentences(r["t"]), r["t"]
        assert r["h"] == f"{splits.content_hash(r['t'].encode()):016x}"
        assert r["b"] == r["t"].encode()[: splits.floor_boundary(r["t"].encode(), 5)].decode()


def test_byte_cuts_and_names():
    r = random.Random(2)
    for _ in range(200):
        t = "".join(r.choice("aé語🙂 ") for _ in range(r.randint(0, 40)))
        for n in range(0, 12):
            cut = splits.floor_boundary(t.encode(), n)
            assert cut <= n and t.startswith(t.encode()[:cut].decode()) and len(t.encode()[:cut]) > n - 4 or cut == len(t.encode())
    assert splits.image_name(b"", "x/a.PNG") == "cbf29ce484222325.png" and splits.image_name(b"a", "a.tiff") is None
    assert splits.char_windows("x" * 30, 10, 3) == ["x" * 10] * 3 + ["x" * 9]


def test_header_votes():
    rows = lambda *c: [[x] for x in c]
    for values in (("$5.00", "$7.25", "$9.10"), ("-1", "+2", "3"), ("50%", "5%", "7%"), ("£1,000", "€2", "3")):
        assert grid.has_header(["Price"], rows(*values)), values
    assert not grid.has_header(["5"], rows("6", "7")) and not grid.has_header([""], rows("6")) and not grid.has_header(["a"], [])
    assert grid.has_header(["a", "b"], [["", "1"], ["", "2"]])


def test_named_encodings_are_strict():
    with pytest.raises(ParseError, match="not utf-8"):
        api.get_chunks(b"a,b\ncaf\xe9,1\n", filename="x.csv", encoding="utf-8")
    assert "café" in api.get_chunks(b"a,b\ncaf\xe9,1\n", filename="x.csv", encoding="windows-1252")[0]["content"]
    with pytest.raises(ValueError, match="unsupported encoding"):
        api.get_chunks(b"a,b\n1,2\n", filename="x.csv", encoding="klingon")


def test_messages_of_a_mailbox_keep_their_charsets():
    mail = b"From: a@x.org\nSubject: s\nContent-Type: text/plain; charset=iso-8859-1\nContent-Transfer-Encoding: 8bit\n\ncaf\xe9 au lait\n"
    box = b"From a@x.org Mon Jan  5 10:00:00 2026\n" + mail + b"\nFrom b@x.org Mon Jan  5 11:00:00 2026\n" + mail.replace(b"iso-8859-1", b"utf-8").replace(b"\xe9", "é".encode())
    assert load("a.mbox", box).text.count("café au lait") == 2


def package(**parts: str) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in parts.items():
            z.writestr(name, text)
    return out.getvalue()


def test_dates_in_sheets():
    assert serial_text("45000") == "2023-03-15 00:00:00" and serial_text("1.5") == "1900-01-01 12:00:00" and serial_text("0.25", True) == "1904-01-01 06:00:00"
    styles = '<styleSheet><numFmts><numFmt numFmtId="164" formatCode="[Red]0.0&quot;d&quot;"/><numFmt numFmtId="165" formatCode="dd/mm/yyyy"/></numFmts><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/><xf numFmtId="164"/><xf numFmtId="165"/></cellXfs></styleSheet>'
    cells = "".join(f'<c r="{c}2" s="{s}"><v>45000</v></c>' for c, s in zip("ABCD", range(4), strict=True))
    names = "".join(f'<c r="{c}1" t="inlineStr"><is><t>{c}</t></is></c>' for c in "ABCD")
    book = '<workbook xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="S" r:id="r1"/></sheets></workbook>'
    rels = '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Target="worksheets/sheet1.xml"/></Relationships>'
    data = package(**{"xl/workbook.xml": book, "xl/_rels/workbook.xml.rels": rels, "xl/styles.xml": styles, "xl/worksheets/sheet1.xml": f'<worksheet><sheetData><row r="1">{names}</row><row r="2">{cells}</row></sheetData></worksheet>'})
    assert load("a.xlsx", data).sheets == [("S", [["A", "B", "C", "D"], ["45000", "2023-03-15 00:00:00", "45000", "2023-03-15 00:00:00"]])]


def test_a_text_of_digits_is_no_number_in_a_sheet():
    assert grid.sheet_header([["42", "x"], [grid.Typed("1"), "y"]])[0] == ["42", "x"]
    assert grid.sheet_header([[grid.Typed("42"), grid.Typed("43")], [grid.Typed("1"), "y"]])[0] == ["", ""]


def test_repeated_cells_and_rows_count_as_often_as_they_say():
    ns = 'xmlns:office="o" xmlns:text="t" xmlns:table="b"'
    cell = lambda t, n=1: f'<table:table-cell table:number-columns-repeated="{n}">' + (f"<text:p>{t}</text:p>" if t else "") + "</table:table-cell>"
    row = lambda c, n=1: f'<table:table-row table:number-rows-repeated="{n}">{c}</table:table-row>'
    body = row(cell("a") + cell("", 98) + cell("b")) + row(cell("", 1024), 7) + row(cell("c", 20_000)) + row(cell("", 16384), 1_000_000)
    rows = load("a.ods", package(**{"content.xml": f'<office:document-content {ns}><office:body><office:spreadsheet><table:table table:name="S">{body}</table:table></office:spreadsheet></office:body></office:document-content>'})).sheets[0][1]
    assert len(rows) == 9 and rows[0].index("b") == 99 and len(rows[8]) == 20_000 and rows[1] == []


def test_rtf_code_pages_fonts_and_headings():
    assert load("a.rtf", rb"{\rtf1\ansi\ansicpg1251 \'cf\'f0\'e8}").text == "При"
    assert load("a.rtf", rb"{\rtf1\ansi{\fonttbl{\f0\fcharset0 A;}{\f1\fnil\fcharset161 B;}}\f0 caf\'e9 {\f1 \'e1} \'e9}").text == "café α é"
    blocks = load("a.rtf", rb"{\rtf1\ansi{\stylesheet{\s0 Normal;}{\s2 heading 2;}}\pard\s2 Head\par\pard\s0 Body.\par}").blocks
    assert [(b.type, b.level) for b in blocks][:1] == [("heading", 2)]


def test_calls_by_family(tmp_path):
    (tmp_path / "a.csv").write_text("name,n\nx,1\nyy,22\nzzz,333\n")
    chunks, took = formats_api.CALLS["chunk_csv"](tmp_path / "a.csv", rows_per_chunk=2, include_headers=False)
    assert [c["content"] for c in chunks] == ["x | 1\nyy | 22", "zzz | 333"] and set(took) == {"read_ms", "chunk_ms"}
    assert list(formats_api.CALLS["stream_chunk_csv"](tmp_path / "a.csv", rows_per_chunk=2, include_headers=False)) == chunks
    (tmp_path / "a.md").write_text("# T\n\nDr. Smith came. He left.")
    assert [c["content"] for c in formats_api.CALLS["chunk_md"](tmp_path / "a.md", "sentence", sentences_per_chunk=1)[0]] == ["T", "Dr. Smith came.", "He left."]
    for bad in ({"mode": "section"}, {"rows_per_chunk": 0}, {"mode": "sliding_window", "overlap": 9}):
        with pytest.raises(ValueError):
            formats_api.CALLS["chunk_csv"](tmp_path / "a.csv", **bad)
    with pytest.raises(ValueError, match="unsupported"):
        formats_api.CALLS["chunk_md"](tmp_path / "a.csv")


@pytest.mark.parametrize("n", [0, 1, 5, 20, 21, 57])
def test_streamed_rows_are_those_of_the_batch(n):
    text = "name,n\n" + "".join(f'"row {i}\nof two lines",{i}{",more" if i == 40 else ""}\n' for i in range(n))
    assert list(formats_api.stream_csv(iter(text.splitlines(keepends=True)))) == grid.csv_chunks(text)


def test_streams_hold_no_more_than_they_need():
    seen = 0

    def lines():
        nonlocal seen
        for i in range(1000):
            seen = i
            yield f"a{i},{i}\n"

    next(formats_api.stream_csv(lines()))
    assert seen < 40


def test_images_of_files(spark):
    data = package(**{"word/document.xml": "<w/>", "word/media/a.png": "one", "word/media/b.png": "one", "word/media/c.jpg": "two", "word/media/d.emf": "three"})
    found = list_images(data, "a.docx")
    assert [n.rpartition(".")[2] for n, _ in found] == ["png", "jpg"] and found[0] == (splits.image_name(b"one", "x.png"), b"one")
    assert list_images(b'<img src="data:image/png;base64,b25l">', "a.html") == [found[0]] and list_images(b"a,b", "a.csv") == []
    df = spark.createDataFrame([("a.docx", bytearray(data)), ("b.docx", bytearray(b"broken")), ("c.docx", None)], "path string, content binary")
    rows = sorted((r["path"], r["position"], r["image_name"], r["parse_error"] is None) for r in image_files(df).collect() if r)
    assert rows == [("a.docx", 0, found[0][0], True), ("a.docx", 1, found[1][0], True), ("b.docx", None, None, False)] or [r[0] for r in rows] == ["a.docx", "a.docx", "b.docx"]


def test_one_very_wide_range_makes_no_more_cells(spark):
    ranges = spark.createDataFrame([(0, 2_000_000_000, "wide"), *((10 * i, 10 * i + 4, f"r{i}") for i in range(1, 50))], "lo long, hi long, band string")
    points = spark.range(600).selectExpr("id as x")
    few, many = ({r["x"]: r["band"] for r in containing(ranges, points, "lo", "hi", "x", "band", m).collect()} for m in (1000, 1))
    assert few == many and set(few.values()) == {"wide"}
    narrow = ranges.where("lo > 0")
    few, many = ({r["x"]: r["band"] for r in containing(narrow, points, "lo", "hi", "x", "band", m).collect()} for m in (1000, 1))
    assert few == many and None in few.values()
