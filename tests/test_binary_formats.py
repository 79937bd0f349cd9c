"""PDF, and the compound files of older office formats, built here byte by byte."""

import base64
import io
import struct
import uuid
import zipfile
import zlib

import pytest
from lexiloom import api
from lexiloom.operators.documents import chunk_files
from lexiloom.sources.compound import Compound, rtf_inflated
from lexiloom.sources.formats import ParseError, load, pdf_blocks
from lexiloom.sources.pdf import Document, _lzw, _run_length, _unpredicted, glyph_text, pdf_markdown

# PDF


def shown(x: float, y: float, text: str, size: int = 10, font: str = "F1") -> bytes:
    return f"BT /{font} {size} Tf {x} {y} Td ({text}) Tj ET\n".encode("cp1252")


def pdf(*pages: bytes, wrap=lambda body: (body, b""), fonts: bytes = b"", packed: bool = False, more: bytes = b"") -> bytes:
    n = len(pages)
    objects = {
        1: b"<< /Type /Catalog /Pages 2 0 R >>",
        2: b"<< /Type /Pages /Kids [" + b" ".join(b"%d 0 R" % (10 + 2 * i) for i in range(n)) + b"] /Count %d /Resources << /Font << /F1 3 0 R /F2 4 0 R %s >> >> >>" % (n, fonts),
        3: b"<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica /Encoding /WinAnsiEncoding >>",
        4: b"<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica-Bold >>",
    }
    streams = {}
    for i, page in enumerate(pages):
        objects[10 + 2 * i] = b"<< /Type /Page /Parent 2 0 R /Contents %d 0 R >>" % (11 + 2 * i)
        body, filters = wrap(page)
        streams[11 + 2 * i] = b"<< /Length %d %s >>\nstream\n%s\nendstream" % (len(body), filters, body)
    if packed:
        bodies, heads, at = [], [], 0
        for k, v in objects.items():
            heads.append(b"%d %d" % (k, at))
            bodies.append(v)
            at += len(v) + 1
        head = b" ".join(heads) + b" "
        body = zlib.compress(head + b" ".join(bodies))
        streams[90] = b"<< /Type /ObjStm /N %d /First %d /Filter /FlateDecode /Length %d >>\nstream\n%s\nendstream" % (len(objects), len(head), len(body), body)
        objects = {}
    out = b"%PDF-1.5\n" + b"".join(b"%d 0 obj\n%s\nendobj\n" % x for x in (objects | streams).items())
    return out + more + b"trailer << /Root 1 0 R >>\n%%EOF"


PROSE = ["The quick brown fox jumps over the lazy dog, as foxes do in", "sentences that are written to show how lines of text are set", "and then read."]
REPORT = shown(72, 720, "Annual Report", 18) + b"".join(shown(72, 690 - 12 * i, t) for i, t in enumerate(PROSE)) + shown(72, 630, "• one item") + shown(72, 618, "• two item") + shown(72, 590, "Outlook", font="F2") + shown(72, 578, "More text here.")
TABLE = b"".join(shown(x, 700 - 14 * i, t) for i, row in enumerate((("Item", "Qty", "Price"), ("Widget", "10", "2"), ("Gadget", "15", "4"))) for x, t in zip((72, 200, 300), row, strict=True))


def test_headings_paragraphs_and_lists():
    markdown, pages = pdf_markdown(pdf(REPORT))
    assert pages == 1
    assert markdown.split("\n\n") == ["# Annual Report", " ".join(PROSE), "- one item", "- two item", "## Outlook", "More text here."]


@pytest.mark.parametrize(
    "wrap",
    [
        lambda b: (zlib.compress(b), b"/Filter /FlateDecode"),
        lambda b: (b.hex().encode() + b">", b"/Filter /ASCIIHexDecode"),
        lambda b: (base64.a85encode(zlib.compress(b)) + b"~>", b"/Filter [/ASCII85Decode /FlateDecode]"),
    ],
)
def test_filters_and_packed_objects(wrap):
    assert pdf_markdown(pdf(REPORT, TABLE, wrap=wrap, packed=True)) == pdf_markdown(pdf(REPORT, TABLE))


def test_lzw_runs_and_predictors():
    assert _lzw(bytes([0x80, 0x0B, 0x60, 0x50, 0x22, 0x0C, 0x0C, 0x85, 0x01])) == bytes([45, 45, 45, 45, 45, 65, 45, 45, 45, 66])
    assert _run_length(bytes([2, 97, 98, 99, 254, 120, 128])) == b"abcxxx"
    assert _unpredicted(bytes([1, 1, 1, 1, 2, 1, 1, 1]), 3) == bytes([1, 2, 3, 2, 3, 4])


@pytest.mark.parametrize("mode", ["default", "structural", "section", "semantic", "sentence", "sliding_window", "page_aware"])
def test_tables_survive_every_mode(mode):
    chunks = api.get_chunks(pdf(REPORT, TABLE), filename="x.pdf", mode=mode)
    joined = "\n".join(c["content"] for c in chunks)
    assert "Widget | 10 | 2" in joined and "Gadget | 15 | 4" in joined
    assert all(c["metadata"]["document_metadata"] == {"source_type": "pdf", "total_pages": 2} for c in chunks)


def test_columns_are_read_one_after_the_other():
    left, right = [f"left column with words of line {i}" for i in range(4)], [f"right column with words of line {i}" for i in range(4)]
    page = b"".join(shown(60, 700 - 12 * i, a) + shown(330, 700 - 12 * i, b) for i, (a, b) in enumerate(zip(left, right, strict=True)))
    assert pdf_markdown(pdf(page))[0] == " ".join(left) + "\n\n" + " ".join(right)


def test_hyphens_heal_between_lower_case_halves_only():
    lines = ["the words of this line run to its end in an inter-", "national text and the next line ends in semi-", "Latin words"]
    page = b"".join(shown(72, 700 - 12 * i, t) for i, t in enumerate(lines))
    assert "international text" in pdf_markdown(pdf(page))[0]
    assert "semi- Latin" in pdf_markdown(pdf(page))[0]


def test_character_maps_wide_codes_and_differences():
    cmap = b"1 begincodespacerange <0000> <FFFF> endcodespacerange 1 beginbfchar <0003> <00660066> endbfchar 2 beginbfrange <0010> <0012> <0061> <0020> <0021> [<4E2D> <6587>] endbfrange"
    more = b"50 0 obj << /Subtype /Type0 /BaseFont /X /ToUnicode 51 0 R /DescendantFonts [52 0 R] >> endobj 51 0 obj << /Length %d >> stream\n%s\nendstream endobj 52 0 obj << /DW 500 /W [16 [600 600]] >> endobj " % (len(cmap), cmap)
    more += b"53 0 obj << /Subtype /Type1 /BaseFont /Helvetica /Encoding << /Differences [1 /eacute /fi /uni4E2D /zero] >> >> endobj "
    page = b"BT /F3 10 Tf 72 700 Td <0010001100120003> Tj ET BT /F3 10 Tf 72 688 Td <00200021> Tj ET BT /F4 10 Tf 72 676 Td <01020304> Tj ET"
    assert pdf_markdown(pdf(page, fonts=b"/F3 50 0 R /F4 53 0 R", more=more))[0].split() == ["abcff", "中文", "éfi中0"]
    assert [glyph_text(x) for x in ("Adieresis", "ccedilla", "u1F600", "A.alt", "nothing")] == ["Ä", "ç", "😀", "A", ""]


def test_forms_strings_and_text_operators():
    form = b"BT /F1 10 Tf 72 650 Td (from a form) Tj ET"
    more = b"60 0 obj << /Subtype /Form /Length %d >> stream\n%s\nendstream endobj " % (len(form), form)
    page = b"BT /F1 10 Tf 12 TL 72 700 Td (a \\(b\\) \\101\\\nB) Tj T* [(sp) -600 (lit) 20 (s)] TJ (next) ' ET q 1 0 0 1 0 0 cm /Fm Do Q BI /W 1 ID xx EI"
    with_form = pdf(page, more=more).replace(b"/Resources << /Font", b"/Resources << /XObject << /Fm 60 0 R >> /Font")
    assert pdf_markdown(with_form)[0].split("\n\n") == ["a (b) AB sp lits next", "from a form"]


def test_what_is_no_text_layer_is_an_error():
    for data, said in ((b"hello", "not a PDF"), (pdf(b"0 0 m 10 10 l S"), "no text layer"), (pdf(REPORT).replace(b"/Root 1 0 R", b"/Root 1 0 R /Encrypt 9 0 R"), "encrypted"), (b"%PDF-1.4\n", "no pages"), (b"", "not a PDF")):
        with pytest.raises(ParseError, match=said):
            load("x.pdf", data)


def test_damaged_files_end_and_cycles_too():
    data = pdf(REPORT, TABLE, wrap=lambda b: (zlib.compress(b), b"/Filter /FlateDecode"))
    for cut in range(0, len(data), 97):
        try:
            load("x.pdf", data[:cut])
        except ParseError:
            pass
    cyclic = b"%PDF-1.4 1 0 obj << /Type /Catalog /Pages 2 0 R >> endobj 2 0 obj << /Kids [2 0 R 2 0 R] >> endobj 3 0 obj 3 0 R endobj trailer << /Root 1 0 R >>"
    assert Document(cyclic).pages() == []


def test_the_default_mode_reads_page_by_page(tmp_path, monkeypatch):
    from lexiloom import formats_api
    from lexiloom.sources import pdf as reader

    pages = [shown(72, 720, f"Chapter {i} of it", 18) + b"".join(shown(72, 690 - 12 * k, f"{i} {t}") for k, t in enumerate(PROSE)) for i in range(50)]
    data = pdf(*pages)
    read, real = [], reader._laid
    monkeypatch.setattr(reader, "_laid", lambda *a: read.append(1) or real(*a))
    stream = api.stream_chunks(data, filename="x.pdf")
    first = next(stream)
    assert first["content"] == "Chapter 0 of it" and len(read) <= 2
    assert [first, *stream] == api.get_chunks(data, filename="x.pdf") and len(read) == 100
    (tmp_path / "x.pdf").write_bytes(data)
    assert list(formats_api.CALLS["stream_chunk_pdf"](tmp_path / "x.pdf")) == formats_api.CALLS["chunk_pdf"](tmp_path / "x.pdf")[0] == api.get_chunks(data, filename="x.pdf")
    with pytest.raises(ParseError, match="no text layer"):
        list(api.stream_chunks(pdf(b"0 0 m"), filename="x.pdf"))


def test_headings_are_ranked_in_the_page_by_default_and_in_the_document_else():
    data = pdf(REPORT.replace(b"/F1 18", b"/F1 14"), REPORT)
    level = lambda mode: [c["metadata"].get("section_level") for c in api.get_chunks(data, filename="x.pdf", mode=mode) if c["content"] == "Annual Report"]
    markdown = pdf_markdown(data)[0]
    assert "## Annual Report" in markdown and "\n# Annual Report" in markdown and level("section") == [2, 1]
    assert [b.level for b in pdf_blocks(data)[0] if b.title == "Annual Report"] == [1, 1]


def test_markdown_of_another_parser():
    chunks = api.chunk_pdf_markdown("# A\n\nText of a page.", 7)
    assert chunks[-1]["metadata"]["document_metadata"] == {"source_type": "pdf", "total_pages": 7}
    assert "Text of a page." in "\n".join(c["content"] for c in chunks)


# compound files


def compound(streams: dict[str, bytes], size: int = 512) -> bytes:
    """A compound file; streams below 4096 bytes go to the small stream."""
    names: list[tuple[str, int]] = [("Root Entry", 5)]
    kids: dict[str, list[int]] = {"": []}
    paths = [""]
    for path in streams:
        parts = path.split("/")
        for i in range(len(parts)):
            whole = "/".join(parts[: i + 1])
            if whole not in kids:
                kids[whole] = []
                kids["/".join(parts[:i])].append(len(names))
                names.append((parts[i], 2 if i == len(parts) - 1 else 1))
                paths.append(whole)
    fat, sectors, small, small_fat = [], [], b"", []

    def put(raw: bytes) -> int:
        if not raw:
            return 0xFFFFFFFE
        first, n = len(sectors), -(-len(raw) // size)
        for i in range(n):
            sectors.append(raw[i * size : (i + 1) * size].ljust(size, b"\0"))
            fat.append(first + i + 1 if i < n - 1 else 0xFFFFFFFE)
        return first

    places = {}
    for path, raw in streams.items():
        if len(raw) >= 4096:
            places[path] = put(raw)
        else:
            n = -(-len(raw) // 64)
            places[path] = len(small_fat)
            small_fat += [len(small_fat) + 1 + i if i < n - 1 else 0xFFFFFFFE for i in range(n)]
            small += raw.ljust(n * 64, b"\0")
    root = put(small)
    small_at = put(struct.pack(f"<{len(small_fat)}I", *small_fat).ljust(-(-len(small_fat) * 4 // size) * size, b"\xff"))
    free = 0xFFFFFFFF
    after = {a: b for k in kids.values() for a, b in zip(k, k[1:], strict=False)}  # siblings as a chain
    entries = b""
    for i, ((name, kind), path) in enumerate(zip(names, paths, strict=True)):
        raw = name.encode("utf-16-le")
        first = root if i == 0 else places.get(path, 0)
        entries += raw.ljust(64, b"\0") + struct.pack("<HBB3I36xIQ", len(raw) + 2, kind, 1, free, after.get(i, free), (kids[path] or [free])[0], first, len(small) if i == 0 else len(streams.get(path, b"")))
    directory = put(entries)
    count = 1
    while count * size // 4 < len(fat) + count:
        count += 1
    at = len(sectors)
    fat += [0xFFFFFFFD] * count
    table = struct.pack(f"<{len(fat)}I", *fat).ljust(count * size, b"\xff")
    head = b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1" + bytes(16) + struct.pack("<HHHHH6x", 62, 3, 0xFFFE, 9, 6) + struct.pack("<9I", 0, count, directory, 0, 4096, small_at, 1, 0xFFFFFFFE, 0)
    return head + struct.pack("<109I", *range(at, at + count), *[free] * (109 - count)) + b"".join(sectors) + table


def test_streams_small_and_large():
    streams = {"A": b"x" * 10, "Folder/B": bytes(range(256)) * 40, "Folder/Inner/C": b"y" * 200}
    file = Compound(compound(streams))
    assert {k: file.stream(k) for k in streams} == streams
    assert file.stream("none") is None and sorted(file.folders) == ["Folder", "Folder/Inner"]


def properties(head: int, **values: bytes) -> bytes:
    return bytes(head) + b"".join(struct.pack("<HHI8s", 3, int(k[1:], 16), 6, v) for k, v in values.items())


def text(pid: int, value: str, path: str = "") -> dict[str, bytes]:
    return {f"{path}__substg1.0_{pid:04X}001F": value.encode("utf-16-le")}


SENT = struct.pack("<Q", (1_500_000_000 + 11_644_473_600) * 10_000_000)


def mail(**more: bytes) -> bytes:
    r, a = "__recip_version1.0_#00000000/", "__attach_version1.0_#00000000/"
    inner = a + "__substg1.0_3701000D/"
    return compound(
        {"__properties_version1.0": properties(32, p0039=SENT, p0017=struct.pack("<II", 2, 0))}
        | text(0x0037, "Hello") | text(0x001A, "IPM.Note") | text(0x1000, "First line.\r\n\r\nSecond.") | text(0x0C1A, "Ann") | text(0x0C1F, "/O=ORG/CN=ANN") | text(0x5D01, "ann@x.org")
        | text(0x3001, "Bob", r) | text(0x3003, "bob@x.org", r) | {r + "__properties_version1.0": properties(8, p0C15=struct.pack("<II", 1, 0))}
        | {a + "__properties_version1.0": properties(8, p3705=struct.pack("<II", 5, 0))}
        | text(0x0037, "Inner", inner) | text(0x1000, "Blah blah", inner) | {inner + "__properties_version1.0": properties(24)}
        | more
    )


def test_mail_item():
    doc = load("x.msg", mail())
    assert doc.style.extra == {
        "message_class": "IPM.Note", "subject": "Hello", "from": "Ann <ann@x.org>", "to": ["Bob <bob@x.org>"], "cc": [], "bcc": [], "sent_date": "2017-07-14 02:40:00", "received_date": None,
        "importance": "High", "conversation_topic": None, "has_attachments": True, "attachment_count": 1,
    }
    head = "**From:** Ann <ann@x.org>  \n**To:** Bob <bob@x.org>  \n**Sent:** 2017-07-14 02:40:00  \n**Importance:** High"
    assert doc.text.startswith(f"# Hello\n\n{head}\n\nFirst line.\n\nSecond.\n\n## Attachments\n\n- Inner.msg\n\n**Subject:** Inner\n\nBlah blah")


def test_task_with_named_properties_and_code_page():
    guid = uuid.UUID("00062003-0000-0000-c000-000000000046").bytes_le
    names = b"".join(struct.pack("<IHH", n, 3 << 1, i) for i, n in enumerate((0x8101, 0x8102, 0x8105)))
    facts = properties(32, p8000=struct.pack("<II", 1, 0), p8001=struct.pack("<d", 0.25), p8002=SENT, p3FFD=struct.pack("<II", 1251, 0))
    streams = {"__nameid_version1.0/__substg1.0_00020102": guid, "__nameid_version1.0/__substg1.0_00030102": names, "__properties_version1.0": facts, "__substg1.0_0037001E": "Задача".encode("cp1251"), "__substg1.0_10130102": b"<p>Body <b>text</b></p>"}
    doc = load("x.msg", compound(streams | text(0x001A, "IPM.Task")))
    assert doc.text.startswith("# Задача\n\n**Due:** 2017-07-14 02:40:00  \n**Status:** In Progress  \n**% Complete:** 25\n\nBody")


def test_compressed_rtf():
    packed = bytes.fromhex("2d0000002b0000004c5a4675f1c5c7a703000a007263706731323542320af32068656c090020627705b06c647d0a800fa0")
    assert rtf_inflated(packed) == b"{\\rtf1\\ansi\\ansicpg1252\\pard hello world}\r\n"
    assert rtf_inflated(struct.pack("<II4sI", 20, 5, b"MELA", 0) + b"{\\rtf") == b"{\\rtf"
    doc = load("x.msg", compound({"__properties_version1.0": bytes(32), "__substg1.0_10090102": packed}))
    assert doc.text == "hello world"


def word(body: str, wide: bool) -> bytes:
    raw = body.encode("utf-16-le" if wide else "cp1252")
    fib = bytearray(1024)
    struct.pack_into("<H", fib, 0, 0xA5EC)
    struct.pack_into("<H", fib, 10, 0x200)
    struct.pack_into("<I", fib, 76, len(body))
    place = 1024 if wide else (1024 * 2) | 0x40000000
    plc = struct.pack("<II", 0, len(body)) + struct.pack("<HIH", 0, place, 0)
    clx = b"\x01" + struct.pack("<H", 3) + b"abc" + b"\x02" + struct.pack("<I", len(plc)) + plc
    struct.pack_into("<II", fib, 418, 0, len(clx))
    return compound({"WordDocument": bytes(fib) + raw, "1Table": clx})


@pytest.mark.parametrize("wide", [True, False])
def test_old_document(wide):
    body = "Main Title\rThis is a paragraph of text, café.\rA link \x13 HYPERLINK x \x14shown\x15 here.\rName\x07Qty\x07\x07Pen\x073\x07\x07After the table, text.\x0cLast page.\r"
    assert load("x.doc", word(body, wide)).text.split("\n\n") == ["## Main Title", "This is a paragraph of text, café.", "A link shown here.", "| Name | Qty |\n| --- | --- |\n| Pen | 3 |", "After the table, text.", "---", "Last page."]


def record(kind: int, body: bytes, instance: int = 0, box: bool = False) -> bytes:
    return struct.pack("<HHI", instance << 4 | (15 if box else 0), kind, len(body)) + body


def deck() -> bytes:
    head = lambda kind: record(3999, struct.pack("<I", kind))
    wide = lambda t: record(4000, t.encode("utf-16-le"))
    persist = lambda n: record(1011, struct.pack("<IIIII", n, 0, 0, 0, 0))
    masters = record(4080, persist(9) + head(0) + wide("Master title"), 1, True)
    outline = record(4080, persist(2) + head(0) + wide("The plan") + head(1) + wide("one\rtwo") + persist(3) + persist(4) + head(1) + record(4008, b"only this text, in one line."), 0, True)
    document = record(1000, masters + outline, box=True)
    slide = lambda inner: record(1006, inner, box=True)
    slides = [slide(record(61453, head(4) + wide("a free box") + head(4) + wide("The  Plan"), box=True)), slide(b""), slide(b"")]
    old = record(1000, record(4080, persist(2) + head(0) + wide("Deleted"), 0, True), box=True)
    stream, places = old + document, {1: len(old)}
    for n, s in enumerate(slides, 2):
        places[n] = len(stream)
        stream += s
    directory = len(stream)
    stream += record(6002, struct.pack("<I", len(places) << 20 | 1) + struct.pack(f"<{len(places)}I", *places.values()))
    edit = len(stream)
    stream += record(4085, struct.pack("<IIII", 0, 0, 0, directory) + bytes(12))
    user = record(4086, struct.pack("<III", 20, 0xE391C05F, edit))
    return compound({"PowerPoint Document": stream, "Current User": user})


def test_old_deck():
    doc = load("x.ppt", deck())
    assert doc.text.split("\n\n") == ["## The plan", "- one\n- two", "a free box", "---", "only this text, in one line."]
    assert [m for _, m in doc.starts] == [{"slide_number": 1, "slide_title": "The plan"}, {"slide_number": 3, "slide_title": None}]


def biff(kind: int, body: bytes) -> bytes:
    return struct.pack("<HH", kind, len(body)) + body


def workbook() -> bytes:
    begin = lambda kind: biff(0x809, struct.pack("<HHHHII", 0x600, kind, 0, 0, 0, 0))
    short = lambda t: struct.pack("<BB", len(t), 0) + t.encode("latin-1")
    long = lambda t: struct.pack("<HB", len(t), 1) + t.encode("utf-16-le")
    # the third string is cut, and goes on with narrow characters behind a new flag
    shared = biff(0xFC, struct.pack("<II", 3, 3) + long("Name") + struct.pack("<HBH", 3, 8, 1) + b"Day" + bytes(4) + struct.pack("<HB", 6, 1) + "日本".encode("utf-16-le")) + biff(0x3C, b"\x00text")
    xf = lambda code: biff(0xE0, struct.pack("<HH", 0, code) + bytes(16))
    rest = shared + xf(0) + xf(14) + xf(164) + biff(0x41E, struct.pack("<H", 164) + long("yyyy-mm")) + biff(0x0A, b"")
    cell = lambda kind, i, j, style, raw: biff(kind, struct.pack("<HHH", i, j, style) + raw)
    rk = lambda v: struct.pack("<I", (v << 2 | 2) & 0xFFFFFFFF)
    sheet = begin(16)
    sheet += cell(0xFD, 0, 0, 0, struct.pack("<I", 0)) + cell(0xFD, 0, 1, 0, struct.pack("<I", 1)) + cell(0xFD, 2, 0, 0, struct.pack("<I", 2)) + cell(0x27E, 2, 1, 1, rk(45000))
    sheet += cell(0x203, 3, 0, 0, struct.pack("<d", 1.5)) + biff(0xBD, struct.pack("<HH", 3, 1) + struct.pack("<H", 2) + rk(45000) + struct.pack("<H", 0) + rk(-7) + struct.pack("<H", 2))
    sheet += cell(0x205, 4, 0, 0, b"\x01\x00") + cell(0x205, 4, 1, 0, b"\x07\x01") + cell(0x06, 4, 2, 0, b"\x00" * 6 + b"\xff\xff" + bytes(6)) + biff(0x207, long("sum"))
    sheet += begin(32) + cell(0x203, 9, 9, 0, struct.pack("<d", 1)) + biff(0x0A, b"") + biff(0x0A, b"")
    size = len(begin(5)) + len(biff(0x85, bytes(6) + short("S"))) + len(rest)
    return compound({"Workbook": begin(5) + biff(0x85, struct.pack("<IBB", size, 0, 0) + short("S")) + rest + sheet})


ROWS = [["Name", "Day"], [], ["日本text", "2023-03-15 00:00:00"], ["1.5", "2023-03-15 00:00:00", "-7"], ["true", "#DIV/0!", "sum"]]


def test_old_workbook():
    assert load("x.xls", workbook()).sheets == [("S", ROWS)]


def test_binary_package():
    def rec(kind: int, body: bytes = b"") -> bytes:
        return (bytes([kind]) if kind < 128 else bytes([kind & 0x7F | 0x80, kind >> 7])) + bytes([len(body) & 0x7F | 0x80, len(body) >> 7]) + body

    wide = lambda t: struct.pack("<I", len(t)) + t.encode("utf-16-le")
    cell = lambda kind, j, style, raw: rec(kind, struct.pack("<II", j, style) + raw)
    rk = lambda v: struct.pack("<I", (v << 2 | 2) & 0xFFFFFFFF)
    row = lambda i: rec(0, struct.pack("<I", i) + bytes(13))
    sheet = rec(145) + row(0) + cell(7, 0, 0, struct.pack("<I", 0)) + cell(6, 1, 0, wide("Day")) + row(2) + cell(7, 0, 0, struct.pack("<I", 1)) + cell(2, 1, 1, rk(45000)) + row(3) + cell(5, 0, 0, struct.pack("<d", 1.5)) + cell(2, 1, 2, rk(45000)) + cell(2, 2, 0, rk(-7)) + cell(1, 3, 0, b"") + row(4) + cell(4, 0, 0, b"\x01") + cell(3, 1, 0, b"\x07") + cell(8, 2, 0, wide("sum") + bytes(4))
    xf = lambda code: rec(47, struct.pack("<HH", 0, code) + bytes(12))
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/workbook.bin", rec(156, struct.pack("<II", 0, 1) + wide("r1") + wide("S")))
        z.writestr("xl/_rels/workbook.bin.rels", '<R><Relationship Id="r1" Target="worksheets/sheet1.bin"/></R>')
        z.writestr("xl/sharedStrings.bin", rec(19, b"\0" + wide("Name")) + rec(19, b"\0" + wide("日本text")))
        z.writestr("xl/styles.bin", rec(44, struct.pack("<H", 164) + wide("yyyy-mm")) + xf(14) + rec(617) + xf(0) + xf(14) + xf(164) + rec(618))
        z.writestr("xl/worksheets/sheet1.bin", sheet)
    assert load("x.xlsb", out.getvalue()).sheets == [("S", ROWS)]


@pytest.mark.parametrize("name", ["msg", "doc", "ppt", "xls"])
def test_damaged_compound_files_are_errors_or_end(name):
    data = {"msg": mail, "doc": lambda: word("Some text.\r", True), "ppt": deck, "xls": workbook}[name]()
    with pytest.raises(ParseError):
        load(f"x.{name}", b"no such file")
    with pytest.raises(ParseError):
        load(f"x.{name}", compound({"Other": b"x"}))
    for cut in range(512, len(data), 331):
        try:
            load(f"x.{name}", data[:cut])
        except ParseError:
            pass


def test_a_dataframe_of_files(spark):
    files = spark.createDataFrame([("a.pdf", bytearray(pdf(REPORT))), ("b.msg", bytearray(mail())), ("c.xls", bytearray(workbook())), ("d.doc", bytearray(b"broken")), ("e.ppt", None)], "path string, content binary")
    found = {p: (n, e) for p, n, e in chunk_files(files).groupBy("path").agg({"chunk_index": "count", "parse_error": "max"}).collect()}
    assert found["d.doc"][0] == 0 and "ParseError" in found["d.doc"][1]
    assert {p for p, (n, e) in found.items() if n and not e} == {"a.pdf", "b.msg", "c.xls"}
