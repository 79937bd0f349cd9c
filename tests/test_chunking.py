"""Chunking of single documents: blocks, modes, token fitting, rows."""

import pytest
from lexiloom import api
from lexiloom.operators import grid, prose
from lexiloom.operators.markup import html_blocks, markdown_blocks, plain, txt_blocks, txt_type
from lexiloom.operators.prose import HTML, MD, TXT, Block, place, size

LONG = " ".join(f"Sentence number {i} has some words in it." for i in range(120))


def test_sentences():
    assert prose.sentences("Hello world. How are you. Fine.") == ["Hello world.", "How are you.", "Fine."]
    assert prose.sentences("First sentence. trailing text") == ["First sentence.", "trailing text"]
    assert prose.sentences("Is v1.2 out? Yes!  ") == ["Is v1.2 out?", "Yes!"]


def test_keywords_leave_out_short_and_stop_words():
    assert prose.keywords("The machine,learning;algorithm and they THEN Über") == {"machine", "learning", "algorithm"}


@pytest.mark.parametrize("text", [LONG, "x" * 5000, "é" * 3000, "word " * 900, "line one\n" * 400])
def test_packed_text_keeps_everything_within_the_cap(text):
    parts = prose.pack_text(text, 1200)
    assert all(len(p) <= 1200 for p in parts)
    assert "".join("".join(parts).split()) == "".join(text.split())


def test_lines_repeat_the_head():
    table = "\n".join(["| a | b |", "| --- | --- |", *(f"| {i} | {'v' * 30} |" for i in range(90))])
    parts = prose.pack_lines(table, 1200, 2)
    assert len(parts) > 1 and all(p.startswith("| a | b |\n| --- |") and len(p) <= 1200 for p in parts)


@pytest.mark.parametrize(
    ("text", "kind"),
    [
        ("```\nx\n```", "code_block"), ('{"a": 1}', "code_block"), ("git status", "code_block"), ("Title\n=====", "heading"), ("## Two", "heading"), ("A GOOD TITLE", "heading"), ("I.", "short_disconnected_paragraph"), ("MOBY-DICK;", "short_disconnected_paragraph"),
        ("a | b\nc | d", "table"), ("- one\n- two", "bullet_list"), ("1. one\n2. two", "bullet_list"), ("x" * 100, "plain_paragraph"), ("x" * 600, "long_single_paragraph"), ("short", "short_disconnected_paragraph"),
    ],
)
def test_kinds_of_plain_text(text, kind):
    assert txt_type(text) == kind


TEXT = "OPENING TITLE\n\nFirst paragraph about engines and pistons.\n\nSub\n----\nEngines need oil. This helps pistons.\n\n- one\n- two\n\nUnrelated thing entirely here, nothing is shared with the former words at all, so it is alone."


def test_blocks_of_plain_text_have_levels_and_paths():
    blocks = txt_blocks(TEXT)
    assert [b.type for b in blocks] == ["heading", "short_disconnected_paragraph", "heading", "short_disconnected_paragraph", "bullet_list", "plain_paragraph"]
    assert place(blocks)[3].path == ["Sub"] and [b.level for b in blocks if b.type == "heading"] == [2, 2]


def test_structural_merges_short_prose_and_keeps_lists_apart():
    out = prose.structural(txt_blocks("a\n\nb\n\n- x\n- y\n\n" + LONG), TXT)
    assert [c["content_type"] for c in out[:2]] == ["short_disconnected_paragraph", "bullet_list"] and out[0]["content"] == "a\nb"
    assert all(size(c["content"]) <= 1550 for c in out)


def test_section_parts_share_their_heading():
    out = prose.section(txt_blocks("# One\n\n" + "\n\n".join([LONG] * 2)), TXT)
    assert out[0]["content_type"] == "heading" and all(c["metadata"]["section_heading"] == "One" and size(c["content"]) <= 2000 for c in out)
    assert prose.section([Block("plain_paragraph", "x")], TXT)[0]["metadata"]["section_heading"] == "Preamble"
    assert prose.section([Block("plain_paragraph", "x")], MD)[0]["metadata"]["section_heading"] is None


@pytest.mark.parametrize(
    ("second", "reason"),
    [
        ("This goes on for rather a long time so that it is over eighty bytes in length, really it does.", "reference_continuity"),
        ("Furthermore there is another matter that has to be said in more than eighty bytes of plain text.", "elaboration"),
        ("For example a thing that takes more than eighty bytes of text to say in full, as it does here.", "example"),
        ("Therefore something follows that takes more than eighty bytes of text to say in full, as here.", "cause_effect"),
        ("Although it rains, a sentence of more than eighty bytes of text can still be written down here.", "contrast_continuation"),
        ("Short.", "short_paragraph"),
        ("Pistons appear again in a paragraph that has more than eighty bytes of text and shares a keyword.", "keyword_overlap"),
        ("However a new topic begins with pistons in a paragraph of more than eighty bytes of plain text.", None),
        ("Nothing whatsoever links up here: bananas, apples, cherries, plums, grapes and so on, and so forth.", None),
    ],
)
def test_semantic_signals(second, reason):
    first = "Engines have pistons, and a sentence about them can be longer than eighty bytes quite easily, as seen."
    out = prose.semantic([Block("plain_paragraph", first), Block("plain_paragraph", second)], TXT)
    assert (len(out) == 1) == (reason is not None)
    if reason:
        assert out[0]["metadata"]["primary_merge_reason"] == reason and out[0]["metadata"]["merge_reasons"] == [reason]


def test_question_and_label_signals():
    long = "Bananas, apples, cherries, plums and grapes are kinds of fruit that people like to eat all over."
    for first, reason in (("What is it?", "question_answer"), ("Fruit of all kinds:", "definition_expansion")):
        assert prose.semantic([Block("plain_paragraph", first), Block("plain_paragraph", long)], TXT)[0]["metadata"]["primary_merge_reason"] == reason


def test_headings_join_paragraphs_in_html_only():
    blocks = html_blocks("<h1>Title</h1><p>Text under it.")
    assert [c["content"] for c in prose.semantic(blocks, HTML)] == ["Title\n\nText under it."]


def test_windows_stop_at_the_first_that_reaches_the_end():
    blocks = [Block("plain_paragraph", f"p{i}") for i in range(7)]
    out = prose.sliding_window(blocks, TXT, 3, 1)
    assert [c["metadata"]["paragraph_range"] for c in out] == [[0, 2], [2, 4], [4, 6]]
    assert prose.sliding_window([], TXT) == []


def test_pages_and_sentences():
    blocks = [Block("heading", "H", 1, "H"), *(Block("plain_paragraph", f"A{i}. B{i}.") for i in range(4))]
    pages = prose.page_aware(blocks, TXT, 3)
    assert [(c["content_type"], c["metadata"].get("page_break_type")) for c in pages] == [("heading", "heading_boundary"), ("page_aware", "heading_boundary"), ("page_aware", "estimated")]
    groups = prose.sentence(blocks, TXT, 3)
    assert [c["content"] for c in groups[1:]] == ["A0. B0. A1.", "B1. A2. B2.", "A3. B3."]
    assert [c["metadata"]["source_paragraph_index"] for c in groups[1:]] == [0, 1, 3]


def test_markdown_blocks():
    text = "---\ntitle: x\n---\n# One\n\nText *with* [link](u) and `code`.\n- a\n- b\n\n| h | i |\n|---|---|\n| 1 | 2 |\n\n```py\nx = 1\n\ny = 2\n```\n\nTwo\n---\nlast"
    blocks = markdown_blocks(text)
    assert [(b.type, b.level) for b in blocks] == [("heading", 1), ("short_disconnected_paragraph", 0), ("bullet_list", 0), ("table", 0), ("code_block", 0), ("heading", 2), ("short_disconnected_paragraph", 0)]
    assert blocks[1].content == "Text with link and code." and blocks[4].content.count("\n") == 4
    assert plain("**b** _i_ snake_case ~~s~~ ![alt](x) \\*") == "b i snake_case s [Image: alt] *"


def test_html_blocks_with_open_tags_and_scripts():
    page = "<html><head><title>t</title></head><body><h1>A &amp; B</h1><script>var x = '</p>';</script><ul><li>one<li>two</ul><p>first<p>second<br>line<table><tr><td>d<th>h<tr><td>1</td><td>2</td></table><!-- c --><pre> a\n  b</pre>"
    assert [(b.type, b.content) for b in html_blocks(page)] == [
        ("heading", "A & B"), ("bullet_list", "- one\n- two"), ("short_disconnected_paragraph", "first"), ("short_disconnected_paragraph", "second\nline"), ("table", "h | d\n1 | 2"), ("code_block", " a\n  b"),
    ]


CSV = "Name,Revenue,Region\nAlpha,120,North\n\nBeta,200,South\nGamma,340,West\nDelta,500,East\n"


def test_csv_rows_and_windows():
    out = grid.csv_chunks(CSV, rows_per_chunk=2)
    assert [(c["metadata"]["row_start"], c["metadata"]["row_end"]) for c in out] == [(1, 2), (3, 4)]
    assert out[0]["content"] == "Name: Alpha | Revenue: 120 | Region: North\nName: Beta | Revenue: 200 | Region: South"
    assert grid.csv_chunks(CSV, include_headers=False)[0]["content"].startswith("Alpha | 120 | North")
    assert [c["metadata"]["row_start"] for c in grid.csv_chunks(CSV, "sliding_window", window_size=3, overlap=1)] == [1, 3]
    for d in "\t;|":
        assert grid.sniff_delimiter(CSV.replace(",", d)) == d
    assert grid.table_markdown(*grid.csv_rows("a,b\nx|y,1\nlonger,22\n")[:2]).splitlines()[2] == "| x\\|y | 1 |"


def test_sheets():
    rows = [[], ["Revenue", "Units", "Quarter"], ["42000", "18", "Q3"], [], ["38000", "15", "Q4"], ["12500", "", "Q1"]]
    sheets = [("Summary", rows), ("Region", [["Region", "Manager"], ["West", "Avery"], ["East", "Jordan"]])]
    out = grid.sheet_chunks(sheets)
    assert [c["content"] for c in out][:2] == ["Revenue: 42000 | Units: 18 | Quarter: Q3", "Revenue: 38000 | Units: 15 | Quarter: Q4"]
    assert [(c["metadata"]["start_row"], c["metadata"]["end_row"]) for c in grid.sheet_chunks(sheets[:1], "table")] == [(2, 2), (5, 5)]
    assert grid.regions(rows) == [(1, 2, 0, 2), (4, 5, 0, 2)]
    with pytest.raises(ValueError, match="sheet"):
        grid.sheet_chunks(sheets, sheet_names=["None"])
    groups = grid.sheet_chunks([("S", [["k", "v"], ["a", "1"], ["b", "2"], ["a", "3"]])], "semantic")
    assert [(c["metadata"]["category_value"], c["metadata"]["row_count"]) for c in groups] == [("a", 2), ("b", 1)] and groups[0]["metadata"]["low_grouping_quality"]


def words(text):
    return len(text.split())


def test_fit_tokens():
    chunk = lambda t, **m: {"content": t, "content_type": "paragraph", "metadata": m}
    long = " ".join(f"w{i}" for i in range(500))
    parts = api.fit_tokens([chunk(long)], words, 50)
    assert all(words(p["content"]) <= 50 for p in parts) and " ".join(p["content"] for p in parts) == long
    assert [p["metadata"]["fit_part"] for p in parts] == list(range(1, 11))
    joined = api.fit_tokens([chunk("a", section_heading="x", n=1), chunk("b", section_heading="x", n=2), chunk("c", section_heading="y")], words, 10, min_tokens=3, merge_metadata="union")
    assert [c["content"] for c in joined] == ["a\n\nb", "c"] and joined[0]["metadata"]["n"] == [1, 2]
    assert api.fit_tokens([chunk(long)], words, 50, oversize="keep")[0]["content"] == long
    for bad, message in (({"budget": 0}, "budget"), ({"min_tokens": -1}, "min_tokens"), ({"split": "sentances"}, "split"), ({"oversize": "error"}, "exceeds")):
        with pytest.raises(ValueError, match=message):
            api.fit_tokens([chunk(long)], words, **({"budget": 50} | bad))
