"""Declared tables, print areas and named ranges of spreadsheets."""

import io
import zipfile

from lexiloom import formats_api
from lexiloom.operators import grid
from lexiloom.sources.formats import _range, load

REL = '<R><Relationship Id="r1" Target="{}"/></R>'
RNS = 'xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'


def package(**parts: str) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in parts.items():
            z.writestr(name, text)
    return out.getvalue()


def book(rows: list[list], table: str = "", area: str = "") -> bytes:
    def cell(i: int, j: int, v) -> str:
        ref = f"{grid.column_letters(j)}{i}"
        return f'<c r="{ref}" t="inlineStr"><is><t>{v}</t></is></c>' if isinstance(v, str) else f'<c r="{ref}"><v>{v}</v></c>'

    sheet = "<worksheet><sheetData>" + "".join(f'<row r="{i}">' + "".join(cell(i, j, v) for j, v in enumerate(r) if v is not None) + "</row>" for i, r in enumerate(rows, 1)) + "</sheetData></worksheet>"
    defined = f'<definedNames><definedName name="_xlnm.Print_Area" localSheetId="0">{area}</definedName></definedNames>' if area else ""
    parts = {"xl/workbook.xml": f'<workbook {RNS}><sheets><sheet name="S" r:id="r1"/></sheets>{defined}</workbook>', "xl/_rels/workbook.xml.rels": REL.format("worksheets/sheet1.xml"), "xl/worksheets/sheet1.xml": sheet}
    if table:
        parts |= {"xl/worksheets/_rels/sheet1.xml.rels": REL.format("../tables/table1.xml"), "xl/tables/table1.xml": f'<table displayName="SalesData" ref="{table}"/>'}
    return package(**parts)


SALES = [["Revenue", "Units", "Quarter"], [42000, 18, "Q3"], [38000, 15, "Q4"], [12500, 9, "Q1"]]


def chunks(tmp_path, data: bytes, mode: str, name: str = "x.xlsx", **options) -> list[dict]:
    (tmp_path / name).write_bytes(data)
    return formats_api.CALLS["chunk_sheet"](tmp_path / name, mode, **options)[0]


def test_a_declared_table(tmp_path):
    (found,) = chunks(tmp_path, book([*SALES, [], ["outside"]], "A1:C4"), "table")
    assert found["content"].split("\n")[0] == "Revenue: 42000 | Units: 18 | Quarter: Q3"
    assert found["metadata"] == {
        "sheet_name": "S", "sheet_index": 0, "table_name": "SalesData", "is_named_table": True, "header_row": ["Revenue", "Units", "Quarter"], "start_row": 1, "end_row": 3, "start_col": 0, "end_col": 2, "row_count": 3, "col_count": 3,
        "is_split": False, "split_part": None, "chunk_index": 0,
    }
    (sheet,) = chunks(tmp_path, book(SALES, "A1:C4"), "sheet")
    assert (sheet["metadata"]["has_named_tables"], sheet["metadata"]["named_tables"], sheet["metadata"]["row_count"]) == (True, ["SalesData"], 3)


def test_tables_without_rows_and_split_ones(tmp_path):
    assert [c["content"] for c in chunks(tmp_path, book(SALES[:1], "A1:C1"), "table")] == ["Revenue: Revenue | Units: Units | Quarter: Quarter"]
    assert chunks(tmp_path, book([["", ""], ["x"]], "A1:B1"), "table") == []
    rows = [SALES[0], *([10000 + i, i, f"Quarter-{i}"] for i in range(1, 35))]
    found = chunks(tmp_path, book(rows, "A1:C35"), "table", max_chunk_chars=120)
    assert len(found) > 1 and all(c["metadata"]["is_split"] and len(c["content"]) <= 120 for c in found)
    assert [c["metadata"]["split_part"] for c in found] == list(range(len(found)))
    assert [i for c in found for i in range(c["metadata"]["start_row"], c["metadata"]["end_row"] + 1)] == list(range(1, 35))


def test_regions_have_no_name(tmp_path):
    found = chunks(tmp_path, book([["A", "B", "C"], ["a1", "b1", "c1"], [], ["X", "Y"], ["x1", "y1"]]), "table")
    assert [(c["metadata"]["header_row"], c["metadata"]["is_named_table"], c["metadata"]["table_name"], c["metadata"]["start_row"]) for c in found] == [(["A", "B", "C"], False, None, 1), (["X", "Y"], False, None, 4)]


def test_print_areas(tmp_path):
    rows = [*SALES, [99999, 1, "Q9"]]
    (found,) = chunks(tmp_path, book(rows, area="S!$A$1:$C$4"), "page_aware")
    assert "99999" not in found["content"] and "Revenue: 42000 | Units: 18 | Quarter: Q3" in found["content"]
    facts = found["metadata"]
    assert (facts["has_print_area"], facts["print_area_ref"], facts["start_row"], facts["end_row"], facts["start_col"], facts["end_col"], facts["row_count"], facts["region_index"]) == (True, "A1:C4", 0, 3, 0, 2, 3, 0)
    assert [c["metadata"]["region_index"] for c in chunks(tmp_path, book(rows, area="'S'!$A$1:$C$2,'S'!$A$3:$B$5"), "page_aware")] == [0, 1]
    (whole,) = chunks(tmp_path, book(rows), "page_aware")
    assert whole["metadata"]["has_print_area"] is False and whole["metadata"]["print_area_ref"] is None
    assert whole["content"] == chunks(tmp_path, book(rows), "sheet")[0]["content"]


def test_windows_know_their_rows(tmp_path):
    found = chunks(tmp_path, book([SALES[0], SALES[1], [], SALES[2], SALES[3]]), "sliding_window", window_size=2, overlap=1)
    assert [(c["metadata"]["start_row"], c["metadata"]["end_row"]) for c in found] == [(1, 3), (3, 4), (4, 4)]


def test_named_ranges_that_cover_a_region(tmp_path):
    row = lambda *c: "<b:table-row>" + "".join(f"<b:table-cell><t:p>{x}</t:p></b:table-cell>" for x in c) + "</b:table-row>"
    names = '<b:named-expressions><b:named-range b:name="Print_Range" b:cell-range-address="$S.$A$1:.$Z$99"/><b:named-range b:name="First" b:cell-range-address="$S.$A$1:.$B$2"/></b:named-expressions>'
    data = package(**{"content.xml": f'<o xmlns:t="t" xmlns:b="b"><b:table b:name="S">{row("A", "B")}{row("a", "b")}<b:table-row/>{row("X")}{row("x")}</b:table>{names}</o>'})
    assert [c["metadata"]["table_name"] for c in chunks(tmp_path, data, "table", "x.ods")] == ["First", None]
    assert load("x.ods", data).marks[0].names == [("First", 0, 0, 1, 1)]


def test_references():
    assert [_range(x) for x in ("'My A1 sheet'!$B$2:$AA$10", "C3", "$S.$A$1:.$C$4", "#REF!")] == [(1, 1, 9, 26), (2, 2, 2, 2), (0, 0, 3, 2), None]
    assert [grid.column_letters(j) for j in (0, 25, 26, 701, 702)] == ["A", "Z", "AA", "ZZ", "AAA"]
