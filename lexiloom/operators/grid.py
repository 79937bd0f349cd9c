"""Rows of one delimited file or sheet into chunks."""

from __future__ import annotations

import csv
import io
import re
from collections import Counter
from typing import NamedTuple

from ..functions.words import SEMANTIC_MAX, SHEET_MAX
from .prose import batches_of, size

Row = list[str]


def sniff_delimiter(text: str) -> str:
    """The most frequent of , tab ; | outside quotes in the first line that is neither blank nor a comment."""
    first = next((x for x in text.split("\n") if x.strip() and not x.lstrip().startswith("#")), "")
    bare = re.sub(r'"[^"]*"?', "", first)
    counts = [(bare.count(d), -i, d) for i, d in enumerate(",\t;|")]
    most = max(counts)
    return most[2] if most[0] else ","


def _number(x: str) -> bool:
    """A number, signed or with a currency before it, thousands set apart by commas, maybe a percentage."""
    try:
        float(x.strip().lstrip("+-$£€").replace(",", "").rstrip("%"))
    except ValueError:
        return False
    return "_" not in x


def has_header(first: Row, rows: list[Row]) -> bool:
    """A vote of the columns over the first 20 rows, which are the rule's own limit: numbers under a name, or texts of another length."""
    rows = rows[:20]
    if not rows or any(not c.strip() for c in first) or all(map(_number, first)):
        return False
    votes = 0
    for i, name in enumerate(first):
        values = [r[i] for r in rows if i < len(r)]
        if not values:
            continue
        if 2 * sum(map(_number, values)) > len(values):
            votes += -1 if _number(name) else 1
        else:
            votes += 1 if sorted(len(v.strip()) for v in values)[len(values) // 2] != len(name.strip()) else -1
    return votes > 0


def csv_rows(text: str, delimiter: str | None = None, skip_empty: bool = True) -> tuple[Row, list[Row], bool, str]:
    """(header, data rows, whether the file has the header, delimiter); ragged rows stay as they are."""
    delimiter = delimiter or sniff_delimiter(text)
    rows = [r for r in csv.reader(io.StringIO(text), delimiter=delimiter) if any(c.strip() for c in r) or not skip_empty]
    own = bool(rows) and has_header(rows[0], rows[1:])
    return (rows[0], rows[1:], True, delimiter) if own else ([f"Column {i + 1}" for i in range(len(rows[0]) if rows else 0)], rows, False, delimiter)


def names(header: Row, width: int) -> Row:
    return [h.strip() or f"Column {i + 1}" for i, h in enumerate(header)] + [f"Column {i + 1}" for i in range(len(header), width)]


def render(row: Row, header: Row, with_names: bool = True) -> str:
    return " | ".join(f"{h}: {c}" if with_names else c for h, c in zip(names(header, len(row)), row, strict=False))


def _chunk(kind: str, content: str, **metadata) -> dict:
    return {"content_type": kind, "content": content, "metadata": metadata}


def csv_chunks(text: str, mode: str = "row", rows_per_chunk: int = 10, window_size: int = 5, overlap: int = 1, include_headers: bool = True, delimiter: str | None = None, encoding: str = "auto", skip_empty_rows: bool = True) -> list[dict]:
    header, rows, own, found = csv_rows(text, delimiter, skip_empty_rows)
    out: list[dict] = []
    windows = mode == "sliding_window"
    starts = range(0, len(rows), window_size - overlap if windows else rows_per_chunk)
    widest = len(header)
    for i, at in enumerate(starts):
        part = rows[at : at + (window_size if windows else rows_per_chunk)]
        widest = max(widest, *map(len, part))
        head = names(header, widest)
        content = "\n".join(render(r, head, include_headers) for r in part)
        common = {"header_row": head, "has_header": own, "col_count": widest, "delimiter_detected": found, "encoding": encoding, "chunk_index": i}
        if windows:
            out.append(_chunk("row_window", content, window_index=i, window_size=window_size, overlap=overlap, row_start=at + 1, row_end=at + len(part), actual_row_count=len(part), **common))
        else:
            out.append(_chunk("row_group", content, row_start=at + 1, row_end=at + len(part), row_count=len(part), **common))
    return out


def table_markdown(header: Row, rows: list[Row]) -> str:
    width = max([len(header), *map(len, rows)], default=0)
    cell = lambda c: c.replace("|", "\\|").replace("\n", " ")
    line = lambda r: "| " + " | ".join([cell(c) for c in r] + [""] * (width - len(r))) + " |"
    return "\n".join([line(names(header, width)), "| " + " | ".join(["---"] * width) + " |", *map(line, rows)]) if width else ""


def _trimmed(rows: list[Row]) -> list[Row]:
    return [r for r in rows if any(c.strip() for c in r)]


class Typed(str):
    """The text of a cell that is no text: a number, truth value, date or error."""

    __slots__ = ()


class Marks(NamedTuple):
    """What a sheet says of its ranges: (name, first row, first column, last row, last column), from 0."""

    tables: list[tuple[str, int, int, int, int]] = []
    areas: list[tuple[int, int, int, int]] = []  # to print
    names: list[tuple[str, int, int, int, int]] = []


def data_rows(rows: list[Row]) -> tuple[Row, list[tuple[int, Row]]]:
    """(header, filled rows below it with their places). The first filled row is the header if all its cells are text, or
    texts follow one number; a sheet of only that row has it as data too."""
    filled = [(i, r) for i, r in enumerate(rows) if any(c.strip() for c in r)]
    if not filled:
        return [], []
    first = filled[0][1]
    texts = [not isinstance(c, Typed) for c in first if c.strip()]
    if all(texts) or (len(texts) > 1 and not texts[0] and all(texts[1:])):
        return first, filled[1:] or filled[:1]
    return [""] * len(first), filled


def sheet_header(rows: list[Row]) -> tuple[Row, list[Row]]:
    header, data = data_rows(rows)
    return header, [r for _, r in data]


def column_letters(j: int) -> str:
    out = ""
    while j >= 0:
        out, j = chr(65 + j % 26) + out, j // 26 - 1
    return out


def regions(rows: list[Row]) -> list[tuple[int, int, int, int]]:
    """(first row, last row, first column, last column) of every run of rows that aren't empty."""
    out, start = [], None
    for i, r in enumerate([*rows, []]):
        if any(c.strip() for c in r):
            start = i if start is None else start
        elif start is not None:
            used = [j for x in rows[start:i] for j, c in enumerate(x) if c.strip()]
            out.append((start, i - 1, min(used), max(used)))
            start = None
    return out


def category_column(header: Row, rows: list[Row]) -> int | None:
    """The text column with the fewest values that repeat; the first of those."""
    best = None
    for j in range(len(header)):
        values = [v if isinstance(v := r[j], Typed) else v.strip() for r in rows if j < len(r) and r[j].strip()]
        distinct = len(set(values))
        if values and distinct < len(values) and not any(isinstance(v, Typed) or _number(v) for v in values) and (best is None or distinct < best[0]):
            best = (distinct, j)
    return best[1] if best else None


def _cells(row: Row, left: int, right: int) -> Row:
    part = row[left : right + 1]
    return part + [""] * (right - left + 1 - len(part))


def _parts(rows: list[tuple[int, Row]], show, limit: int):
    """(places, lines, split facts) of rows whose lines fit together into limit bytes."""
    parts = list(batches_of(((i, show(r)) for i, r in rows), limit + 1, lambda x: size(x[1]) + 1))
    for k, part in enumerate(parts):
        yield [i for i, _ in part], [line for _, line in part], {"is_split": len(parts) > 1, "split_part": k if len(parts) > 1 else None}


def sheet_chunks(sheets: list[tuple[str, list[Row]]], mode: str = "row", rows_per_chunk: int = 1, window_size: int = 3, overlap: int = 1, sheet_names: list[str] | None = None, serialize_as: str = "key_value", max_chunk_chars: int = SHEET_MAX, marks: list[Marks] | None = None) -> list[dict]:
    """Chunks of sheets. Places of rows and columns count from 0; declared tables, where a sheet has any, stand for its regions."""
    known = [n for n, _ in sheets]
    if unknown := [n for n in sheet_names or () if n not in known]:
        raise ValueError(f"unknown sheet names: {', '.join(unknown)}")
    out: list[dict] = []
    for at, (name, rows) in enumerate(sheets):
        if sheet_names and name not in sheet_names:
            continue
        header, places = data_rows(rows)
        data = [r for _, r in places]
        if not data:
            continue
        mark = marks[at] if marks else Marks()
        head = names(header, max(map(len, data)))
        show = lambda r, h=head: render(r, h, serialize_as == "key_value")
        where = {"sheet_name": name, "sheet_index": at, "header_row": head, "col_count": len(head)}
        if mode in ("default", "row"):
            for i, k in enumerate(range(0, len(data), rows_per_chunk)):
                part = data[k : k + rows_per_chunk]
                out.append(_chunk("row_document", "\n".join(map(show, part)), **where, row_index=k + 1, rows_per_chunk=rows_per_chunk, actual_row_count=len(part), chunk_index=i))
        elif mode == "sliding_window":
            for i, k in enumerate(range(0, len(data), window_size - overlap)):
                part = data[k : k + window_size]
                out.append(_chunk("row_window", "\n".join(map(show, part)), **where, window_index=i, window_size=window_size, overlap=overlap, start_row=places[k][0], end_row=places[k + len(part) - 1][0], actual_row_count=len(part)))
        elif mode in ("sheet", "section"):
            named = [t[0] for t in mark.tables] or [n[0] for n in mark.names]
            for _, lines, split in _parts(places, show, max_chunk_chars):
                out.append(_chunk("sheet", "\n".join(lines), **where, row_count=len(lines), has_named_tables=bool(named), named_tables=named, **split))
        elif mode == "page_aware":
            areas = mark.areas or [None]
            for n, area in enumerate(areas):
                top, left, bottom, right = area or (0, 0, len(rows) - 1, len(head) - 1)
                h, body = data_rows([_cells(r, left, right) for r in rows[top : bottom + 1]])
                hh = names(h, right - left + 1)
                ref = f"{column_letters(left)}{top + 1}:{column_letters(right)}{bottom + 1}" if area else None
                for _, lines, split in _parts(body, lambda r, hh=hh: render(r, hh, serialize_as == "key_value"), max_chunk_chars):
                    facts = {"has_print_area": area is not None, "print_area_ref": ref, "start_row": top, "end_row": bottom, "start_col": left, "end_col": right, "row_count": len(lines), "region_index": n if area else split["split_part"] or 0}
                    out.append(_chunk("sheet_region", "\n".join(lines), **where | {"header_row": hh, "col_count": right - left + 1}, **facts, **split))
        elif mode in ("table", "structural"):
            found = [(t[0], *t[1:]) for t in mark.tables]
            own = bool(found)
            for top, bottom, left, right in [] if own else regions(rows):
                within = next((n[0] for n in mark.names if n[1] <= top and n[2] <= left and n[3] >= bottom and n[4] >= right), None)
                found.append((within, top, left, bottom, right))
            for called, top, left, bottom, right in found:
                cells = [_cells(r, left, right) for r in rows[top : bottom + 1]]
                # a declared table has a header; what only holds that has it as data too
                h, body = (cells[0], [(i, r) for i, r in enumerate(cells) if i and any(c.strip() for c in r)] or [(0, r) for r in cells[:1] if any(c.strip() for c in r)]) if own and cells else data_rows(cells)
                hh = names(h, right - left + 1)
                for at_rows, lines, split in _parts(body, lambda r, hh=hh: render(r, hh, serialize_as == "key_value"), max_chunk_chars):
                    facts = {"table_name": called, "is_named_table": called is not None, "header_row": hh, "start_row": top + at_rows[0], "end_row": top + at_rows[-1], "start_col": left, "end_col": right, "row_count": len(lines), "col_count": right - left + 1}
                    out.append(_chunk("table_region", "\n".join(lines), sheet_name=name, sheet_index=at, **facts, **split))
        elif mode == "semantic":
            j = category_column(head, data)
            key = (lambda r: r[j].strip() if j < len(r) else "") if j is not None else None
            groups: list[tuple[str | None, list[Row]]] = []
            if key:
                counts = Counter(map(key, data))
                groups = [(v, [r for r in data if key(r) == v]) for v in sorted(counts)]
            else:
                groups = [(None, data[k : k + rows_per_chunk]) for k in range(0, len(data), rows_per_chunk)]
            average = int(len(data) / len(groups) * 100 + 0.5) / 100
            for v, part in groups:
                for piece in batches_of(list(map(show, part)), SEMANTIC_MAX + 1, lambda s: len(s) + 1):
                    out.append(_chunk("semantic_group", "\n".join(piece), **where, category_column=head[j] if key else None, category_value=v, row_count=len(piece), avg_group_size=average, low_grouping_quality=average < 2))
        else:
            raise ValueError(f"mode {mode!r} is not known for spreadsheets")
    for i, c in enumerate(out):
        c["metadata"].setdefault("chunk_index", i)
    return out
