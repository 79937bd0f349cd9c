"""Bytes of one file, by its extension, into blocks of prose or sheets of rows. Only the standard library is used."""

from __future__ import annotations

import datetime
import email
import email.policy
import email.utils
import io
import json
import posixpath
import re
import struct
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass, field, replace
from xml.etree import ElementTree

from ..functions.words import ENVELOPES
from ..operators import grid, prose
from ..operators.markup import blocks_to_markdown, front_matter, html_blocks, markdown_blocks, txt_blocks
from ..operators.prose import HTML, MD, TXT, Block, Style
from . import compound
from .compound import CompoundError, binary_package, mail_item, old_deck, old_document, old_workbook
from .pdf import PdfError, pdf_pages
from .word import Word, read_word, word_blocks, word_markdown

FAMILIES = {
    "txt": ("txt",),
    "md": ("md", "markdown"),
    "html": ("html", "htm"),
    "csv": ("csv", "tsv"),
    "json": ("json", "jsonl", "ndjson"),
    "eml": ("eml",),
    "mbox": ("mbox",),
    "ipynb": ("ipynb",),
    "sheet": ("xlsx", "xlsm", "xltx", "xltm", "ods", "xls", "xlsb"),
    "docx": ("docx", "docm", "dotx", "dotm"),
    "pptx": ("pptx", "potx", "potm", "ppsx", "ppsm"),
    "odf": ("odt", "odp"),
    "epub": ("epub",),
    "rtf": ("rtf",),
    "pdf": ("pdf",),
    "msg": ("msg",),
    "doc": ("doc",),
    "ppt": ("ppt",),
}
FAMILY = {ext: family for family, exts in FAMILIES.items() for ext in exts}


class UnsupportedFormat(ValueError):
    pass


class ParseError(ValueError):
    pass


@dataclass
class Loaded:
    """A parsed file. starts: (first block, metadata) of its records, messages, slides or chapters."""

    style: Style
    blocks: list[Block] = field(default_factory=list)
    sheets: list[tuple[str, list[grid.Row]]] | None = None
    marks: list[grid.Marks] | None = None  # of the sheets
    text: str = ""
    starts: list[tuple[int, dict]] = field(default_factory=list)
    word: Word | None = None  # for the structural mode of word-processor files


def extension(name: str) -> str:
    return posixpath.basename(name.replace("\\", "/")).rpartition(".")[2].lower()


#: Encodings that a caller may name for delimited text, with Python's name for each. Fixed values.
NAMED = {"utf-8": "utf-8", "utf-8-bom": "utf-8-sig", "utf-16-le": "utf-16-le", "utf-16-be": "utf-16-be", "latin-1": "cp1252", "windows-1252": "cp1252"}


def decode_named(data: bytes, encoding: str) -> str:
    """Text in the encoding that the caller names: strict, where `auto` never fails."""
    if encoding == "auto":
        return decode(data)
    if encoding not in NAMED:
        raise ValueError(f"unsupported encoding: {encoding!r}")
    try:
        return _newlines(data.decode(NAMED[encoding]))
    except UnicodeDecodeError as e:
        raise ParseError(f"the bytes are not {encoding}: {e.reason} at {e.start}") from None


def decode(data: bytes, declared: str | None = None) -> str:
    """Byte-order mark, zero bytes of UTF-16, UTF-8, a declared charset, else windows-1252; line ends are line feeds."""
    head = data[:4096]
    for mark, name in ((b"\xef\xbb\xbf", "utf-8"), (b"\xff\xfe", "utf-16-le"), (b"\xfe\xff", "utf-16-be")):
        if data.startswith(mark):
            return _newlines(data[len(mark) :].decode(name, "replace"))
    if len(head) >= 4:
        even, odd = (head[i::2].count(0) / len(head[i::2]) for i in (0, 1))
        if max(even, odd) >= 0.2 and min(even, odd) < 0.05:
            return _newlines(data.decode("utf-16-le" if odd > even else "utf-16-be", "replace"))
    try:
        return _newlines(data.decode("utf-8"))
    except UnicodeDecodeError:
        pass
    try:
        return _newlines(data.decode(declared or "cp1252", "replace"))
    except LookupError:
        return _newlines(data.decode("cp1252", "replace"))


def _newlines(text: str) -> str:
    return text.replace("\r\n", "\n").replace("\r", "\n")


def _html_text(data: bytes) -> str:
    declared = re.search(rb"charset=[\"']?\s*([\w-]+)", data[:1024], re.IGNORECASE)
    return decode(data, declared[1].decode() if declared else None)


# JSON


def _scalar(v) -> str | None:
    if isinstance(v, (dict, list)):
        return None
    return v if isinstance(v, str) else json.dumps(v)


def _compact(v) -> str:
    s = json.dumps(v, ensure_ascii=False, separators=(",", ":"))
    return s if prose.size(s) <= 4000 else s.encode()[:4000].decode("utf-8", "ignore") + "…"


def _bullets(pairs, depth: int):
    for key, v in pairs:
        mark = f"{'  ' * depth}- **{key}:**"
        if (one := _scalar(v)) is not None:
            yield f"{mark} {one}"
        elif isinstance(v, list) and all(_scalar(x) is not None for x in v):
            yield f"{mark} {', '.join(map(_scalar, v))}"
        elif depth >= 6:
            yield f"{mark} {_compact(v)}"
        else:
            yield mark
            yield from _bullets(v.items() if isinstance(v, dict) else ((f"[{i}]", x) for i, x in enumerate(v)), depth + 1)


def render_record(v) -> str:
    if (one := _scalar(v)) is not None:
        return one
    if not v:
        return "(empty object)" if isinstance(v, dict) else "(empty array)"
    return "\n".join(_bullets(v.items() if isinstance(v, dict) else ((f"[{i}]", x) for i, x in enumerate(v)), 0))


def _records(texts: list[str], style: Style, lead: str = "") -> Loaded:
    blocks, starts = (markdown_blocks(lead), []) if lead else ([], [])
    for i, t in enumerate(texts, 1):
        starts.append((len(blocks), {"record_range": [i, i]}))
        blocks += markdown_blocks(t)
    return Loaded(style, blocks, text="\n\n".join([lead] * bool(lead) + texts), starts=starts)


def _json(data: bytes, ext: str) -> Loaded:
    text = decode(data)
    style = lambda n, top, key=None: replace(MD, name=ext, extra={"record_count": n, "top_level": top, "envelope_key": key})
    if ext != "json":
        found = []
        for line in text.split("\n"):
            line = line.strip().removeprefix("\x1e")
            if line:
                try:
                    found.append(render_record(json.loads(line)))
                except ValueError:
                    found.append(line)
        return _records(found, style(len(found), "lines"))
    if not text.strip():
        return Loaded(style(0, "empty"))
    try:
        root = json.loads(text)
    except (ValueError, RecursionError) as e:
        raise ParseError(f"not valid JSON: {e}") from None
    if isinstance(root, list):
        return _records([render_record(x) for x in root], style(len(root), "array"))
    key = next((k for k in ENVELOPES if isinstance(root, dict) and isinstance(root.get(k), list)), None)
    if key:
        rest = {k: v for k, v in root.items() if k != key}
        return _records([render_record(x) for x in root[key]], style(len(root[key]), "object", key), render_record(rest) if rest else "")
    return _records([render_record(root)], style(1, "object" if isinstance(root, dict) else "scalar"))


# mail


def _body(message) -> str:
    plain = message.get_body(("plain",))
    if plain is not None:
        return _newlines(plain.get_content()).strip()
    page = message.get_body(("html",))
    return blocks_to_markdown(html_blocks(page.get_content())) if page is not None else ""


def _date(message) -> str | None:
    try:
        return email.utils.parsedate_to_datetime(str(message["date"])).isoformat()
    except (TypeError, ValueError):
        return None


def _mail(data: bytes, level: int = 1) -> tuple[str, dict]:
    m = email.message_from_bytes(data, policy=email.policy.default)
    people = lambda h: [str(a) for x in m.get_all(h, []) for a in x.addresses]
    files = list(m.iter_attachments())
    facts = {
        "subject": m["subject"] and str(m["subject"]), "from": (people("from") or [None])[0], "to": people("to"), "cc": people("cc"), "bcc": people("bcc"), "date": _date(m), "message_id": (str(m["message-id"]).strip("<> ") if m["message-id"] else None),
        "in_reply_to": re.findall(r"<([^>]+)>", str(m["in-reply-to"] or "")), "references": re.findall(r"<([^>]+)>", str(m["references"] or "")), "has_attachments": bool(files), "attachment_count": len(files),
    }
    head = [f"**{n}:** {v}" for n, v in (("From", facts["from"]), ("To", ", ".join(facts["to"])), ("Cc", ", ".join(facts["cc"])), ("Date", facts["date"])) if v]
    parts = [f"{'#' * level} {facts['subject']}"] if facts["subject"] else []
    parts += ["  \n".join(head)] if head else []
    parts += [b] if (b := _body(m)) else []
    if files:
        parts += ["## Attachments", "\n".join(f"- {f.get_filename() or '(unnamed)'} ({f.get_content_type()})" for f in files)]
    return "\n\n".join(parts), facts


def _eml(data: bytes) -> Loaded:
    text, facts = _mail(data)
    return Loaded(replace(MD, name="eml", extra=facts), markdown_blocks(text), text=text)


_POSTMARK = re.compile(rb"^From (?:.*\d{4}\s*|\S+@\S+.*)$")


def split_mbox(data: bytes) -> list[bytes]:
    """Messages that begin with a postmark line (`From `, with a year at its end or an address) before a header line.

    They stay bytes: each message declares its own charsets.
    """
    lines = data.replace(b"\r\n", b"\n").split(b"\n")
    at = [i for i, x in enumerate(lines[:-1]) if _POSTMARK.match(x) and re.match(rb"[\w-]+:", lines[i + 1])]
    return [b"\n".join(re.sub(rb"^>(>*From )", rb"\1", x) for x in lines[i + 1 : j]) for i, j in zip(at, [*at[1:], len(lines)], strict=True)]


def _mbox(data: bytes) -> Loaded:
    blocks, starts, texts = [], [], []
    for i, m in enumerate(split_mbox(data)):
        text, f = _mail(m, 2)
        starts.append((len(blocks), {"message_index": i, "message_subject": f["subject"], "message_from": f["from"], "message_date": f["date"], "message_id": f["message_id"], "in_reply_to": f["in_reply_to"], "references": f["references"]}))
        blocks += markdown_blocks(text)
        texts.append(text)
    return Loaded(replace(MD, name="mbox", extra={"message_count": len(texts), "skipped_messages": []}), blocks, text="\n\n---\n\n".join(texts), starts=starts)


# notebooks


def _joined(v) -> str:
    return "".join(v) if isinstance(v, list) else v or ""


def _ipynb(data: bytes) -> Loaded:
    try:
        root = json.loads(decode(data))
        cells = root.get("cells") or [c for w in root.get("worksheets", []) for c in w.get("cells", [])]
    except (ValueError, AttributeError) as e:
        raise ParseError(f"not a notebook: {e}") from None
    meta = root.get("metadata", {})
    kernel = meta.get("kernelspec", {})
    language = kernel.get("language") or meta.get("language_info", {}).get("name")
    parts = []
    for c in cells:
        source = _joined(c.get("source") or c.get("input")).strip("\n")
        if c.get("cell_type") != "code":
            parts.append(source)
            continue
        parts.append(f"```{language or ''}\n{source}\n```" if source else "")
        for o in c.get("outputs", []):
            rich = o.get("data", {})
            shown = _joined(o.get("text")) or _joined(rich.get("text/markdown")) or _joined(rich.get("text/plain")) or "\n".join(o.get("traceback", []))
            shown = re.sub("\x1b\\[[^@-~]*[@-~]", "", shown).strip()
            parts.append(f"```\n{shown[:4000]}\n```" if shown else "")
    kinds = [c.get("cell_type") for c in cells]
    extra = {"language": language, "kernel": kernel.get("display_name") or kernel.get("name"), "nbformat": f"{root.get('nbformat')}.{root.get('nbformat_minor', 0)}", "cell_count": len(cells), "code_cell_count": kinds.count("code"), "markdown_cell_count": kinds.count("markdown")}
    text = "\n\n".join(p for p in parts if p.strip())
    return Loaded(replace(MD, name="ipynb", extra=extra), markdown_blocks(text), text=text)


# packages


class _Package:
    def __init__(self, data: bytes):
        try:
            self.zip = zipfile.ZipFile(io.BytesIO(data))
        except zipfile.BadZipFile as e:
            raise ParseError(f"not a package: {e}") from None
        self.names = set(self.zip.namelist())

    def xml(self, name: str) -> ElementTree.Element | None:
        if name not in self.names:
            return None
        try:
            return ElementTree.fromstring(self.zip.read(name))
        except ElementTree.ParseError as e:
            raise ParseError(f"{name}: {e}") from None

    def related(self, part: str) -> dict[str, str]:
        folder, base = posixpath.split(part)
        root = self.xml(f"{folder}/_rels/{base}.rels")
        return {r.get("Id"): posixpath.normpath(posixpath.join("/" + folder, r.get("Target"))).lstrip("/") for r in (root if root is not None else ()) if r.get("TargetMode") != "External"}


def _local(e) -> str:
    return e.tag.rpartition("}")[2] if isinstance(e.tag, str) else ""


def _attr(e, name: str) -> str | None:
    return next((v for k, v in e.attrib.items() if k.rpartition("}")[2] == name), None)


def _all(e, name: str):
    return (x for x in e.iter() if _local(x) == name)


def _docx(data: bytes) -> Loaded:
    def imported(part: bytes, name: str) -> list[Block]:
        try:
            return load(name, part).blocks if FAMILY.get(extension(name)) in ("docx", "html", "txt", "rtf") else []
        except ParseError:
            return []

    found = read_word(_Package(data), imported)
    if found is None:
        raise ParseError("word/document.xml is missing")
    return Loaded(replace(MD, name="docx"), word_blocks(found), text=word_markdown(found), word=found)


def _diagram(root) -> list[str]:
    """Paragraphs of a diagram's points, without those that only arrange it."""
    points = [x for x in _all(root, "pt") if x.get("type") in (None, "node", "asst", "doc")]
    return [s for x in points for t in x if _local(t) == "t" for q in _all(t, "p") if (s := "".join(r.text or "" for r in _all(q, "t")).strip())]


def _decimal(v: str) -> str:
    """A number with up to six decimals; other texts as they are."""
    try:
        x = float(v)
    except ValueError:
        return v
    return v if x != x or abs(x) == float("inf") else (f"{x:.6f}".rstrip("0").rstrip(".") if round(x, 6) else "0")


def _chart(root) -> list[list[str]]:
    """A chart's stored values: a row of `Category` and the names of its series, then a row for each category."""

    def points(e, *names: str) -> dict[int, str]:
        found = next((x for x in e if _local(x) in names), None)
        return {int(q.get("idx") or 0): next((v.text or "" for v in _all(q, "v")), "").strip() for q in _all(found, "pt")} if found is not None else {}

    series = list(_all(root, "ser"))
    values = [points(s, "val", "yVal") for s in series]
    if not any(values):
        return []
    labels: dict[int, str] = {}
    for s in series:
        labels = points(s, "cat", "xVal") | labels
    labels = labels or {i: str(i + 1) for i in range(max(i for v in values for i in v) + 1)}
    names = []
    for s in series:
        tx = next((x for x in s if _local(x) == "tx"), None)
        names.append(next((v.text for v in _all(tx, "v")), None) if tx is not None else None)
    head = [f"Series {n}" if not x else f"{x} ({n})" if names.count(x) > 1 else x for n, x in enumerate(names, 1)]
    return [["Category", *head], *([label, *(_decimal(v.get(i, "")) for v in values)] for i, label in sorted(labels.items()))]


def _deck_sections(deck) -> dict[int, str]:
    """Name of the section of a slide, by its place in the deck."""
    own = next(_all(deck, "sldIdLst"), ())
    place = {x.get("id"): n for n, x in enumerate(own)}
    return {place[x.get("id")]: s.get("name") or "" for s in _all(deck, "section") for x in _all(s, "sldId") if x.get("id") in place}


def _pptx(data: bytes) -> Loaded:
    package = _Package(data)
    deck, links = package.xml("ppt/presentation.xml"), package.related("ppt/presentation.xml")
    if deck is None:
        raise ParseError("ppt/presentation.xml is missing")
    slides = [links[i] for x in _all(deck, "sldId") if (i := next((v for k, v in x.attrib.items() if k.endswith("}id")), None)) in links]
    sections = _deck_sections(deck)
    blocks, starts = [], []
    lines = lambda shape: [t for p in _all(shape, "p") if (t := " ".join(x for x in ((r.text or "").strip() for r in _all(p, "t")) if x))]
    for n, part in enumerate(slides, 1):
        slide = package.xml(part)
        title, body = None, []
        for shape in slide.iter() if slide is not None else ():
            kind = _local(shape)
            if kind == "sp":
                ph = next(_all(shape, "ph"), None)
                role = None if ph is None else ph.get("type") or ("title" if ph.get("idx") == "0" else None)
                if role in ("sldNum", "ftr", "dt"):
                    continue
                text = lines(shape)
                if role in ("title", "ctrTitle", "subTitle") and title is None:
                    title = " ".join(text) or None
                elif text:
                    body.append(("text", "\n".join(text)))
            elif kind == "tbl":
                rows = [[" ".join(lines(c)) for c in r if _local(c) == "tc"] for r in _all(shape, "tr")]
                if rows := [" | ".join(r) for r in rows if any(r)]:
                    body.append(("table", "\n".join(rows)))
        near = package.related(part)
        for shape in slide.iter() if slide is not None else ():
            if _local(shape) == "relIds" and (drawn := package.xml(near.get(_attr(shape, "dm") or "", ""))) is not None:
                body += [("text", t) for t in _diagram(drawn)]
        for shape in slide.iter() if slide is not None else ():
            if _local(shape) == "chart" and (drawn := package.xml(near.get(_attr(shape, "id") or "", ""))) is not None and (rows := _chart(drawn)):
                body += [("text", "Chart"), ("table", "\n".join(" | ".join(r) for r in rows))]
        notes = next((package.xml(t) for t in near.values() if "notesSlide" in t), None)
        noted = "\n".join(t for s in _all(notes, "sp") if any(_attr(x, "type") == "body" for x in _all(s, "ph")) for t in lines(s)) if notes is not None else ""
        starts.append((len(blocks), {"slide_number": n, "slide_range": [n, n], "slide_count": 1, "slide_title": title} | ({"section_heading": sections.get(n - 1)} if sections else {})))
        blocks.append(Block("heading", title or f"Slide {n}", 2, title or f"Slide {n}"))
        blocks += [Block("table" if kind == "table" else prose.prose_type(x), x) for kind, text in body for x in prose.pack_text(text, prose.PROSE_MAX)]
        if noted:
            blocks.append(Block(prose.prose_type(noted), f"[Notes] {noted}"))
    if not slides:
        raise ParseError("the deck has no slides")
    return Loaded(replace(MD, name="pptx", extra={"total_slides": len(slides)}), blocks, text=blocks_to_markdown(blocks), starts=starts)


def cell_text(v: str) -> str:
    """A number as the shortest text of 15 digits; whole numbers without a point."""
    try:
        x = float(v)
    except ValueError:
        return v
    if x != x or x in (float("inf"), float("-inf")):
        return ""
    return str(int(x)) if x == int(x) and abs(x) < 2**63 else repr(float(f"{x:.15g}"))


def _column(ref: str) -> int:
    n = 0
    for ch in re.match("[A-Z]*", ref)[0]:
        n = 26 * n + ord(ch) - 64
    return n - 1


#: Built-in number formats that show dates or times. Fixed values.
DATE_FORMATS = {14, 15, 16, 17, 18, 19, 20, 21, 22, 45, 46, 47}


def _is_date(code: str) -> bool:
    """Whether a number format shows a date or time: day, month, year, hour or second letters outside quotes and brackets."""
    bare = re.sub(r'"[^"]*"|\\.|_.|\*.|\[(?!h+\]|m+\]|s+\])[^\]]*\]', "", code.split(";")[0].lower())
    return bool(re.search("[ymdhs]", bare.replace("general", "")))


def _date_styles(package: _Package) -> set[int]:
    """Numbers of the cell styles that show dates."""
    styles = package.xml("xl/styles.xml")
    if styles is None:
        return set()
    own = {int(x.get("numFmtId")): x.get("formatCode") or "" for x in _all(styles, "numFmt")}
    cells = next(_all(styles, "cellXfs"), None)
    formats = [int(x.get("numFmtId") or 0) for x in cells if _local(x) == "xf"] if cells is not None else []
    return {i for i, f in enumerate(formats) if (_is_date(own[f]) if f in own else f in DATE_FORMATS)}


def serial_text(v: str, from_1904: bool = False) -> str:
    """A day number as `YYYY-MM-DD HH:MM:SS`; day 60 of 1900, which there never was, moves the days before it."""
    try:
        days = float(v) + (1462 if from_1904 else 0)
        start = datetime.datetime(1899, 12, 31 if days < 60 else 30)
        at = start + datetime.timedelta(milliseconds=round(days * 86_400_000))
    except (ValueError, OverflowError):
        return cell_text(v)
    return at.strftime("%Y-%m-%d %H:%M:%S") + (f".{at.microsecond // 1000:03d}" if at.microsecond else "")


def _shown(v: float, code: str | int, from_1904: bool) -> str:
    """A number of a binary workbook by the code, or the built-in number, of its format."""
    date = _is_date(code) if isinstance(code, str) else code in DATE_FORMATS
    return serial_text(repr(v), from_1904) if date else cell_text(repr(v))


def _xlsx(package: _Package) -> list[tuple[str, list[grid.Row]]]:
    book, links = package.xml("xl/workbook.xml"), package.related("xl/workbook.xml")
    if book is None:
        raise ParseError("xl/workbook.xml is missing")
    strings = package.xml("xl/sharedStrings.xml")
    shared = ["".join(t.text or "" for t in _all(s, "t")) for s in (strings if strings is not None else ()) if _local(s) == "si"]
    dates = _date_styles(package)
    from_1904 = any(x.get("date1904") in ("1", "true") for x in _all(book, "workbookPr"))
    out = []
    for s in _all(book, "sheet"):
        root = package.xml(links.get(_attr(s, "id"), ""))
        rows: list[grid.Row] = []
        for r in _all(root, "row") if root is not None else ():
            at = int(r.get("r") or len(rows) + 1)
            rows += [[] for _ in range(at - 1 - len(rows))]
            row: grid.Row = []
            for c in r:
                j = _column(c.get("r") or "") if c.get("r") else len(row)
                row += [""] * (j - len(row))
                v = next((x.text or "" for x in c if _local(x) == "v"), "")
                kind = c.get("t")
                if kind == "s":
                    v = shared[int(v)] if v else ""
                elif kind == "inlineStr":
                    v = "".join(t.text or "" for t in _all(c, "t"))
                elif kind == "b":
                    v = grid.Typed("true" if v == "1" else "false")
                elif kind in ("d", "e"):
                    v = grid.Typed(v)
                elif (kind is None or kind == "n") and v:
                    v = grid.Typed(serial_text(v, from_1904) if int(c.get("s") or 0) in dates else cell_text(v))
                row.append(v)
            rows.append(row)
        out.append((s.get("name"), rows))
    return out


def _ods(package: _Package) -> list[tuple[str, list[grid.Row]]]:
    """Repeated cells and rows count as often as they say; empty ones behind the last filled one are left out."""
    root = package.xml("content.xml")
    if root is None:
        raise ParseError("content.xml is missing")
    out = []
    for table in _all(root, "table"):
        rows: list[grid.Row] = []
        empty = 0  # rows since the last filled one
        for r in _all(table, "table-row"):
            row: grid.Row = []
            gap = 0
            for c in r:
                if _local(c) in ("table-cell", "covered-table-cell"):
                    text = "\n".join("".join(p.itertext()) for p in c if _local(p) == "p")
                    times = int(_attr(c, "number-columns-repeated") or 1)
                    if not text:
                        gap += times
                        continue
                    row += [""] * gap + [text if _attr(c, "value-type") in (None, "string") else grid.Typed(text)] * times
                    gap = 0
            times = int(_attr(r, "number-rows-repeated") or 1)
            if not row:
                empty += times
                continue
            rows += [[]] * empty + [row] * times
            empty = 0
        out.append((_attr(table, "name"), rows))
    return out


#: Names of ranges that spreadsheets set by themselves. Fixed values.
ODS_OWN_NAMES = ["Print_Area", "Print_Range", "Repeat_Row", "Repeat_Column"]


def _range(ref: str) -> tuple[int, int, int, int] | None:
    """(first row, first column, last row, last column) of `Sheet!$A$1:$C$4`, `$Sheet.$A$1:.$C$4` or one cell."""
    ends = re.findall(r"(?:^|[!.:$'\s])\$?([A-Z]{1,3})\$?(\d+)(?=$|:)", ref)
    if not ends:
        return None
    (a, b), (c, d) = ends[0], ends[-1]
    return min(int(b), int(d)) - 1, min(_column(a), _column(c)), max(int(b), int(d)) - 1, max(_column(a), _column(c))


def _xlsx_marks(package: _Package) -> list[grid.Marks]:
    book, links = package.xml("xl/workbook.xml"), package.related("xl/workbook.xml")
    out = []
    for s in _all(book, "sheet"):
        parts = [package.xml(t) for t in package.related(links.get(_attr(s, "id"), "")).values() if "/tables/" in t]
        found = [(t.get("name") or t.get("displayName"), r) for t in parts if t is not None and (r := _range(t.get("ref") or ""))]
        out.append(grid.Marks([(n, *r) for n, r in found], [], []))
    for d in _all(book, "definedName"):
        at = d.get("localSheetId") or ""
        if d.get("name") == "_xlnm.Print_Area" and at.isdigit() and int(at) < len(out):
            out[int(at)].areas.extend(r for part in (d.text or "").split(",") if (r := _range(part.strip())))
    return out


def _ods_marks(package: _Package) -> list[grid.Marks]:
    root = package.xml("content.xml")
    out = {_attr(t, "name"): grid.Marks([], [], []) for t in _all(root, "table")}
    for n in _all(root, "named-range"):
        name, ref = _attr(n, "name") or "", _attr(n, "cell-range-address") or ""
        sheet = ref.rpartition(":")[0].partition(".")[0].strip("$'") if ":" in ref else ref.partition(".")[0].strip("$'")
        if sheet in out and name not in ODS_OWN_NAMES and not name.startswith("_") and (r := _range(ref)):
            out[sheet].names.append((name, *r))
    return list(out.values())


def _sheet(data: bytes, ext: str) -> Loaded:
    marks = None
    if data[:8] == compound.MAGIC:
        sheets = old_workbook(data, _shown)
    else:
        package = _Package(data)
        if ext == "ods":
            sheets, marks = _ods(package), _ods_marks(package)
        elif "xl/workbook.bin" in package.names:
            sheets = binary_package(package, _shown)
        else:
            sheets, marks = _xlsx(package), _xlsx_marks(package)
    parts = []
    for name, rows in sheets:
        header, body = grid.sheet_header(rows)
        parts.append(f"## {name}\n\n{grid.table_markdown(header, body)}".strip())
    return Loaded(replace(MD, name=ext), sheets=sheets, marks=marks, text="\n\n---\n\n".join(parts))


def _odf(data: bytes, ext: str) -> Loaded:
    package = _Package(data)
    root = package.xml("content.xml")
    if root is None:
        raise ParseError("content.xml is missing")
    meta = package.xml("meta.xml")
    facts = {k: next(("".join(x.itertext()) for x in _all(meta, k)), None) if meta is not None else None for k in ("title", "creator")}
    blocks: list[Block] = []
    starts: list[tuple[int, dict]] = []

    def items(e, depth: int) -> list[str]:
        out = []
        for li in e:
            for x in li:
                if _local(x) == "list":
                    out += items(x, depth + 1)
                elif text := "".join(x.itertext()).strip():
                    out.append("  " * depth + "- " + text)
        return out

    def walk(e) -> None:
        for x in e:
            kind = _local(x)
            if kind == "page":
                n = len(starts) + 1
                starts.append((len(blocks), {"slide_number": n, "slide_title": _attr(x, "name")}))
                blocks.append(Block("heading", f"Slide {n}", 2, f"Slide {n}"))
                walk(x)
            elif kind == "h":
                text = "".join(x.itertext()).strip()
                blocks.append(Block("heading", text, int(_attr(x, "outline-level") or 1), text))
            elif kind == "p":
                if text := "".join(x.itertext()).strip():
                    blocks.extend(Block(prose.prose_type(t), t) for t in prose.pack_text(text, prose.PROSE_MAX))
            elif kind == "list":
                if found := items(x, 0):
                    blocks.append(Block("bullet_list", "\n".join(found)))
            elif kind == "table":
                rows = [" | ".join("".join(c.itertext()).strip() for c in r if _local(c) == "table-cell") for r in _all(x, "table-row")]
                if rows := [r for r in rows if r.strip(" |")]:
                    blocks.append(Block("table", "\n".join(rows)))
            elif kind not in ("notes", "sequence-decls", "forms"):
                walk(x)

    walk(next(_all(root, "body"), root))
    extra = facts | ({"slide_count": len(starts)} if ext == "odp" else {})
    return Loaded(replace(MD, name=ext, extra=extra), blocks, text=blocks_to_markdown(blocks), starts=starts)


def _epub(data: bytes) -> Loaded:
    package = _Package(data)
    container = package.xml("META-INF/container.xml")
    path = next((x.get("full-path") for x in _all(container, "rootfile")), None) if container is not None else None
    opf = package.xml(path or "")
    if opf is None:
        raise ParseError("the package document is missing")
    manifest = {x.get("id"): x for x in _all(opf, "item")}
    spine = [x.get("idref") for x in _all(opf, "itemref")]
    if not spine:
        raise ParseError("the spine is empty")
    one = lambda k: next((x.text for x in _all(opf, k)), None)
    blocks, starts, skipped = [], [], []
    for i, ref in enumerate(spine):
        item = manifest.get(ref)
        href = posixpath.normpath(posixpath.join(posixpath.dirname(path), item.get("href"))) if item is not None else ""
        if href not in package.names:
            skipped.append(ref)
            continue
        nav = "nav" in (item.get("properties") or "").split() or re.fullmatch(r"(toc|tableofcontents|contents|nav|navigation)", posixpath.splitext(posixpath.basename(href))[0].lower()) is not None
        starts.append((len(blocks), {"spine_index": i, "href": href, "is_navigation": nav}))
        blocks += html_blocks(_html_text(package.zip.read(href)))
    extra = {"title": one("title"), "language": one("language"), "creator": one("creator"), "identifier": one("identifier"), "epub_version": opf.get("version"), "spine_count": len(spine), "skipped_spine_items": skipped}
    return Loaded(replace(HTML, name="epub", extra=extra), blocks, text=blocks_to_markdown(blocks), starts=starts)


# rtf

_RTF = re.compile(r"\\([a-z]+)(-?\d+)? ?|\\'([0-9a-fA-F]{2})|\\([^a-z])|([{}])|[\r\n]+|([^\\{}\r\n]+)")
_RTF_SKIP = set("fonttbl colortbl stylesheet info pict object listtable listoverridetable generator header footer themedata datastore".split())


#: Python's names of the code pages and font charsets that RTF may name; any other is windows-1252. Fixed values.
CODE_PAGES = {932: "cp932", 936: "gbk", 949: "cp949", 950: "cp950", 1250: "cp1250", 1251: "cp1251", 1253: "cp1253", 1254: "cp1254", 1255: "cp1255", 1256: "cp1256"}
FONT_CHARSETS = {128: "cp932", 134: "gbk", 136: "cp950", 129: "cp949", 238: "cp1250", 204: "cp1251", 161: "cp1253", 162: "cp1254", 177: "cp1255", 178: "cp1256"}


def _rtf_fonts(text: str) -> dict[int, str]:
    """Code page by font number, from the font table."""
    table = re.search(r"{\\fonttbl(?:[^{}]|{[^{}]*(?:{[^{}]*}[^{}]*)*})*}", text)
    found = re.findall(r"\\f(\d+)(?=[\\ ])[^{};]*?\\fcharset(\d+)", table[0]) if table else []
    return {int(f): FONT_CHARSETS[int(c)] for f, c in found if int(c) in FONT_CHARSETS}


def _rtf_headings(text: str) -> dict[int, int]:
    """Heading level by style number, from the style sheet's names."""
    return {int(n): int(level) for n, level in re.findall(r"{\\s(\d+)\b[^{}]*?[Hh]eading (\d)\s*;}", text)}


def _rtf(data: bytes) -> Loaded:
    text = data.decode("latin-1")
    if not text.lstrip().startswith("{\\rtf"):
        raise ParseError("not RTF")
    out: list[str] = []
    stack: list[tuple[bool, int, str]] = []
    skip, fallback, pending = False, 1, 0
    raw = bytearray()
    page = re.search(r"\\ansicpg(\d+)", text[:512])
    default = code = CODE_PAGES.get(int(page[1]), "cp1252") if page else "cp1252"
    fonts, levels = _rtf_fonts(text), _rtf_headings(text)

    def put(s: str) -> None:
        nonlocal raw
        if raw:
            out.append(raw.decode(code, "replace"))
            raw = bytearray()
        out.append(s)

    for m in _RTF.finditer(text):
        word, number, hexa, mark, brace, plain = m.groups()
        if brace == "{":
            put("")
            stack.append((skip, fallback, code))
        elif brace == "}":
            put("")
            if stack:
                skip, fallback, code = stack.pop()
        elif mark == "*" or word in _RTF_SKIP:
            skip = True
        elif skip:
            continue
        elif word == "f" and number:
            put("")
            code = fonts.get(int(number), default)
        elif word == "s" and number and int(number) in levels:
            put("#" * levels[int(number)] + " ")
        elif word == "uc":
            fallback = int(number or 1)
        elif word == "u" and number:
            put(chr(int(number) % 65536))
            pending = fallback
        elif word in ("par", "sect", "page", "row"):
            put("\n\n")
        elif word in ("line",):
            put("\n")
        elif word in ("tab", "cell"):
            put("\t" if word == "tab" else " | ")
        elif hexa:
            if pending:
                pending -= 1
            else:
                raw.append(int(hexa, 16))
        elif mark in ("\\", "{", "}"):
            put(mark)
        elif mark == "~":
            put("\u00a0")
        elif plain:
            drop = min(pending, len(plain))
            pending -= drop
            put(plain[drop:])
    put("")
    body = "".join(out).encode("utf-16", "surrogatepass").decode("utf-16", "replace")
    style = replace(MD, name="rtf", extra={k: (f[1].strip() if (f := re.search(r"{\\" + k + r" ([^}\\]*)", text)) else None) for k in ("title", "author")})
    if style.extra["title"]:
        body = f"# {style.extra['title']}\n\n{body}"
    return Loaded(style, markdown_blocks(body), text=body.strip())


# fixed layouts and compound files


def of_pdf_markdown(markdown: str, pages: int) -> Loaded:
    """A PDF that another parser has turned into Markdown."""
    return Loaded(_pdf_style(pages), markdown_blocks(markdown), text=markdown)


def _pdf_style(pages: int) -> Style:
    return replace(MD, name="pdf", extra={"total_pages": pages})


def _pdf(data: bytes) -> Loaded:
    n, texts = pdf_pages(data)
    found = list(texts)
    return Loaded(_pdf_style(n), [b for t in found for b in markdown_blocks(t)], text="\n\n---\n\n".join(found))


def pdf_blocks(data: bytes) -> tuple[Iterator[Block], Style]:
    """Blocks of a PDF page by page, as they are asked for; headings are ranked within a page."""
    try:
        n, texts = pdf_pages(data, each_page=True)
    except PdfError as e:
        raise ParseError(f"pdf: {e}") from None

    def blocks() -> Iterator[Block]:
        try:
            for t in texts:
                yield from markdown_blocks(t)
        except PdfError as e:
            raise ParseError(f"pdf: {e}") from None

    return blocks(), _pdf_style(n)


def _msg(data: bytes) -> Loaded:
    page = lambda raw: blocks_to_markdown(html_blocks(_html_text(raw)))
    text, facts = mail_item(data, page, lambda raw: _rtf(raw).text if raw else "")
    return Loaded(replace(MD, name="msg", extra=facts), markdown_blocks(text), text=text)


def _doc(data: bytes) -> Loaded:
    text = old_document(data)
    return Loaded(replace(MD, name="doc"), markdown_blocks(text), text=text)


def _ppt(data: bytes) -> Loaded:
    blocks, starts, texts = [], [], []
    for n, (title, parts) in enumerate(old_deck(data), 1):
        if parts:
            text = "\n\n".join(parts)
            starts.append((len(blocks), {"slide_number": n, "slide_title": title}))
            blocks += markdown_blocks(text)
            texts.append(text)
    return Loaded(replace(MD, name="ppt"), blocks, text="\n\n---\n\n".join(texts), starts=starts)


def load(name: str, data: bytes, encoding: str = "auto") -> Loaded:
    """Parse a file by the extension of its name; csv and tsv give their text, in the encoding named."""
    ext = extension(name)
    family = FAMILY.get(ext)
    if family is None:
        raise UnsupportedFormat(f"unsupported file extension: .{ext}")
    if family == "txt":
        text = decode(data)
        return Loaded(TXT, txt_blocks(text), text=text)
    if family == "md":
        text = decode(data)
        return Loaded(MD, markdown_blocks(text), text=front_matter(text))
    if family == "html":
        blocks = html_blocks(_html_text(data))
        return Loaded(HTML, blocks, text=blocks_to_markdown(blocks))
    if family == "csv":
        return Loaded(replace(MD, name=ext), text=decode_named(data, encoding))
    two = {"json": _json, "sheet": _sheet, "odf": _odf}
    one = {"eml": _eml, "mbox": _mbox, "ipynb": _ipynb, "docx": _docx, "pptx": _pptx, "epub": _epub, "rtf": _rtf, "pdf": _pdf, "msg": _msg, "doc": _doc, "ppt": _ppt}
    try:
        return two[family](data, ext) if family in two else one[family](data)
    except (CompoundError, PdfError, RecursionError, struct.error) as e:
        raise ParseError(f"{ext}: {e}") from None
