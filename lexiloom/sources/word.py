"""Word-processor packages: the body as a list of parts with their page, notes and pictures."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

from ..functions.words import WORD_CLOSERS, WORD_ENDS, WORD_LONG, WORD_SHORT
from ..operators import prose
from ..operators.prose import Block


@dataclass
class Part:
    """A paragraph, list item, table or picture. page: breaks before it, plus one."""

    type: str
    text: str
    level: int = 0  # of a heading, or of a list item's depth
    page: int = 1
    footnotes: list[str] = field(default_factory=list)
    endnotes: list[str] = field(default_factory=list)
    number: str | None = None  # the list that counts this item


@dataclass
class Word:
    parts: list[Part]
    footnotes: dict[str, str]
    endnotes: dict[str, str]
    facts: dict  # document_metadata


def local(e) -> str:
    return e.tag.rpartition("}")[2] if isinstance(e.tag, str) else ""


def attr(e, name: str) -> str | None:
    return next((v for k, v in e.attrib.items() if k.rpartition("}")[2] == name), None)


def every(e, name: str):
    return (x for x in e.iter() if local(x) == name)


#: Readings over words, and the second form of what a file gives in two.
_TWICE = {"rt", "Fallback"}


@dataclass
class _Paragraph:
    segments: list[str]
    broken: bool = False  # a page or section ends in it
    footnotes: list[str] = field(default_factory=list)
    endnotes: list[str] = field(default_factory=list)
    pictures: list[str] = field(default_factory=list)  # their descriptions


def _read(e, into: _Paragraph) -> _Paragraph:
    for x in e:
        kind = local(x)
        if kind == "t":
            into.segments[-1] += x.text or ""
        elif kind == "tab" and not x.attrib:
            into.segments[-1] += "\t"
        elif kind == "noBreakHyphen":
            into.segments[-1] += "-"
        elif kind == "br" and attr(x, "type") == "page" or kind in ("lastRenderedPageBreak", "sectPr"):
            into.broken = True
        elif kind in ("br", "cr"):
            into.segments.append("")
        elif kind in ("footnoteReference", "endnoteReference"):
            (into.footnotes if kind[0] == "f" else into.endnotes).append(attr(x, "id") or "")
        elif kind in ("drawing", "pict"):
            about = next(every(x, "docPr"), None)
            into.pictures += [((about.get("descr") if about is not None else None) or "").strip() for b in x.iter() if local(b) in ("blip", "imagedata")]
            _read(x, into)  # words in boxes
        elif kind not in _TWICE:
            _read(x, into)
    return into


def text_of(p) -> str:
    return "\n".join(_read(p, _Paragraph([""])).segments).strip()


def heading_level(style: str, outline: str | None) -> int | None:
    if m := re.match(r"(?i)(?:heading|titre|überschrift|title)(\d+)?", style):
        return int(m[1] or 0) or 1
    return int(outline) + 1 if outline is not None and int(outline) < 9 else None


def whole_sentence(text: str) -> bool:
    bare = text.rstrip("".join(WORD_CLOSERS))
    return len(bare) >= 12 and bare.endswith(tuple(WORD_ENDS))


def paragraph_type(text: str, style: str, listed: bool, pictured: bool) -> str:
    style = style.lower()
    if "caption" in style:
        return "footnote_caption"
    if listed:
        return "bullet_list"
    if "code" in style or "```" in text:
        return "code_block"
    if pictured:
        return "image"
    if prose.size(text) > WORD_LONG:
        return "long_single_paragraph"
    return "short_disconnected_paragraph" if prose.size(text) < WORD_SHORT and not whole_sentence(text) else "plain_paragraph"


def _picture(description: str) -> str:
    return f"[Image: {description}]" if description else "[Image]"


def _cell(tc) -> str:
    """Paragraphs of a cell in one line; a table inside it as `a | b; c | d`."""
    found = []
    for x in tc:
        if local(x) == "tbl":
            found.append("; ".join(" | ".join(r) for r in rows_of(x)))
        elif local(x) != "tcPr":
            found.append(" ".join(text_of(x).split()))
    return " ".join(f for f in found if f)


def rows_of(table) -> list[list[str]]:
    """Cells by row: wide ones repeated, those that go on from above with what is above."""
    rows: list[list[str]] = []
    for tr in (r for r in _inside(table, "tr")):
        row: list[str] = []
        for tc in _inside(tr, "tc"):
            about = next((x for x in tc if local(x) == "tcPr"), ())
            merge = next((x for x in about if local(x) == "vMerge"), None)
            wide = next((int(attr(x, "val") or 1) for x in about if local(x) == "gridSpan"), 1)
            on = merge is not None and attr(merge, "val") in (None, "continue")
            text = rows[-1][len(row)] if on and rows and len(row) < len(rows[-1]) else _cell(tc)
            row += [text] * min(wide, 1000)
        rows.append(row)
    return rows


def _inside(e, name: str) -> Iterator:
    """Children of a name, through the wrappers of content controls and changes."""
    for x in e:
        if local(x) == name:
            yield x
        elif local(x) in ("sdt", "sdtContent", "ins", "customXml", "smartTag"):
            yield from _inside(x, name)


def pipe_table(rows: list[list[str]]) -> str:
    wide = max(map(len, rows))
    line = lambda r: "| " + " | ".join(c.replace("|", "\\|") for c in r + [""] * (wide - len(r))) + " |"
    return "\n".join([line(rows[0]), line(["---"] * wide), *map(line, rows[1:])])


def _numbered_lists(root) -> set[tuple[str, str]]:
    """(list, level) of those that count."""
    if root is None:
        return set()
    counting = {(attr(a, "abstractNumId"), attr(v, "ilvl")) for a in every(root, "abstractNum") for v in every(a, "lvl") if any(attr(f, "val") not in ("bullet", "none") for f in every(v, "numFmt"))}
    kinds = {attr(n, "numId"): next((attr(a, "val") for a in every(n, "abstractNumId")), None) for n in every(root, "num")}
    return {(num, level) for num, a in kinds.items() for b, level in counting if a == b}


def read_word(package, imported) -> Word | None:
    """The parts of a package's document; imported(bytes, name) gives the blocks of a file that it takes in."""
    root = package.xml("word/document.xml")
    if root is None:
        return None
    links, counting = package.related("word/document.xml"), _numbered_lists(package.xml("word/numbering.xml"))
    parts: list[Part] = []
    page = 1

    def paragraph(e) -> None:
        nonlocal page
        style = next((attr(x, "val") or "" for x in every(e, "pStyle")), "")
        outline = next((attr(x, "val") for x in every(e, "outlineLvl")), None)
        number = next((next((attr(x, "val") for x in every(n, "numId")), None) for n in every(e, "numPr")), None)
        depth = next((attr(x, "val") for x in every(e, "ilvl")), None) or "0"
        listed = any(True for _ in every(e, "numPr")) or style.lower().startswith("list")
        level, found = heading_level(style, outline), _read(e, _Paragraph([""]))
        for i, text in enumerate(s.strip() for s in found.segments):
            pictures = found.pictures if i == 0 else []
            if not text and not pictures:
                continue
            kind = "heading" if level and text else paragraph_type(text, style, listed and bool(text), bool(pictures))
            shown = "\n".join(x for x in (text, _picture(pictures[0]) if pictures else "") if x)
            notes = (found.footnotes, found.endnotes) if i == 0 or not any(s.strip() for s in found.segments[:i]) else ([], [])
            parts.append(Part(kind, shown, level or 0 if kind == "heading" else int(depth) if kind == "bullet_list" and depth.isdigit() else 0, page, *notes, f"{number}:{depth}" if (number, depth) in counting else None))
            parts.extend(Part("image", _picture(d), 0, page) for d in pictures[1:])
        page += found.broken

    def walk(e) -> None:
        for x in e:
            kind = local(x)
            if kind == "p":
                paragraph(x)
            elif kind == "tbl":
                rows, inner = rows_of(x), _read(x, _Paragraph([""]))
                if any(any(r) for r in rows):
                    parts.append(Part("table", pipe_table(rows), 0, page, inner.footnotes, inner.endnotes))
                parts.extend(Part("image", _picture(d), 0, page) for d in inner.pictures)
            elif kind == "altChunk":
                name = links.get(attr(x, "id") or "", "")
                if name in package.names:
                    parts.extend(Part(b.type, b.title or b.content, b.level, page) for b in imported(package.zip.read(name), name))
            elif kind != "sectPr":
                walk(x)

    walk(next(every(root, "body"), root))

    def notes(name: str) -> dict[str, str]:
        found = package.xml(name)
        return {attr(n, "id") or "": t for n in (found if found is not None else ()) if attr(n, "type") in (None, "normal") and (t := " ".join(text_of(n).split()))}

    def first(kind: str) -> str | None:
        name = min((n for n in package.names if re.fullmatch(rf"word/{kind}\d*\.xml", n)), default="")
        found = package.xml(name)
        return None if found is None else " ".join(t for p in every(found, "p") if (t := text_of(p)))

    facts = {"header_text": first("header"), "footer_text": first("footer"), "image_count": sum(n.startswith("word/media/") for n in package.names)}
    return Word(parts, notes("word/footnotes.xml"), notes("word/endnotes.xml"), facts)


def word_blocks(word: Word) -> list[Block]:
    """Parts as blocks for the modes that all formats share: items of a list together, long paragraphs cut."""
    out: list[Block] = []
    items: list[str] = []
    for p in [*word.parts, Part("", "")]:
        if p.type == "bullet_list":
            items.append(f"{'  ' * p.level}- {p.text}")
            continue
        if items:
            out.append(Block("bullet_list", "\n".join(items)))
            items = []
        if p.type == "heading":
            out.append(Block("heading", p.text, p.level, p.text))
        elif p.type in ("table", "code_block", "footnote_caption"):
            out.append(Block(p.type, p.text))
        elif p.text:
            out += [Block(prose.prose_type(x), x) for x in prose.pack_text(p.text, prose.PROSE_MAX)]
    return out + [Block("footnote_caption", t) for notes in (word.footnotes, word.endnotes) for t in notes.values()]


def word_markdown(word: Word) -> str:
    """Items that count have their number, which begins anew behind anything else; notes stand below a rule."""
    out: list[str] = []
    counts: Counter = Counter()
    page, before = 1, ""
    for p in word.parts:
        if p.page != page and out:
            out.append("---")
        page = p.page
        marks = "".join(f"[^{n}]" for n in (*p.footnotes, *p.endnotes) if n in word.footnotes or n in word.endnotes)
        if p.type == "bullet_list":
            counts[p.number] += 1
            item = f"{'  ' * p.level}{f'{counts[p.number]}.' if p.number else '-'} {p.text}{marks}"
            if before == "bullet_list" and out[-1] != "---":
                out[-1] += "\n" + item
            else:
                out.append(item)
        else:
            counts.clear()
            out.append(("#" * min(p.level, 6) + " " if p.type == "heading" else "") + p.text + (marks if p.type != "table" else ""))
        before = p.type
    noted = [f"[^{n}]: {t}" for notes in (word.footnotes, word.endnotes) for n, t in notes.items()]
    return "\n\n".join(out + (["---", *noted] if noted else []))
