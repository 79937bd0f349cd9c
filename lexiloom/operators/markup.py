"""Text of one document into blocks: plain text, Markdown and HTML."""

from __future__ import annotations

import html
import re
from html.parser import HTMLParser
from itertools import groupby

from ..functions.words import COMMANDS, PROSE_MAX
from .prose import Block, pack_lines, pack_text, size


def lines_of(text: str) -> list[str]:
    return text.removesuffix("\n").replace("\r\n", "\n").split("\n") if text else []


# plain text


def _underline(line: str, least: int) -> bool:
    t = line.strip()
    return len(t) >= least and "|" not in t and (set(t) == {"="} or set(t) == {"-"})


def _around_underlined(block: str) -> list[str]:
    """A block cut around lines that are underlined as headings."""
    lines = lines_of(block)
    parts: list[list[str]] = [[]]
    i = 0
    while i < len(lines):
        if lines[i].strip() and i + 1 < len(lines) and _underline(lines[i + 1], 4):
            parts += [[lines[i].strip(), lines[i + 1].strip()], []]
            i += 2
        else:
            parts[-1].append(lines[i])
            i += 1
    return [x for x in ("\n".join(p).strip() for p in parts) if x]


_LIST_ITEM = re.compile(r"[-*+] |\[[xX ]\]|\d{1,3}[.)].|[A-Za-z][).].", re.DOTALL | re.ASCII)
_COMMANDS = tuple(COMMANDS)
#: Bytes of a title in capitals at most.
_TITLE_MAX = 80


def list_item(line: str) -> bool:
    return _LIST_ITEM.match(line.strip()) is not None


def _shouted(line: str) -> bool:
    """A line in capitals that is a title."""
    if size(line) > _TITLE_MAX or "|" in line:  # before any letter is looked at: most lines are longer
        return False
    letters = "".join(filter(str.isalpha, line))
    if not letters or letters != letters.upper():
        return False
    banner = line.startswith("***") and line.endswith("***")
    return not (banner or len(letters) < 3 or re.fullmatch(r"[IVXLCDM]+\.", line) or line.endswith((";", ",")))


def txt_type(block: str) -> str:
    lines = [x for x in map(str.strip, lines_of(block)) if x]
    if not lines:
        return "short_disconnected_paragraph"
    json_like = (lines[0] == "{" or lines[0].startswith('{"')) and block.rstrip().endswith("}")
    if block.lstrip().startswith("```") or json_like or any(x.lstrip("#").strip().startswith(_COMMANDS) for x in lines):
        return "code_block"
    if len(lines) == 2 and _underline(lines[1], 4) or len(lines) == 1 and (lines[0].startswith(("# ", "## ")) or _shouted(lines[0])):
        return "heading"
    if len(lines) >= 2 and 2 * sum("|" in x for x in lines) >= len(lines):
        return "table"
    if list_item(lines[0]) and 2 * sum(map(list_item, lines)) >= len(lines):
        return "bullet_list"
    n = size(block)
    return "long_single_paragraph" if n > 500 else "short_disconnected_paragraph" if n < 80 else "plain_paragraph"


def _txt_block(text: str, kind: str) -> Block:
    if kind != "heading":
        return Block(kind, text)
    first, *rest = [x.strip() for x in lines_of(text)]
    level = (1 if rest[0][:1] == "=" else 2) if rest else {"# ": 1, "##": 2}.get(first[:2], 2)
    return Block(kind, text, level, first.lstrip("#").strip() if not rest and first.startswith("#") else first)


def txt_blocks(text: str) -> list[Block]:
    out = []
    for raw in text.split("\n\n"):
        for part in _around_underlined(raw.strip()):
            kind = txt_type(part)
            parts = [part] if kind in ("table", "code_block") else pack_text(part, PROSE_MAX)
            out += [_txt_block(part, kind)] if parts == [part] else [_txt_block(x, txt_type(x)) for x in parts]
    return out


# Markdown

_RULE = re.compile(r"-{3,}|\*{3,}|_{3,}")
_UNDER = re.compile(r"={3,}|-{3,}")
_HASHES = re.compile(r"#{1,6} ")
_ITEM = re.compile(r"[-*+] |\[[xX ]\] |\d{1,4}[.)] ")


def _row(line: str) -> bool:
    if "|" not in line:
        return False
    cells = [c for c in map(str.strip, line.split("|")) if c]
    return len(cells) >= 2 and any(not c.startswith("[") or ("]" in c and "](#" not in c) for c in cells)


def _kinds(lines: list[str]):
    """(kind, number of the block for those that stand alone, line)."""
    fenced, n, skip = False, 0, False
    for i, raw in enumerate(lines):
        if skip:
            skip = False
            continue
        line = raw.rstrip()
        bare = line.strip()
        if fenced:
            yield "code", n, line
            fenced = not bare.startswith("```")
        elif bare.startswith("```"):
            n, fenced = n + 1, True
            yield "code", n, line
        elif not bare or _RULE.fullmatch(bare):
            yield "gap", 0, ""
        elif i + 1 < len(lines) and "|" not in bare and _UNDER.fullmatch(lines[i + 1].strip()):
            n, skip = n + 1, True
            yield "heading", n, f"{bare}\n{lines[i + 1].strip()}"
        elif _HASHES.match(bare):
            n += 1
            yield "heading", n, bare
        elif _ITEM.match(bare):
            yield "list", 0, line
        elif _row(bare):
            yield "row", 0, bare
        else:
            yield "text", 0, bare


def _is_table(rows: list[str]) -> bool:
    cells = [c.strip() for c in rows[1].strip("|").split("|")] if len(rows) > 1 else []
    ruled = bool(cells) and all(re.fullmatch(r"[-:]*-[-:]*", c) for c in cells)
    return len(rows) > 1 and (ruled or all(r.startswith("|") and r.endswith("|") for r in rows))


#: What an inline mark must hold, by mark: a text without it is left unread.
_INLINE = [
    ("](", re.compile(r"!\[([^\]]*)\]\([^)]*\)"), r"[Image: \1]"),
    ("[^", re.compile(r"\[\^[^\]]+\]"), ""),
    ("](", re.compile(r"\[([^\]]*)\]\([^)]*\)"), r"\1"),
    ("<http", re.compile(r"<(https?://[^>\s]+)>"), r"\1"),
    ("<", re.compile(r"</?[A-Za-z][^>]*>"), ""),
    ("`", re.compile(r"`([^`]*)`"), r"\1"),
    ("", re.compile(r"(\*\*|__|~~)(?=\S)(.+?)(?<=\S)\1"), r"\2"),
    ("*", re.compile(r"(?<![\w*])\*(?=\S)(.+?)(?<=\S)\*(?![\w*])"), r"\1"),
    ("_", re.compile(r"(?<!\w)_(?=\S)(.+?)(?<=\S)_(?!\w)"), r"\1"),
    ("\\", re.compile(r"\\([\\`*_{}\[\]()#+.!~|-])"), r"\1"),
]
_MARK = re.compile(r"[\[<`*_~\\]")


def plain(text: str) -> str:
    """Inline Markdown as plain text."""
    if not _MARK.search(text):
        return text
    for held, mark, by in _INLINE:
        if held in text:
            text = mark.sub(by, text)
    return text


def front_matter(text: str) -> str:
    return re.sub(r"(?sm)\A---\n.*?^---$\n*", "", text, count=1)


def markdown_blocks(text: str) -> list[Block]:
    out = []
    for (kind, _), run in groupby(_kinds(front_matter(text).split("\n")), key=lambda x: x[:2]):
        lines = [x[2] for x in run]
        content = "\n".join(lines).strip()
        if kind == "gap" or not content:
            continue
        if kind == "heading":
            first, *rest = content.split("\n")
            level = (1 if rest[0][0] == "=" else 2) if rest else len(first) - len(first.lstrip("#"))
            out.append(Block("heading", content, level, plain(first.lstrip("#").rstrip("#").strip() if not rest else first)))
        elif kind == "code":
            out += [Block("code_block", x) for x in pack_lines(content, PROSE_MAX)]
        elif kind == "row" and _is_table(lines):
            out += [Block("table", x) for x in pack_lines(content, PROSE_MAX, 2)]
        elif kind == "list":
            out += [Block("bullet_list", plain(x)) for x in pack_text(content, PROSE_MAX)]
        else:
            out += [Block(_length_type(x), plain(x)) for x in pack_text(content, PROSE_MAX)]
    return out


def _length_type(text: str) -> str:
    n = size(text)
    return "long_single_paragraph" if n > 900 else "short_disconnected_paragraph" if n < 90 else "plain_paragraph"


# HTML

_HEADINGS = {f"h{i}": i for i in range(1, 7)}
_APART = set("p div section article aside main header footer nav blockquote figure figcaption form fieldset dl dt dd address details summary hr body html center td th caption".split()) | set(_HEADINGS)
_SKIPPED = set("script style noscript head svg canvas template".split())


class _Reader(HTMLParser):
    """Collects blocks; an open paragraph, item or cell ends where the next one begins."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.blocks: list[Block] = []
        self.text: list[str] = []
        self.skip = 0
        self.heading = 0
        self.lists: list[list] = []  # [tag, items]
        self.rows: list[tuple[list, list]] | None = None
        self.tables = 0
        self.cell: str | None = None
        self.pre = False

    def taken(self) -> str:
        raw, self.text = "".join(self.text), []
        if self.pre:
            return raw.strip("\n")
        return "\n".join(x for x in (re.sub(r"\s+", " ", line).strip() for line in raw.split("\n")) if x)

    def loose(self) -> None:
        text = self.taken()
        if not text or re.fullmatch(r"[|\-_*=.\s]+", text):
            return
        if self.lists:
            self.lists[-1][1].append(text)
        elif self.heading:
            self.blocks.append(Block("heading", text, self.heading, text))
        else:
            self.blocks += [Block(_length_type(x), x) for x in pack_text(text, PROSE_MAX)]

    def end_cell(self) -> None:
        if self.cell and self.rows:
            self.rows[-1][self.cell == "td"].append(self.taken().replace("\n", " "))
        self.cell = None

    def handle_starttag(self, tag, attrs):
        if tag in _SKIPPED:
            self.skip += 1
        if self.skip:
            return
        if tag == "br":
            self.text.append("\n")
        elif tag == "img":
            alt = dict(attrs).get("alt")
            self.text.append(f"[Image: {alt}]" if alt else "")
        elif tag == "table":
            self.tables += 1
            if self.tables == 1:
                self.loose()
                self.rows = []
        elif self.tables:
            if tag == "tr" and self.tables == 1:
                self.end_cell()
                self.rows.append(([], []))
            elif tag in ("td", "th") and self.tables == 1:
                self.end_cell()
                if not self.rows:
                    self.rows.append(([], []))
                self.cell, self.text = tag, []
            elif tag in ("td", "th"):
                self.text.append(" / ")
        elif tag in ("ul", "ol"):
            self.loose()
            self.lists.append([tag, []])
        elif tag == "li":
            self.loose()
        elif tag == "pre":
            self.loose()
            self.pre = True
        elif tag in _APART:
            self.loose()
            self.heading = _HEADINGS.get(tag, 0)

    def handle_endtag(self, tag):
        if tag in _SKIPPED:
            self.skip = max(0, self.skip - 1)
        if self.skip:
            return
        if tag == "table" and self.tables:
            self.tables -= 1
            if not self.tables:
                self.end_cell()
                rows = [" | ".join(head + body) for head, body in self.rows if any(head + body)]
                self.rows, self.text = None, []
                if rows:
                    self.blocks.append(Block("table", "\n".join(rows)))
        elif self.tables:
            if tag in ("td", "th") and self.tables == 1:
                self.end_cell()
        elif tag in ("ul", "ol") and self.lists:
            self.loose()
            kind, items = self.lists.pop()
            marked = [f"{i}. {x}" if kind == "ol" else f"- {x}" for i, x in enumerate(items, 1)]
            if self.lists:
                self.lists[-1][1] += ["  " + x for x in items]
            elif items:
                self.blocks += [Block("bullet_list", x) for x in pack_lines("\n".join(marked), PROSE_MAX)]
        elif tag == "pre":
            text = self.taken()
            self.pre = False
            if text.strip():
                self.blocks.append(Block("code_block", text))
        elif tag in _APART or tag == "li":
            self.loose()
            if tag in _HEADINGS:
                self.heading = 0

    def handle_data(self, data):
        if not self.skip:
            self.text.append(data if self.pre else data.replace("\n", " "))


def html_blocks(text: str) -> list[Block]:
    reader = _Reader()
    reader.feed(text)
    reader.close()
    while reader.lists:
        reader.handle_endtag(reader.lists[-1][0])
    if reader.tables:
        reader.tables = 1
        reader.handle_endtag("table")
    reader.loose()
    return reader.blocks


def blocks_to_markdown(blocks: list[Block]) -> str:
    def one(b: Block) -> str:
        if b.type == "heading":
            return "#" * max(1, b.level) + " " + (b.title or b.content)
        if b.type == "code_block" and not b.content.startswith("```"):
            return f"```\n{b.content}\n```"
        if b.type == "table" and "|" in b.content and not b.content.startswith("|"):
            head, *rest = [f"| {x} |" for x in b.content.split("\n")]
            return "\n".join([head, "|" + " --- |" * (head.count("|") - 1), *rest])
        return b.content

    return "\n\n".join(map(one, blocks))


def unescape(text: str) -> str:
    return html.unescape(text)
