"""Blocks of one document into chunks: the modes for prose.

A document is a list of blocks. Every mode looks at them with the headings above them. These functions see one document
at a time; documents.py runs them in Arrow batches next to the scan, without a shuffle.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field
from itertools import chain, groupby, pairwise
from string import ascii_uppercase
from typing import NamedTuple

from ..functions.splits import docx_sentences, md_sentences
from ..functions.words import BREAKS, NOT_IN_TXT, PROSE_MAX, PROSE_MIN, SECTION_MAX, SEMANTIC_MAX, SHORT_PARAGRAPH, SIGNALS, STOP_WORDS

PROSE = ("plain_paragraph", "long_single_paragraph", "short_disconnected_paragraph")
_STOP = frozenset(STOP_WORDS)


class Block(NamedTuple):
    type: str
    content: str
    level: int = 0
    title: str = ""  # of a heading


class Placed(NamedTuple):
    """A block and the headings above it; a heading is above itself."""

    block: Block
    above: tuple[tuple[int, str], ...]

    @property
    def heading(self) -> str | None:
        return self.above[-1][1] if self.above else None

    @property
    def level(self) -> int:
        return self.above[-1][0] if self.above else 0

    @property
    def path(self) -> list[str]:
        return [t for _, t in self.above]


@dataclass(frozen=True)
class Style:
    """What differs between formats of prose."""

    name: str
    preamble: str | None = "Preamble"
    txt_phrases: bool = False  # without NOT_IN_TXT
    lists_merge: bool = False  # semantic: lists join prose
    lists_alone: bool = False  # sentence: lists are chunks of their own
    headings_merge: bool = False  # semantic: a heading joins the paragraph after it
    cap_paragraphs_only: bool = False  # section: only paragraphs begin a new part
    page_max: int = 0  # page_aware: longer pages are cut
    extra: dict = field(default_factory=dict)


TXT = Style("txt", txt_phrases=True)
MD = Style("md", preamble=None, lists_merge=True, lists_alone=True, cap_paragraphs_only=True, page_max=2000)
HTML = Style("html", headings_merge=True)


def size(s: str) -> int:
    """UTF-8 bytes."""
    return len(s) if s.isascii() else len(s.encode("utf-8", "surrogatepass"))


def batches_of(parts: Iterable[str], limit: int, cost: Callable[[str], int]) -> Iterator[list[str]]:
    """Neighbours together while their costs add up to no more than limit."""
    held, used = [], 0
    for p in parts:
        c = cost(p)
        if held and used + c > limit:
            yield held
            held, used = [], 0
        held.append(p)
        used += c
    if held:
        yield held


_SENTENCE_END = re.compile(r"[.!?](?=\s)")


def sentences(text: str) -> list[str]:
    ends = [0, *(m.end() for m in _SENTENCE_END.finditer(text)), len(text)]
    return [s for a, b in pairwise(ends) if (s := text[a:b].strip())]


def pack_sentences(text: str, limit: int) -> list[str]:
    if size(text) <= limit:
        return [text.strip()]
    return [" ".join(b) for b in batches_of(sentences(text), limit + 1, lambda s: size(s) + 1)] or [text.strip()]


def pack_lines(text: str, limit: int, repeat: int = 0) -> list[str]:
    """Parts of at most limit characters, each after the first `repeat` lines."""
    if len(text) <= limit:
        return [text]
    lines = re.split(r"\r?\n", text.removesuffix("\n"))
    head = lines[:repeat]
    room = limit - sum(len(x) + 1 for x in head)
    return ["\n".join(head + b) for b in batches_of(lines[repeat:], room, lambda x: len(x) + 1)] or ["\n".join(head)]


def cut_hard(text: str, limit: int) -> list[str]:
    """Cut at the last white space within limit characters, or there."""
    out, start = [], 0
    while len(text) - start > limit:
        at = start + (max((m.start() for m in re.finditer(r"\s", text[start : start + limit])), default=0) or limit)
        if piece := text[start:at].rstrip():
            out.append(piece)
        start = at
        while text[start : start + 1].isspace():
            start += 1
    return out + ([text[start:]] if text[start:].strip() else [])


def pack_text(text: str, limit: int) -> list[str]:
    """By lines, then sentences, then hard."""
    out: list[str] = []
    for part in pack_lines(text, limit):
        if len(part) <= limit:
            out.append(part)
            continue
        for piece in pack_sentences(part, limit):
            out += [piece] if len(piece) <= limit else cut_hard(piece, limit)
    return [x for x in out if x.strip()] or [text]


def pack_paragraphs(text: str, limit: int) -> list[str]:
    if size(text) <= limit:
        return [text.strip()]
    return [p for p in ("\n\n".join(b).strip() for b in batches_of(text.split("\n\n"), limit + 2, lambda s: size(s) + 2)) if p] or [text.strip()]


def prose_type(text: str) -> str:
    n = size(text)
    return "long_single_paragraph" if n > 900 else "short_disconnected_paragraph" if n < 90 else "plain_paragraph"


_WORD = re.compile("[A-Za-z0-9]{4,}")


def keywords(text: str) -> frozenset[str]:
    return frozenset(map(str.lower, _WORD.findall(text))) - _STOP


def placed(blocks: Iterable[Block]) -> Iterator[Placed]:
    above: tuple[tuple[int, str], ...] = ()
    for b in blocks:
        if b.type == "heading":
            above = (*(x for x in above if x[0] < b.level), (b.level, b.title or b.content))
        yield Placed(b, above)


def place(blocks: Iterable[Block]) -> list[Placed]:
    return list(placed(blocks))


def _chunk(kind: str, content: str, **metadata) -> dict:
    return {"content_type": kind, "content": content, "metadata": metadata}


def _numbered(chunks: Iterable[dict], style: Style, total: int) -> list[dict]:
    """chunk_index and document_metadata as the last keys; formats with facts of their own do not count blocks."""
    out = []
    for i, c in enumerate(chunks):
        c["metadata"] |= {"chunk_index": i, "document_metadata": {"source_type": style.name} | (style.extra or {"total_input_blocks": total})}
        out.append(c)
    return out


def structural_chunks(blocks: Iterable[Block], style: Style) -> Iterator[dict]:
    """Headings, tables, code and lists alone; prose in runs of up to PROSE_MAX bytes; short ones join those before.

    Blocks are taken as chunks are asked for; only the last chunk and the one in the making are held.
    """

    def meta(heading: str | None) -> dict:
        fixed = {"footnotes_captions": [], "page_number": None} if style.name in ("txt", "html") else {}
        return {"section_heading": heading, **fixed, "document_metadata": {"source_type": style.name} | style.extra}

    def whole() -> Iterator[dict]:
        for is_prose, run in groupby(placed(blocks), key=lambda p: p.block.type in PROSE):
            if not is_prose:
                for p in run:
                    yield _chunk(p.block.type, p.block.title or p.block.content, **meta(None)) if p.block.type == "heading" else _chunk(p.block.type, p.block.content, **meta(p.heading))
                continue
            first = next(run)
            parts = (x for p in chain([first], run) for x in (pack_sentences(p.block.content, PROSE_MAX) if size(p.block.content) > PROSE_MAX else [p.block.content]))
            for group in batches_of(parts, PROSE_MAX, lambda s: size(s) + 1):
                if text := "\n".join(group).strip():
                    yield _chunk(prose_type(text), text, **meta(first.heading))

    last: dict | None = None
    for c in whole():
        if last and c["content_type"] in PROSE and last["content_type"] in PROSE and size(c["content"]) < PROSE_MIN and size(last["content"]) + size(c["content"]) < PROSE_MAX + PROSE_MIN:
            last["content"] = f"{last['content']}\n{c['content']}".strip()
            last["content_type"] = prose_type(last["content"])
            continue
        if last:
            yield last
        last = c
    if last:
        yield last


def structural(blocks: list[Block], style: Style) -> list[dict]:
    return list(structural_chunks(blocks, style))


_SECTION_NAMES = {"bullet_list": "list", "code_block": "code_block", "table": "table"} | dict.fromkeys(PROSE, "paragraph")


def section(blocks: list[Block], style: Style) -> list[dict]:
    """A heading, then what stands under it, in parts of up to SECTION_MAX bytes."""
    out: list[dict] = []

    def body(parts: list[Placed], heading: str | None) -> None:
        kinds = [_SECTION_NAMES.get(p.block.type, "other") for p in parts]
        pieces = [x for x in pack_paragraphs("\n\n".join(p.block.content for p in parts), SECTION_MAX) if x]
        first = parts[0]
        for i, text in enumerate(pieces):
            split = (i + 1, len(pieces)) if len(pieces) > 1 else (None, None)
            out.append(
                _chunk(
                    "section", text, section_heading=heading, section_level=first.level, heading_path=first.path, paragraph_count=sum(k in ("paragraph", "list") for k in kinds),
                    block_types=list(dict.fromkeys(kinds)), char_count=size(text), split_part=split[0], split_total=split[1],
                )
            )

    held: list[Placed] = []
    used = 0

    def flush() -> None:
        nonlocal held, used
        if held and any(p.block.content.strip() for p in held):
            body(held, held[0].heading if held[0].above else style.preamble)
        held, used = [], 0

    placed = place(blocks)
    for p in placed:
        if p.block.type == "heading":
            flush()
            count = {} if style.name == "html" else {"char_count": size(p.heading)}
            out.append(_chunk("heading", p.heading, section_heading=p.heading, section_level=p.block.level, heading_path=p.path, paragraph_count=0, block_types=["heading"], **count))
            continue
        n = size(p.block.content)
        caps = not style.cap_paragraphs_only or p.block.type in PROSE
        if held and caps and used + 2 * (len(held) - 1) + n + 2 > SECTION_MAX:
            flush()
        held.append(p)
        used += n
    flush()
    return _numbered(out, style, len(blocks))


def _known_phrases(txt: bool) -> list[tuple[str, tuple[str, ...]]]:
    return [("break", tuple(BREAKS)), *((reason, tuple(p for p in phrases if not (txt and p in NOT_IN_TXT))) for reason, phrases in SIGNALS.items())]


_PHRASES = {txt: _known_phrases(txt) for txt in (True, False)}
_LONGEST = {txt: max(len(p) for _, phrases in known for p in phrases) for txt, known in _PHRASES.items()}
_LOWER = {ord(c): c.lower() for c in ascii_uppercase}


def _opening(text: str, txt: bool) -> str | None:
    low = text.lstrip()[: _LONGEST[txt]].translate(_LOWER)
    return next((reason for reason, phrases in _PHRASES[txt] if low.startswith(phrases)), None)


def _reason(text: str, words: frozenset[str], kind: str, held: list[tuple[str, str]], used: int, known: set[str], style: Style) -> str | None:
    """Why a paragraph of these keywords belongs to those before it, which have `used` bytes, or None."""
    if used + 2 * (len(held) - 1) + size(text) + 2 > SEMANTIC_MAX:
        return None
    if held[-1][1] == "heading":
        return "heading_merge"
    opening = _opening(text, style.txt_phrases)
    if opening:
        return None if opening == "break" else opening
    last = held[-1][0].rstrip()
    if last.endswith("?"):
        return "question_answer"
    if last.endswith(":") and size(held[-1][0]) <= SHORT_PARAGRAPH and size(text) > 60:
        return "definition_expansion"
    if size(text) <= SHORT_PARAGRAPH:
        return "short_paragraph"
    if not known.isdisjoint(words):
        return "list_continuation" if kind == "bullet_list" else "keyword_overlap"
    return None


def semantic(blocks: list[Block], style: Style) -> list[dict]:
    """Neighbouring paragraphs that belong together, by their openings, endings and keywords."""
    out: list[dict] = []
    held: list[tuple[str, str]] = []  # text, reason
    used = 0
    known: set[str] = set()
    first: Placed | None = None
    kinds: list[str] = []

    def flush() -> None:
        nonlocal held, used, known, first, kinds
        if held:
            text = "\n\n".join(t for t, _ in held)
            reasons = [r for _, r in held if r not in ("initial", "heading")]
            ranked = sorted(Counter(reasons).items(), key=lambda x: (-x[1], x[0]))
            more = {"block_types": list(dict.fromkeys(kinds)), "has_list": "list" in kinds} if style.lists_merge else {"has_body_content": any(r != "heading" for _, r in held)} if style.headings_merge else {}
            average = {} if style.headings_merge else {"avg_block_length": used // len(held)}
            out.append(
                _chunk(
                    "semantic", text, section_heading=first.heading, heading_path=first.path, section_level=first.level, paragraph_count=len(held), merge_reasons=list(dict.fromkeys(reasons)),
                    primary_merge_reason=ranked[0][0] if ranked else "initial", keyword_density=int(len(known) / max(1, len(text.split())) * 1000 + 0.5) / 1000, **average, **more,
                )
            )
        held, used, known, first, kinds = [], 0, set(), None, []

    for p in place(blocks):
        b = p.block
        merges = b.type in PROSE or (b.type == "bullet_list" and style.lists_merge)
        if b.type == "heading" and style.headings_merge:
            flush()
            held, used, first, kinds = [(p.heading, "heading")], size(p.heading), p, ["heading"]
        elif b.type == "heading":
            flush()
            parent = p.above[-2][1] if len(p.above) > 1 else None
            out.append(_chunk("heading", p.heading, section_heading=parent, heading_path=p.path, section_level=b.level, paragraph_count=0, merge_reasons=[], primary_merge_reason="initial", keyword_density=0.0, avg_block_length=size(p.heading)))
        elif not merges:
            flush()
            out.append(_chunk(b.type, b.content, section_heading=p.heading, heading_path=p.path, **({"primary_merge_reason": "structural_boundary"} if style.lists_merge else {})))
        elif text := b.content.strip():
            words = keywords(text)
            why = _reason(text, words, b.type, held, used, known, style) if held else "initial"
            if why is None:
                flush()
                why = "initial"
            first = first or p
            held.append((text, why))
            used += size(text)
            kinds.append(_SECTION_NAMES[b.type])
            known |= words
    flush()
    return _numbered(out, style, len(blocks))


def sentence(blocks: list[Block], style: Style, sentences_per_chunk: int = 3) -> list[dict]:
    """Sentences in groups that end at headings, code and tables."""
    out: list[dict] = []
    held: list[tuple[str, int, Placed]] = []
    number = 0

    def flush() -> None:
        for i in range(0, len(held), sentences_per_chunk):
            part = held[i : i + sentences_per_chunk]
            _, at, p = part[0]
            out.append(_chunk("sentence", " ".join(s for s, _, _ in part), sentences_per_chunk=sentences_per_chunk, actual_sentence_count=len(part), source_paragraph_index=at, section_heading=p.heading, heading_path=p.path))
        held.clear()

    for p in place(blocks):
        b = p.block
        if b.type == "heading":
            flush()
            out.append(_chunk("heading", p.heading, section_heading=p.heading, section_level=b.level, heading_path=p.path))
            continue
        if b.type in ("code_block", "table") or (b.type == "bullet_list" and style.lists_alone):
            flush()
            out.append(_chunk(b.type, b.content, section_heading=p.heading, heading_path=p.path))
        else:
            split = docx_sentences if style.name == "docx" else md_sentences if style.lists_alone else sentences
            units = [x for x in map(str.strip, b.content.split("\n")) if x] if b.type == "bullet_list" else split(b.content)
            held += [(s, number, p) for s in units]
        number += 1
    flush()
    return _numbered(out, style, len(blocks))


def sliding_window(blocks: list[Block], style: Style, window_size: int = 3, overlap: int = 1) -> list[dict]:
    """Every window of blocks, headings among them, up to the first that reaches the end."""
    units = [p for p in place(blocks) if (p.block.title or p.block.content).strip()]
    step, out = window_size - overlap, []
    for w in range(max(0, -(-(len(units) - window_size) // step)) + 1 if units else 0):
        part = units[w * step : w * step + window_size]
        counted = "block_count" if style.name == "md" else "paragraph_count"
        out.append(
            _chunk(
                "sliding_window", "\n\n".join(p.block.title or p.block.content for p in part), window_size=window_size, overlap=overlap, window_index=w, paragraph_range=[w * step, w * step + len(part) - 1],
                section_heading=part[0].heading, heading_path=part[0].path, **{counted: len(part)},
            )
        )
    return _numbered(out, style, len(blocks))


def page_aware(blocks: list[Block], style: Style, paragraphs_per_page: int = 15) -> list[dict]:
    """Pages of so many blocks; a heading ends one."""
    out: list[dict] = []
    for under, run in groupby(place(blocks), key=lambda p: p.block.type == "heading"):
        run = list(run)
        if under:
            out += [_chunk("heading", p.heading, page_break_type="heading_boundary", paragraph_count=0, section_heading=p.heading, section_level=p.block.level, heading_path=p.path) for p in run]
            continue
        for i in range(0, len(run), paragraphs_per_page):
            part = run[i : i + paragraphs_per_page]
            kind = "heading_boundary" if i == 0 and part[0].above else "estimated"
            text = "\n\n".join(p.block.content for p in part)
            for piece in pack_paragraphs(text, style.page_max) if style.page_max else [text]:
                out.append(_chunk("page_aware", piece, page_break_type=kind, paragraph_count=len(part), section_heading=part[0].heading, heading_path=part[0].path))
    return _numbered(out, style, len(blocks))


MODES = {"default": structural, "structural": structural, "section": section, "semantic": semantic, "sentence": sentence, "sliding_window": sliding_window, "page_aware": page_aware}
