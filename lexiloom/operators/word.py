"""The structural mode of word-processor files: a heading and all that stands under it are one chunk."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

from ..functions.splits import char_windows, marked_sentences
from ..functions.words import WORD_PACK, WORD_SECTION, WORD_TABLE
from .prose import batches_of, pack_lines, pack_text, size

_LEFT_OUT = ("footnote_caption", "header_footer")
_SHORT = "short_disconnected_paragraph"


def _groups(parts) -> Iterator[tuple[tuple[int, str], object]]:
    """((number, kind) of a group, part): a section goes on until a heading, table or code; outside one, neighbouring
    list items, and short paragraphs, are together."""
    n, kind = 0, ""
    for p in parts:
        if p.type in _LEFT_OUT:
            continue
        if p.type == "heading":
            n, kind = n + 1, "section"
        elif p.type in ("table", "code_block"):
            n, kind = n + 1, p.type
        elif kind != "section":
            now = {"bullet_list": "list", _SHORT: "short"}.get(p.type, "alone")
            n, kind = n + (now == "alone" or now != kind), now
        yield (n, kind), p


def _packed(text: str) -> list[str]:
    """Sentences together up to WORD_PACK bytes; every end mark ends one."""
    if size(text) <= WORD_PACK:
        return [text.strip()]
    return [" ".join(b).strip() for b in batches_of(marked_sentences(text), WORD_PACK + 1, lambda s: size(s) + 1)] or [text.strip()]


def word_structural(word) -> list[dict]:
    """Chunks of a Word. Notes are those of a chunk's parts by id, unknown ids left out; of a paragraph or of short ones
    that are cut, the first piece has them; of a section or table, each piece."""
    out: list[dict] = []

    def add(kind: str, pieces: list[str], group: list, heading=None, first_only: bool = False) -> None:
        notes = [[{"id": i, "text": known[i]} for p in group for i in ids(p) if i in known] for known, ids in ((word.footnotes, lambda p: p.footnotes), (word.endnotes, lambda p: p.endnotes))]
        for k, text in enumerate(pieces):
            foot, end = ([], []) if first_only and k else notes
            facts = {"footnotes": foot, "endnotes": end, "page_number": group[0].page, "section_heading": heading and heading.text, "section_heading_level": heading.level if heading else None, "document_metadata": word.facts}
            out.append({"content_type": kind, "content": text, "metadata": facts})

    for (_, kind), run in groupby(_groups(word.parts), key=lambda x: x[0]):
        group = [p for _, p in run]
        if kind == "section":
            lines = [p.text for p in group if p.type != _SHORT]
            shorts = [p.text for p in group if p.type == _SHORT]
            text = "\n".join(lines + ([" ".join(shorts)] if shorts else [])).strip()
            add("mixed_content" if len(group) > 1 else "heading", pack_text(text, WORD_SECTION), group, group[0])
        elif kind == "table":
            add("table", pack_lines(group[0].text, WORD_TABLE, 2), group)
        elif kind == "code_block":
            add("code_block", [group[0].text], group)
        elif kind == "list":
            add("bullet_list", ["\n".join(p.text for p in group)], group)
        elif kind == "short":
            if text := " ".join(p.text for p in group).strip():
                add(_SHORT, char_windows(text), group, first_only=True)
        else:
            add(group[0].type, _packed(group[0].text), group, first_only=True)
    return out
