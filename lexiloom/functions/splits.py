"""Text splitters of single formats, byte cuts and content names: plain Python for whole files, columns for tables."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import filled, trim

# fixed values: abbreviations that end no sentence, in Markdown and in word-processor files
MD_TITLES = ["mr.", "mrs.", "dr.", "prof.", "sr.", "jr.", "vs.", "etc.", "approx.", "est."]
DOCX_TITLES = ["mr.", "mrs.", "ms.", "dr.", "prof.", "sr.", "jr.", "vs.", "etc.", "st.", "capt.", "lt.", "sgt.", "gen.", "col.", "rev.", "hon.", "gov.", "sen.", "rep.", "fig.", "vol."]
# fixed values: quotes and brackets that may follow a sentence's end in word-processor files
CLOSERS = ['"', "”", "'", "’", ")", "]"]
# fixed values: extensions of images that chunks may name
IMAGE_EXTENSIONS = ["png", "jpg", "jpeg", "gif", "webp"]
# fixed values: offset and prime of the 64-bit FNV-1a hash
FNV_OFFSET, FNV_PRIME = 0xCBF29CE484222325, 0x00000100000001B3

_MD_KEEP = re.compile(rf"(?:{'|'.join(map(re.escape, MD_TITLES))}|(?:^|\s)[0-9]+\.|[A-Za-z]\.\.[A-Za-z]\.)\Z", re.IGNORECASE | re.ASCII)
_DOCX_KEEP = re.compile(rf"(?:(?i:{'|'.join(map(re.escape, DOCX_TITLES))})|(?:^|\s)[0-9]{{1,3}}\.|[A-Z]\.\.[A-Z]\.)\Z", re.ASCII)


def _cut(text: str, end: re.Pattern, keep: re.Pattern) -> list[str]:
    out, at = [], 0
    for m in end.finditer(text):
        if m.start() < at or not text[m.end() + 1 : m.end() + 2].isupper():
            continue
        if m[0][0] == "." and keep.search(text, max(0, m.start() - 64), m.start() + 1):
            continue
        out.append(text[at : m.end()])
        at = m.end() + 1
    return [x for s in (*out, text[at:]) if (x := " ".join(s.split()))]


def md_sentences(text: str) -> list[str]:
    """Sentences of Markdown: an end mark, one space, a capital; not after titles, numbers and doubled initials."""
    return _cut(text, re.compile(r"[.?!](?= )"), _MD_KEEP)


def docx_sentences(text: str) -> list[str]:
    """The same for word-processor files: closing quotes belong to the sentence, numbers of up to three digits are markers."""
    return _cut(text, re.compile(rf"[.?!][{re.escape(''.join(CLOSERS))}]*(?= )"), _DOCX_KEEP)


def marked_sentences(text: str) -> list[str]:
    """Every end mark ends a sentence."""
    return [x for s in re.findall(r"[^.!?]*[.!?]|[^.!?]+\Z", text) if (x := s.strip())]


def floor_boundary(data: bytes, n: int) -> int:
    """The last place at or before byte n where a character begins."""
    n = min(n, len(data))
    while 0 < n < len(data) and data[n] & 0xC0 == 0x80:
        n -= 1
    return n


def char_windows(text: str, limit: int = 700, overlap: int = 100) -> list[str]:
    """Windows of at most limit bytes, each begun overlap bytes before the last one's end; trimmed but for the last."""
    out, data = [], text.encode()
    while len(data) > limit:
        cut = floor_boundary(data, limit)
        out.append(data[:cut].decode().strip())
        tail = data[floor_boundary(data, max(0, cut - overlap)) :].decode().strip().encode()
        if not tail or len(tail) >= len(data):
            return out
        data = tail
    return [*out, data.decode()]


def content_hash(data: bytes) -> int:
    """FNV-1a of 64 bits."""
    h = FNV_OFFSET
    for b in data:
        h = (h ^ b) * FNV_PRIME & 0xFFFFFFFFFFFFFFFF
    return h


def image_name(data: bytes, path: str) -> str | None:
    """`<hash>.<extension>` of an image; None for other extensions."""
    ext = path.rpartition(".")[2].lower()
    return f"{content_hash(data):016x}.{ext}" if ext in IMAGE_EXTENSIONS else None


# columns


def md_sentences_column(c: Column) -> Column:
    titles = "|".join(re.escape(t) for t in MD_TITLES)
    keep = rf"(?<!(?i:{titles}))(?<!(?:^|\s)[0-9]{{1,30}}\.)(?<![A-Za-z]\.\.[A-Za-z]\.)"
    parts = F.split(c, rf"(?U)(?:(?<=[?!])|(?<=\.){keep}) (?=\p{{Lu}})")
    return F.filter(F.transform(parts, lambda x: trim(F.regexp_replace(x, r"(?U)\s+", " "))), lambda x: x != "")


def marked_sentences_column(c: Column) -> Column:
    return filled(F.regexp_extract_all(c, F.lit(r"[^.!?]*[.!?]|[^.!?]+$"), F.lit(0)))


def floor_boundary_column(c: Column, n: int) -> Column:
    """c cut to at most n bytes, between characters."""
    data = F.encode(c, "UTF-8")
    begins = lambda k: (F.hex(F.substring(data, k + 1, 1)) < "80") | (F.hex(F.substring(data, k + 1, 1)) > "BF")
    cut = F.coalesce(*[F.when(begins(k), F.lit(k)) for k in range(n, max(n - 4, -1), -1)], F.lit(0))
    return F.when(F.octet_length(c) <= n, c).otherwise(F.decode(F.substring(data, F.lit(1), cut), "UTF-8"))


def content_hash_column(data: Column) -> Column:
    """FNV-1a of a binary column, as 16 hexadecimal digits; by halves of 32 bits, so that nothing overflows."""
    low = F.lit((1 << 32) - 1)

    def step(h: Column, i: Column) -> Column:
        byte = F.conv(F.hex(F.substring(data, i, F.lit(1))), 16, 10).cast("long")
        x = h.bitwiseXOR(byte)
        # times 2^40 + 435: two summands of 64 bits, added by halves
        a, lo, hi = F.shiftleft(x, 40), x.bitwiseAND(low) * 435, F.shiftrightunsigned(x, 32) * 435
        ll = a.bitwiseAND(low) + lo.bitwiseAND(low)
        hh = F.shiftrightunsigned(a, 32) + F.shiftrightunsigned(lo, 32) + hi + F.shiftrightunsigned(ll, 32)
        return F.shiftleft(hh, 32).bitwiseOR(ll.bitwiseAND(low))

    start = F.lit(FNV_OFFSET - (1 << 64))
    places = F.when(F.octet_length(data) > 0, F.sequence(F.lit(1), F.octet_length(data))).otherwise(F.array().cast("array<int>"))
    return F.lower(F.lpad(F.hex(F.aggregate(places, start, step)), 16, "0"))
