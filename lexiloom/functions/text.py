"""Scalar text operators as built-in column expressions; all stay in the JVM and in one stage with the scan."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .words import BREAKS, NOT_IN_TXT, PROSE_MAX, SIGNALS, STOP_WORDS

PHRASES = [p for phrases in (BREAKS, *SIGNALS.values()) for p in phrases]
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def trim(c: Column) -> Column:
    """Without white space, in Unicode's sense, at both ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def lower_ascii(c: Column) -> Column:
    return F.translate(c, _UPPER, _LOWER)


def normalize_newlines(c: Column) -> Column:
    return F.regexp_replace(c, "\r\n?", "\n")


def decode_text(data: Column) -> Column:
    """Bytes as text: a byte-order mark counts, then UTF-16 by its zero bytes, then UTF-8, else windows-1252."""
    head = F.hex(F.substring(data, 1, 4))
    probe = F.hex(F.substring(data, 1, 4096))
    zeros = lambda odd: F.size(F.filter(F.sequence(F.lit(1 + 2 * odd), F.greatest(F.length(probe) - 1, F.lit(1 + 2 * odd)), F.lit(4)), lambda i: F.substring(probe, i, F.lit(2)) == "00"))
    each = F.greatest(F.length(probe) / 4, F.lit(1))
    text = (
        F.when(data.isNull(), F.lit(None).cast("string"))
        .when(head.startswith("EFBBBF"), F.decode(F.substring(data, 4, 2**31 - 1), "UTF-8"))
        .when(head.startswith("FFFE"), F.decode(F.substring(data, 3, 2**31 - 1), "UTF-16LE"))
        .when(head.startswith("FEFF"), F.decode(F.substring(data, 3, 2**31 - 1), "UTF-16BE"))
        .when((F.octet_length(data) >= 4) & (zeros(1) >= 0.2 * each) & (zeros(0) < 0.05 * each), F.decode(data, "UTF-16LE"))
        .when((F.octet_length(data) >= 4) & (zeros(0) >= 0.2 * each) & (zeros(1) < 0.05 * each), F.decode(data, "UTF-16BE"))
        .when(F.is_valid_utf8(data.cast("string")), data.cast("string"))
        .otherwise(F.translate(F.decode(data, "ISO-8859-1"), "".join(map(chr, range(128, 160))), bytes(range(128, 160)).decode("cp1252", "replace")))
    )
    return normalize_newlines(text)


def strip_front_matter(c: Column) -> Column:
    return F.regexp_replace(c, r"(?sm)\A---\n.*?^---$\n*", "")


def strip_ansi(c: Column) -> Column:
    return F.regexp_replace(c, "\x1b\\[[^@-~]*[@-~]", "")


def lines(c: Column) -> Column:
    return F.split(c, "\n")


def filled(a: Column) -> Column:
    """Items of an array of strings, trimmed, without empty ones."""
    return F.filter(F.transform(a, trim), lambda x: x != "")


def sentences(c: Column) -> Column:
    """Cut after `.`, `!` or `?` before white space; trimmed, without empty ones."""
    return filled(F.split(c, r"(?U)(?<=[.!?])(?=\s)"))


def keywords(c: Column) -> Column:
    """Distinct ASCII words of four letters or digits and more that are no stop words, in order."""
    stop = F.array(*[F.lit(w) for w in STOP_WORDS])
    return F.array_distinct(F.filter(F.split(lower_ascii(c), "[^a-z0-9]+"), lambda w: (F.length(w) >= 4) & ~F.array_contains(stop, w)))


def n_words(c: Column) -> Column:
    return F.size(F.filter(F.split(c, r"(?U)\s+"), lambda w: w != ""))


def keyword_density(c: Column) -> Column:
    return F.round(F.size(keywords(c)) / F.greatest(n_words(c), F.lit(1)), 3)


def starts_with_any(c: Column, phrases: list[str]) -> Column:
    """Whether c opens with a phrase; only as much of c as the longest has is looked at."""
    return _opens(opening(c, phrases), phrases)


def opening(c: Column, phrases: list[str] = PHRASES) -> Column:
    """As many characters of c as the longest phrase has, in lower case."""
    return lower_ascii(F.substring(c, 1, max(map(len, phrases), default=0)))


def _opens(low: Column, phrases: list[str]) -> Column:
    return F.coalesce(low.rlike(f"^(?:{'|'.join(map(re.escape, phrases))})") if phrases else F.lit(False), F.lit(False))


def signal(c: Column, txt: bool = True) -> Column:
    """What the opening of a paragraph says: `break`, one of SIGNALS, or null."""
    return opening_signal(opening(c), txt)


def opening_signal(low: Column, txt: bool = True) -> Column:
    """The same of an opening."""
    found = F.when(_opens(low, BREAKS), "break")
    for reason, phrases in SIGNALS.items():
        found = found.when(_opens(low, [p for p in phrases if not (txt and p in NOT_IN_TXT)]), reason)
    return found


def prose_type(c: Column) -> Column:
    size = F.octet_length(c)
    return F.when(size > 900, "long_single_paragraph").when(size < 90, "short_disconnected_paragraph").otherwise("plain_paragraph")


def pack(parts: Column, limit: int, joiner: str = " ", bytes_: bool = True) -> Column:
    """Neighbouring strings of an array joined while they fit into limit; a longer one stands alone."""
    size = F.octet_length if bytes_ else F.length
    start = F.array().cast("array<string>")

    def step(done: Column, part: Column) -> Column:
        last = F.element_at(done, -1)
        joined = F.concat(last, F.lit(joiner), part)
        fits = (F.size(done) > 0) & (size(joined) <= limit)
        return F.when(fits, F.concat(F.slice(done, 1, F.size(done) - 1), F.array(joined))).otherwise(F.concat(done, F.array(part)))

    return F.aggregate(parts, start, step)


def pack_sentences(c: Column, limit: int = PROSE_MAX) -> Column:
    """A text in parts of at most limit bytes, cut between sentences."""
    return F.when(F.octet_length(c) <= limit, F.array(trim(c))).otherwise(pack(sentences(c), limit))


def pack_lines(c: Column, limit: int = PROSE_MAX) -> Column:
    """A text in parts of at most limit characters, a line feed for each line counted in, cut between lines."""
    whole = F.length(c) <= limit
    return F.when(whole, F.array(c)).otherwise(pack(lines(c), limit - 1, "\n", bytes_=False))


def html_text(c: Column) -> Column:
    """HTML without scripts, comments and tags, common entities decoded, white space of each line collapsed."""
    x = F.regexp_replace(c, r"(?is)<!--.*?-->|<(script|style|noscript|head|svg|canvas)\b.*?</\1\s*>", "")
    x = F.regexp_replace(x, r"(?i)<br\s*/?>|</(p|li|tr|h[1-6]|div|ul|ol|table)\s*>", "\n")
    x = F.regexp_replace(x, r"(?s)<[^>]*>", "")
    for entity, plain in (("&nbsp;", " "), ("&copy;", "©"), ("&middot;", "·"), ("&quot;", '"'), ("&lt;", "<"), ("&gt;", ">"), ("&#39;", "'"), ("&amp;", "&")):
        x = F.replace(x, F.lit(entity), F.lit(plain))
    return F.array_join(F.filter(F.transform(F.split(x, "\n"), lambda l: F.trim(F.regexp_replace(l, r"[ \t\r\f]+", " "))), lambda l: l != ""), "\n")
