"""Compound files (the older office formats): mail items, documents, decks and workbooks.

Each reader gives Markdown, or the rows of sheets. Damaged chains of sectors end where they repeat or leave the file.
"""

from __future__ import annotations

import datetime
import re
import struct
import uuid

from ..operators import grid


class CompoundError(ValueError):
    pass


MAGIC = b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1"
_LAST = 0xFFFFFFFA  # sector numbers from here on are marks


class Compound:
    """The streams of a compound file by path."""

    def __init__(self, data: bytes):
        if data[:8] != MAGIC or len(data) < 512:
            raise CompoundError("not a compound file")
        self.data = data
        shift, small = struct.unpack_from("<HH", data, 30)
        if shift not in (9, 12) or small > shift:
            raise CompoundError("the compound file's sector size is not known")
        self.size, self.small = 1 << shift, 1 << small
        first, _, self.cutoff, small_first, _, more, _ = struct.unpack_from("<7I", data, 48)
        fats = [x for x in struct.unpack_from("<109I", data, 76) if x < _LAST]
        seen: set[int] = set()
        while more < _LAST and more not in seen:
            seen.add(more)
            found = self._numbers(self._sector(more))
            fats += [x for x in found[:-1] if x < _LAST]
            more = found[-1] if found else _LAST
        self.fat = [x for f in fats for x in self._numbers(self._sector(f))]
        self.small_fat = self._numbers(self._chain(small_first))
        entries = self._chain(first)
        self.entries = [entries[i : i + 128] for i in range(0, len(entries) - 127, 128)]
        root = struct.unpack_from("<I", self.entries[0], 116)[0] if self.entries else _LAST
        self.small_data = self._chain(root)
        self.at: dict[str, tuple[int, int]] = {}
        self.folders: list[str] = []
        self._walk()

    def _sector(self, n: int) -> bytes:
        return self.data[(n + 1) * self.size : (n + 2) * self.size]

    @staticmethod
    def _numbers(raw: bytes) -> list[int]:
        return list(struct.unpack(f"<{len(raw) // 4}I", raw[: len(raw) // 4 * 4]))

    def _chain(self, n: int) -> bytes:
        out, seen = [], set()
        while n < len(self.fat) and n not in seen:
            seen.add(n)
            out.append(self._sector(n))
            n = self.fat[n]
        return b"".join(out)

    def _walk(self) -> None:
        todo, seen = [(0, "")], set()
        while todo:
            i, folder = todo.pop()
            if i >= len(self.entries) or i in seen:
                continue
            seen.add(i)
            e = self.entries[i]
            length, kind = struct.unpack_from("<HB", e, 64)
            left, right, child = struct.unpack_from("<3I", e, 68)
            start, size = struct.unpack_from("<II", e, 116)
            path = folder + e[: max(length - 2, 0)].decode("utf-16-le", "replace")
            todo += [(left, folder), (right, folder)]
            if kind == 2:
                self.at[path] = (start, size)
            elif kind == 5:
                todo.append((child, ""))
            elif kind == 1:
                self.folders.append(path)
                todo.append((child, path + "/"))

    def stream(self, path: str) -> bytes | None:
        if path not in self.at:
            return None
        n, size = self.at[path]
        if size >= self.cutoff:
            return self._chain(n)[:size]
        out, seen = [], set()
        while n < len(self.small_fat) and n not in seen:
            seen.add(n)
            out.append(self.small_data[n * self.small : (n + 1) * self.small])
            n = self.small_fat[n]
        return b"".join(out)[:size]


# mail items

#: Labels of a task's status, and of a contact's fields by property. Fixed values.
TASK_STATUS = ["Not Started", "In Progress", "Complete", "Waiting on someone else", "Deferred"]
CONTACT = {0x3A16: "Company", 0x3A17: "Job Title", 0x3A18: "Department", 0x3A08: "Business Phone", 0x3A1C: "Mobile Phone", 0x3A1B: "Home Phone", 0x3A00: "Account"}
_APPOINTMENT, _TASK = (uuid.UUID(f"0006200{n}-0000-0000-c000-000000000046").bytes_le for n in (2, 3))
#: The dictionary that compressed RTF begins with. Fixed value.
RTF_START = (
    b"{\\rtf1\\ansi\\mac\\deff0\\deftab720{\\fonttbl;}{\\f0\\fnil \\froman \\fswiss \\fmodern \\fscript \\fdecor MS Sans SerifSymbolArialTimes New RomanCourier"
    b"{\\colortbl\\red0\\green0\\blue0\r\n\\par \\pard\\plain\\f0\\fs20\\b\\i\\u\\tab\\tx"
)


def rtf_inflated(data: bytes) -> bytes:
    """Compressed RTF as RTF: references into a ring of 4096 bytes that begins with a fixed text."""
    if len(data) < 16:
        return b""
    size, kind = struct.unpack_from("<I4s", data, 4)
    if kind == b"MELA":
        return data[16 : 16 + size]
    ring = bytearray(RTF_START.ljust(4096, b"\0"))
    put, at, out = len(RTF_START), 16, bytearray()
    while at < len(data) and len(out) < size:
        flags = data[at]
        at += 1
        for bit in range(8):
            if flags >> bit & 1:
                if at + 2 > len(data):
                    return bytes(out)
                pair = data[at] << 8 | data[at + 1]
                at += 2
                offset = pair >> 4
                if offset == put:
                    return bytes(out)
                copied = (pair & 15) + 2
            elif at < len(data):
                offset, copied = -1, 1
                at += 1
            else:
                return bytes(out)
            for i in range(copied):
                byte = data[at - 1] if offset < 0 else ring[(offset + i) % 4096]
                out.append(byte)
                ring[put] = byte
                put = (put + 1) % 4096
    return bytes(out[:size])


class _Item:
    """The properties of a message, recipient or attachment below a path."""

    def __init__(self, file: Compound, path: str, head: int, page: str = "cp1252"):
        self.file, self.path, self.page = file, path, page
        raw = file.stream(path + "__properties_version1.0") or b""
        self.fixed = {struct.unpack_from("<H", raw, i + 2)[0]: raw[i + 8 : i + 16] for i in range(head, len(raw) - 15, 16)}
        if not path:
            number = self.number(0x3FFD) or self.number(0x3FDE) or 1252
            self.page = {65001: "utf-8", 20127: "cp1252", 28591: "latin-1"}.get(number, f"cp{number}")
            try:
                "".encode(self.page)
            except LookupError:
                self.page = "cp1252"

    def binary(self, pid: int, kind: str = "0102") -> bytes | None:
        return self.file.stream(f"{self.path}__substg1.0_{pid:04X}{kind}")

    def text(self, pid: int) -> str | None:
        wide, narrow = self.binary(pid, "001F"), self.binary(pid, "001E")
        found = wide.decode("utf-16-le", "replace") if wide is not None else narrow.decode(self.page, "replace") if narrow is not None else ""
        return found.rstrip("\0").strip() or None

    def number(self, pid: int) -> int | None:
        return struct.unpack("<I", self.fixed[pid][:4])[0] if pid in self.fixed else None

    def date(self, pid: int) -> str | None:
        ticks = struct.unpack("<Q", self.fixed[pid])[0] if pid in self.fixed else 0
        seconds = ticks // 10_000_000 - 11_644_473_600
        if not ticks or seconds < 0:
            return None
        try:
            return (datetime.datetime(1970, 1, 1) + datetime.timedelta(seconds=seconds)).strftime("%Y-%m-%d %H:%M:%S")
        except OverflowError:
            return None

    def below(self, begin: str) -> list[str]:
        return sorted(f + "/" for f in self.file.folders if f.startswith(self.path + begin) and "/" not in f[len(self.path) :])


def _address(item: _Item, smtp: int, address: int, kind: int) -> str | None:
    own = item.text(address)
    usable = own if own and ("@" in own and not own.upper().startswith("/O=")) and (item.text(kind) or "SMTP").upper() == "SMTP" else None
    return item.text(smtp) or usable


def _person(name: str | None, address: str | None) -> str | None:
    return f"{name} <{address}>" if name and address and name != address else name or address


def _named(file: Compound) -> dict[tuple[bytes, int], int]:
    guids, entries = file.stream("__nameid_version1.0/__substg1.0_00020102") or b"", file.stream("__nameid_version1.0/__substg1.0_00030102") or b""
    out = {}
    for i in range(0, len(entries) - 7, 8):
        number, about, index = struct.unpack_from("<IHH", entries, i)
        if not about & 1 and (g := about >> 1) >= 3:
            out[guids[(g - 3) * 16 : (g - 2) * 16], number] = 0x8000 + index
    return out


def _fields(item: _Item, kind: str) -> list[tuple[str, str | None]]:
    kind, named = kind.lower(), _named(item.file)
    if kind.startswith(("ipm.appointment", "ipm.schedule")):
        pid = lambda n: named.get((_APPOINTMENT, n), 0)
        return [("Start", item.date(pid(0x820D))), ("End", item.date(pid(0x820E))), ("Location", item.text(pid(0x8208)))]
    if kind.startswith("ipm.task"):
        pid = lambda n: named.get((_TASK, n), 0)
        status, part = item.number(pid(0x8101)), item.fixed.get(pid(0x8102))
        return [
            ("Task Start", item.date(pid(0x8104))),
            ("Due", item.date(pid(0x8105))),
            ("Status", None if status is None else TASK_STATUS[status if status < len(TASK_STATUS) else 0]),
            ("% Complete", None if part is None else str(round(struct.unpack("<d", part)[0] * 100))),
        ]
    return [(label, item.text(pid)) for pid, label in CONTACT.items()] if kind.startswith("ipm.contact") else []


def _message(file: Compound, path: str, page: str, html, rtf, depth: int) -> tuple[dict, str, list[str], list[tuple[str, str | None]]]:
    """(facts, body, lines of attachments, fields) of the message below a path."""
    item = _Item(file, path, 24 if path else 32, page)
    kind = item.text(0x001A) or "IPM.Note"
    people: dict[int, list[str]] = {1: [], 2: [], 3: []}
    for r in item.below("__recip_version1.0_"):
        one = _Item(file, r, 8, item.page)
        who = _person(one.text(0x3001), _address(one, 0x39FE, 0x3003, 0x3002))
        if who:
            people.setdefault(one.number(0x0C15) or 1, []).append(who)
    for n, pid in ((1, 0x0E04), (2, 0x0E03), (3, 0x0E02)):
        if not people[n] and (shown := item.text(pid)):
            people[n] = [shown]
    body = item.text(0x1000)
    if body is None and (raw := item.binary(0x1013)) is not None:
        body = html(raw)
    if body is None and (as_text := item.text(0x1013)):
        body = html(as_text.encode())
    if body is None and (raw := item.binary(0x1009)) is not None:
        body = rtf(rtf_inflated(raw))
    attached = []
    for a in item.below("__attach_version1.0_"):
        one = _Item(file, a, 8, item.page)
        name, mime, inner = one.text(0x3707) or one.text(0x3704), one.text(0x370E), ""
        if one.number(0x3705) == 5 and depth < 3:
            facts, text, _, _ = _message(file, a + "__substg1.0_3701000D/", item.page, html, rtf, depth + 1)
            shown = (("Subject", facts["subject"]), ("From", facts["from"]), ("To", ", ".join(facts["to"])), ("Sent", facts["sent_date"]))
            inner = "\n\n".join(p for p in ("  \n".join(f"**{k}:** {v}" for k, v in shown if v), text) if p)
            name = name or facts["subject"] and facts["subject"] + ".msg"
        attached.append(f"- {name or '(unnamed)'}" + (f" ({mime})" if mime else "") + (f"\n\n{inner}\n" if inner else ""))
    level = item.number(0x0017)
    facts = {
        "message_class": kind, "subject": item.text(0x0037), "from": _person(item.text(0x0C1A), _address(item, 0x5D01, 0x0C1F, 0x0C1E)), "to": people[1], "cc": people[2], "bcc": people[3], "sent_date": item.date(0x0039), "received_date": item.date(0x0E06),
        "importance": None if level is None else {0: "Low", 2: "High"}.get(level, "Normal"), "conversation_topic": item.text(0x0070), "has_attachments": bool(attached), "attachment_count": len(attached),
    }
    return facts, (body or "").replace("\r\n", "\n").replace("\r", "\n").strip(), attached, _fields(item, kind)


def mail_item(data: bytes, html, rtf) -> tuple[str, dict]:
    """Markdown and facts of a mail item. html and rtf give Markdown of bodies; a plain body comes first."""
    file = Compound(data)
    if not any(p.startswith(("__properties_version1.0", "__substg1.0_")) for p in file.at):
        raise CompoundError("the compound file is no mail item")
    facts, body, attached, fields = _message(file, "", "cp1252", html, rtf, 0)
    head = [("From", facts["from"]), ("To", ", ".join(facts["to"])), ("Cc", ", ".join(facts["cc"])), ("Sent", facts["sent_date"]), ("Importance", facts["importance"] if facts["importance"] != "Normal" else None), *fields]
    parts = [f"# {facts['subject']}" if facts["subject"] else "", "  \n".join(f"**{k}:** {v}" for k, v in head if v), body, "## Attachments\n\n" + "\n".join(attached) if attached else ""]
    return "\n\n".join(p for p in parts if p), facts


# documents


def fallback_heading(text: str) -> bool:
    """A line of 2 to 10 words, or one of two letters and more, all capitals or each word capitalised, with no end mark."""
    words = text.split()
    letters = [c for c in text if c.isalpha()]
    if not letters or len(words) > 10 or len(text) < 2 or text.endswith((".", "!", "?")):
        return False
    return all(map(str.isupper, letters)) or all(w[0].isupper() for w in words)


def _pieces(word: bytes, table: bytes) -> str:
    """The main text of a document through its piece table."""
    main = struct.unpack_from("<I", word, 76)[0]
    start, size = struct.unpack_from("<II", word, 418)
    clx, at = table[start : start + size], 0
    while at < len(clx) and clx[at] == 1:
        at += 3 + struct.unpack_from("<H", clx, at + 1)[0]
    if at + 5 > len(clx) or clx[at] != 2:
        raise CompoundError("the document has no piece table")
    length = struct.unpack_from("<I", clx, at + 1)[0]
    plc = clx[at + 5 : at + 5 + length]
    n = (len(plc) - 4) // 12
    ends = struct.unpack_from(f"<{n + 1}I", plc)
    out = []
    for i in range(n):
        place = struct.unpack_from("<I", plc, 4 * (n + 1) + 8 * i + 2)[0]
        chars = min(ends[i + 1], main) - ends[i]
        if chars <= 0:
            continue
        if place & 0x40000000:
            begin = (place & 0x3FFFFFFF) // 2
            out.append(word[begin : begin + chars].decode("cp1252", "replace"))
        else:
            out.append(word[place : place + 2 * chars].decode("utf-16-le", "replace"))
    return "".join(out)


_FIELD = re.compile("\x13[^\x13\x14\x15]*(?:\x14([^\x13\x14\x15]*))?\x15")


def _row(cells: list[str]) -> str:
    return "| " + " | ".join(c.replace("|", "\\|") for c in cells) + " |"


def old_document(data: bytes) -> str:
    """Markdown of a binary document. Rows of tables end at an empty cell; headings are told by their look alone."""
    file = Compound(data)
    word = file.stream("WordDocument")
    if word is None or len(word) < 426:
        raise CompoundError("the compound file is no document")
    flags = struct.unpack_from("<H", word, 10)[0]
    if flags & 0x100:
        raise CompoundError("the document is encrypted")
    text = _pieces(word, file.stream("1Table" if flags & 0x200 else "0Table") or b"")
    while "\x13" in text and (shown := _FIELD.sub(lambda m: m[1] or "", text)) != text:  # fields show their results
        text = shown
    text = re.sub("[\x00-\x06\x08\x0e-\x1f]", "", text.replace("\x1e", "-").replace("\x0b", "\n"))
    out: list[str] = []
    rows: list[list[str]] = []
    cells: list[str] = []
    held = ""  # paragraphs of an open cell

    def close() -> None:
        nonlocal rows
        if rows:
            wide = max(map(len, rows))
            whole = [r + [""] * (wide - len(r)) for r in rows]
            out.append("\n".join([_row(whole[0]), _row(["---"] * wide), *map(_row, whole[1:])]))
        rows = []

    marks = re.split("([\r\x07\x0c])", text)
    last_cell = max((i for i in range(1, len(marks), 2) if marks[i] == "\x07"), default=-1)
    for i in range(0, len(marks), 2):
        part, mark = marks[i].strip(), marks[i + 1] if i + 1 < len(marks) else "\r"
        if mark == "\x07":
            if part or held:
                cells.append(f"{held} {part}".strip().replace("\n", " "))
            elif cells:
                rows.append(cells)
                cells = []
            held = ""
            continue
        if cells and i < last_cell and mark == "\r":
            held = f"{held} {part}".strip()
            continue
        close()
        if part:
            out.append(f"## {part}" if "\n" not in part and fallback_heading(part) else part)
        if mark == "\x0c" and out and out[-1] != "---":
            out.append("---")
    if cells:
        rows.append(cells)
    close()
    while out and out[-1] == "---":
        out.pop()
    return "\n\n".join(out)


# decks


def _records(data: bytes, at: int, end: int):
    """(version and instance, type, begin, end) of the records of a range."""
    while at + 8 <= end:
        about, kind, size = struct.unpack_from("<HHI", data, at)
        yield about, kind, at + 8, min(at + 8 + size, end)
        at += 8 + size


def _persisted(data: bytes, user: bytes | None) -> dict[int, int]:
    """Place of each live object, through the chain of edits from the newest; all directories, where the chain can't be read."""
    edit = struct.unpack_from("<I", user, 16)[0] if user and len(user) >= 20 else 0
    directories, seen = [], set()
    while edit and edit not in seen and edit + 36 <= len(data) and struct.unpack_from("<H", data, edit + 2)[0] == 4085:
        seen.add(edit)
        before, place = struct.unpack_from("<II", data, edit + 16)
        directories.append(place)
        edit = before
    found: dict[int, int] = {}
    places = reversed(directories) if directories else [b - 8 for _, k, b, _ in _records(data, 0, len(data)) if k == 6002]
    for place in places:  # from the oldest: newer ones replace
        if place + 8 > len(data):
            continue
        at, end = place + 8, min(place + 8 + struct.unpack_from("<I", data, place + 4)[0], len(data))
        while at + 4 <= end:
            about = struct.unpack_from("<I", data, at)[0]
            n, first = about >> 20, about & 0xFFFFF
            n = min(n, (end - at - 4) // 4)
            found |= dict(zip(range(first, first + n), struct.unpack_from(f"<{n}I", data, at + 4), strict=True))
            at += 4 + 4 * n
    return found


def _texts(data: bytes, at: int, end: int, depth: int = 0):
    """(kind of text, text) below a range, in order."""
    kind = None
    for about, record, a, b in _records(data, at, end):
        if record == 3999 and b - a >= 4:
            kind = struct.unpack_from("<I", data, a)[0]
        elif record == 4000:
            yield kind, data[a:b].decode("utf-16-le", "replace")
        elif record == 4008:
            yield kind, data[a:b].decode("latin-1")
        elif about & 15 == 15 and depth < 32:
            yield from _texts(data, a, b, depth + 1)


def _lines(text: str) -> list[str]:
    return [s for x in re.split("[\r\n\x0b]", text.replace("\0", "")) if (s := x.strip()) and s != "*"]


def old_deck(data: bytes) -> list[tuple[str | None, list[str]]]:
    """(title, Markdown parts) of each slide, those without text included."""
    file = Compound(data)
    stream = file.stream("PowerPoint Document")
    if stream is None:
        raise CompoundError("the compound file is no deck")
    places = _persisted(stream, file.stream("Current User"))
    documents = [(a, b) for _, k, a, b in _records(stream, 0, len(stream)) if k == 1000]
    live = [d for d in documents if d[0] - 8 in places.values()] or documents
    slides: list[tuple[int | None, list[tuple[int | None, str]]]] = []
    for a, b in live[-1:]:
        for about, k, c, d in _records(stream, a, b):
            if k != 4080 or about >> 4:  # the outline of the slides; others are of masters and notes
                continue
            kind = None
            for _, record, e, f in _records(stream, c, d):
                if record == 1011:
                    slides.append((struct.unpack_from("<I", stream, e)[0], []))
                    kind = None
                elif record == 3999:
                    kind = struct.unpack_from("<I", stream, e)[0]
                elif record in (4000, 4008) and slides:
                    slides[-1][1].append((kind, stream[e:f].decode("utf-16-le" if record == 4000 else "latin-1", "replace")))
    out = []
    for ref, runs in slides:
        at = places.get(ref, len(stream))
        shapes = list(_texts(stream, at + 8, min(at + 8 + struct.unpack_from("<I", stream, at + 4)[0], len(stream)))) if at + 8 <= len(stream) else []
        title, parts, seen = None, [], set()
        for runs_of, free in ((runs, False), (shapes, bool(runs))):
            for kind, text in runs_of:
                lines = _lines(text)
                if free:
                    lines = [x for x in lines if " ".join(x.split()).lower() not in seen]
                seen.update(" ".join(x.split()).lower() for x in lines)
                if not lines:
                    continue
                headed = kind in (0, 6) or not parts and title is None and kind is None and len(lines) == 1 and fallback_heading(lines[0])
                if headed and not free:
                    title = title or lines[0]
                    parts += [f"## {lines[0]}", *lines[1:]]
                elif len(lines) > 1 and not free:
                    parts.append("\n".join(f"- {x}" for x in lines))
                else:
                    parts += lines
        out.append((title, parts))
    return out


# workbooks

#: Texts of error values by code. Fixed values.
ERRORS = {0: "#NULL!", 7: "#DIV/0!", 15: "#VALUE!", 23: "#REF!", 29: "#NAME?", 36: "#NUM!", 42: "#N/A"}


def packed_number(n: int) -> float:
    """A number of 30 bits, whole or the upper half of a double, perhaps in hundredths."""
    v = float((n >> 2) - (1 << 30 if n & 0x80000000 else 0)) if n & 2 else struct.unpack("<d", struct.pack("<Q", (n & 0xFFFFFFFC) << 32))[0]
    return v / 100 if n & 1 else v


class _Segments:
    """Shared strings over a record and its continuations; a string cut by one goes on behind a new flag."""

    def __init__(self, parts: list[bytes]):
        self.parts, self.i, self.at = parts, 0, 0

    def take(self, n: int) -> bytes:
        out = b""
        while n > len(out) and self.i < len(self.parts):
            got = self.parts[self.i][self.at : self.at + n - len(out)]
            out += got
            self.at += len(got)
            if self.at >= len(self.parts[self.i]) and len(out) < n:
                self.i, self.at = self.i + 1, 0
        return out.ljust(n, b"\0")

    def text(self) -> str:
        chars, flag = struct.unpack("<HB", self.take(3))
        runs = struct.unpack("<H", self.take(2))[0] if flag & 8 else 0
        more = struct.unpack("<I", self.take(4))[0] if flag & 4 else 0
        out = ""
        while chars > 0 and self.i < len(self.parts):
            width = 1 + (flag & 1)
            if self.at >= len(self.parts[self.i]):
                self.i, self.at = self.i + 1, 1
                if self.i >= len(self.parts):
                    break
                flag = self.parts[self.i][0]
                continue
            n = min(chars, (len(self.parts[self.i]) - self.at) // width)
            if n == 0:
                self.at = len(self.parts[self.i])
                continue
            raw = self.parts[self.i][self.at : self.at + n * width]
            out += raw.decode("utf-16-le" if width == 2 else "latin-1", "replace")
            self.at += n * width
            chars -= n
        self.take(4 * runs + more)
        return out


def _string(raw: bytes, wide_count: bool) -> str:
    chars, flag = struct.unpack_from("<HB" if wide_count else "<BB", raw)
    at = 3 if wide_count else 2
    return raw[at : at + chars * (1 + (flag & 1))].decode("utf-16-le" if flag & 1 else "latin-1", "replace")


def old_workbook(data: bytes, shown) -> list[tuple[str, list[grid.Row]]]:
    """(name, rows) of each worksheet; shown(number, format code or number, from 1904) gives a cell's text.

    Rows hold cells up to their last; a sheet's rows end with its last filled one.
    """
    file = Compound(data)
    book = file.stream("Workbook") or file.stream("Book")
    if book is None:
        raise CompoundError("the compound file is no workbook")
    at = 0

    def records(at: int):
        while at + 4 <= len(book):
            kind, size = struct.unpack_from("<HH", book, at)
            yield kind, book[at + 4 : at + 4 + size]
            at += 4 + size

    sheets, strings, codes, styles, from_1904, parts = [], [], {}, [], False, None
    for kind, r in records(at):
        if parts is not None and kind != 0x3C:
            s = _Segments(parts)
            strings = [s.text() for _ in range(struct.unpack("<II", s.take(8))[1]) if s.i < len(parts)]
            parts = None
        if kind == 0x0809 and struct.unpack_from("<H", r)[0] != 0x0600:
            raise CompoundError("the workbook is older than 1997")
        if kind == 0x2F:
            raise CompoundError("the workbook is encrypted")
        if kind == 0x85 and r[5] == 0:
            sheets.append((_string(r[6:], False), struct.unpack_from("<I", r)[0]))
        elif kind == 0xFC:
            parts = [r]
        elif kind == 0x3C and parts is not None:
            parts.append(r)
        elif kind == 0x041E:
            codes[struct.unpack_from("<H", r)[0]] = _string(r[2:], True)
        elif kind == 0xE0:
            styles.append(struct.unpack_from("<H", r, 2)[0])
        elif kind == 0x22:
            from_1904 = bool(struct.unpack_from("<H", r)[0])
        elif kind == 0x0A:
            break

    def number(v: float, style: int) -> grid.Typed:
        code = styles[style] if style < len(styles) else 0
        return grid.Typed(shown(v, codes.get(code, code), from_1904))

    out = []
    for name, place in sheets:
        cells: dict[int, dict[int, str]] = {}
        depth, waiting = 0, None
        put = lambda i, j, v: cells.setdefault(i, {}).__setitem__(j, v)  # noqa: B023, E731
        for kind, r in records(place):
            if kind == 0x0809:
                depth += 1
            elif kind == 0x0A:
                depth -= 1
                if depth <= 0:
                    break
            elif depth != 1:
                continue  # charts inside the sheet
            elif kind in (0xFD, 0x203, 0x27E, 0x205, 0x06, 0x204, 0xBD):
                i, j, style = struct.unpack_from("<HHH", r)
                if kind == 0xFD:
                    n = struct.unpack_from("<I", r, 6)[0]
                    put(i, j, strings[n] if n < len(strings) else "")
                elif kind == 0x203:
                    put(i, j, number(struct.unpack_from("<d", r, 6)[0], style))
                elif kind == 0x27E:
                    put(i, j, number(packed_number(struct.unpack_from("<I", r, 6)[0]), style))
                elif kind == 0xBD:
                    for k in range((len(r) - 6) // 6):
                        style, n = struct.unpack_from("<HI", r, 4 + 6 * k)
                        put(i, j + k, number(packed_number(n), style))
                elif kind == 0x205:
                    put(i, j, grid.Typed(ERRORS.get(r[6], "") if r[7] else "true" if r[6] else "false"))
                elif kind == 0x204:
                    put(i, j, _string(r[6:], True))
                elif r[12:14] != b"\xff\xff":
                    put(i, j, number(struct.unpack_from("<d", r, 6)[0], style))
                elif r[6] == 0:
                    waiting = (i, j)  # the text follows
                elif r[6] in (1, 2):
                    put(i, j, grid.Typed(ERRORS.get(r[8], "") if r[6] == 2 else "true" if r[8] else "false"))
            elif kind == 0x207 and waiting:
                put(*waiting, _string(r, True))
                waiting = None
        rows: list[grid.Row] = []
        for i in sorted(cells):
            rows += [[] for _ in range(i - len(rows))]
            rows.append([cells[i].get(j, "") for j in range(max(cells[i]) + 1)])
        out.append((name, rows))
    return out


def binary_package(package, shown) -> list[tuple[str, list[grid.Row]]]:
    """old_workbook for the binary parts of a package."""

    def records(part: str):
        data, at = package.zip.read(part) if part in package.names else b"", 0
        while at < len(data):
            kind = data[at]
            at += 1
            if kind & 0x80 and at < len(data):
                kind = kind & 0x7F | (data[at] & 0x7F) << 7
                at += 1
            size = shift = 0
            for _ in range(4):
                if at >= len(data):
                    break
                byte = data[at]
                at += 1
                size |= (byte & 0x7F) << shift
                shift += 7
                if not byte & 0x80:
                    break
            yield kind, data[at : at + size]
            at += size

    def wide(r: bytes, at: int) -> tuple[str, int]:
        n = struct.unpack_from("<I", r, at)[0]
        n = 0 if n == 0xFFFFFFFF else n
        return r[at + 4 : at + 4 + 2 * n].decode("utf-16-le", "replace"), at + 4 + 2 * n

    book = "xl/workbook.bin"
    if book not in package.names:
        raise CompoundError("xl/workbook.bin is missing")
    links = package.related(book)
    sheets, from_1904 = [], False
    for kind, r in records(book):
        if kind == 153:
            from_1904 = bool(r[0] & 1)
        elif kind == 156:
            link, at = wide(r, 8)
            sheets.append((wide(r, at)[0], links.get(link, "")))
    strings = [wide(r, 1)[0] for kind, r in records("xl/sharedStrings.bin") if kind == 19]
    codes, styles, cell_styles = {}, [], False
    for kind, r in records("xl/styles.bin"):
        if kind == 44:
            codes[struct.unpack_from("<H", r)[0]] = wide(r, 2)[0]
        elif kind in (617, 618):
            cell_styles = kind == 617
        elif kind == 47 and cell_styles:
            styles.append(struct.unpack_from("<H", r, 2)[0])
    out = []
    for name, part in sheets:
        if not part.startswith("xl/worksheets/"):
            continue
        rows: list[grid.Row] = []
        for kind, r in records(part):
            if kind == 0:
                at = struct.unpack_from("<I", r)[0]
                rows += [[] for _ in range(at + 1 - len(rows))]
            elif 1 <= kind <= 11 and rows and len(r) >= 8:
                column, style = struct.unpack_from("<II", r)
                code = styles[style & 0xFFFFFF] if style & 0xFFFFFF < len(styles) else 0
                if kind == 2:
                    v = grid.Typed(shown(packed_number(struct.unpack_from("<I", r, 8)[0]), codes.get(code, code), from_1904))
                elif kind in (5, 9):
                    v = grid.Typed(shown(struct.unpack_from("<d", r, 8)[0], codes.get(code, code), from_1904))
                elif kind in (3, 11):
                    v = grid.Typed(ERRORS.get(r[8], ""))
                elif kind in (4, 10):
                    v = grid.Typed("true" if r[8] else "false")
                elif kind in (6, 8):
                    v = wide(r, 8)[0]
                elif kind == 7:
                    n = struct.unpack_from("<I", r, 8)[0]
                    v = strings[n] if n < len(strings) else ""
                else:
                    v = ""
                rows[-1] += [""] * (column + 1 - len(rows[-1]))
                rows[-1][column] = v
        out.append((name, [[*r[: max((j + 1 for j, v in enumerate(r) if v), default=0)]] for r in rows]))
    return out
