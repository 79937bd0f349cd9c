"""Operator 8: SentencePiece encoding and decoding for merge-type (BPE) vocabularies.

Text is cut where no piece can cross: before runs of the space mark and before line feeds. Each distinct unit is
encoded once: its adjacent symbol pairs are an agenda ordered by score, then place, from which the best is merged until
none is left. The agendas of all new units of an Arrow batch run at once, as rows of a matrix; long units have a heap.
Every new unit, and the first text of each slice of a batch, is checked against the sentencepiece library; differences
are counted in `differs` and never mended: the result is always the agenda's own.
A null text is empty and has no ids. Repeated rows are coded alike; a text of any length is coded whole. Columns of
other names are not read.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import handing_back

MARK = "▁"
LONG = 24
#: Encoded units that a task keeps; when full, it begins anew. Only speed depends on it.
KEEP = 200_000


class Codec:
    def __init__(self, path: str):
        import sentencepiece

        self.library = sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        self.piece = [sp.id_to_piece(i) for i in range(n)]
        plain = [i for i in range(n) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i))]
        self.byte = {int(self.piece[i][3:5], 16): i for i in range(n) if sp.is_byte(i)}
        self.bytes = frozenset(self.byte.values())
        self.digits = [str(i) for i in range(n)]
        self.plain_text = [p.replace(MARK, " ") for p in self.piece]
        self.unknown = sp.unk_id()
        if any(MARK in self.piece[i].lstrip(MARK) or "\n" in self.piece[i] for i in plain):
            raise ValueError("a piece crosses the places where text is cut")
        self.id = {self.piece[i]: i for i in plain}
        # symbols: pieces by id, then characters that occur in pieces without being one
        self.symbol = dict(self.id)
        for i in plain:
            for ch in self.piece[i]:
                self.symbol.setdefault(ch, n + len(self.symbol))
        self.text = {v: k for k, v in self.symbol.items()}
        self.width = 2 * n + len(self.symbol) + 1
        score = {i: sp.get_score(i) for i in plain}
        by_score = sorted(plain, key=lambda i: -score[i])
        rank, self.merge = {}, {}
        for i in by_score:
            rank.setdefault(score[i], len(rank))
        for i in plain:
            p = self.piece[i]
            for k in range(1, len(p)):
                a, b = self.symbol.get(p[:k]), self.symbol.get(p[k:])
                if a is not None and b is not None:
                    self.merge[a, b] = (rank[score[i]], i)
        size = 1 << (len(self.merge) * 4).bit_length()
        self.mask = np.uint64(size - 1)
        self.slot_key, self.slot_rank, self.slot_id = np.full(size, -1, np.int64), np.zeros(size, np.int32), np.zeros(size, np.int32)
        self.probes = 1
        for (a, b), (r, i) in self.merge.items():
            key = a * self.width + b
            at, steps = int(self._hash(np.array([key]))[0]), 1
            while self.slot_key[at] >= 0:
                at, steps = (at + 1) & int(self.mask), steps + 1
            self.probes = max(self.probes, steps)
            self.slot_key[at], self.slot_rank[at], self.slot_id[at] = key, r, i
        self.points = np.full(0x110000, -1, np.int32)  # symbols by code point
        for ch, i in self.symbol.items():
            if len(ch) == 1:
                self.points[ord(ch)] = i
        self.known: dict[str, str] = {}  # ids, joined, of the units met
        self.said: dict[str, str] = {}  # the decoded text of those units that it differs from
        self.differ = 0
        self.cut = re.compile(f"{MARK}+[^{MARK}\n]*|\n[^{MARK}\n]*|[^{MARK}\n]+")

    def _hash(self, key: np.ndarray) -> np.ndarray:
        x = key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return ((x >> np.uint64(29)) & self.mask).astype(np.int64)

    NONE = np.int32(2**31 - 1)

    def _rank(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rank, merged symbol) of pairs; NONE where they don't merge."""
        key = left.astype(np.int64) * self.width + right
        rank, merged = np.full(len(key), self.NONE, np.int32), np.zeros(len(key), np.int32)
        key[(left < 0) | (right < 0)] = -2
        at, open_ = self._hash(np.maximum(key, 0)), np.arange(len(key))
        for _ in range(self.probes):
            found = self.slot_key[at]
            hit = found == key[open_]
            rank[open_[hit]], merged[open_[hit]] = self.slot_rank[at[hit]], self.slot_id[at[hit]]
            go = ~hit & (found >= 0)
            if not go.any():
                break
            open_, at = open_[go], (at[go] + 1) & int(self.mask)
        return rank, merged

    def _heap(self, unit: str) -> list:
        """Symbols (numbers, or characters that no piece has) of one unit, by a heap of pairs."""
        s: list = [self.symbol.get(ch, ch) for ch in unit]
        after, before = list(range(1, len(s) + 1)), list(range(-1, len(s) - 1))
        agenda: list = []

        def push(i: int, j: int) -> None:
            m = self.merge.get((s[i], s[j]))
            if m:
                heapq.heappush(agenda, (m[0], i, j, s[i], s[j], m[1]))

        for i in range(len(s) - 1):
            push(i, i + 1)
        while agenda:
            _, i, j, a, b, new = heapq.heappop(agenda)
            if s[i] != a or s[j] != b or after[i] != j:
                continue
            s[i], s[j] = new, None
            after[i] = after[j]
            if after[j] < len(s):
                before[after[j]] = i
                push(i, after[j])
            if before[i] >= 0:
                push(before[i], i)
        return [x for x in s if x is not None]

    def _rows(self, units: list[str]) -> list[list[int]]:
        """The ids of many units of one length, side by side: each step merges the best pair of every unit."""
        n, width = len(units), len(units[0])
        points = np.frombuffer("".join(units).encode("utf-32-le"), "<u4").astype(np.int64)
        # with a column of -1 at each end, where links of the first and last symbols lead to
        s = np.full((n, width + 2), -1, np.int64)
        found = self.points[points]
        s[:, 1:-1] = np.where(found >= 0, found, -2 - points).reshape(n, width)  # characters that no piece has: negative numbers
        row = width + 2
        s = s.ravel()
        after, before = np.arange(1, n * row + 1), np.arange(-1, n * row - 1)
        rank, merged = (x.reshape(-1) for x in self._rank(s, np.append(s[1:], -1)))
        best_of = rank.reshape(n, row)
        live = np.arange(n)
        while len(live):
            part = best_of[live]
            best = part.argmin(axis=1)
            more = part[np.arange(len(live)), best] != self.NONE
            live = live[more]
            at = live * row + best[more]
            gone = after[at]
            beyond = after[gone]
            s[at], s[gone] = merged[at], -1
            after[at], before[beyond] = beyond, at
            rank[gone] = self.NONE
            for left in (before[at], at):
                rank[left], merged[left] = self._rank(s[left], s[after[left]])
        kept = s.reshape(n, row) != -1
        ends = np.cumsum(kept.sum(axis=1)).tolist()
        symbols = s[kept.ravel()]
        odd = np.logical_or.reduceat((symbols < 0) | (symbols >= len(self.piece)), [0, *ends[:-1]]).tolist()
        symbols = symbols.tolist()
        rows = [symbols[i:j] for i, j in zip([0, *ends], ends, strict=False)]
        return [self._ids([x if x >= 0 else chr(-2 - x) for x in r]) if o else r for r, o in zip(rows, odd, strict=True)]

    def _ids(self, symbols: list) -> list[int]:
        out: list[int] = []
        n = len(self.piece)
        for x in symbols:
            if isinstance(x, int) and x < n:
                out.append(x)
                continue
            ch = x if isinstance(x, str) else self.text[x]
            out += [self.byte[b] for b in ch.encode()] if self.byte else [self.unknown]
        return out

    def decode(self, ids: list[int]) -> str:
        """The pieces' text, runs of byte pieces as UTF-8, space marks as spaces; the first mark is not removed."""
        if self.bytes.isdisjoint(ids):
            return "".join([self.plain_text[i] for i in ids])
        out, held = [], bytearray()
        for i in ids:
            if i in self.bytes:
                held.append(int(self.piece[i][3:5], 16))
                continue
            if held:
                out.append(held.decode("utf-8", "replace"))
                held = bytearray()
            out.append(self.plain_text[i])
        return "".join(out) + held.decode("utf-8", "replace").replace(MARK, " ")

    def learn(self, units: list[str]) -> None:
        """Encode new units."""
        by_length: dict[int, list[str]] = {}
        for u in units:
            by_length.setdefault(len(u), []).append(u)
        for length, group in by_length.items():
            for i in range(0, len(group), 20_000):
                part = group[i : i + 20_000]
                ids = [self._ids(self._heap(u)) for u in part] if length > LONG or length == 1 or len(part) < 4 else self._rows(part)
                digits = self.digits
                for u, own, told in zip(part, ids, self._told(part), strict=True):
                    self.differ += own != told
                    self.known[u] = ",".join([digits[i] for i in own])
                    if (text := self.decode(own)) != u.replace(MARK, " "):
                        self.said[u] = text

    def _told(self, units: list[str]) -> list[list[int]]:
        """The library's ids for units: it puts a mark before a text, which units that start with one have."""
        marked = [u[0] == MARK for u in units]
        out = self.library.encode([u[1:] if m else u for u, m in zip(units, marked, strict=True)], num_threads=1)
        # a unit without mark starts with a line feed, which merges with nothing
        for k, (u, m) in enumerate(zip(units, marked, strict=True)):
            if u == MARK:
                out[k] = [self.id[MARK]] if MARK in self.id else [self.byte[b] for b in MARK.encode()]
            elif not m:
                out[k] = out[k][1:]
        return out

    def encode(self, texts: list[str]):
        """(number of ids, ids joined by commas, decoded text) of each text."""
        cut = [self.cut.findall((MARK + t).replace(" ", MARK)) if t else [] for t in texts]
        if len(self.known) > KEEP:
            self.known, self.said = {}, {}
        new = set(chain.from_iterable(cut)).difference(self.known)
        if new:
            self.learn(list(new))
        out = []
        for units in cut:
            ids = ",".join(map(self.known.__getitem__, units))
            out.append((ids.count(",") + 1 if ids else 0, ids, "".join(map(self.said.get, units, units)).replace(MARK, " ")[1:]))
        return out


def _run(path: str, texts: bool):
    def run(batches):
        codec = Codec(path)  # anew for each task: a worker that is idle holds neither tables nor units
        for batch in batches:
            body = batch.column(1).to_pylist()
            i = 0
            while i < len(body):
                j, size = i, 0
                while j < len(body) and (j == i or size + len(body[j]) <= 1 << 20):
                    size += len(body[j])
                    j += 1
                before = codec.differ
                rows = codec.encode(body[i:j])
                own = [int(x) for x in rows[0][1].split(",")] if rows[0][1] else []
                differ = codec.differ - before + (own != codec.library.encode(body[i], num_threads=1)) + (codec.library.decode(own) != rows[0][2])
                sha = lambda s: hashlib.sha256(s.encode("utf-8", "surrogatepass")).hexdigest()
                columns = [
                    batch.column(0).slice(i, j - i),
                    pa.array([r[0] for r in rows], pa.int64()),
                    pa.array([sha(r[1]) for r in rows]),
                    pa.array([sha(r[2]) for r in rows]),
                    pa.array([differ] + [0] * (j - i - 1), pa.int32()),
                ]
                names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "differs"]
                if texts:
                    columns += [pa.array([[int(x) for x in r[1].split(",")] if r[1] else [] for r in rows], pa.list_(pa.int32())), pa.array([r[2] for r in rows], pa.string())]
                    names += ["ids", "decoded"]
                yield pa.RecordBatch.from_arrays(columns, names=names)
                i = j

    return run


def transcode(docs: DataFrame, model_path: str, texts: bool = False, text: str = "text", key: str = "doc_id") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and differs for each row of docs; with texts also ids and decoded.

    differs: on the first row of a slice, the number of new units and of whole texts that the library codes otherwise.

    model_path: a SentencePiece model of type BPE at the same place on every executor.
    """
    source = docs.select(F.col(key).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    schema = f"doc_id {source.schema['doc_id'].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string, differs int"
    return source.mapInArrow(handing_back(_run(model_path, texts)), schema + (", ids array<int>, decoded string" if texts else ""))
