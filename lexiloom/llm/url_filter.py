"""Operator 2: URL filters, as one bit-parallel automaton for all wildcard rules.

A canonical URL is host, U+0001, path. In a glob `*` stands for any run of characters within its part, `**` for any run
at all and `?` for one character; every other character stands for itself. The positions of all globs are packed into
64-bit words (Shift-And); a step over one byte moves every glob of every URL of a batch at once.
A null URL, or one without `://`, has an empty host and path; no rule fits it and, as no glob does, it is allowed.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ascii_lower, flat

SEP = "\x01"

#: (verdict, host and its subdomains, path prefix)
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))

#: The method's own verdict where no rule fits: blocked if one of these fits, else allowed.
BLOCKED = (f"*casino*{SEP}**", f"*porn*{SEP}**", f"*xxx*{SEP}**", f"*-bet.*{SEP}**", f"*viagra*{SEP}**", f"**{SEP}**/ads/**", f"**{SEP}*.exe", f"**{SEP}*.zip")


def canonical(url: Column) -> tuple[Column, Column]:
    """(host, path) as the contract has them, with SQL expressions."""
    rest = F.when(F.instr(url, "://") > 0, F.expr("substring(__url, instr(__url, '://') + 3)")).otherwise("")
    return ascii_lower(F.coalesce(F.regexp_extract(rest, r"^[^/?#]*", 0), F.lit(""))), F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def _bytes(glob: str) -> list:
    """A glob as bytes, and None (any byte), "*" (run within a part) or "**" (any run)."""
    out: list = []
    i = 0
    while i < len(glob):
        if glob.startswith("**", i):
            out.append("**")
            i += 2
            continue
        ch = glob[i]
        out += ["*"] if ch == "*" else [None] if ch == "?" else list(ch.encode())
        i += 1
    return out


class Automaton:
    """Bit k of the state: the first k items of the packed globs' current one have been read."""

    def __init__(self, globs: list[str]):
        steps, self.ends, starts, loops_any, loops_part = [], [], [], [], []
        for glob in globs:
            at = len(steps)
            steps.append(frozenset())  # the state before anything is read
            starts.append(at)
            for x in _bytes(glob):
                if isinstance(x, str):
                    (loops_any if x == "**" else loops_part).append(len(steps) - 1)
                else:
                    steps.append(range(256) if x is None else (x,))
            self.ends.append(len(steps) - 1)
        self.words = (len(steps) + 63) // 64 or 1
        self.start, self.any_loop, self.part_loop = (self._pack(x) for x in (starts, loops_any, loops_part))
        self.by_byte = np.zeros((256, self.words), np.uint64)
        for k, allowed in enumerate(steps):
            for b in allowed:
                self.by_byte[b, k // 64] |= np.uint64(1) << np.uint64(k % 64)
        self.stay = np.where((np.arange(256) == ord(SEP))[:, None], self.any_loop, self.any_loop | self.part_loop)

    def _pack(self, bits: list[int]) -> np.ndarray:
        out = np.zeros(self.words, np.uint64)
        for k in bits:
            out[k // 64] |= np.uint64(1) << np.uint64(k % 64)
        return out

    def match(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """A boolean matrix: string x glob."""
        n = len(offsets) - 1
        length = np.diff(offsets)
        order = np.argsort(-length, kind="stable")
        begin, sorted_length = offsets[:-1][order], -length[order]
        state = np.tile(self.start, (n, 1))
        one, top = np.uint64(1), np.uint64(63)
        for j in range(int(length.max(initial=0))):
            m = int(np.searchsorted(sorted_length, -j, "left"))  # strings longer than j
            b = data[begin[:m] + j]
            s = state[:m]
            moved = s << one
            moved[:, 1:] |= s[:, :-1] >> top
            moved &= self.by_byte[b]
            moved |= s & self.stay[b]
            state[:m] = moved
        out = np.empty((n, len(self.ends)), bool)
        for g, k in enumerate(self.ends):
            out[order, g] = (state[:, k // 64] >> np.uint64(k % 64)) & one > 0
        return out


def rule_globs(rules=RULES) -> list[tuple[str, str, str]]:
    """(glob, rule's name, verdict), longest rules first; a rule has a glob for its host and one for its subdomains."""
    ordered = sorted(rules, key=lambda r: (-len(r[1]) - len(r[2]), -len(r[1])))
    return [(f"{sub}{host}{SEP}{path}**", host + path, verdict) for verdict, host, path in ordered for sub in ("", "*.")]


def judge(pages: DataFrame, url: str = "url", rules=RULES, blocked=BLOCKED) -> DataFrame:
    """pages with host, path, rule and verdict. Column names of pages that clash with these give way."""
    ruled = rule_globs(rules)
    globs = [g for g, _, _ in ruled] + list(blocked)
    names, verdicts = [r for _, r, _ in ruled], [v for _, _, v in ruled]

    def run(batches):
        automaton = Automaton(globs)
        for batch in batches:
            data, off = flat(batch.column(batch.num_columns - 1))
            hit = automaton.match(data, off)
            own, bad = hit[:, : len(ruled)], hit[:, len(ruled) :].any(axis=1)
            fits, first = own.any(axis=1), own.argmax(axis=1) if ruled else np.zeros(len(own), int)
            rule = [names[k] if f else None for f, k in zip(fits, first, strict=True)]
            verdict = [verdicts[k] if f else "block" if b else "allow" for f, k, b in zip(fits, first, bad, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(rule, pa.string()), pa.array(verdict, pa.string())], names=[*batch.schema.names[:-1], "rule", "verdict"])

    host, path = canonical(F.col("__url"))
    kept = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict")]
    parts = pages.withColumn("__url", F.col(url)).select(*kept, host.alias("host"), path.alias("path"))
    typed = parts.withColumn("__canonical", F.concat("host", F.lit(SEP), "path"))
    schema = T.StructType([*parts.schema, T.StructField("rule", T.StringType()), T.StructField("verdict", T.StringType())])
    return typed.mapInArrow(run, schema)
