"""Operator 1: removal of byte strings that occur more than once, by distributed prefix doubling.

The rank of a string is a 64-bit digest, so equal strings share a rank on every executor without a global sort.
Ranks double in length from 1 to 32 bytes inside each text. At 32 bytes the corpus is thinned consistently: of the
ranks inside any window of `length` bytes only the smallest stays (all of them on ties), so two equal windows keep the
same positions. Spark then sorts the pairs (rank of 32 bytes, rank of the surrounding 2 * length - 32 bytes). A
position whose rank is unique is dropped; one whose pair occurs twice is past the threshold and is covered whole. The
rest are compared at every offset around the position, in memory where a rank has up to LOCAL_GROUP of them. A hotter
rank's positions are ranked again by longer strings: the offsets are split into PARTS runs, and the rank of a run is that
of the bytes which all its windows share. What is still hot is ranked by whole windows.

A rank that is met often in one slice of texts is dealt to several places by its context, before the sort; its pairs are
then told apart wherever they stand, so no rank's positions meet in one task.

Nothing is sampled: every window of `length` bytes contains a kept position, and is decided with it.
Nulls and empty texts have no bytes. Texts shorter than `length` lose nothing. Repeated rows are copies of a text.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BYTE_RANK, cut, double, flat, handing_back, mix, pair, partitions, slices, text_key

GRAM = 32
PAD = 255  # never a byte of UTF-8
#: Contexts of one group that a task compares in memory; larger groups are ranked anew by longer strings.
LOCAL_GROUP = 16384
PARTS = 8
ROWS = 1024  # contexts whose windows are ranked at once


def _sliding(f, x: np.ndarray, w: int) -> np.ndarray:
    """f (minimum or maximum) over every w consecutive items."""
    n = 1
    while n * 2 <= w:
        x = f(x[:-n], x[n:])
        n *= 2
    return f(x[: len(x) - (w - n)], x[w - n :]) if n < w else x


def _positions(texts: list[np.ndarray], length: int) -> tuple[np.ndarray, ...]:
    """(text, position, rank of GRAM bytes, rank of the context) of the kept positions."""
    side = length
    size = sum(map(len, texts)) + side * (len(texts) + 1)
    buf = np.full(size, PAD, np.uint8)
    valid = np.zeros(size, bool)
    starts = np.empty(len(texts), np.int64)
    at = side
    for i, t in enumerate(texts):
        starts[i] = at
        buf[at : at + len(t)] = t
        valid[at : at + len(t) - length + 1] = True
        at += len(t) + side
    ranks = double(BYTE_RANK[buf], 1, GRAM)
    w = length - GRAM + 1
    low = _sliding(np.minimum, ranks, w)  # by window start
    low[~valid[: len(low)]] = 0
    high = np.zeros(len(low) + w - 1, np.uint64)
    high[w - 1 : len(low)] = _sliding(np.maximum, low, w)[: len(low) - w + 1]
    high = high[: len(ranks)]
    keep = np.flatnonzero((high == ranks[: len(high)]) & (high > 0))
    context = double(ranks, GRAM, 2 * length - GRAM)
    doc = np.searchsorted(starts, keep, "right") - 1
    return doc, keep - starts[doc], ranks[keep], context[keep - (length - GRAM)]


POSITIONS = "h long, s int, c long, k binary, p int, n int"

#: A rank met so often among the positions of one slice is dealt to SALTS places by its context. From place SETTLED on
#: there are positions whose pair the slice itself has more than once: one of them stands for all, the others are settled.
HOT, SALTS, SETTLED = 8, 63, 64


def _again(h: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(the first of each pair that stands more than once, the others)."""
    order = np.lexsort((c, h))
    same = (h[order[1:]] == h[order[:-1]]) & (c[order[1:]] == c[order[:-1]])
    return order[:-1][same & ~np.concatenate([[False], same[:-1]])], order[1:][same]


def _scan(length: int):
    def scan(batches):
        for batch in batches:
            data, off = flat(batch.column(1))
            keys = batch.column(0)
            for i, j in slices(off, 1 << 18):
                seen: dict[bytes, list] = {}
                for r in range(i, j):
                    k = keys[r].as_py()
                    if k in seen:
                        seen[k][1] += 1
                    else:
                        seen[k] = [data[off[r] : off[r + 1]], 1]
                names = list(seen)
                doc, pos, h, c = _positions([seen[k][0] for k in names], length)
                count = np.array([seen[k][1] for k in names], np.int32)[doc]
                ranks, place, met = np.unique(h, return_inverse=True, return_counts=True)
                salt = np.where(met[place] >= HOT, 1 + c % np.uint64(SALTS), 0).astype(np.int32)
                first, others = _again(h, c)
                count[first] = np.maximum(count[first], 2)
                salt[others], count[others] = SETTLED + pos[others] % SALTS, 2
                # a mark at place 0 tells the rows there that their rank stands at other places too
                marks = ranks[met >= HOT]
                names.append(b"")
                row = lambda x, v, t: np.concatenate([x.astype(t), np.full(len(marks), v, t)])
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.concatenate([h, marks]).view(np.int64)), pa.array(row(salt, 0, np.int32)), pa.array(np.concatenate([c.view(np.int64), np.full(len(marks), np.iinfo(np.int64).min)])),
                        pa.array(names, pa.binary()).take(pa.array(row(doc, len(names) - 1, np.int64))), pa.array(row(pos, -1, np.int32)), pa.array(row(count, 0, np.int32)),
                    ],
                    names=["h", "s", "c", "k", "p", "n"],
                )

    return scan


DECIDED = "whole boolean, h long, k binary, p int"


def _decide(batches):
    """Sorted by (h, s, c): positions of repeated pairs as whole, and one position of each pair where a rank has several.

    At the places other than 0 a rank has several pairs for sure; at place 0 also if there is a mark.
    """
    last = None  # (h, s), c, k, p, n so far, sent as a representative

    def rows(out):
        return pa.RecordBatch.from_arrays([pa.array(out[0], pa.bool_()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.binary()), pa.array(out[3], pa.int32())], names=["whole", "h", "k", "p"])

    for batch in batches:
        if not batch.num_rows:
            continue
        h, s, c, p, n = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1, 2, 4, 5))
        keys = batch.column(3)
        # rows whose rank is met once only, in the inside of the batch, need no look
        lone = np.ones(len(h), bool)
        same = (h[1:] == h[:-1]) & (s[1:] == s[:-1])
        lone[1:] &= ~same
        lone[:-1] &= ~same
        lone &= (n == 1) & (s == 0)
        lone[[0, -1]] = False
        settled = s >= SETTLED
        lone |= settled
        at = np.flatnonzero(settled)
        out: tuple[list, ...] = ([True] * len(at), h[at].tolist(), keys.take(pa.array(at)).to_pylist(), p[at].tolist())

        def put(whole, hh, kk, pp, out=out):
            if pp >= 0:  # not a mark
                for o, v in zip(out, (whole, hh, kk, pp), strict=True):
                    o.append(v)

        for i in np.flatnonzero(~lone):
            g, cc, kk, pp, nn = (int(h[i]), int(s[i])), int(c[i]), keys[int(i)].as_py(), int(p[i]), int(n[i])
            if last is not None and last[0] == g and last[1] == cc:
                if last[4] == 1:
                    put(True, g[0], last[2], last[3])
                put(True, g[0], kk, pp)
                last[4] += nn
                continue
            several = g[1] > 0
            if last is not None and last[0] == g:
                if not last[5]:
                    put(False, g[0], last[2], last[3])
                several = True
            if several:
                put(False, g[0], kk, pp)
            if nn > 1:
                put(True, g[0], kk, pp)
            last = [g, cc, kk, pp, nn, several]
        yield rows(out)


CONTEXTS = "g long, d long, k binary, p int, s int, ctx binary"


def _parts(length: int) -> list[tuple[int, int]]:
    """The offsets of the windows around a position, in PARTS runs (first, after last)."""
    n = length - GRAM + 1
    w = -(-n // PARTS)
    return [(a, min(a + w, n)) for a in range(0, n, w)]


def _contexts(length: int):
    """Per text and its undecided positions, by mode: the bytes around each; for a hot rank, the bytes of each run of
    windows, ranked anew by what all of the run's windows share; for a hot run (`part`), a digest of each window."""
    before, span = length - GRAM, 2 * length - GRAM
    parts = _parts(length)

    def rank(x: np.ndarray) -> np.uint64:
        return double(BYTE_RANK[x], 1, len(x))[0]

    def emit(batches):
        for batch in batches:
            data, off = flat(batch.column(1))
            cols: tuple[list, ...] = ([], [], [], [], [], [])

            def put(*row):
                for o, v in zip(cols, row, strict=True):  # noqa: B023
                    o.append(v)

            for r in range(batch.num_rows):
                key = batch.column(0)[r].as_py()
                text = np.full(off[r + 1] - off[r] + 2 * length, PAD, np.uint8)
                text[length:-length] = data[off[r] : off[r + 1]]
                for x in batch.column(2)[r].as_py():
                    ctx = text[x["p"] + length - before :][:span]
                    if x["part"] >= 0:
                        lo, hi = parts[x["part"]]
                        own = ctx[lo : hi - 1 + length]
                        d = double(BYTE_RANK[own], 1, length)
                        e = mix(d ^ np.arange(lo, hi, dtype=np.uint64))
                        ok = (own[: len(d)] != PAD) & (own[length - 1 :] != PAD)
                        for s in np.flatnonzero(ok):
                            put(int(d[s].view(np.int64)), int(e[s].view(np.int64)), key, x["p"], PARTS + lo + int(s), None)
                    elif x["hot"]:
                        for i, (lo, hi) in enumerate(parts):
                            shared, own = ctx[hi - 1 : lo + length], ctx[lo : hi - 1 + length]
                            if shared[0] != PAD and shared[-1] != PAD:
                                put(int(mix(np.array([rank(shared) ^ np.uint64(i)]))[0].view(np.int64)), int(rank(own).view(np.int64)), key, x["p"], i, own.tobytes())
                    else:
                        put(x["h"], 0, key, x["p"], -1, ctx.tobytes())
                if len(cols[0]) > 20_000:
                    yield _context_rows(cols)
                    cols = ([], [], [], [], [], [])
            yield _context_rows(cols)

    return emit


def _context_rows(cols) -> pa.RecordBatch:
    types = (pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.int32(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(cols, types, strict=True)], names=["g", "d", "k", "p", "s", "ctx"])


FOUND = "k binary, lo int, hi int, part int"


def _solve(length: int, limit: int):
    """Sorted by (g, d): which windows around undecided positions occur twice. A position's share is one interval.

    A run's group with more than `limit` different rows comes back undecided: lo is the position, part the run.
    """
    before = length - GRAM
    parts = _parts(length)

    def local(rows: list, found) -> None:
        by_size: dict[int, list] = {}
        for r in rows:
            by_size.setdefault(len(r[5]), []).append(r)
        for same in by_size.values():
            ctx = np.frombuffer(b"".join(r[5] for r in same), np.uint8).reshape(len(same), -1)
            d = np.concatenate([double(BYTE_RANK[ctx[i : i + ROWS]], 1, length, axis=1) for i in range(0, len(ctx), ROWS)])
            d = pair(d, np.array([r[0] for r in same], np.int64).view(np.uint64)[:, None])
            # by offset too: a periodic text has one window around several positions, which is not a repetition
            d = pair(d, np.arange(d.shape[1], dtype=np.uint64)[None, :])
            ok = (ctx[:, : d.shape[1]] != PAD) & (ctx[:, length - 1 :] != PAD)
            _, inverse, count = np.unique(d[ok], return_inverse=True, return_counts=True)
            twice = np.zeros(d.shape, bool)
            twice[ok] = count[inverse] > 1
            first, last = twice.argmax(axis=1), d.shape[1] - 1 - twice[:, ::-1].argmax(axis=1)
            for i in np.flatnonzero(twice.any(axis=1)):
                at = same[i][3] - before + (parts[same[i][4]][0] if same[i][4] >= 0 else 0)
                found(same[i][2], at + int(first[i]), at + int(last[i]) + length)

    def whole(row, found) -> None:
        """All windows of a run that lie inside the text."""
        inside = np.flatnonzero(np.frombuffer(row[5], np.uint8) != PAD)
        at = row[3] - before + parts[row[4]][0]
        found(row[2], at + int(inside[0]), at + int(inside[-1]) + 1)

    def solve(batches):
        held: list = []  # whole groups of contexts, and the one that is not yet complete
        begin, over = 0, False  # of the current group in held; whether it is past the limit
        now = last = None  # group; the last row of a run, or of window digests

        for batch in batches:
            cols: tuple[list, ...] = ([], [], [], [])

            def found(k, lo, hi, part=-1, cols=cols):
                for o, v in zip(cols, (k, lo, hi, part), strict=True):
                    o.append(v)

            for row in zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True):
                g, d, k, p, s, _ = row
                if s >= PARTS:
                    if last and last[:2] == (g, d):
                        for _, _, kk, pp, ss, _ in ([] if over else [last]) + [row]:
                            at = pp - before + ss - PARTS
                            found(kk, at, at + length)
                        over = True
                    else:
                        over = False
                    last = row
                    continue
                if g != now:
                    if len(held) >= ROWS:
                        local(held, found)
                        held = []
                    now, begin, over, last = g, len(held), False, None
                if s >= 0:
                    if last and last[1] == d:
                        for x in ([last] if last[4] >= 0 else []) + [row]:
                            whole(x, found)
                        last = (g, d, None, 0, -1, None)  # its first row has been told
                        continue
                    last = row
                if over:
                    found(k, p, 0, s)
                    continue
                held.append(row)
                if s >= 0 and len(held) - begin > limit:
                    for x in held[begin:]:
                        found(x[2], x[3], 0, x[4])
                    held, over = held[:begin], True
            if cols[0]:
                yield rows(cols)
        if held:
            cols = ([], [], [], [])
            local(held, lambda *row: [o.append(v) for o, v in zip(cols, (*row, -1), strict=True)])
            yield rows(cols)

    def rows(cols):
        return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(cols, (pa.binary(), pa.int32(), pa.int32(), pa.int32()), strict=True)], names=["k", "lo", "hi", "part"])

    return solve


RESULT = "k binary, n_removed long, n_spans long, kept_sha256 string, kept binary, spans array<struct<lo:int,hi:int>>"


def _finish(length: int, texts: bool):
    def finish(batches):
        for batch in batches:
            data, off = flat(batch.column(1))
            cols: tuple[list, ...] = ([], [], [], [], [], [])
            for r, (k, n, found) in enumerate(zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)):
                text = data[off[r] : off[r + 1]].tobytes()
                merged: list[list[int]] = []
                if n > 1 and len(text) >= length:
                    merged = [[0, len(text)]]
                else:
                    for x in sorted((max(0, x["lo"]), min(len(text), x["hi"])) for x in found or []):
                        if merged and x[0] <= merged[-1][1]:
                            merged[-1][1] = max(merged[-1][1], x[1])
                        else:
                            merged.append(list(x))
                at, parts = 0, []
                for lo, hi in merged:
                    parts.append(text[at:lo])
                    at = hi
                kept = b"".join([*parts, text[at:]])
                row = (k, len(text) - len(kept), len(merged), hashlib.sha256(kept).hexdigest(), kept if texts else None, [{"lo": lo, "hi": hi} for lo, hi in merged])
                for o, v in zip(cols, row, strict=True):
                    o.append(v)
            types = (pa.binary(), pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.list_(pa.struct([("lo", pa.int32()), ("hi", pa.int32())])))
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(cols, types, strict=True)], names=["k", "n_removed", "n_spans", "kept_sha256", "kept", "spans"])

    return finish


#: Keys of 16 bytes up to which texts are picked by a broadcast, counted first; more are joined by a shuffle.
BROADCAST_KEYS = 1_000_000


def _small(keys: DataFrame) -> DataFrame:
    """Distinct keys k, to be broadcast if they are counted to be few."""
    found = cut(keys.select("k").distinct())
    return F.broadcast(found) if found.count() <= BROADCAST_KEYS else found


def _touched(docs: DataFrame, length: int, text: str, local_group: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(texts long enough, as k and t; touched texts, as k, n copies and found spans; their keys)."""
    if length < 2 * GRAM:
        raise ValueError(f"length must be at least {2 * GRAM}")
    source = docs.select(text_key(F.col(text)).alias("k"), F.col(text).alias("t")).where(F.octet_length("t") >= length)
    n = partitions(docs)
    pairs = source.mapInArrow(handing_back(_scan(length)), POSITIONS).repartition(n, "h", "s").sortWithinPartitions("h", "s", "c")
    decided = cut(pairs.mapInArrow(_decide, DECIDED))
    whole = decided.where("whole").select("k", (F.col("p") - (length - GRAM)).alias("lo"), (F.col("p") + length).alias("hi"))
    open_ = decided.where("not whole").select("h", "k", "p")
    hot = cut(open_.groupBy("h").count().where(F.col("count") > local_group).select("h", F.lit(True).alias("hot")))
    asked = open_.join(F.broadcast(hot) if hot.count() <= BROADCAST_KEYS else hot, "h", "left").select("k", F.struct("h", "p", F.coalesce("hot", F.lit(False)).alias("hot"), F.lit(-1).alias("part")).alias("x"))

    def solved(asked: DataFrame) -> DataFrame:
        listed = asked.groupBy("k").agg(F.collect_list("x").alias("asked"))
        texts = source.join(_small(asked), "k", "left_semi").groupBy("k").agg(F.first("t").alias("t"))
        windows = texts.join(listed, "k").select("k", "t", "asked").mapInArrow(handing_back(_contexts(length)), CONTEXTS)
        return windows.repartition(n, "g").sortWithinPartitions("g", "d").mapInArrow(handing_back(_solve(length, local_group)), FOUND)

    edges = cut(solved(asked))
    near = edges.where("part < 0")
    hot_runs = edges.where("part >= 0").select("k", F.struct(F.lit(0).cast("long").alias("h"), F.col("lo").alias("p"), F.lit(True).alias("hot"), "part").alias("x"))
    if not hot_runs.isEmpty():
        near = near.union(solved(hot_runs))
    near = near.groupBy("k", "lo").agg(F.max("hi").alias("hi")).select("k", "lo", "hi")
    spans = whole.union(near).distinct().groupBy("k").agg(F.collect_list(F.struct("lo", "hi")).alias("found"))
    copies = source.groupBy("k").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    touched = cut(copies.join(spans, "k", "full").select("k", F.coalesce("n", F.lit(1)).alias("n"), "found"))
    return source, touched, _small(touched)


def _finished(source: DataFrame, touched: DataFrame, keys: DataFrame, length: int, texts: bool) -> DataFrame:
    own = source.join(keys, "k", "left_semi").groupBy("k").agg(F.first("t").alias("t"))
    return own.join(touched, "k").select("k", "t", "n", "found").mapInArrow(handing_back(_finish(length, texts)), RESULT)


def repeated_spans(docs: DataFrame, length: int = 200, texts: bool = False, text: str = "text", local_group: int = LOCAL_GROUP) -> DataFrame:
    """Per distinct text that loses bytes: k (its 16-byte key), n_removed, n_spans, kept_sha256, spans and, if texts, kept.

    length: bytes of a string that must not occur twice, from 2 * 32 up. Texts without a part in it are not shuffled.
    """
    return _finished(*_touched(docs, length, text, local_group), length, texts)


def dedup_report(docs: DataFrame, length: int = 200) -> DataFrame:
    """One row for every row of docs: doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    body = F.coalesce(F.col("text"), F.lit(""))
    own = docs.select("doc_id", text_key(F.col("text")).alias("k"), F.octet_length(body).cast("long").alias("n_bytes"), F.sha2(body, 256).alias("own"))
    found = repeated_spans(docs, length).select("k", "n_removed", "n_spans", "kept_sha256")
    return own.join(found, "k", "left").select(
        "doc_id", "n_bytes", F.coalesce("n_removed", F.lit(0).cast("long")).alias("n_removed"), F.coalesce("n_spans", F.lit(0).cast("long")).alias("n_spans"), F.coalesce("kept_sha256", "own").alias("kept_sha256")
    )


def _texts(batches):
    for batch in batches:
        kept = [v.decode("utf-8", "ignore") for v in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(kept, pa.string())], names=["__k", "__kept"])


def without_repeats(docs: DataFrame, length: int = 200) -> DataFrame:
    """docs with repeated strings cut out of text, n_chars (if there) set anew.

    A character that a cut leaves in part goes too; a document of which nothing but white space is left goes. Documents
    that lose nothing are passed on next to the scan.
    """
    source, touched, keys = _touched(docs, length, "text", LOCAL_GROUP)
    found = _finished(source, touched, keys, length, True).select("k", "kept").mapInArrow(_texts, "__k binary, __kept string")
    keyed = docs.withColumn("__k", text_key(F.col("text")))
    named = keys.withColumnRenamed("k", "__k")
    joined = keyed.join(named, "__k", "left_semi").join(found, "__k").where(F.col("__kept").rlike(r"[^\x20\x09-\x0D]"))
    new = {"text": F.col("__kept")} | ({"n_chars": F.length("__kept").cast(docs.schema["n_chars"].dataType)} if "n_chars" in docs.columns else {})
    return keyed.join(named, "__k", "left_anti").select(*docs.columns).union(joined.withColumns(new).select(*docs.columns))
