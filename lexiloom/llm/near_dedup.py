"""Operator 9: near-duplicate documents by a multi-index Hamming join over MinHash signatures.

A signature has SYMBOLS minima of 16 bits. Two signatures that differ in at most DISTANCE symbols have, among CHUNKS
chunks, one with at most DISTANCE // CHUNKS = 1 differing symbol; a document is therefore filed under each chunk with
each one of its symbols left out, and all pairs under the signature distance meet. Found pairs are confirmed on the
full shingle sets. At a similarity of 0.8 a pair differs in 12.8 of 64 symbols on average and in more than DISTANCE once
in about 12 million cases (binomial tail 8.2e-8), at a higher similarity far more rarely; that is the only loss.

A shingle is its 64-bit digest, a set the 128-bit digest of its sorted shingles.

Documents with the same set are one class from the start. Each file (one key) gives a spanning forest of its classes
that are close, large files in blocks, so the close pairs' components are exact without all pairs being made. The full
sets of a component's classes then meet once, large components in blocks, and give a spanning forest of the true links.
No pair under the signature distance is left out, and groups of copies never become all pairs.
Null and empty texts, and texts without words, have empty sets and are linked with nothing. A row whose id is null is in
the component of its smallest other id, or of null; it is kept in the latter case only. Rows that repeat id and text are
kept or not together. A very long text is one row of its task. Columns of other names are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import IS_SPACE, LOWER, cut, flat, handing_back, mix, pair, slices, span_digests, text_key, word_spans

SYMBOLS, CHUNKS, DISTANCE = 64, 16, 31
_SEEDS = np.random.default_rng(77).integers(1, 2**63, SYMBOLS, dtype=np.uint64) | np.uint64(1)

#: Classes, and shingles, of a file or component that a task holds at once; larger ones are dealt to pairs of blocks.
BLOCK, BLOCK_SHINGLES = 1024, 1 << 20
#: Rows of at most 40 bytes up to which classes asked for and large groups are broadcast; more are joined by a shuffle.
BROADCAST_ROWS = 500_000


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int) -> list[np.ndarray]:
    """Per text its distinct shingles of k words as sorted digests; fewer words are one shingle."""
    data = LOWER[data]
    starts, ends, doc = word_spans(data, offsets, IS_SPACE)
    w = span_digests(data, starts, ends)
    at = np.searchsorted(doc, np.arange(len(offsets)))
    full = w
    for _ in range(k - 1):
        full = pair(full[:-1], w[len(w) - len(full) + 1 :]) if len(full) else full
    out = []
    for lo, hi in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        if hi - lo >= k:
            out.append(np.unique(full[lo : hi - k + 1]))
        elif hi > lo:
            x = np.uint64(hi - lo)
            for v in w[lo:hi]:
                x = pair(np.array([x]), np.array([v]))[0]
            out.append(np.array([x], np.uint64))
        else:
            out.append(w[:0])
    return out


def signature(s: np.ndarray) -> np.ndarray:
    low = np.full(SYMBOLS, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(s), 8192):
        x = s[i : i + 8192, None] * _SEEDS
        x ^= x >> np.uint64(32)
        x *= np.uint64(0xC2B2AE3D27D4EB4F)
        np.minimum(low, x.min(axis=0), out=low)
    return ((low * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(48)).astype(np.uint16)


def _sign(k: int):
    def sign(batches):
        for batch in batches:
            data, off = flat(batch.column(2))
            keys = batch.column(1).to_pylist()
            n, cls, sig = [], [], []
            seen: dict[bytes, tuple] = {}
            for i, j in slices(off):
                for r, s in zip(range(i, j), shingle_sets(data[off[i] : off[j]], off[i : j + 1] - off[i], k), strict=True):
                    found = seen.get(keys[r])
                    if found is None:
                        name = hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None
                        found = seen[keys[r]] = (len(s), name, signature(s).tobytes() if len(s) else None)
                    n.append(found[0])
                    cls.append(found[1])
                    sig.append(found[2])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(cls, pa.binary()), pa.array(sig, pa.binary())], names=["doc_id", "k", "n", "cls", "sig"])

    return sign


def _file(batches):
    """Every key of each class: chunk, place of the symbol left out, the other symbols."""
    per = SYMBOLS // CHUNKS
    for batch in batches:
        if not batch.num_rows:
            continue
        sig = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint16).reshape(-1, CHUNKS, per).astype(np.uint64)
        keys = np.empty((len(sig), CHUNKS, per), np.uint64)
        for out in range(per):
            x = np.broadcast_to(np.arange(CHUNKS, dtype=np.uint64) * np.uint64(per) + np.uint64(out), sig.shape[:2])
            for m in range(per):
                if m != out:
                    x = pair(mix(x), sig[:, :, m])
            keys[:, :, out] = x
        yield pa.RecordBatch.from_arrays([pa.array(keys.reshape(-1).view(np.int64)), pa.array(np.repeat(batch.column(0).to_numpy(), CHUNKS * per))], names=["key", "id"])


class _Forest:
    """Union-find that keeps the pairs which joined something."""

    def __init__(self, n: int):
        self.root = np.arange(n)
        self.pairs: list[tuple[int, int]] = []

    def join(self, i: int, others: np.ndarray) -> None:
        for j in others.tolist():
            x, y = self.root[i], self.root[j]
            if x != y:
                self.root[self.root == y] = x
                self.pairs.append((i, j))


def _partners(i: int, p: int, q: int, salt: np.ndarray, root: np.ndarray) -> np.ndarray:
    """Rows that row i is to be held against: later ones, in a pair of blocks those of the other, in another tree."""
    if p == q:
        others = np.arange(i + 1, len(salt))
    elif salt[i] == p:
        others = np.flatnonzero(salt == q)
    else:
        return np.zeros(0, np.int64)
    return others[root[others] != root[i]]


def _close_pairs(percent: int):
    def solve(p: int, q: int, rows: list) -> list[tuple[int, int]]:
        n, salt = np.array([r[2] for r in rows]), np.array([r[3] for r in rows])
        sig = np.frombuffer(b"".join(r[1] for r in rows), np.uint16).reshape(-1, SYMBOLS)
        forest = _Forest(len(rows))
        for i in range(len(rows)):
            others = _partners(i, p, q, salt, forest.root)
            near = ((sig[others] != sig[i]).sum(axis=1) <= DISTANCE) & (100 * np.minimum(n[others], n[i]) >= percent * np.maximum(n[others], n[i]))
            forest.join(i, others[near])
        return forest.pairs

    return _by_group(solve)


def _true_pairs(percent: int):
    def solve(p: int, q: int, rows: list) -> list[tuple[int, int]]:
        sets, salt = [np.frombuffer(r[1], np.uint64) for r in rows], np.array([r[3] for r in rows])
        n = np.array([len(x) for x in sets])
        forest = _Forest(len(rows))
        if len(rows) == 2:
            both = len(np.intersect1d(*sets, assume_unique=True))
            forest.join(0, np.array([1] if 100 * both >= percent * (n.sum() - both) else [], np.int64))
            return forest.pairs
        owner = np.repeat(np.arange(len(rows)), n)
        _, number = np.unique(np.concatenate(sets), return_inverse=True)
        order = np.argsort(number, kind="stable")
        holders, first = owner[order], np.searchsorted(number[order], np.arange(number.max(initial=-1) + 2))
        begin = np.concatenate([[0], np.cumsum(n)])
        for i in range(len(rows)):
            others = _partners(i, p, q, salt, forest.root)
            if not len(others):
                continue
            own = number[begin[i] : begin[i + 1]]
            size = first[own + 1] - first[own]
            at = np.repeat(first[own] - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
            both = np.bincount(holders[at], minlength=len(rows))[others]
            forest.join(i, others[100 * both >= percent * (n[others] + n[i] - both)])
        return forest.pairs

    return _by_group(solve)


def _by_group(solve):
    """Rows (g, p, q, id, x, n, salt), sorted by the first four, to pairs of ids: a forest of each group's pairs."""

    def pairs(held: list, g: tuple) -> tuple[list, list]:
        found = solve(g[1], g[2], held)
        return [held[i][0] for i, _ in found], [held[j][0] for _, j in found]

    def run(batches):
        held: list = []
        now = None
        for batch in batches:
            out: tuple[list, list] = ([], [])
            for g, p, q, *rest in zip(*(batch.column(i).to_pylist() for i in range(7)), strict=True):
                if now != (g, p, q):
                    if len(held) > 1:
                        for o, v in zip(out, pairs(held, now), strict=True):
                            o.extend(v)
                    held, now = [], (g, p, q)
                held.append(rest)
            yield pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in out], names=["a", "b"])
        if len(held) > 1:
            yield pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in pairs(held, now)], names=["a", "b"])

    return run


def _in_blocks(rows: DataFrame, sizes: DataFrame, n: int) -> DataFrame:
    """rows (g, id, x, n) once for each pair of blocks of their group that they are in (sizes: g, blocks; others have one).

    A large group meets in no task: its rows learn their number of blocks from a broadcast before they are dealt. Rows of
    a block come in the order of their ids, so that a task that runs again finds the same forest.
    """
    large = cut(sizes.where("blocks > 1").select("g", "blocks"))
    looked = F.broadcast(large) if large.count() <= BROADCAST_ROWS else large
    known = rows.join(looked, "g", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    dealt = known.withColumn("salt", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("g", F.least("salt", "other").alias("p"), F.greatest("salt", "other").alias("q"), "id", "x", "n", "salt")
    return dealt.repartition(n, "g", "p", "q").sortWithinPartitions("g", "p", "q", "id")


def _sets(k: int):
    def sets(batches):
        for batch in batches:
            data, off = flat(batch.column(1))
            found = []
            for i, j in slices(off):
                found += [s.tobytes() for s in shingle_sets(data[off[i] : off[j]], off[i : j + 1] - off[i], k)]
            yield pa.RecordBatch.from_arrays([batch.column(2), batch.column(0), pa.array(found, pa.binary()), batch.column(3)], names=["g", "id", "x", "n"])

    return sets


def components(links: DataFrame) -> DataFrame:
    """(id, comp): comp is one of the ids reachable over links (a, b), the same for all of them.

    Each round every id moves to the neighbour whose hash is smallest, its own included, and on to where that one moves;
    links are then drawn between the places moved to. A round leaves at most half of the ids, so all rounds together
    read and write a small multiple of the links. The rounds' moves are joined at the end, the last and smallest first.
    """
    both = F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))  # a union would compute links twice
    edges = cut(links.where("a <> b").select(F.inline(both)).distinct())
    moves: list[DataFrame] = []
    place = lambda c: F.struct(F.xxhash64(c).alias("h"), F.col(c).alias("id"))
    while not edges.isEmpty():
        first = edges.groupBy(F.col("a").alias("id")).agg(F.min(place("b")).alias("m")).select("id", F.least(place("id"), F.col("m"))["id"].alias("to"))
        onward = first.select(F.col("id").alias("to"), F.col("to").alias("next"))
        step = cut(first.join(onward, "to").select("id", F.col("next").alias("to")))
        moves.append(step)
        from_, to = (step.select(F.col("id").alias(c), F.col("to").alias(n)) for c, n in (("a", "x"), ("b", "y")))
        edges = cut(edges.join(from_, "a").join(to, "b").where("x <> y").select(F.col("x").alias("a"), F.col("y").alias("b")).distinct())
    if not moves:
        return links.select(F.col("a").alias("id"), F.col("b").alias("comp")).limit(0)
    found = moves.pop().withColumnRenamed("to", "comp")
    while moves:
        later = found.select(F.col("id").alias("to"), "comp")
        found = moves.pop().join(later, "to", "left").select("id", F.coalesce("comp", "to").alias("comp"))
    return cut(found)


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80, text: str = "text", key: str = "doc_id") -> DataFrame:
    """doc_id, n_shingles, component_id (smallest id reachable) and kept for each row of docs.

    Documents are linked if 100 * intersection >= percent * union of their sets of `shingle` words.
    """
    source = docs.select(F.col(key).alias("doc_id"), text_key(F.col(text)).alias("k"), F.col(text).alias("t"))
    kind = source.schema["doc_id"].dataType.simpleString()
    signed = cut(source.mapInArrow(handing_back(_sign(shingle)), f"doc_id {kind}, k binary, n long, cls binary, sig binary"))
    rep = F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("doc"), F.col("k")))
    grouped = signed.where("cls is not null").groupBy("cls").agg(rep.alias("rep"), F.first("sig").alias("sig"), F.first("n").alias("n"))
    classes = cut(grouped.withColumn("id", F.monotonically_increasing_id()))

    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    filed = classes.select("id", "sig").mapInArrow(_file, "key long, id long")
    blocks = F.ceil(F.greatest(F.count(F.lit(1)) / BLOCK, F.sum("n") / BLOCK_SHINGLES)).cast("int")
    shared = filed.groupBy("key").agg(F.min("id").alias("lo"), F.max("id").alias("hi"), F.count(F.lit(1)).alias("size")).where("lo < hi").select(F.col("key").alias("g"), F.ceil(F.col("size") / BLOCK).cast("int").alias("blocks"))
    members = filed.join(shared.select(F.col("g").alias("key")), "key").join(classes.select("id", F.col("sig").alias("x"), "n"), "id").select(F.col("key").alias("g"), "id", "x", "n")
    close = components(_in_blocks(members, shared, parts).mapInArrow(_close_pairs(percent), "a long, b long").distinct())

    asked = cut(close.join(classes, "id").select("id", "comp", "n", F.col("rep.k").alias("k"), F.col("rep.doc").alias("doc")))
    groups = asked.groupBy(F.col("comp").alias("g")).agg(blocks.alias("blocks"))
    looked = F.broadcast(asked) if asked.count() <= BROADCAST_ROWS else asked
    found = docs.select(text_key(F.col(text)).alias("k"), F.col(key).alias("doc_id"), F.col(text).alias("t")).join(looked, "k").where(F.col("doc_id").eqNullSafe(F.col("doc")))
    sets = found.select("id", "t", "comp", "n").mapInArrow(handing_back(_sets(shingle)), "g long, id long, x binary, n long").dropDuplicates(["id"])
    part = components(_in_blocks(sets, groups, parts).mapInArrow(_true_pairs(percent), "a long, b long").distinct())

    comp = classes.join(part, "id", "left").select("cls", F.col("rep.doc").alias("doc"), F.coalesce("comp", "id").alias("comp"))
    smallest = comp.groupBy("comp").agg(F.min("doc").alias("component_id"))
    named = comp.join(smallest, "comp").select("cls", "component_id")
    return signed.select("doc_id", "n", "cls").join(named, "cls", "left").select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.when(F.col("cls").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
        F.when(F.col("cls").isNull(), F.lit(True)).otherwise(F.col("doc_id").eqNullSafe(F.col("component_id"))).alias("kept"),
    )


def without_near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """docs with one document of each group of near duplicates: that with the smallest id."""
    gone = near_duplicates(docs, shingle, percent).where("not kept").select(F.col("doc_id").alias("__id")).distinct()
    return docs.join(gone, docs["doc_id"].eqNullSafe(gone["__id"]), "left_anti").select(*docs.columns)
