"""Operator 7: language-model scoring by cross-entropy difference.

Two interpolated bigram models share one vocabulary, the words of the corpus: the target, over documents that `target`
marks, and the background, over all documents. A document's score is its mean loss per token under the target less that
under the background; lower is closer to the target. A word's probability is

    weight * c(before, word) / c(before, any word) + (1 - weight) * base(word),    or base(word) where `before` was never followed

with base = (c(word) + 1) / (N + V + 1) for the V words that the corpus has twice or more; words met once share
(their tokens + 1) / (N + V + 1) in equal parts, one more part being left for a word never met. Both models thus sum to 1
over all words. Target documents are scored on counts that hold their own words too (nothing is left out).

Documents are dealt to batches of a bounded size. A batch sends each of its distinct n-grams once, as sorted 48-bit
digests packed by hash range, to the range's bucket, which sums them over the corpus and gives the sums back in the same
order. Hot n-grams are thus summed before the shuffle, no table of n-grams is gathered or broadcast, and ranges that a
batch has nothing in are not sent, so what is exchanged is at most one row for each distinct n-gram of a batch and grows
with the text. Nothing is pruned. Two n-grams share a digest with a chance of 1 in 7e13 for each pair.
Null and empty texts have no tokens and null losses. Repeated rows are counted as often as they come and score alike.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import IS_SPACE, LOWER, flat, mix, pair, partitions, slices, span_digests, word_spans

START = np.uint64(0x5851F42D4C957F2D)
SPAN = 1 << 48
WORD, PAIR, BEFORE = np.uint64(0), np.uint64(1), np.uint64(2)


def _key(digest: np.ndarray, kind: np.uint64) -> np.ndarray:
    """48 bits, the last two of which tell the kind of the n-gram."""
    return (digest >> np.uint64(16)) & ~np.uint64(3) | kind


def _words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(digest, document) of each token."""
    data = LOWER[data]
    starts, ends, doc = word_spans(data, offsets, IS_SPACE)
    return span_digests(data, starts, ends), doc


class Batch:
    """The n-grams of some texts: distinct keys in order, and for each token the places of its three n-grams in them."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        found, docs = [], []
        for i, j in slices(offsets, 1 << 20):
            w, d = _words(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
            found.append(w)
            docs.append((d + i).astype(np.int32))
        w = np.concatenate(found) if found else np.zeros(0, np.uint64)
        self.doc = np.concatenate(docs) if docs else np.zeros(0, np.int32)
        first = np.ones(len(w), bool)
        first[1:] = self.doc[1:] != self.doc[:-1]
        before = np.empty_like(w)
        before[1:] = w[:-1]
        before[first] = START
        pairs, self.pair = np.unique(_key(pair(before, w), PAIR), return_inverse=True)
        del before
        words, at = np.unique(w, return_inverse=True)
        del w
        words = np.append(words, START)
        last = np.empty_like(at)
        last[1:] = at[:-1]
        last[first] = len(words) - 1
        keys = np.concatenate([_key(mix(words[:-1].copy()), WORD), pairs, _key(mix(words ^ START), BEFORE)])
        self.keys, place = np.unique(keys, return_inverse=True)
        place = place.astype(np.int32)
        self.word = place[at]
        self.pair = place[len(words) - 1 + self.pair]
        self.before = place[len(words) - 1 + len(pairs) + last]

    def counts(self, chosen: np.ndarray | slice = slice(None)) -> np.ndarray:
        return sum(np.bincount(x[chosen], minlength=len(self.keys)) for x in (self.word, self.pair, self.before)).astype(np.int64)


def _pack(x: np.ndarray) -> bytes:
    """Numbers as planes of bytes, as many as the largest asks for; the high planes are mostly zero and compress well."""
    width = max(1, (int(x.max(initial=0)).bit_length() + 7) // 8)
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()


def _unpack(blob: bytes, n: int) -> np.ndarray:
    out = np.zeros((n, 8), np.uint8)
    if n:
        planes = np.frombuffer(blob, np.uint8).reshape(-1, n)
        out[:, : len(planes)] = planes.T
    return out.reshape(-1).view("<u8").astype(np.int64)


def _lows(buckets: int) -> np.ndarray:
    return np.array([-(-SPAN * k // buckets) for k in range(buckets + 1)], np.uint64)


COUNTED = "b int, bucket int, n int, grams binary, every binary, aimed binary"
SUMMED = "b int, bucket int, n int, every binary, aimed binary"
_BIN, _INT = pa.binary(), pa.int32()


def _count(buckets: int):
    def count(table: pa.Table) -> pa.Table:
        batch = Batch(*flat(table.column("t")))
        target = table.column("target").to_numpy().astype(bool)
        every, aimed = batch.counts(), batch.counts(target[batch.doc])
        lows = _lows(buckets)
        at = np.searchsorted(batch.keys, lows)
        rows = [
            (k, j - i, _pack(np.diff(batch.keys[i:j], prepend=lows[k])), _pack(every[i:j]), _pack(aimed[i:j]))
            for k, i, j in ((k, int(at[k]), int(at[k + 1])) for k in np.flatnonzero(at[1:] > at[:-1]).tolist())
        ]
        b = pa.array([table.column("b")[0].as_py()] * len(rows), _INT)
        columns = [pa.array([r[c] for r in rows], t) for c, t in enumerate((_INT, _INT, _BIN, _BIN, _BIN))]
        return pa.table([b, *columns], names=["b", "bucket", "n", "grams", "every", "aimed"])

    return count


def _sum(buckets: int):
    def summed(table: pa.Table) -> pa.Table:
        n, bucket = table.column("n").to_pylist(), table.column("bucket")[0].as_py()
        low = -(-SPAN * bucket // buckets)
        keys = np.concatenate([low + np.cumsum(_unpack(x.as_py(), k)) for x, k in zip(table.column("grams"), n, strict=True)])
        keys, place = np.unique(keys, return_inverse=True)
        ends = np.cumsum([0, *n])
        out = []
        for c in ("every", "aimed"):
            total = np.zeros(len(keys), np.int64)
            for x, k, i, j in zip(table.column(c), n, ends, ends[1:], strict=False):
                total[place[i:j]] += _unpack(x.as_py(), k)  # a batch has each key once
            out.append(pa.array([_pack(total[place[i:j]]) for i, j in zip(ends, ends[1:], strict=False)], _BIN))
        return pa.table([table.column("b"), table.column("bucket"), table.column("n"), *out], names=["b", "bucket", "n", "every", "aimed"])

    return summed


def _score(weight: float, facts: dict[str, int]):
    def score(table: pa.Table, sums: pa.Table) -> pa.Table:
        data, off = flat(table.column("t"))
        batch = Batch(data, off)
        order = np.argsort(sums.column("bucket").to_numpy()).tolist()
        n = sums.column("n").to_pylist()
        size = np.bincount(batch.doc, minlength=len(off) - 1)
        some = size > 0
        every = _gather(sums.column("every"), n, order)
        once = every[batch.word] < 2
        means = []
        for counts, kind in ((_gather(sums.column("aimed"), n, order), "aimed"), (every, "every")):
            base = np.where(once, (facts[f"{kind}_once"] + 1) / (facts["once"] + 1), counts[batch.word] + 1) / (facts[kind] + facts["known"] + 1)
            before = counts[batch.before]
            p = np.where(before > 0, weight * counts[batch.pair] / np.maximum(before, 1) + (1 - weight) * base, base)
            means.append(np.where(some, np.bincount(batch.doc, -np.log(p), len(off) - 1) / np.maximum(size, 1), 0.0))
        put = lambda x: pa.array(x, pa.float64(), mask=~some)
        return pa.table(
            [table.column("doc_id"), pa.array(size.astype(np.int64)), table.column("target"), put(means[0]), put(means[1]), put(means[0] - means[1])],
            names=["doc_id", "n_tokens", "in_target", "loss_target", "loss_background", "score"],
        )

    return score


def _gather(column: pa.ChunkedArray, n: list[int], order: list[int]) -> np.ndarray:
    return np.concatenate([_unpack(column[k].as_py(), n[k]) for k in order]) if order else np.zeros(0, np.int64)


def _tally(batches):
    """(word, tokens, tokens in the target) of some texts at a time."""
    for batch in batches:
        data, off = flat(batch.column(0))
        target = batch.column(1).to_numpy(zero_copy_only=False).astype(bool)
        for i, j in slices(off, 8 << 20):
            w, doc = _words(data[off[i] : off[j]], off[i : j + 1] - off[i])
            words, place = np.unique(w, return_inverse=True)
            every, aimed = np.bincount(place, minlength=len(words)), np.bincount(place[target[i:j][doc]], minlength=len(words))
            yield pa.RecordBatch.from_arrays([pa.array(words.view(np.int64)), pa.array(every.astype(np.int64)), pa.array(aimed.astype(np.int64))], names=["w", "every", "aimed"])


def vocabulary(source: DataFrame) -> dict[str, int]:
    """Of the texts t with their mark target: tokens of all words and of those met once, in all and in the target; numbers of words."""
    words = source.select("t", "target").mapInArrow(_tally, "w long, every long, aimed long").groupBy("w").agg(F.sum("every").alias("every"), F.sum("aimed").alias("aimed"))
    once = F.col("every") < 2
    row = words.agg(
        F.sum("every").alias("every"), F.sum("aimed").alias("aimed"), F.sum(F.when(once, F.col("every"))).alias("every_once"), F.sum(F.when(once, F.col("aimed"))).alias("aimed_once"),
        F.count(F.when(~once, 1)).alias("known"), F.count(F.when(once, 1)).alias("once"),
    ).first()
    return {k: v or 0 for k, v in row.asDict().items()}


def cross_entropy_difference(docs: DataFrame, target: Column, batch_bytes: int = 4 << 20, weight: float = 0.5, text: str = "text", key: str = "doc_id") -> DataFrame:
    """doc_id, n_tokens, in_target, loss_target, loss_background (nats a token) and score for each row of docs.

    target: a boolean column of docs, null is false. batch_bytes: text of a batch. weight: of pairs against words.
    """
    source = docs.select(F.col(key).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("t"), F.coalesce(target, F.lit(False)).alias("target"))
    total = docs.agg(F.sum(F.octet_length(F.col(text)).cast("long"))).first()[0] or 0
    facts = vocabulary(source)
    n = max(1, -(-total // batch_bytes))
    buckets = partitions(docs, total, 8 << 20)
    dealt = source.withColumn("b", F.pmod(F.xxhash64("doc_id", "t"), F.lit(n)).cast("int")).repartition(partitions(docs, total), "b")
    counted = dealt.groupBy("b").applyInArrow(_count(buckets), COUNTED)
    sums = counted.groupBy("bucket").applyInArrow(_sum(buckets), SUMMED)
    kind = source.schema["doc_id"].dataType.simpleString()
    return dealt.groupBy("b").cogroup(sums.groupBy("b")).applyInArrow(_score(weight, facts), f"doc_id {kind}, n_tokens long, in_target boolean, loss_target double, loss_background double, score double")
