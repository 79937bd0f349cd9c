"""Operator 3: language identification.

Averaged hashed subword embeddings with a linear softmax, trained by stochastic gradient descent in numpy; temperature
and rejection threshold are set on a part of the sample that is kept from training. Averaging and the linear layer
commute, so prediction looks up one row of class scores for each subword.
Subwords are three and four bytes long, of the text with A-Z lower-cased and runs of other ASCII characters as word ends. A text
that is null or has no letter is `und` with score 0.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import flat, slices

BITS = 14
#: Letters lower-cased; bytes of non-ASCII characters as they are; all else one mark.
FOLD = np.full(256, 32, np.uint8)
FOLD[65:91] = np.arange(97, 123)
FOLD[97:123] = np.arange(97, 123)
FOLD[128:] = np.arange(128, 256)


def fold(doc_id: Column) -> Column:
    """0 to 3 by the id; 2 is held out."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))), F.lit(4))


def subwords(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashed subwords, row of each text's first, number in each text); texts without any get the mark's."""
    n = len(offsets) - 1
    size = np.diff(offsets)
    at = offsets[:-1] + 4 * np.arange(n) + 2  # two marks before and after each text
    buf = np.full(len(data) + 4 * n, 32, np.uint8)
    place = np.arange(len(data)) + np.repeat(4 * np.arange(n) + 2, size)
    buf[place] = FOLD[data]
    x = buf.astype(np.uint32)
    tri = x[:-3] | (x[1:-2] << np.uint32(8)) | (x[2:-1] << np.uint32(16))
    middle = (buf[1:-2] != 32) & (buf[:-3] != 32)
    ids = []
    for k, g in ((3, tri), (4, tri | (x[3:] << np.uint32(24)))):
        h = g * np.uint32(2654435761 if k == 3 else 2246822519)
        ids.append((h >> np.uint32(32 - BITS)).astype(np.int32))
    begin, end = at - 1, at + size + 1
    count = np.concatenate([[0], np.cumsum(middle)])
    first, last = count[np.minimum(begin, len(middle))], count[np.minimum(end, len(middle))]
    keep = np.flatnonzero(middle)
    return np.stack([ids[0][keep], ids[1][keep]]), first, last - first


def _average(table: np.ndarray, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(mean of the table's rows over each text's subwords, number of them)."""
    ids, first, count = subwords(data, offsets)
    rows = table[ids[0]] + table[ids[1]]
    total = np.zeros((len(first), table.shape[1]), np.float64)
    some = count > 0
    if some.any():
        total[some] = np.add.reduceat(rows, first[some], axis=0)
    return total / np.maximum(2 * count, 1)[:, None], count


class Model:
    def __init__(self, classes: list[str], scores: np.ndarray, bias: np.ndarray, temperature: float, threshold: float):
        self.classes, self.scores, self.bias, self.temperature, self.threshold = classes, scores, bias, temperature, threshold

    def predict(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(class, calibrated probability) of each text."""
        logits, _ = _average(self.scores, data, offsets)
        z = (logits + self.bias) / self.temperature
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        return p.argmax(axis=1), p.max(axis=1)


def train(texts: list[bytes], labels: list[str], dim: int = 16, epochs: int = 8, rate: float = 2.0, seed: int = 5, precision: float = 0.99) -> Model:
    """Fit on labelled texts; a fifth of them sets temperature and threshold only."""
    classes = sorted(set(labels))
    if not classes:
        return Model(["und"], np.zeros((1 << BITS, 1), np.float32), np.zeros(1), 1.0, 0.0)
    rng = np.random.default_rng(seed)
    y = np.array([classes.index(v) for v in labels])
    bags = []
    for t in texts:
        ids, _, _ = subwords(np.frombuffer(t, np.uint8), np.array([0, len(t)]))
        u, c = np.unique(ids, return_counts=True)
        bags.append((u, (c / max(1, ids.size)).astype(np.float32)))
    E, W, b = rng.normal(0, 0.1, (1 << BITS, dim)).astype(np.float32), np.zeros((dim, len(classes)), np.float32), np.zeros(len(classes), np.float32)
    W += rng.normal(0, 0.1, W.shape)
    order = rng.permutation(len(texts))
    kept, tuned = (order[: -len(order) // 5], order[-len(order) // 5 :]) if len(order) >= 10 else (order, order)
    steps, step = epochs * len(kept), 0
    for _ in range(epochs):
        for i in rng.permutation(kept):
            u, f = bags[i]
            lr = rate * (1 - step / steps)
            step += 1
            h = f @ E[u]
            z = h @ W + b
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y[i]] -= 1
            back = W @ p
            W -= lr * np.outer(h, p)
            b -= 0.05 * lr * p
            E[u] -= (lr * len(u) ** 0.5) * f[:, None] * back[None, :]
    z = np.array([bags[i][1] @ E[bags[i][0]] @ W + b for i in tuned])

    def loss(t: float) -> float:
        q = z / t
        q = q - q.max(axis=1, keepdims=True)
        return float(np.mean(np.log(np.exp(q).sum(axis=1)) - q[np.arange(len(q)), y[tuned]]))

    temperature = min((t for t in np.geomspace(0.1, 10, 41)), key=loss)
    q = z / temperature
    p = np.exp(q - q.max(axis=1, keepdims=True))
    p /= p.sum(axis=1, keepdims=True)
    right, top = p.argmax(axis=1) == y[tuned], p.max(axis=1)
    threshold = next((float(t) for t in np.unique(np.r_[0.0, top]) if right[top >= t].mean() >= precision), 1.0)
    return Model(classes, E @ W, b, float(temperature), threshold)


def sample(docs: DataFrame, per_class: int = 600, text: str = "text", label: str = "lang", key: str = "doc_id") -> tuple[list[bytes], list[str]]:
    """At most about per_class labelled texts of each class, chosen by a hash of the id, none from the held-out fold.

    This bounds what the driver gathers and trains on; a class with fewer texts gives all of them.
    """
    rows = docs.where((fold(F.col(key)) != 2) & F.col(label).isNotNull() & F.col(text).rlike(r"\p{L}"))
    count = {r["y"]: r["n"] for r in docs.where((fold(F.col(key)) != 2) & F.col(label).isNotNull()).groupBy(F.col(label).cast("string").alias("y")).agg(F.count(F.lit(1)).alias("n")).collect()}
    at = F.pmod(F.xxhash64(F.lit(11), F.col(key)), F.lit(1 << 30))
    share = F.lit(False)
    for y, n in count.items():
        share = share | ((F.col(label).cast("string") == y) & (at < int((1 << 30) * min(1.0, per_class / n))))
    found = rows.where(share).select(F.col(text).alias("t"), F.col(label).cast("string").alias("y")).orderBy(F.xxhash64("t", "y")).limit(2 * per_class * max(1, len(count))).collect()
    return [r["t"].encode() for r in found], [r["y"] for r in found]


def identify(docs: DataFrame, model: Model, text: str = "text", key: str = "doc_id") -> DataFrame:
    """doc_id, held_out, lang_pred, score and accepted (score is at least the model's threshold) for each row of docs."""

    def run(batches):
        for batch in batches:
            data, off = flat(batch.column(2))
            lang, score = [], []
            for i, j in slices(off):
                c, p = model.predict(data[off[i] : off[j]], off[i : j + 1] - off[i])
                lang.append(c)
                score.append(p)
            c, p = (np.concatenate(v) if v else np.zeros(0) for v in (lang, score))
            letters = batch.column(3).to_numpy(zero_copy_only=False).astype(bool)
            names = [model.classes[int(k)] if ok else "und" for k, ok in zip(c, letters, strict=True)]
            p = np.where(letters, p, 0.0)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(names, pa.string()), pa.array(p), pa.array(letters & (p >= model.threshold))], names=["doc_id", "held_out", "lang_pred", "score", "accepted"])

    source = docs.select(F.col(key).alias("doc_id"), (fold(F.col(key)) == 2).alias("held_out"), F.col(text).alias("t"), F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False)).alias("letters"))
    kind = source.schema["doc_id"].dataType.simpleString()
    return source.mapInArrow(run, f"doc_id {kind}, held_out boolean, lang_pred string, score double, accepted boolean")
