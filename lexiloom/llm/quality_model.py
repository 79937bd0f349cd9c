"""Operator 5: a quality classifier by attention over passages (multiple-instance learning).

A document is a bag of passages: runs of up to 400 bytes that end at a word's end. A passage is the mean of learned
vectors of its hashed byte trigrams next to shares of character kinds. Gated attention weighs the passages, the
weighted mean is scored by a logistic layer, and only documents have labels. Trained by Adam in numpy.
A score is a function of the text alone: each text is encoded apart, and its sums run in an order of their own, so that
neighbours, slices and repeated rows change no bit of it. Equal texts tie.
Null and empty texts have one empty passage and get the score of that. A doc_id whose labels contradict each other
teaches nothing; labels other than 0 and 1, and null ids, are left out. Columns of other names are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import flat, slices
from .language_id import fold

BITS, DIM, HIDDEN, PASSAGE = 12, 12, 12, 400
#: Kinds of bytes whose shares in a passage are features.
KINDS = np.zeros((256, 6), np.float32)
KINDS[97:123, 0] = 1
KINDS[128:, 0] = 1
KINDS[65:91, 1] = 1
KINDS[48:58, 2] = 1
KINDS[[32, 9, 10, 11, 12, 13], 3] = 1
for _c in b"#*$%&|<>!":
    KINDS[_c, 4] = 1
KINDS[:128, 5] = 1 - KINDS[:128, :5].max(axis=1)
EXTRA = 6 + 2


def passages(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first byte of each passage, document of each): cuts at the first space after every PASSAGE bytes."""
    begin, owner = [], []
    space = np.flatnonzero(data == 32)
    for lo, hi in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        at = np.searchsorted(space, np.arange(lo + PASSAGE, hi - PASSAGE // 4, PASSAGE))
        cuts = np.unique(space[at[at < len(space)]])
        cuts = np.append(lo, cuts[cuts < hi])
        begin.append(cuts)
        owner.append(len(cuts))
    return np.concatenate(begin) if begin else np.zeros(0, int), np.repeat(np.arange(len(offsets) - 1), owner)


def encode(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(trigram bucket of each byte, first byte and document of each passage, other features of each passage)."""
    begin, owner = passages(data, offsets)
    x = np.concatenate([data, np.full(2, 32, np.uint8)]).astype(np.uint32)
    h = x[:-2] | (x[1:-1] << np.uint32(8)) | (x[2:] << np.uint32(16))
    # past a text's end there are spaces
    size = np.diff(offsets)
    for k in (1, 2):
        at = offsets[1:][size >= k] - k
        h[at] = (x[at] | (x[at + 1] << np.uint32(8)) if k == 2 else x[at] | np.uint32(32 << 8)) | np.uint32(32 << 16)
    ids = ((h * np.uint32(2654435761)) >> np.uint32(32 - BITS)).astype(np.int32)
    end = np.append(begin[1:], len(data))
    size = end - begin
    some = size > 0
    kinds = np.zeros((len(begin), EXTRA), np.float32)
    if some.any():
        kinds[some, :6] = np.add.reduceat(KINDS[data], begin[some], axis=0) / size[some, None]
        # how few different trigrams a passage has; a block of passages at a time
        for i in range(0, len(begin), 256):
            j = min(i + 256, len(begin))
            met = np.zeros((j - i, 1 << BITS), bool)
            met[np.repeat(np.arange(j - i), size[i:j]), ids[begin[i] : end[j - 1]]] = True
            kinds[i:j, 6] = met.sum(axis=1) / np.maximum(size[i:j], 1)
    kinds[:, 7] = size == 0
    return ids, begin, owner, kinds


def _times(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The matrix product, each row summed in the same order whatever the others are (a BLAS may not)."""
    out = np.zeros((len(x), y.shape[1]), np.float32)
    for k in range(x.shape[1]):
        out += x[:, k, None] * y[k]
    return out


def _mean(table: np.ndarray, ids: np.ndarray, begin: np.ndarray, n: int) -> np.ndarray:
    size = np.append(begin[1:], n) - begin
    out = np.zeros((len(begin), table.shape[1]), np.float32)
    some = size > 0
    if some.any():
        out[some] = np.add.reduceat(table[ids], begin[some], axis=0) / size[some, None]
    return out


class Model:
    def __init__(self, seed: int = 3):
        r = np.random.default_rng(seed)
        d = DIM + EXTRA
        self.p = {"E": r.normal(0, 0.3, (1 << BITS, DIM)), "V": r.normal(0, 0.3, (d, HIDDEN)), "U": r.normal(0, 0.3, (d, HIDDEN)), "a": r.normal(0, 0.3, HIDDEN), "w": np.zeros(d), "b": np.zeros(1)}
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}
        self.mean, self.scale = np.zeros(EXTRA, np.float32), np.ones(EXTRA, np.float32)

    def forward(self, ids, begin, owner, kinds, n_docs):
        p = self.p
        h = np.concatenate([_mean(p["E"], ids, begin, len(ids)), (kinds - self.mean) / self.scale], axis=1)
        t, g = np.tanh(_times(h, p["V"])), 1 / (1 + np.exp(-np.clip(_times(h, p["U"]), -30, 30)))
        starts = np.searchsorted(owner, np.arange(n_docs))
        e = np.clip(_times(t * g, p["a"][:, None])[:, 0], -30, 30)
        e = np.exp(e - np.maximum.reduceat(e, starts)[owner]) if len(e) else e
        weight = e / np.maximum(np.add.reduceat(e, starts), 1e-30)[owner] if len(e) else e
        z = np.add.reduceat(weight[:, None] * h, starts, axis=0) if len(e) else np.zeros((0, h.shape[1]))
        s = 1 / (1 + np.exp(-np.clip(_times(z, p["w"][:, None])[:, 0] + p["b"][0], -30, 30)))
        return s, (h, t, g, weight, z, starts)

    def predict(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        ids, begin, owner, kinds = encode(data, offsets)
        return self.forward(ids, begin, owner, kinds, len(offsets) - 1)[0]


def train(texts: list[bytes], labels: list[int], epochs: int = 6, rate: float = 0.01, batch: int = 16, seed: int = 3) -> Model:
    model = Model(seed)
    if not texts:
        return model
    r = np.random.default_rng(seed)
    bags = [encode(np.frombuffer(t, np.uint8), np.array([0, len(t)])) for t in texts]
    kinds = np.concatenate([b[3] for b in bags])
    model.mean, model.scale = kinds.mean(axis=0), kinds.std(axis=0) + 1e-3
    y = np.array(labels, np.float32)
    p = model.p
    m1, m2, step = {k: np.zeros_like(v) for k, v in p.items()}, {k: np.zeros_like(v) for k, v in p.items()}, 0
    for _ in range(epochs):
        order = r.permutation(len(bags))
        for i in range(0, len(order), batch):
            chosen = order[i : i + batch]
            ids = np.concatenate([bags[k][0] for k in chosen])
            shift = np.cumsum([0, *(len(bags[k][0]) for k in chosen)])
            begin = np.concatenate([bags[k][1] + s for k, s in zip(chosen, shift, strict=False)])
            owner = np.concatenate([np.full(len(bags[k][1]), j) for j, k in enumerate(chosen)])
            s, (h, t, g, weight, z, starts) = model.forward(ids, begin, owner, np.concatenate([bags[k][3] for k in chosen]), len(chosen))
            err = (s - y[chosen]) / len(chosen)
            grad = {"w": z.T @ err, "b": np.array([err.sum()])}
            dz = err[:, None] * p["w"][None, :]
            dh = weight[:, None] * dz[owner]
            dweight = (dz[owner] * h).sum(axis=1)
            de = weight * (dweight - np.add.reduceat(weight * dweight, starts)[owner])
            grad["a"] = (t * g).T @ de
            dt, dg = de[:, None] * p["a"] * g * (1 - t * t), de[:, None] * p["a"] * t * g * (1 - g)
            grad["V"], grad["U"] = h.T @ dt, h.T @ dg
            dh = dh + dt @ p["V"].T + dg @ p["U"].T
            size = np.append(begin[1:], len(ids)) - begin
            per = np.repeat(dh[:, :DIM] / np.maximum(size, 1)[:, None], size, axis=0)
            grad["E"] = np.stack([np.bincount(ids, weights=per[:, k], minlength=1 << BITS) for k in range(DIM)], axis=1)
            step += 1
            for k in p:
                v = grad[k].astype(np.float32) + 1e-5 * p[k]
                m1[k] += 0.1 * (v - m1[k])
                m2[k] += 0.001 * (v * v - m2[k])
                p[k] -= rate * (m1[k] / (1 - 0.9**step)) / (np.sqrt(m2[k] / (1 - 0.999**step)) + 1e-8)
    return model


def sample(docs: DataFrame, labels: DataFrame, rows: int = 1500) -> tuple[list[bytes], list[int]]:
    """At most about rows labelled texts outside the held-out fold, half of each label where there are enough, chosen by a hash of the id."""
    usable = labels.where((fold(F.col("doc_id")) != 2) & F.col("quality").isin(0, 1)).groupBy("doc_id").agg(F.min("quality").cast("int").alias("y"), F.max("quality").alias("top"))
    known = usable.where("y = top").drop("top")
    count = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    at = F.pmod(F.xxhash64(F.lit(12), F.col("doc_id")), F.lit(1 << 30))
    share = F.lit(False)
    for y, n in count.items():
        share = share | ((F.col("y") == y) & (at < int((1 << 30) * min(1.0, rows / 2 / n))))
    chosen = known.where(share).orderBy(at, "doc_id").limit(2 * rows)
    found = docs.select("doc_id", F.col("text").alias("t")).join(F.broadcast(chosen), "doc_id").orderBy(F.xxhash64("doc_id", "t")).limit(2 * rows).collect()
    return [(r["t"] or "").encode() for r in found], [r["y"] for r in found]


def score(docs: DataFrame, model: Model, threshold: float = 0.7) -> DataFrame:
    """doc_id, held_out, score and predicted for each row of docs."""

    def run(batches):
        for batch in batches:
            data, off = flat(batch.column(2))
            parts = [model.predict(data[off[i] : off[j]], off[i : j + 1] - off[i]) for i, j in slices(off, 1 << 20)]
            s = np.concatenate(parts).astype(np.float64) if parts else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(s), pa.array((s >= threshold).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    source = docs.select("doc_id", (fold(F.col("doc_id")) == 2).alias("held_out"), F.col("text").alias("t"))
    kind = source.schema["doc_id"].dataType.simpleString()
    return source.mapInArrow(run, f"doc_id {kind}, held_out boolean, score double, predicted int")
