"""Language identification, quality model, language-model scoring: held-out accuracy, brute force and edge cases."""

import math
import re
from collections import Counter

import numpy as np
import pytest
from lexiloom.llm import language_id, lm_scoring, quality_model
from lexiloom.llm.common import read, span_digests
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.01"
ODD = [(1, None), (2, ""), (3, "12 34 !"), (4, "語"), (5, "word " * 30_000), (None, "some text without an id"), (7, "some text"), (7, "some text")]


@pytest.fixture(scope="module")
def language(spark):
    return language_id.train(*language_id.sample(read(spark, SF, "documents")))


def test_held_out_languages(spark, language):
    docs = read(spark, SF, "documents")
    found = language_id.identify(docs, language).where("held_out").join(docs.select("doc_id", "lang"), "doc_id").where("lang is not null and lang_pred <> 'und'")
    right, n = found.agg(F.sum((F.col("lang_pred") == F.col("lang")).cast("int")), F.count("*")).first()
    assert n > 100 and right / n > 0.95


def test_the_sample_is_never_held_out_and_bounded(spark):
    docs = read(spark, SF, "documents")
    texts, labels = language_id.sample(docs, per_class=20)
    held = {r["text"].encode() for r in docs.where(language_id.fold(F.col("doc_id")) == 2).select("text").collect() if r["text"]}
    free = {r["text"].encode() for r in docs.where(language_id.fold(F.col("doc_id")) != 2).select("text").collect() if r["text"]}
    assert 20 < len(texts) == len(labels) <= 160
    assert all(t in free or t not in held for t in texts)


def test_languages_of_odd_texts(spark, language):
    docs = spark.createDataFrame([(*r, "zz", 1) for r in ODD], "doc_id long, text string, lang string, score int")
    got = language_id.identify(docs, language).collect()
    assert len(got) == len(ODD) and all(0 <= r["score"] <= 1 for r in got)
    by = {r["doc_id"]: r for r in got}
    assert [by[i]["lang_pred"] for i in (1, 2, 3)] == ["und"] * 3 and by[4]["lang_pred"] in language.classes
    empty = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert language_id.identify(empty, language_id.train(*language_id.sample(empty))).collect() == []


def test_held_out_quality(spark):
    docs, labels = read(spark, SF, "documents"), read(spark, SF, "labels")
    model = quality_model.train(*quality_model.sample(docs, labels))
    rows = quality_model.score(docs, model).where("held_out").join(labels.where("quality is not null"), "doc_id").select("score", "quality", "predicted").collect()
    good, bad = ([r["score"] for r in rows if r["quality"] == q] for q in (1, 0))
    auc = np.mean([(g > b) + 0.5 * (g == b) for g in good for b in bad])
    assert auc > 0.9, auc
    assert all(r["predicted"] == (r["score"] >= 0.7) for r in rows)


def test_quality_of_odd_texts(spark):
    model = quality_model.train([b"a good text of words", b"#### $$$$"] * 8, [1, 0] * 8)
    got = quality_model.score(spark.createDataFrame([(*r, 2) for r in ODD], "doc_id long, text string, score int"), model).collect()
    assert len(got) == len(ODD) and all(0 <= r["score"] <= 1 for r in got)
    by = {r["doc_id"]: r["score"] for r in got}
    assert by[1] == pytest.approx(by[2])
    assert quality_model.score(spark.createDataFrame([], "doc_id long, text string"), quality_model.train([], [])).collect() == []


def test_a_score_is_that_of_the_text_alone(spark):
    docs, labels = read(spark, SF, "documents"), read(spark, SF, "labels")
    model = quality_model.train(*quality_model.sample(docs, labels, rows=200))
    texts = [(r["text"] or "").encode() for r in docs.limit(80).collect()] + [b"", b"x", b"xy", b"xyz", "語".encode()]

    def together(chosen):
        return model.predict(np.frombuffer(b"".join(chosen), np.uint8), np.cumsum([0, *map(len, chosen)]))

    alone = np.concatenate([together([t]) for t in texts])
    assert together(texts).tolist() == alone.tolist() == together(texts[::-1])[::-1].tolist()


def test_contradicting_labels_teach_nothing(spark):
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(40)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, q, 0) for i in range(40) for q in ((0, 1) if i % 4 == 0 else (1, 1))] + [(None, 1, 0), (41, None, 0)], "doc_id long, quality int, toxic int")
    texts, marks = quality_model.sample(docs, labels)
    want = {f"text {r['doc_id']}".encode() for r in docs.where(quality_model.fold(F.col("doc_id")) != 2).collect() if r["doc_id"] % 4}
    assert set(texts) == want and set(marks) == {1}


def brute_models(rows):
    """For each row its words; the two models as functions (before, word) -> probability; all words."""
    words = [re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) for _, t, _ in rows]
    everywhere = Counter(w for d in words for w in d)
    known = {w for w, n in everywhere.items() if n > 1}
    once = set(everywhere) - known

    def model(chosen, weight=0.5):
        uni = Counter(w for d in chosen for w in d)
        bi = Counter(p for d in chosen for p in zip([None, *d], d, strict=False))
        after = Counter(p[0] for p in bi.elements())
        total, rare = sum(uni.values()) + len(known) + 1, sum(uni[w] for w in once) + 1

        def probability(before, w):
            base = (uni[w] + 1) / total if w in known else rare / total / (len(once) + 1)
            return weight * bi[before, w] / after[before] + (1 - weight) * base if after[before] else base

        return probability

    return words, [model([w for w, r in zip(words, rows, strict=True) if r[2]]), model(words)], everywhere


def brute_scores(rows):
    words, models, everywhere = brute_models(rows)
    for m in models:  # both sum to 1, with one part for a word never met
        for before in (None, "w1", "w2", "once"):
            assert math.isclose(sum(m(before, w) for w in [*everywhere, "never met"]), 1.0)
    return [None if not d else sum(math.log(models[1](b, w)) - math.log(models[0](b, w)) for b, w in zip([None, *d], d, strict=False)) / len(d) for d in words]


@pytest.mark.parametrize("batch_bytes", [300, 1 << 20])
def test_scores_are_those_of_plain_counts(spark, batch_bytes):
    r = np.random.default_rng(4)
    rows = [(i, " ".join(f"w{k}" for k in r.zipf(1.5, 20) % 40), bool(i % 3 == 0)) for i in range(60)] + [(90, None, True), (91, "", False), (92, "once", None), (93, "W1 w2\tw3", True)]
    docs = spark.createDataFrame([(*x, 5) for x in rows], "doc_id long, text string, good boolean, b int")
    got = {x["doc_id"]: x["score"] for x in lm_scoring.cross_entropy_difference(docs, F.col("good"), batch_bytes).collect()}
    for (i, _, _), want in zip(rows, brute_scores(rows), strict=True):
        assert got[i] is None if want is None else got[i] == pytest.approx(want, abs=1e-9), i


def test_packed_numbers_come_back():
    for x in ([], [0], [255, 256, 0], [2**40, 1], [0] * 9):
        blob = lm_scoring._pack(np.array(x, np.int64))
        assert lm_scoring._unpack(blob, len(x)).tolist() == x


def test_spans_of_equal_digest_are_equal():
    """Words that differ in structure only: the two complementary Thue-Morse words collide under sums of powers."""
    a = "".join("ab"[bin(i).count("1") % 2] for i in range(1024)).encode()
    spans = [a, a.translate(bytes.maketrans(b"ab", b"ba")), b"", b"\0", b"\0\0", a[:8], a[:9], a[:64], a[:65], a[:64] + b"\0"]
    data = np.frombuffer(b"".join(spans), np.uint8)
    ends = np.cumsum([len(s) for s in spans])
    starts = ends - [len(s) for s in spans]
    found = span_digests(data, starts, ends)
    assert len(set(found.tolist())) == len(spans)
    alone = [span_digests(np.frombuffer(s, np.uint8), np.array([0]), np.array([len(s)]))[0] for s in spans]
    assert found.tolist() == alone


def test_scores_of_odd_texts_and_of_no_texts(spark):
    docs = spark.createDataFrame(ODD, "doc_id long, text string")
    assert lm_scoring.cross_entropy_difference(docs, F.lit(True)).count() == len(ODD)
    assert lm_scoring.cross_entropy_difference(docs.limit(0), F.lit(None).cast("boolean")).collect() == []
