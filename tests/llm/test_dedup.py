"""Suffix dedup and near-duplicate detection against brute force."""

import hashlib
import itertools
import random
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from lexiloom.llm import near_dedup, suffix_dedup

SCHEMA = "doc_id long, text string"


def brute_spans(texts: list[str | None], length: int) -> list[tuple[int, int, int, str]]:
    """(n_bytes, n_removed, n_spans, kept_sha256) by looking at every window."""
    raw = [(t or "").encode() for t in texts]
    seen = defaultdict(list)
    for d, b in enumerate(raw):
        for i in range(len(b) - length + 1):
            seen[b[i : i + length]].append((d, i))
    gone = [bytearray(len(b)) for b in raw]
    for places in seen.values():
        if len(places) > 1:
            for d, i in places:
                gone[d][i : i + length] = b"\1" * length
    out = []
    for b, g in zip(raw, gone, strict=True):
        kept = bytes(x for x, y in zip(b, g, strict=True) if not y)
        out.append((len(b), len(b) - len(kept), len(re.findall(b"\1+", bytes(g))), hashlib.sha256(kept).hexdigest()))
    return out


def corpus(seed: int, n: int = 60) -> list[str | None]:
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdeéß語") for _ in range(r.randint(1, 7)))
    passage = [" ".join(word() for _ in range(60)) for _ in range(4)]
    texts: list[str | None] = [None, "", "x", "ab" * 400, "c" * 700, "c" * 900, "c" * 200, "d" * 201]
    for _ in range(n):
        body = " ".join(word() for _ in range(r.randint(5, 80)))
        if r.random() < 0.5:
            p = r.choice(passage)
            lo = r.randint(0, 100)
            body = body + p[lo : lo + r.randint(60, 260)] + " ".join(word() for _ in range(20))
        texts.append(body)
    return [*texts, *texts[10:14], " ".join(word() for _ in range(8000)) + passage[0] + word()]


@pytest.mark.parametrize(("length", "local_group", "hot"), [(200, 16384, 8), (64, 16384, 8), (64, 2, 8), (64, 2, 2), (200, 16384, 2), (200, 16384, 1)])
def test_repeated_strings_are_removed_as_brute_force_has_it(spark, monkeypatch, length, local_group, hot):
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    texts = corpus(length + local_group)
    docs = spark.createDataFrame(list(enumerate(texts)), SCHEMA)
    found = {r["k"]: r for r in suffix_dedup.repeated_spans(docs, length, local_group=local_group).collect()}
    for (n_bytes, n_removed, n_spans, sha), t in zip(brute_spans(texts, length), texts, strict=True):
        row = found.get(hashlib.md5((t or "").encode()).digest())
        got = (row["n_removed"], row["n_spans"], row["kept_sha256"]) if row else (0, 0, hashlib.sha256((t or "").encode()).hexdigest())
        assert got == (n_removed, n_spans, sha), (n_bytes, (t or "")[:60])


def test_a_line_that_every_text_has_many_times(spark):
    r = random.Random(6)
    line = "the one very common line of the whole corpus, which every text has again and again"
    word = lambda: "".join(r.choice("abcdefg") for _ in range(6))
    texts = [" ".join(x for _ in range(r.randint(1, 12)) for x in (line, word(), *([line, "tail " * 30] if r.random() < 0.2 else []))) for _ in range(80)]
    got = suffix_dedup.dedup_report(spark.createDataFrame(list(enumerate(texts)), SCHEMA).repartition(5))
    assert {x["doc_id"]: (x["n_bytes"], x["n_removed"], x["n_spans"], x["kept_sha256"]) for x in got.collect()} == dict(enumerate(brute_spans(texts, 200)))


def test_report_has_a_row_for_every_row(spark):
    texts = corpus(9)
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(texts)], SCHEMA + ", k string, n int")
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in suffix_dedup.dedup_report(docs).collect()}
    assert got == dict(enumerate(brute_spans(texts, 200)))


def test_texts_without_repeats_keep_their_columns(spark):
    passage = "the same words stand here in more than one place of this corpus, and so they go. " * 4
    docs = spark.createDataFrame([(1, "first " + passage, 9, "a"), (2, passage + " lästé", 9, "b"), (3, "clean", 5, "c"), (4, None, None, "d")], "doc_id long, text string, n_chars long, k string")
    got = {r["doc_id"]: r for r in suffix_dedup.without_repeats(docs).collect()}
    assert got[3]["text"] == "clean" and got[3]["n_chars"] == 5 and got[4]["text"] is None
    assert got[1]["text"] == "first" and got[1]["n_chars"] == 5 and got[1]["k"] == "a"
    assert got[2]["text"].endswith("lästé")


def test_suffix_dedup_of_an_empty_table(spark):
    docs = spark.createDataFrame([], SCHEMA)
    assert suffix_dedup.dedup_report(docs).collect() == [] and suffix_dedup.without_repeats(docs).collect() == []
    with pytest.raises(ValueError, match="length"):
        suffix_dedup.repeated_spans(docs, 10)


def brute_components(texts: list[str | None], k: int, percent: int) -> list[tuple[int, int]]:
    sets = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set())
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(range(len(texts)), 2):
        if sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return [(len(s), find(i)) for i, s in enumerate(sets)]


def near_corpus(seed: int) -> list[str | None]:
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(500)]
    texts: list[str | None] = [None, "", "  \n", "one two", "One  TWO", "one two three", "A b c d e f g"]
    for _ in range(25):
        base = [r.choice(vocabulary) for _ in range(r.randint(30, 90))]
        texts.append(" ".join(base))
        for _ in range(r.randint(0, 6)):
            other = list(base)
            for _ in range(r.randint(0, 4)):
                other[r.randrange(len(other))] = r.choice(vocabulary)
            texts.append(" ".join(other).upper() if r.random() < 0.2 else "\t".join(other))
    return texts


@pytest.mark.parametrize(("shingle", "block"), [(4, 1024), (5, 1024), (4, 3)])
def test_components_are_those_of_all_pairs(spark, monkeypatch, shingle, block):
    monkeypatch.setattr(near_dedup, "BLOCK", block)
    texts = near_corpus(shingle)
    docs = spark.createDataFrame([(i, t, b"x") for i, t in enumerate(texts)], SCHEMA + ", k binary")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in near_dedup.near_duplicates(docs, shingle).collect()}
    assert got == {i: (n, c, c == i) for i, (n, c) in enumerate(brute_components(texts, shingle, 80))}


def test_many_near_copies_in_small_blocks(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCK", 16)
    base = [f"v{i}" for i in range(200)]
    texts = [" ".join([*base[:100], f"own{i}", *base[100:]]) for i in range(90)]
    docs = spark.createDataFrame(list(enumerate(texts)), SCHEMA)
    assert {r["component_id"] for r in near_dedup.near_duplicates(docs).collect()} == {0}
    assert [r["doc_id"] for r in near_dedup.without_near_duplicates(docs).collect()] == [0]


def test_links_that_are_another_forest_each_time_they_are_computed(spark):
    def forests(batches):
        r = np.random.default_rng()
        for batch in batches:
            for g in batch.column(0).to_pylist():
                ids = g * 100 + r.permutation(25)
                yield pa.RecordBatch.from_arrays([pa.array(ids[1:]), pa.array([int(ids[r.integers(0, i)]) for i in range(1, 25)])], names=["a", "b"])

    found = near_dedup.components(spark.range(40).mapInArrow(forests, "a long, b long")).collect()
    assert sorted(x["id"] for x in found) == [g * 100 + i for g in range(40) for i in range(25)]
    assert all(x["comp"] // 100 == x["id"] // 100 for x in found) and len({x["comp"] for x in found}) == 40


@pytest.mark.parametrize("blocks", [1, 3])
def test_a_forest_does_not_depend_on_the_order_in_which_rows_arrive(spark, blocks):
    r = np.random.default_rng(12)
    rows = []
    for g in range(6):
        base = r.integers(1, 2**63, 200, dtype=np.uint64)
        rows += [(g, g * 100 + i, np.sort(np.concatenate([base[10:], r.integers(1, 2**63, 10, dtype=np.uint64)])).tobytes(), 200) for i in range(20)]
    sizes = spark.createDataFrame([(g, blocks) for g in range(6)], "g long, blocks int")

    def forest(given):
        dealt = near_dedup._in_blocks(spark.createDataFrame(given, "g long, id long, x binary, n long").coalesce(1), sizes, 3)
        return sorted(tuple(x) for x in dealt.mapInArrow(near_dedup._true_pairs(80), "a long, b long").collect())

    assert forest(rows) == forest(rows[::-1]) == forest([rows[i] for i in r.permutation(len(rows))])


def test_pairs_at_the_threshold_are_under_the_signature_distance():
    """Recall of the signatures: 4000 pairs of sets at a similarity of exactly 0.8."""
    r = np.random.default_rng(8)
    far = 0
    for _ in range(4000):
        both = r.integers(1, 2**63, 88, dtype=np.uint64)
        a, b = (near_dedup.signature(np.concatenate([both[:80], x])) for x in (both[80:84], r.integers(1, 2**63, 16, dtype=np.uint64)))
        far += (a != b).sum() > near_dedup.DISTANCE
    assert far == 0


def test_every_pair_under_the_distance_shares_a_key():
    r = np.random.default_rng(9)
    for _ in range(200):
        a = r.integers(0, 2**16, near_dedup.SYMBOLS).astype(np.uint16)
        b = a.copy()
        at = r.choice(near_dedup.SYMBOLS, near_dedup.DISTANCE, replace=False)
        b[at] ^= 1
        batch = pa.RecordBatch.from_arrays([pa.array([1, 2]), pa.array([a.tobytes(), b.tobytes()])], names=["id", "sig"])
        keys = np.array(next(near_dedup._file([batch])).column(0).to_pylist()).reshape(2, -1)
        assert (keys[0] == keys[1]).any()


def test_words_that_only_differ_in_structure_are_not_linked(spark):
    one = "".join("ab"[bin(i).count("1") % 2] for i in range(1024))
    docs = spark.createDataFrame([(1, one), (2, one.translate(str.maketrans("ab", "ba"))), (3, "long " * 200_000), (4, "long " * 200_001)], SCHEMA)
    assert {r["doc_id"]: r["component_id"] for r in near_dedup.near_duplicates(docs, 4).collect()} == {1: 1, 2: 2, 3: 3, 4: 3}


def test_repeated_and_missing_ids(spark):
    text = "one text of some words that is given more than once here"
    docs = spark.createDataFrame([(None, text), (7, text), (7, text), (None, "another text that nothing else is like"), (8, None)], SCHEMA)
    got = sorted((str(r["doc_id"]), str(r["component_id"]), r["kept"]) for r in near_dedup.near_duplicates(docs).collect())
    assert got == [("7", "7", True), ("7", "7", True), ("8", "8", True), ("None", "7", False), ("None", "None", True)]


def test_near_dedup_of_an_empty_table(spark):
    docs = spark.createDataFrame([], SCHEMA)
    assert near_dedup.near_duplicates(docs).collect() == [] and near_dedup.without_near_duplicates(docs).collect() == []
