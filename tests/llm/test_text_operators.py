"""URL filters, quality rules, decontamination, the piece codec and sharding against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict
from fnmatch import translate

import numpy as np
import pytest
from lexiloom.llm import decontamination, piece_codec, quality_rules, sharding, url_filter
from lexiloom.llm.queries import piece_model
from pyspark.sql import functions as F

ODD = [None, "", " \n\t ", "a", "é" * 50, "word " * 20_000, "# $ % & | < > *", "one\none\n\none\ntwo", "é\x00b", "\ufeffx"]


# URL filters

URLS = [
    None, "", "no scheme", "http://Example.NET/en/a", "https://example.net/de/", "http://a.b.example.com/de/x?q#f", "http://example.com", "http://notexample.com/de/", "ftp://x.org/fr/", "x://y.org/en/",
    "http://casino.org/fr/", "http://casino.info/", "http://a.info/ads/x", "http://a.info/x/ads/y", "http://a.info/x/ads/y", "http://a.info/ads", "http://b.info/" + "y" * 300_000 + "/ads/", "http://a.info/x.exe", "http://a.info/x.exe?y", "://net/", "http://net", "http://NET/#", "a://b://c.net/", "http://ü.net/é", "http://a.com/" + "x" * 5000,
]


def judged(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^/?#]*([^?#]*)", rest)[1]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [(len(h) + len(p), h + p, v) for v, h, p in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    if fits:
        return host, path, max(fits)[1], max(fits)[2]
    bad = re.search(r"casino|porn|xxx|-bet\.|viagra", host) or "/ads/" in path or path.endswith((".exe", ".zip"))
    return host, path, None, "block" if bad else "allow"


def test_urls_are_judged_by_the_longest_rule(spark):
    pages = spark.createDataFrame([(i, u, "x", b"h") for i, u in enumerate(URLS)], "page_id long, url string, host string, html binary")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.judge(pages).collect()}
    assert got == {i: judged(u) for i, u in enumerate(URLS)}
    assert url_filter.judge(pages.limit(0)).collect() == []


def test_many_globs_over_several_words_of_state():
    r = random.Random(1)
    globs = ["".join(r.choice("ab?*") for _ in range(r.randint(1, 12))).replace("**", "*") for _ in range(60)]
    strings = ["".join(r.choice("ab") for _ in range(r.randint(0, 14))) for _ in range(200)]
    data = np.frombuffer("".join(strings).encode(), np.uint8)
    got = url_filter.Automaton(globs).match(data, np.cumsum([0, *map(len, strings)]))
    assert got.tolist() == [[bool(re.match(translate(g), s)) for g in globs] for s in strings]


# quality rules


def measured(text):
    t = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    five = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    count, covered = Counter(five), set()
    for i, g in enumerate(five):
        if count[g] > 1:
            covered |= set(range(i, i + 5))
    lines, seen, dup = t.split("\n"), set(), 0
    for line in lines:
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(covered), len(w) < 10 or 100 * len(covered) > 20 * len(w)


def test_measurements_are_those_of_plain_counting(spark):
    r = random.Random(2)
    texts = [*ODD, *(" ".join(r.choice("abc") for _ in range(r.randint(0, 60))) + "\n" + "x y\n" * r.randint(0, 3) for _ in range(40))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {x["doc_id"]: tuple(x[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")) for x in quality_rules.apply_policy(quality_rules.ledger(docs)).collect()}
    assert got == {i: measured(t) for i, t in enumerate(texts)}


def test_policies_and_ablations_work_on_the_bits(spark):
    book = quality_rules.ledger(spark.createDataFrame([(1, "a b"), (2, "## " * 30), (3, None), (4, " ".join(f"word{i}" for i in range(30)))], "doc_id long, text string"))
    for policy in quality_rules.POLICIES:
        own = quality_rules.apply_policy(book, policy).collect()
        assert [r["doc_id"] for r in own if r["kept"]] == [4]
        assert all(r["kept"] == ((r["fail_bits"] & (quality_rules.mask(policy) | quality_rules.mask("base"))) == 0) for r in own)
    rows = {r["rule"]: r for r in quality_rules.ablations(book).collect()}
    assert rows["min_words"]["n_failed"] == 2 and rows["repeat_words"]["n_failed"] == 1 and rows["symbols"]["n_only"] == 0


# decontamination


def leaks(texts, items):
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    wins = defaultdict(set)
    for i, t in items:
        w = split(t)
        for k in range(max(len(w) - 10, 0) + 1 if w else 0):
            wins[tuple(w[k : k + 10])].add(i)
    out = []
    for t in texts:
        w, hit, found = split(t), set(), set()
        for size in {len(x) for x in wins}:
            for k in range(len(w) - size + 1):
                if (own := wins.get(tuple(w[k : k + size]))) is not None:
                    hit |= set(range(k, k + size))
                    found |= own
        out.append((len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(str(i) for i in found if i is not None)).encode()).hexdigest(), bool(hit)))
    return out


@pytest.mark.parametrize("inline", [50_000, 0])
def test_benchmark_windows_are_found_wherever_they_stand(spark, inline):
    r = random.Random(3)
    words = [f"v{i}" for i in range(40)] + ["Über", "the", "a"]
    text = lambda n: " ".join(r.choice(words) for _ in range(n))
    items = [(1, text(30)), (2, text(12)), (3, text(10)), (4, "only four words here"), (5, "solo"), (6, None), (7, "..."), (None, text(11)), (3, text(15)), (9, "two words"), (None, "nameless"), (9, "two words")]
    texts = [*ODD, "solo", "Solo nameless here", "solo " + "filler " * 30_000 + items[1][1], items[7][1], items[7][1] + " " + items[1][1] + " " + items[1][1], "Only FOUR, words here!", items[0][1], items[1][1].replace(" ", "--"), text(5) + " " + items[0][1] + " " + text(3) + " " + items[2][1], *(text(r.randint(0, 40)) for _ in range(20))]
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, k string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = decontamination.hits(docs, bench, inline=inline)
    rows = {bytes(x["k"]): x for x in found.collect()}
    got = {k: (x["n_hit"], x["n_items"]) for k, x in rows.items()}
    assert all(sum(s["hi"] - s["lo"] for s in x["spans"]) == x["n_hit"] and all(a["hi"] < b["lo"] for a, b in zip(x["spans"], x["spans"][1:], strict=False)) for x in rows.values())
    want = leaks(texts, items)
    assert got == {hashlib.md5((t or "").encode()).digest(): w[1:3] for t, w in zip(texts, want, strict=True) if w[1]}
    report = {x["doc_id"]: (x["n_words"], x["n_hit"], x["n_items"], x["items_sha256"], x["contaminated"]) for x in decontamination.report(docs, bench).collect()}
    assert report == dict(enumerate(want))


def test_decontamination_of_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert sorted((r["doc_id"], r["n_words"], r["contaminated"]) for r in decontamination.report(docs, none).collect()) == [(1, 2, False), (2, 0, False)]
    items = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert decontamination.report(docs.limit(0), items).collect() == []
    assert [r["doc_id"] for r in decontamination.without_contaminated(docs, items).collect()] == [2]


# piece codec

PIECES = [*ODD, "▁", "▁▁ a", " lead", "trail ", "  two  spaces", "naïve café — 漢字かな 🙂👩‍👩‍👧", "a\nb\n\n c", "x" * 3000, "٣٤ عربي", "\u00a0\u2003", "abc▁def", "<s> </s> <unk> <0x41>", "é" * 3 + "e\u0301", "\ud7ff\U0010ffff"]


def test_a_wrong_agenda_is_told_and_not_mended():
    codec = piece_codec.Codec(piece_model())
    unit = codec.piece[codec.merge[next(iter(codec.merge))][1]]
    codec.merge.clear()
    codec.learn(["▁" + unit.lstrip("▁") + "abc" * 10])
    assert codec.differ == 1
    assert len(next(iter(codec.known.values())).split(",")) > 20


def test_ids_and_text_are_the_librarys(spark):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=piece_model())
    r = random.Random(5)
    texts = PIECES + ["".join(chr(r.choice([32, 32, 10, r.randint(33, 126), r.randint(160, 1200), r.randint(0x4E00, 0x4F00)])) for _ in range(r.randint(0, 300))) for _ in range(60)]
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, n_tokens int")
    got = {x["doc_id"]: x for x in piece_codec.transcode(docs, piece_model(), texts=True).collect()}
    for i, t in enumerate(texts):
        ids = library.encode(t or "")
        assert got[i]["ids"] == ids and got[i]["n_tokens"] == len(ids), t
        assert got[i]["decoded"] == library.decode(ids), t
        assert got[i]["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
    assert sum(x["differs"] for x in got.values()) == 0
    copies = docs.union(docs).union(docs.where("doc_id % 3 = 0"))
    assert {tuple(x) for x in piece_codec.transcode(copies, piece_model()).drop("differs").collect()} == {tuple(x) for x in piece_codec.transcode(docs, piece_model()).drop("differs").collect()}
    assert piece_codec.transcode(docs.limit(0), piece_model()).collect() == []


def test_agenda_rows_and_heap_agree():
    codec = piece_codec.Codec(piece_model())
    r = random.Random(6)
    units = ["▁" + "".join(r.choice("etaoinshrdlu語é") for _ in range(8)) for _ in range(300)]
    assert codec._rows(units) == [codec._heap(u) for u in units]


# sharding


def test_shards_are_even_gapless_and_repeatable(spark):
    texts = [*ODD, *(f"text {i % 7}" for i in range(90))]
    docs = spark.createDataFrame([(i, t, 3) for i, t in enumerate(texts)], "doc_id long, text string, shard int")
    got = sharding.digest(docs, bucket_bytes=2000).collect()
    assert sorted(r["doc_id"] for r in got) == list(range(len(texts)))
    slots = defaultdict(list)
    for r in got:
        t = (texts[r["doc_id"]] or "").encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(t) + 1, zlib.crc32(t), "rows", None)
        slots[r["shard"]].append(r["slot"])
    assert set(slots) <= set(range(8)) and all(sorted(v) == list(range(len(v))) for v in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    again = sharding.digest(docs.orderBy(F.desc("doc_id")).repartition(3), bucket_bytes=2000).collect()
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, again), key=str)


def test_sharding_of_repeated_rows_and_no_rows(spark):
    docs = spark.createDataFrame([(1, "a")] * 20 + [(None, None)] * 5, "doc_id long, text string")
    got = sharding.digest(docs, 3).collect()
    assert len(got) == 25 and len({(r["shard"], r["slot"]) for r in got}) == 25
    assert sharding.digest(docs.limit(0)).collect() == []
    with pytest.raises(ValueError, match="n_shards"):
        sharding.shuffle(docs, 0)


def test_shards_are_written(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"t{i}") for i in range(30)], "doc_id long, text string")
    sharding.write(docs, str(tmp_path / "out"), 4)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == 30 and sorted(r["count"] for r in back.groupBy("shard").count().collect()) == [7, 7, 8, 8]
