"""Work that must not grow with more than the input."""

import json
import re
import weakref

import pyarrow as pa
from lexiloom.functions import text as T
from lexiloom.functions.words import BREAKS, SIGNALS
from lexiloom.operators import documents, markup, prose
from lexiloom.operators.fit import fit_chunks, fit_tokens
from lexiloom.operators.prose import _opening
from lexiloom.plans.queries import QUERIES
from pyspark.sql import functions as F


def words(s):
    return len(s.split())


def test_fit_chunks_streams_keys_through_one_function(spark):
    texts = {None: ["a b", "c d e"], "x": ["one two.", " ".join(f"w{i}" for i in range(25)), "end"], "y": ["q " * 11 + "s. t u v. " + "w " * 7]}
    rows = [(k, i, "plain_paragraph", t, json.dumps({"section_heading": k})) for k, parts in texts.items() for i, t in enumerate(parts)]
    chunks = spark.createDataFrame([*rows[::-1], ("bad", None, None, None, None)], "doc_id string, chunk_index int, content_type string, content string, metadata string").repartition(3)
    fitted = fit_chunks(chunks, words, 10, min_tokens=3)
    assert "InPandas" not in fitted._jdf.queryExecution().toString()
    want = [("bad", 0, None, None, "{}")]
    for k, parts in texts.items():
        found = fit_tokens(({"content": t, "content_type": "plain_paragraph", "metadata": {"section_heading": k}} for t in parts), words, 10, min_tokens=3)
        want += [(k, i, c["content_type"], c["content"], json.dumps(c["metadata"])) for i, c in enumerate(found)]
    assert len(want) == 10
    assert sorted(map(repr, map(tuple, fitted.collect()))) == sorted(map(repr, want))


def test_fit_tokens_weighs_a_run_once():
    seen = []
    fit_tokens([{"content": "a b c. d e f. g h i. j k l."}], lambda s: seen.append(s) or words(s), 6)
    assert len(seen) == len(set(seen))


def test_long_lines_are_no_titles_unread():
    class Line(str):
        def __iter__(self):
            raise AssertionError("read letter by letter")

    assert not markup._shouted(Line("A" * 81))
    assert markup._shouted("A TITLE") and not markup._shouted("Å" * 41) and markup._shouted("Å" * 40)


def test_signal_reads_only_the_opening(spark):
    plan = QUERIES["signal_prefix"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "translate(substring(" in plan
    assert not re.search(r"translate\((?!substring\()", plan)


def test_signal_equals_the_openings_of_paragraphs(spark):
    ends = ["", " x" * 40, "\n", "İ", "😀 it "]
    lines = [f"{f(p)}{e}" for phrases in (BREAKS, *SIGNALS.values()) for p in phrases for f in (str, str.upper, lambda p: p[:-1], lambda p: f"x{p}") for e in ends]
    lines += ["", "İt is", "It is", "e.g. x", "exgx", "i.e.", "such as x", "While this", "x\nhowever", "😀however", None]
    df = spark.createDataFrame([(x,) for x in lines], "line string")
    for txt in (True, False):
        got = {r.line: r.signal for r in df.select("line", T.signal(F.col("line"), txt).alias("signal")).collect()}
        assert got == {x: _opening(x, txt) if x else None for x in lines}


def test_semantic_reads_the_words_of_a_paragraph_once(monkeypatch):
    seen = []
    monkeypatch.setattr(prose, "keywords", lambda text, f=prose.keywords: seen.append(text) or f(text))
    blocks = [prose.Block("plain_paragraph", f"Paragraph {i} speaks about gardens and rivers, " + f"number{i} " * 12) for i in range(9)]
    chunks = prose.semantic(blocks, prose.TXT)
    assert chunks[0]["metadata"]["primary_merge_reason"] == "keyword_overlap"
    assert len(seen) == len(blocks)


def test_keywords_lower_ascii_only():
    assert prose.keywords("Gardens GARDENS the İstanbul Kelvin abc ab-cdef éclair") == {"gardens", "stanbul", "elvin", "cdef", "clair"}


def test_semantic_sizes_under_headings_that_merge():
    blocks = [prose.Block("heading", "Überschrift", 1), *(prose.Block("plain_paragraph", "It " + "é" * n) for n in (350, 420, 5))]
    chunks = prose.semantic(blocks, prose.HTML)
    assert [c["metadata"]["paragraph_count"] for c in chunks] == [2, 2]


def test_plain_leaves_text_without_marks_unread(monkeypatch):
    seen = []
    monkeypatch.setattr(markup.re, "sub", lambda *a, f=re.sub, **k: seen.append(a) or f(*a, **k))
    text = "Plain words (in brackets), a - dash, #7 and 3 > 2!"
    assert markup.plain(text) == text
    assert not seen


def test_plain_strips_each_mark():
    marked = r"![i](u) [t](v) x[^1] <https://a.b> <b>c</b> `d` **e** __f__ ~~g~~ *h* _i_ \* snake_case_word"
    assert markup.plain(marked) == "[Image: i] t x https://a.b c d e f g h i * snake_case_word"
    for part, want in (("![i](u)", "[Image: i]"), ("[t](v)", "t"), ("x[^1]", "x"), ("<https://a.b>", "https://a.b"), ("<b>c</b>", "c"), ("`d`", "d"), ("**e**", "e"), ("__f__", "f"), ("~~g~~", "g"), ("*h*", "h"), ("_i_", "i"), (r"\*", "*")):
        assert markup.plain(part) == want


def test_batches_are_let_go_and_output_is_sent_on_by_its_own_size(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "x")], "doc_id long, text string")
    got, seen = [], []
    monkeypatch.setattr(type(docs), "mapInArrow", lambda self, fn, schema: got.append(fn))
    documents.chunk_texts(docs, "sentence")

    def batch(i):
        made = pa.RecordBatch.from_arrays([pa.array([i] * 40), pa.array([b"Red. " * 2000] * 40), pa.array(["x.txt"] * 40)], names=["k", "d", "n"])
        seen.append(weakref.ref(made))
        return made

    def batches():
        for i in range(3):
            assert not seen or seen[-1]() is None
            yield batch(i)

    rows, sizes = 0, []
    for out in got[0](batches()):
        rows += out.num_rows
        sizes.append(sum(len(x) for c in ("content_type", "content", "metadata") for x in out.column(c).to_pylist()))
    assert rows == 3 * 40 * 667
    assert max(sizes) < documents.BATCH_CHARS + (1 << 20) < sum(sizes) / 3
