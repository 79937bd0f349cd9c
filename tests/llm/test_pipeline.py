"""The pipeline's stages against plain Python, and its queries' schema."""

import hashlib

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lexiloom.llm import queries
from lexiloom.llm.queries_sql import SQL
from tests.llm.test_dedup import brute_components
from tests.llm.test_text_operators import leaks

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def tables(spark, tmp_path):
    words = lambda tag, n: " ".join(f"{tag}word{i}" for i in range(n))
    passage = words("shared", 60)
    texts = {
        1: words("alpha", 80), 2: words("alpha", 80), 3: words("alpha", 79) + " other", 4: "too short", 5: None, 6: "", 7: words("beta", 60) + " " + passage,
        8: words("gamma", 60) + " " + passage, 9: words("delta", 30) + " " + words("item", 12) + " " + words("epsilon", 20), 10: "### " * 40, 11: words("clean", 50), 12: "a b c d e " * 30,
    }
    docs = spark.createDataFrame([(i, t, "en", "s", len(t) if t is not None else None) for i, t in texts.items()], COLUMNS)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, words("item", 12)), (2, "unseen words of another item that no document has at all")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    return texts, str(tmp_path)


def test_the_stages_in_turn(spark, tables):
    texts, path = tables
    docs = spark.read.parquet(f"{path}/documents.parquet")
    kept = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, path)
        assert docs.columns == [c.split()[0] for c in COLUMNS.split(", ")], name
        docs = spark.createDataFrame(docs.collect(), COLUMNS)
        kept.append({r["doc_id"]: r["text"] for r in docs.collect()})
    assert set(kept[0]) == {1, 2, 3, 7, 8, 9, 11}
    near = [texts[i] for i in sorted(kept[0])]
    assert set(kept[1]) == {sorted(kept[0])[i] for i, (_, c) in enumerate(brute_components(near, 5, 80)) if c == i} == {1, 7, 8, 9, 11}
    assert kept[2][1] == texts[1] and "sharedword30" not in kept[2][7] + kept[2][8]
    assert set(kept[3]) == {i for i, x in zip(kept[2], leaks(kept[2].values(), [(1, " ".join(f"itemword{k}" for k in range(12)))]), strict=True) if not x[4]} == {1, 7, 8, 11}
    got = {r["doc_id"]: r for r in corpus_pipeline.run(spark, path).collect()}
    assert set(got) == {1, 7, 8, 11}
    assert got[11]["decoded_sha256"] == hashlib.sha256(texts[11].encode()).hexdigest()


def test_clashing_columns_pass_through_the_stages(spark, tables):
    _, path = tables
    docs = spark.read.parquet(f"{path}/documents.parquet").withColumns({"kept": F.lit("mine"), "n_words": F.lit("own"), "k": F.lit(1), "id": F.lit(2), "fail_bits": F.lit("x"), "component_id": F.lit(None).cast("int")})
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, path)
        assert out.columns == docs.columns, name
        assert {(r["kept"], r["n_words"], r["k"], r["fail_bits"]) for r in out.collect()} == {("mine", "own", 1, "x")}, name


def test_empty_documents(spark, tmp_path):
    spark.createDataFrame([], COLUMNS).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_names_of_the_queries():
    assert [n.split("_")[0] for n in queries.QUERIES] == [f"op{i}" for i in range(1, 11)]
    assert set(SQL) <= set(queries.QUERIES)
