"""One query for each operator, over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import rows
from ..operators.documents import blocks_of, chunk_texts
from ..operators.fit import fit_chunks, fit_words
from . import relation_queries

CUSTOMER = ["c_custkey", "c_name", "c_nationkey", "c_mktsegment"]
BANDS = [(1, 10, "small"), (5, 20, "medium"), (21, 50, "large")]


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", "text")


def _exploded(df: DataFrame, array, name: str, *more) -> DataFrame:
    placed = df.select("doc_id", F.posexplode(array).alias("pos", name))
    return placed.select("doc_id", F.col("pos").cast("long").alias("pos"), name, *more)


def _paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents with every line as a paragraph."""
    return _texts(spark, sf_dir).withColumn("text", F.replace("text", F.lit("\n"), F.lit("\n\n")))


def sentence_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _exploded(_texts(spark, sf_dir), T.sentences(F.col("text")), "sentence")


def sentence_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    split = _texts(spark, sf_dir).select("doc_id", T.sentences(F.col("text")).alias("s")).where(F.size("s") > 0)
    groups = F.transform(F.sequence(F.lit(0), F.floor((F.size("s") - 1) / 3).cast("int")), lambda i: F.struct(F.array_join(F.slice("s", i * 3 + 1, 3), " ").alias("content"), F.size(F.slice("s", i * 3 + 1, 3)).cast("long").alias("n")))
    return split.select("doc_id", F.posexplode(groups).alias("i", "x")).select("doc_id", F.col("i").cast("long").alias("chunk_index"), F.col("x.content").alias("content"), F.col("x.n").alias("actual_sentence_count"))


def keyword_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = F.array_sort(T.keywords(F.col("text")))
    return _texts(spark, sf_dir).select("doc_id", F.array_join(found, " ").alias("keywords"), F.size(found).cast("long").alias("n_keywords"))


def keyword_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _texts(spark, sf_dir).where("text is not null")
    n, words = F.size(T.keywords(F.col("text"))).cast("long"), F.greatest(T.n_words(F.col("text")), F.lit(1))
    return docs.select("doc_id", F.floor(n * 1000 / words).cast("long").alias("per_mille"))


def prose_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _texts(spark, sf_dir).where("text is not null").select("doc_id", T.prose_type(F.col("text")).alias("prose_type"))


def signal_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = _exploded(_texts(spark, sf_dir), F.transform(T.lines(F.col("text")), lambda x: T.opening(x)), "low")
    return placed.select("doc_id", "pos", T.opening_signal(F.col("low")).alias("signal")).where("signal is not null")


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _texts(spark, sf_dir).select("doc_id", T.filled(T.lines(F.col("text"))).alias("u")).where(F.size("u") > 0)


def sliding_window_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    last = F.ceil(F.greatest(F.size("u") - 3, F.lit(0)) / 2).cast("int")
    windows = F.transform(F.sequence(F.lit(0), last), lambda i: F.array_join(F.slice("u", i * 2 + 1, 3), "\n\n"))
    return _lines(spark, sf_dir).select("doc_id", F.posexplode(windows).alias("i", "content")).select("doc_id", F.col("i").cast("long").alias("window_index"), "content")


def page_aware_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = F.transform(F.sequence(F.lit(0), F.floor((F.size("u") - 1) / 15).cast("int")), lambda i: F.array_join(F.slice("u", i * 15 + 1, 15), "\n\n"))
    return _lines(spark, sf_dir).select("doc_id", F.posexplode(pages).alias("i", "content")).select("doc_id", F.col("i").cast("long").alias("chunk_index"), "content")


def pack_sentences_1200(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _exploded(_texts(spark, sf_dir), T.pack_sentences(F.col("text")), "content")


def pack_lines_1200(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _exploded(_texts(spark, sf_dir), T.pack_lines(F.col("text")), "content")


def fit_pack_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _exploded(_texts(spark, sf_dir).where("text is not null"), fit_words(F.col("text"), 100), "content")


def conversation_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = read(spark, sf_dir, "conversations")
    return rows.row_windows(turns, ["turn", "role", "text"], F.concat_ws(": ", "role", "text"), 3, 1, ["conv_id"], to_the_end=False, by="\n\n")


def record_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = F.when(F.col("role") == "user", F.col("turn"))
    return rows.as_of(read(spark, sf_dir, "conversations").select("conv_id", "turn", "role"), ["turn"], asked, ["conv_id"], "user_turn")


def csv_row_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows.row_groups(read(spark, sf_dir, "customer"), ["c_custkey"], CUSTOMER, 10)


def csv_values_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows.row_groups(read(spark, sf_dir, "customer"), ["c_custkey"], CUSTOMER, 10, include_headers=False)


def csv_row_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows.row_windows(read(spark, sf_dir, "customer"), ["c_custkey"], rows.render(CUSTOMER), 5, 1)


def csv_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows.markdown_rows(read(spark, sf_dir, "customer"), ["c_custkey"], CUSTOMER)


def category_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows.category_column(read(spark, sf_dir, "customer"), ["c_name", "c_mktsegment"])


def category_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows.row_groups(read(spark, sf_dir, "customer"), ["c_custkey"], CUSTOMER, 10, within=["c_mktsegment"])


def region_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    bands = spark.createDataFrame(BANDS, "lo int, hi int, band string")
    return rows.containing(bands, read(spark, sf_dir, "part").select("p_partkey", "p_size"), "lo", "hi", "p_size", "band")


def ordered_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    heads = docs.select("doc_id", F.lit(0).cast("long").alias("pos"), F.concat_ws("/", "lang", "source").alias("content"))
    return rows.ordered_union("doc_id", heads, _exploded(docs, T.filled(T.lines(F.col("text"))), "content"))


def json_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = F.map_entries(F.from_json("props", "map<string,string>"))
    lines = F.transform(pairs, lambda e: F.concat(F.lit("- **"), e["key"], F.lit(":** "), e["value"]))
    return read(spark, sf_dir, "events").select("event_id", F.array_join(lines, "\n").alias("content"))


def _tags(pattern: str, name: str):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        found = F.regexp_extract_all("html", F.lit(pattern), F.lit(1))
        placed = read(spark, sf_dir, "pages").select("page_id", F.posexplode(found).alias("pos", name))
        return placed.select("page_id", F.col("pos").cast("long").alias("pos"), name)

    return query


TAGS = {"html_headings": (r"(?is)<h1[^>]*>(.*?)</h1>", "heading"), "html_links": (r'(?is)<a\s[^>]*href="([^"]*)"', "href"), "html_list_items": (r"(?is)<li[^>]*>(.*?)</li>", "item")}


def html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "pages").select("page_id", T.html_text(F.col("html")).alias("text"))


def html_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocks_of(read(spark, sf_dir, "pages"), "html", "page_id", "html")


def txt_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocks_of(_paragraphs(spark, sf_dir))


def _mode(mode: str, table: str = "documents", fmt: str = "txt"):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        if table == "pages":
            return chunk_texts(read(spark, sf_dir, "pages"), mode, "html", "page_id", fmt)
        return chunk_texts(_paragraphs(spark, sf_dir), mode, format=fmt)

    return query


def fitted_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Structural chunks of documents fitted to 120 words, those under 40 joined to the next."""
    chunks = chunk_texts(_paragraphs(spark, sf_dir), "structural").drop("parse_error")
    return fit_chunks(chunks, lambda s: len(s.split()), 120, min_tokens=40)


def jsonl_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each row of part as a line of JSON, chunked as a file of one record."""
    part = read(spark, sf_dir, "part").select("p_partkey", F.to_json(F.struct("p_partkey", "p_name", "p_brand", "p_type", "p_size")).alias("line"))
    return chunk_texts(part, "structural", "line", "p_partkey", "jsonl")


QUERIES = {
    f.__name__: f
    for f in (
        sentence_split, sentence_chunks, keyword_tokens, keyword_density, prose_classify, signal_prefix, sliding_window_lines, page_aware_lines, pack_sentences_1200, pack_lines_1200, fit_pack_words, conversation_windows,
        record_asof, csv_row_group, csv_values_only, csv_row_window, csv_markdown, category_column, category_groups, region_containment, ordered_union, json_records, html_text, html_blocks, txt_blocks, fitted_chunks, jsonl_chunks,
    )
}
QUERIES |= {name: _tags(*x) for name, x in TAGS.items()}
QUERIES |= {f"{m}_mode": _mode(m) for m in ("structural", "section", "semantic", "sentence", "sliding_window", "page_aware")}
QUERIES |= {f"html_{m}_mode": _mode(m, "pages", "html") for m in ("structural", "section", "semantic", "sentence", "sliding_window", "page_aware")}
QUERIES |= {"md_structural_mode": _mode("structural", fmt="md"), "md_semantic_mode": _mode("semantic", fmt="md")}
QUERIES |= relation_queries.QUERIES
