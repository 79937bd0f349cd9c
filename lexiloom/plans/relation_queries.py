"""Queries of the relational and text operators of chunks, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import splits as S
from ..functions import text as T
from ..functions.words import PROSE_MAX, STOP_WORDS
from ..operators import relations as R
from .mode_sql import _SENTENCES, _TRIMMED, _fold


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _split(array, name: str):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        placed = read(spark, sf_dir, "documents").select("doc_id", F.posexplode(array(F.col("text"))).alias("pos", name))
        return placed.select("doc_id", F.col("pos").cast("long").alias("pos"), name)

    return query


def _exploded(array: str, name: str) -> str:
    return f"WITH d AS (SELECT doc_id, {array} AS a FROM documents) SELECT doc_id, unnest(range(len(a))) AS pos, unnest(a) AS {name} FROM d"


# splitters

md_sentences = _split(S.md_sentences_column, "sentence")
marked_sentences = _split(S.marked_sentences_column, "sentence")
_TITLES = "|".join(t.replace(".", "") for t in S.MD_TITLES)
_KEPT = rf"regexp_replace(regexp_replace(regexp_replace(text, '([A-Za-z]\.\.[A-Za-z])\.', '\1' || chr(2), 'g'), '((?i:{_TITLES}))\.', '\1' || chr(2), 'g'), '(^|\s)([0-9]+)\.', '\1\2' || chr(2), 'g')"
_MD = rf"list_filter(list_transform(string_split(regexp_replace({_KEPT}, '([.?!]) (\p{{Lu}})', '\1' || chr(1) || '\2', 'g'), chr(1)), lambda x: {_TRIMMED.format(r"regexp_replace(replace(x, chr(2), '.'), '\s+', ' ', 'g')")}), lambda x: x <> '')"
_MARKED = f"list_filter(list_transform(regexp_extract_all(text, '[^.!?]*[.!?]|[^.!?]+$'), lambda x: {_TRIMMED.format('x')}), lambda x: x <> '')"

#: Bytes of the packed runs of sentences that word-processor files are cut into.
DOCX_RUN = 900
pack_marked_900 = _split(lambda c: F.when(F.octet_length(c) <= DOCX_RUN, F.array(T.trim(c))).otherwise(T.pack(S.marked_sentences_column(c), DOCX_RUN)), "content")
pack_paragraphs_1200 = _split(lambda c: T.filled(T.pack(T.lines(c), PROSE_MAX, "\n\n")), "content")


def _packed(parts: str, limit: int, joiner: str, width: int, where: str, more: str = "") -> str:
    return f"""
WITH d AS (SELECT doc_id, {_fold(parts, f'strlen(a.c) + {width} + strlen(x.c) <= {limit}', joiner)} AS f FROM documents WHERE {where}),
a AS (SELECT doc_id, list_filter(list_transform(list_append(f.o, f.c), lambda x: {_TRIMMED.format('x')}), lambda x: x <> '') AS a FROM d{more})
SELECT doc_id, unnest(range(len(a))) AS pos, unnest(a) AS content FROM a"""


def byte_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", S.floor_boundary_column(F.col("text"), 101).alias("head"))


def content_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The name that a document's text would have as content."""
    return read(spark, sf_dir, "pages").select("page_id", S.content_hash_column(F.encode("url", "UTF-8")).alias("name"))


def density(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", T.keyword_density(F.col("text")).alias("density"))


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")


def keyword_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each turn and the same conversation's next one: shared keywords, all of both, and whether any is shared."""
    turns = _turns(spark, sf_dir).select("conv_id", "turn", T.keywords(F.col("text")).alias("k"))
    after = turns.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("k").alias("l"))
    both = turns.join(after, ["conv_id", "turn"])
    joined = lambda a: F.array_join(F.array_sort(a), " ")
    return both.select("conv_id", "turn", joined(F.array_intersect("k", "l")).alias("shared"), joined(F.array_union("k", "l")).alias("either"), F.arrays_overlap("k", "l").alias("overlaps"))


# relations


def note_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels as the notes of documents; documents without one are dropped."""
    return R.resolve_notes(read(spark, sf_dir, "documents").select("doc_id", "lang"), read(spark, sf_dir, "labels").select("doc_id", "quality"), ["doc_id"])


def fact_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.look_up(read(spark, sf_dir, "documents").select("doc_id", "source"), read(spark, sf_dir, "labels").select("doc_id", "toxic"), ["doc_id"])


def unknown_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.unknown_names(read(spark, sf_dir, "documents").select("doc_id"), read(spark, sf_dir, "labels"), "doc_id")


def first_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.first_by(read(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderstatus"), ["o_custkey"], ["o_orderkey"])


def primary_reason(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.most_common(read(spark, sf_dir, "documents"), ["source"], "lang")


def top_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.top_k(read(spark, sf_dir, "part"), ["p_brand"], "p_type", 3).select("p_brand", "place", "p_type", "n")


def group_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.group_quality(read(spark, sf_dir, "documents"), ["lang"], F.length("text").cast("long"))


def turn_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.with_totals(_turns(spark, sf_dir).drop("text"), "conv_id", "total_turns")


def page_counter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of users end a page."""
    return R.page_numbers(_turns(spark, sf_dir).drop("text"), ["conv_id"], ["turn"], F.col("role") == "user")


def break_promotion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of users are kept; a long turn breaks the page."""
    return R.promote_breaks(_turns(spark, sf_dir), ["conv_id"], ["turn"], F.length("text") > 200, F.col("role") == "user").drop("text")


def title_back_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.filled_both_ways(_turns(spark, sf_dir).drop("text"), ["conv_id"], ["turn"], F.when(F.col("role") == "assistant", F.col("turn")), "title")


def widest_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.widest_so_far(_turns(spark, sf_dir), ["conv_id"], ["turn"], F.length("text").cast("long")).drop("text")


def non_empty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that are not empty and, as prose, not shorter than 20 bytes."""
    lines = read(spark, sf_dir, "documents").select("doc_id", F.explode(T.filled(T.lines(F.col("text")))).alias("line"))
    return lines.where(F.octet_length("line") >= 20)


def ansi_stripped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments, put in colours, without them."""
    coloured = F.concat(F.lit("\x1b[1;31m"), "c_mktsegment", F.lit("\x1b[0m"), F.lit("\x1b[2K"), "c_name")
    return read(spark, sf_dir, "customer").select("c_custkey", T.strip_ansi(coloured).alias("plain"))


def front_matter(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = F.concat(F.lit("---\ntitle: "), "source", F.lit("\n---\n\n"), F.substring("text", 1, 80))
    return read(spark, sf_dir, "documents").select("doc_id", T.strip_front_matter(made).alias("body"))


_STOP = ", ".join(f"'{w}'" for w in STOP_WORDS)


def _keywords(text: str) -> str:
    low = f"translate({text}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"list_distinct(list_filter(regexp_split_to_array({low}, '[^a-z0-9]+'), lambda w: length(w) >= 4 AND NOT list_contains([{_STOP}], w)))"


def _words(text: str) -> str:
    return rf"list_filter(regexp_split_to_array({text}, '\s+'), lambda w: w <> '')"


QUERIES = {
    "md_sentences": md_sentences, "marked_sentences": marked_sentences, "pack_marked_900": pack_marked_900, "pack_paragraphs_1200": pack_paragraphs_1200,
    **{f.__name__: f for f in (byte_cut, content_names, density, keyword_overlap, note_join, fact_lookup, unknown_names, first_wins, primary_reason, top_reasons, group_quality, turn_totals, page_counter, break_promotion, title_back_fill, widest_row, non_empty, ansi_stripped, front_matter)},
}

_SPAN = "(PARTITION BY conv_id ORDER BY turn)"
_BEFORE = "(PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"

SQL = {
    "md_sentences": _exploded(_MD, "sentence"),
    "marked_sentences": _exploded(_MARKED, "sentence"),
    "pack_marked_900": _packed(_MARKED, DOCX_RUN, "' '", 1, f"strlen(text) > {DOCX_RUN}", f" UNION ALL SELECT doc_id, [{_TRIMMED.format('text')}] FROM documents WHERE strlen(text) <= {DOCX_RUN}"),
    "pack_paragraphs_1200": _packed("string_split(text, chr(10))", PROSE_MAX, "chr(10) || chr(10)", 2, "true"),
    "byte_cut": "SELECT doc_id, CASE WHEN strlen(text) <= 101 THEN text ELSE left(text, CAST(list_max(list_filter(range(0, 102), lambda i: strlen(left(text, i)) <= 101)) AS BIGINT)) END AS head FROM documents",
    "content_names": f"""
SELECT page_id, CASE WHEN url IS NOT NULL THEN lpad(lower(to_hex(CAST(list_reduce(list_prepend(CAST({S.FNV_OFFSET} AS HUGEINT), list_transform(range(1, strlen(url) + 1), lambda i: CAST(('0x' || substr(hex(encode(url)), 2 * i - 1, 2))::INTEGER AS HUGEINT))),
    lambda h, b: (xor(h, b) * {S.FNV_PRIME}) % 18446744073709551616) AS UBIGINT))), 16, '0') END AS name FROM pages""",
    "density": f"SELECT doc_id, round(len({_keywords('text')}) / greatest(len({_words('text')}), 1), 3) AS density FROM documents",
    "keyword_overlap": f"""
WITH k AS (SELECT conv_id, turn, {_keywords('text')} AS k FROM conversations)
SELECT a.conv_id, a.turn, array_to_string(list_sort(list_intersect(a.k, b.k)), ' ') AS shared, array_to_string(list_sort(list_distinct(list_concat(a.k, b.k))), ' ') AS either, list_has_any(a.k, b.k) AS overlaps FROM k a JOIN k b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1""",
    "note_join": "SELECT doc_id, lang, quality FROM documents JOIN labels USING (doc_id)",
    "fact_lookup": "SELECT doc_id, source, toxic FROM documents LEFT JOIN labels USING (doc_id)",
    "unknown_names": "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL)",
    "first_wins": "SELECT o_custkey, o_orderkey, o_orderstatus FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS r FROM orders) WHERE r = 1",
    "primary_reason": "SELECT source, lang, n FROM (SELECT source, lang, count(*) AS n, row_number() OVER (PARTITION BY source ORDER BY count(*) DESC, lang) AS r FROM documents WHERE lang IS NOT NULL GROUP BY source, lang) WHERE r = 1",
    "top_reasons": "SELECT p_brand, place, p_type, n FROM (SELECT p_brand, p_type, count(*) AS n, row_number() OVER (PARTITION BY p_brand ORDER BY count(*) DESC, p_type) AS place FROM part GROUP BY p_brand, p_type) WHERE place <= 3",
    "group_quality": "SELECT lang, count(*) AS n, min(length(text)) AS lo, max(length(text)) AS hi, list_sort(list(length(text)))[count(*) // 2 + 1] AS median FROM documents WHERE text IS NOT NULL GROUP BY lang",
    "turn_totals": "SELECT conv_id, turn, role, count(*) OVER (PARTITION BY conv_id) AS total_turns FROM conversations",
    "page_counter": f"SELECT conv_id, turn, role, CAST(1 + coalesce(sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER {_BEFORE}, 0) AS BIGINT) AS page FROM conversations",
    "break_promotion": f"""
WITH i AS (SELECT *, sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER {_SPAN} AS island FROM conversations),
m AS (SELECT *, max(coalesce(length(text) > 200, false)) OVER (PARTITION BY conv_id, island) AS page_break FROM i)
SELECT conv_id, turn, role, page_break FROM m WHERE role = 'user'""",
    "title_back_fill": f"""
SELECT conv_id, turn, role, coalesce(last_value(CASE WHEN role = 'assistant' THEN turn END IGNORE NULLS) OVER {_SPAN},
    first_value(CASE WHEN role = 'assistant' THEN turn END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS title FROM conversations""",
    "widest_row": f"SELECT conv_id, turn, role, max(length(text)) OVER {_SPAN} AS widest FROM conversations",
    "non_empty": f"SELECT * FROM (SELECT doc_id, unnest(list_transform(string_split(text, chr(10)), lambda x: {_TRIMMED.format('x')})) AS line FROM documents) WHERE strlen(line) >= 20",
    "ansi_stripped": "SELECT c_custkey, c_mktsegment || c_name AS plain FROM customer",
    "front_matter": "SELECT doc_id, CASE WHEN source IS NOT NULL THEN ltrim(left(text, 80), chr(10)) END AS body FROM documents",
    "jsonl_chunks": """
SELECT p_partkey, CAST(0 AS INTEGER) AS chunk_index, 'bullet_list' AS content_type, array_to_string(list_filter(['- p_partkey: ' || p_partkey, '- p_name: ' || p_name, '- p_brand: ' || p_brand, '- p_type: ' || p_type, '- p_size: ' || p_size], lambda x: x IS NOT NULL), chr(10)) AS content,
    '{"section_heading": null, "document_metadata": {"source_type": "jsonl", "record_count": 1, "top_level": "lines", "envelope_key": null}, "record_range": [1, 1]}' AS metadata, CAST(NULL AS VARCHAR) AS parse_error FROM part""",
}
