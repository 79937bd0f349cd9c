"""DuckDB SQL with the same result as the query of that name."""

from __future__ import annotations

from ..functions.words import BREAKS, NOT_IN_TXT, SIGNALS, STOP_WORDS
from . import mode_sql, relation_queries
from .queries import BANDS, CUSTOMER, TAGS

_AZ = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
_TRIM = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"
_FILLED = "list_filter(list_transform({}, lambda x: " + _TRIM.format("x") + "), lambda x: x <> '')"
_SENTENCES = _FILLED.format(r"string_split(regexp_replace(text, '([.!?])(\s)', '\1' || chr(1) || '\2', 'g'), chr(1))")
_LINES = _FILLED.format("string_split(text, chr(10))")
_STOP = ", ".join(f"'{w}'" for w in STOP_WORDS)
_KEYWORDS = f"list_sort(list_distinct(list_filter(regexp_split_to_array(translate(text, {_AZ}), '[^a-z0-9]+'), lambda w: length(w) >= 4 AND NOT list_contains([{_STOP}], w))))"
_WORDS = r"list_filter(regexp_split_to_array({}, '\s+'), lambda w: w <> '')"
_PARAGRAPH = "chr(10) || chr(10)"


def _placed(array: str, name: str, where: str = "true") -> str:
    return f"WITH d AS (SELECT doc_id, {array} AS a FROM documents WHERE {where}) SELECT doc_id, unnest(range(len(a))) AS pos, unnest(a) AS {name} FROM d"


def _openings() -> str:
    cases = [("break", BREAKS), *((r, [p for p in ps if p not in NOT_IN_TXT]) for r, ps in SIGNALS.items())]
    low = f"translate(line, {_AZ})"
    return "CASE " + " ".join("WHEN " + " OR ".join(f"starts_with({low}, '{p}')" for p in ps) + f" THEN '{r}'" for r, ps in cases) + " END"


def _packed(parts: str, fits: str) -> str:
    """Parts folded from the left: o holds the finished ones, c the one that grows."""
    start = "list_transform({}, lambda s: {{'o': CAST([] AS VARCHAR[]), 'c': s}})".format(parts)
    fold = f"list_reduce({start}, lambda a, x: CASE WHEN {fits} THEN {{'o': a.o, 'c': a.c || sep || x.c}} ELSE {{'o': list_append(a.o, a.c), 'c': x.c}} END)"
    return fold


def _row_groups(names: bool, within: str = "") -> str:
    part = f"PARTITION BY {within}" if within else ""
    cells = " || ' | ' || ".join((f"'{c}: ' || " if names else "") + f"coalesce(CAST({c} AS VARCHAR), '')" for c in CUSTOMER)
    also = f"{within}, " if within else ""
    return f"""
WITH p AS (SELECT {also}row_number() OVER ({part} ORDER BY c_custkey) - 1 AS idx, {cells} AS line FROM customer)
SELECT {also}idx // 10 AS chunk_index, min(idx) + 1 AS row_start, max(idx) + 1 AS row_end, count(*) AS row_count, string_agg(line, chr(10) ORDER BY idx) AS content FROM p GROUP BY {also}idx // 10"""


def _html_text() -> str:
    x = r"regexp_replace(html, '<!--.*?-->', '', 'gs')"
    for tag in ("script", "style", "noscript", "head", "svg", "canvas"):
        x = rf"regexp_replace({x}, '<{tag}\b.*?</{tag}\s*>', '', 'gsi')"
    x = rf"regexp_replace({x}, '<br\s*/?>|</(p|li|tr|h[1-6]|div|ul|ol|table)\s*>', chr(10), 'gi')"
    x = f"regexp_replace({x}, '<[^>]*>', '', 'gs')"
    for entity, plain in (("&nbsp;", " "), ("&copy;", "©"), ("&middot;", "·"), ("&quot;", '"'), ("&lt;", "<"), ("&gt;", ">"), ("&#39;", "''"), ("&amp;", "&")):
        x = f"replace({x}, '{entity}', '{plain}')"
    return rf"SELECT page_id, array_to_string(list_filter(list_transform(string_split({x}, chr(10)), lambda l: trim(regexp_replace(l, '[ \t\r\f]+', ' ', 'g'))), lambda l: l <> ''), chr(10)) AS text FROM pages"


_BANDS = ", ".join(f"({lo}, {hi}, '{b}')" for lo, hi, b in BANDS)

SQL = {
    "sentence_split": _placed(_SENTENCES, "sentence"),
    "sentence_chunks": f"""
WITH d AS (SELECT doc_id, {_SENTENCES} AS s FROM documents), g AS (SELECT doc_id, s, unnest(range((len(s) + 2) // 3)) AS i FROM d)
SELECT doc_id, i AS chunk_index, array_to_string(s[i * 3 + 1:i * 3 + 3], ' ') AS content, len(s[i * 3 + 1:i * 3 + 3]) AS actual_sentence_count FROM g""",
    "keyword_tokens": f"SELECT doc_id, array_to_string({_KEYWORDS}, ' ') AS keywords, len({_KEYWORDS}) AS n_keywords FROM documents",
    "keyword_density": f"SELECT doc_id, len({_KEYWORDS}) * 1000 // greatest(len({_WORDS.format('text')}), 1) AS per_mille FROM documents WHERE text IS NOT NULL",
    "prose_classify": "SELECT doc_id, CASE WHEN strlen(text) > 900 THEN 'long_single_paragraph' WHEN strlen(text) < 90 THEN 'short_disconnected_paragraph' ELSE 'plain_paragraph' END AS prose_type FROM documents WHERE text IS NOT NULL",
    "signal_prefix": f"SELECT * FROM (SELECT doc_id, pos, {_openings()} AS signal FROM ({_placed('string_split(text, chr(10))', 'line')})) WHERE signal IS NOT NULL",
    "sliding_window_lines": f"""
WITH d AS (SELECT doc_id, {_LINES} AS u FROM documents), w AS (SELECT doc_id, u, unnest(range((greatest(len(u) - 3, 0) + 1) // 2 + 1)) AS i FROM d WHERE len(u) > 0)
SELECT doc_id, i AS window_index, array_to_string(u[i * 2 + 1:i * 2 + 3], {_PARAGRAPH}) AS content FROM w""",
    "page_aware_lines": f"""
WITH d AS (SELECT doc_id, {_LINES} AS u FROM documents), w AS (SELECT doc_id, u, unnest(range((len(u) + 14) // 15)) AS i FROM d)
SELECT doc_id, i AS chunk_index, array_to_string(u[i * 15 + 1:i * 15 + 15], {_PARAGRAPH}) AS content FROM w""",
    "pack_sentences_1200": f"""
WITH d AS (SELECT doc_id, text, {_packed(_SENTENCES, "strlen(a.c) + 1 + strlen(x.c) <= 1200").replace('sep', "' '")} AS f FROM documents WHERE strlen(text) > 1200),
a AS (SELECT doc_id, list_append(f.o, f.c) AS a FROM d UNION ALL SELECT doc_id, [{_TRIM.format('text')}] FROM documents WHERE strlen(text) <= 1200)
SELECT doc_id, unnest(range(len(a))) AS pos, unnest(a) AS content FROM a""",
    "pack_lines_1200": f"""
WITH d AS (SELECT doc_id, text, {_packed("string_split(text, chr(10))", "length(a.c) + 1 + length(x.c) <= 1199").replace('sep', "chr(10)")} AS f FROM documents WHERE length(text) > 1200),
a AS (SELECT doc_id, list_append(f.o, f.c) AS a FROM d UNION ALL SELECT doc_id, [text] FROM documents WHERE length(text) <= 1200)
SELECT doc_id, unnest(range(len(a))) AS pos, unnest(a) AS content FROM a""",
    "fit_pack_words": rf"""
WITH p AS (SELECT doc_id, text, list_filter(list_transform(string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: x), lambda x: trim(x) <> '') AS s FROM documents WHERE len({_WORDS.format('text')}) > 100),
d AS (SELECT doc_id, list_reduce(list_transform(s, lambda y: {{'o': CAST([] AS VARCHAR[]), 'c': y, 'n': len({_WORDS.format('y')})}}),
      lambda a, x: CASE WHEN a.n + x.n <= 100 THEN {{'o': a.o, 'c': a.c || ' ' || x.c, 'n': a.n + x.n}} ELSE {{'o': list_append(a.o, a.c), 'c': x.c, 'n': x.n}} END) AS f FROM p),
q AS (SELECT doc_id, flatten(list_transform(list_append(f.o, f.c), lambda x: CASE WHEN len({_WORDS.format('x')}) <= 100 THEN [x]
      ELSE list_transform(range((len({_WORDS.format('x')}) + 99) // 100), lambda i: array_to_string(({_WORDS.format('x')})[i * 100 + 1:i * 100 + 100], ' ')) END)) AS a FROM d
      UNION ALL SELECT doc_id, [text] FROM documents WHERE len({_WORDS.format('text')}) <= 100)
SELECT doc_id, unnest(range(len(a))) AS pos, unnest(a) AS content FROM q""",
    "conversation_windows": f"""
WITH p AS (SELECT conv_id, concat_ws(': ', role, text) AS line, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) - 1 AS idx, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations),
w AS (SELECT conv_id, unnest(range((greatest(n - 3, 0) + 1) // 2 + 1)) AS window_index FROM (SELECT DISTINCT conv_id, n FROM p))
SELECT w.conv_id, window_index, min(idx) + 1 AS row_start, max(idx) + 1 AS row_end, count(*) AS row_count, string_agg(line, {_PARAGRAPH} ORDER BY idx) AS content
FROM w JOIN p ON w.conv_id IS NOT DISTINCT FROM p.conv_id AND idx >= 2 * window_index AND idx < 2 * window_index + 3 GROUP BY w.conv_id, window_index""",
    "record_asof": "SELECT conv_id, turn, role, last_value(CASE WHEN role = 'user' THEN turn END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS user_turn FROM conversations",
    "csv_row_group": _row_groups(True),
    "csv_values_only": _row_groups(False),
    "csv_row_window": f"""
WITH p AS (SELECT row_number() OVER (ORDER BY c_custkey) - 1 AS idx, {" || ' | ' || ".join(f"'{c}: ' || coalesce(CAST({c} AS VARCHAR), '')" for c in CUSTOMER)} AS line FROM customer),
w AS (SELECT unnest(range((count(*) + 3) // 4)) AS window_index FROM p)
SELECT window_index, min(idx) + 1 AS row_start, max(idx) + 1 AS row_end, count(*) AS row_count, string_agg(line, chr(10) ORDER BY idx) AS content FROM w JOIN p ON idx >= 4 * window_index AND idx < 4 * window_index + 5 GROUP BY window_index""",
    "csv_markdown": f"""
SELECT 0 AS line_no, '| {" | ".join(CUSTOMER)} |' AS line UNION ALL SELECT 1, '| {" | ".join(["---"] * len(CUSTOMER))} |'
UNION ALL SELECT row_number() OVER (ORDER BY c_custkey) + 1, '| ' || concat_ws(' | ', {", ".join(f"replace(coalesce(CAST({c} AS VARCHAR), ''), '|', chr(92) || '|')" for c in CUSTOMER)}) || ' |' FROM customer""",
    "category_column": "SELECT name, n FROM (SELECT 'c_name' AS name, 0 AS i, count(DISTINCT c_name) AS n, count(c_name) AS m FROM customer UNION ALL SELECT 'c_mktsegment', 1, count(DISTINCT c_mktsegment), count(c_mktsegment) FROM customer) WHERE n < m ORDER BY n, i LIMIT 1",
    "category_groups": _row_groups(True, "c_mktsegment"),
    "region_containment": f"SELECT p_partkey, p_size, (SELECT band FROM (VALUES {_BANDS}) r(lo, hi, band) WHERE lo <= p_size AND hi >= p_size ORDER BY lo, band LIMIT 1) AS band FROM part",
    "ordered_union": f"""
WITH b AS ({_placed(_LINES, 'content')}), u AS (SELECT doc_id, 0 AS part, 0 AS pos, concat_ws('/', lang, source) AS content FROM documents UNION ALL SELECT doc_id, 1, pos, content FROM b)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY part, pos) - 1 AS chunk_index, content FROM u""",
    "json_records": "SELECT event_id, array_to_string(list_transform(json_keys(props), lambda k: '- **' || k || ':** ' || (props ->> k)), chr(10)) AS content FROM events",
    "html_text": _html_text(),
}
for _name, (_pattern, _column) in TAGS.items():
    SQL[_name] = f"WITH d AS (SELECT page_id, regexp_extract_all(html, '{_pattern}', 1) AS a FROM pages) SELECT page_id, unnest(range(len(a))) AS pos, unnest(a) AS {_column} FROM d"
SQL |= mode_sql.SQL | relation_queries.SQL
