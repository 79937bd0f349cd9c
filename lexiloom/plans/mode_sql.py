"""DuckDB SQL of the prose modes over plain text whose every line is a paragraph: an independent statement of their rules."""

from __future__ import annotations

import re

from ..functions.words import COMMANDS, PROSE_MAX, PROSE_MIN, SECTION_MAX

_TRIMMED = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"
_PROSE = "('plain_paragraph', 'long_single_paragraph', 'short_disconnected_paragraph')"
_SENTENCES = (
    r"list_filter(list_transform(string_split(regexp_replace({0}, '([.!?])(\s)', '\1' || chr(1) || '\2', 'g'), chr(1)), lambda y: " + _TRIMMED.format("y") + "), lambda y: y <> '')"
)


def _block_type(x: str) -> str:
    commands = "|".join(re.escape(c).replace("\\ ", " ") for c in COMMANDS)
    letters = rf"regexp_replace({x}, '[^\p{{L}}]', '', 'g')"
    return rf"""CASE
    WHEN starts_with({x}, '```') OR (({x} = '{{' OR starts_with({x}, '{{"')) AND suffix({x}, '}}')) OR regexp_matches({x}, '^#*\s*({commands})') THEN 'code_block'
    WHEN starts_with({x}, '# ') OR starts_with({x}, '## ') OR (length({letters}) >= 3 AND {letters} = upper({letters}) AND strlen({x}) <= 80 AND NOT contains({x}, '|')
        AND NOT (starts_with({x}, '***') AND suffix({x}, '***')) AND NOT regexp_full_match({x}, '[IVXLCDM]+\.') AND NOT regexp_matches({x}, '[;,]$')) THEN 'heading'
    WHEN regexp_matches({x}, '^(?s:[-*+] |\[[xX ]\]|[0-9]{{1,3}}[.)].|[A-Za-z][).].)') THEN 'bullet_list'
    WHEN strlen({x}) > 500 THEN 'long_single_paragraph' WHEN strlen({x}) < 80 THEN 'short_disconnected_paragraph' ELSE 'plain_paragraph' END"""


def _fold(parts: str, fits: str, joiner: str) -> str:
    """Parts folded from the left into a list of strings."""
    start = f"list_transform({parts}, lambda s: {{'o': CAST([] AS VARCHAR[]), 'c': s}})"
    return f"list_reduce({start}, lambda a, x: CASE WHEN {fits} THEN {{'o': a.o, 'c': a.c || {joiner} || x.c}} ELSE {{'o': list_append(a.o, a.c), 'c': x.c}} END)"


_PROSE_TYPE = "CASE WHEN strlen({0}) > 900 THEN 'long_single_paragraph' WHEN strlen({0}) < 90 THEN 'short_disconnected_paragraph' ELSE 'plain_paragraph' END"
_PACKED = _fold(_SENTENCES.format("line"), f"strlen(a.c) + 1 + strlen(x.c) <= {PROSE_MAX}", "' '")

#: Blocks b: doc_id, i, type, content, level, title, with the headings above them (h, path as JSON) and the document's number of blocks n.
BLOCKS = f"""
WITH RECURSIVE line AS (SELECT doc_id, unnest(range(len(u))) AS pos, unnest(u) AS line FROM (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: {_TRIMMED.format('x')}), lambda x: x <> '') AS u FROM documents)),
typed AS (SELECT *, {_block_type('line')} = 'code_block' OR length(line) <= {PROSE_MAX} AS whole FROM line),
packed AS (SELECT doc_id, pos, list_append(f.o, f.c) AS a FROM (SELECT doc_id, pos, {_PACKED} AS f FROM typed WHERE NOT whole)),
piece AS (SELECT doc_id, pos, unnest(range(len(a))) AS k, unnest(a) AS rest FROM packed),
hard AS (SELECT doc_id, pos, k, 0 AS m, '' AS out, rest FROM piece
    UNION ALL SELECT doc_id, pos, k, m + 1, CASE WHEN length(rest) > {PROSE_MAX} THEN rtrim(left(rest, place)) ELSE rest END, CASE WHEN length(rest) > {PROSE_MAX} THEN ltrim(substr(rest, place + 1)) ELSE '' END
    FROM (SELECT *, CASE WHEN regexp_matches(left(rest, {PROSE_MAX}), '^.+\\s') THEN length(regexp_extract(left(rest, {PROSE_MAX}), '^(.+)\\s', 1)) ELSE {PROSE_MAX} END AS place FROM hard WHERE rest <> '')),
part AS (SELECT doc_id, pos, 0 AS k, 0 AS m, line AS content FROM typed WHERE whole UNION ALL SELECT doc_id, pos, k, m, out FROM hard WHERE trim(out) <> ''),
flat AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY pos, k, m) - 1 AS i, {_block_type('content')} AS type, content FROM part),
lev AS (SELECT *, CASE WHEN type <> 'heading' THEN 0 WHEN starts_with(content, '# ') THEN 1 ELSE 2 END AS level,
    CASE WHEN type <> 'heading' THEN NULL WHEN starts_with(content, '#') THEN {_TRIMMED.format("ltrim(content, '#')")} ELSE content END AS title FROM flat),
seen AS (SELECT *, count(*) OVER (PARTITION BY doc_id) AS n, last_value(title IGNORE NULLS) OVER w AS h, last_value(CASE WHEN level = 1 THEN title END IGNORE NULLS) OVER w AS h1, last_value(CASE WHEN level = 2 THEN title END IGNORE NULLS) OVER w AS h2,
    max(CASE WHEN level = 1 THEN i END) OVER w AS i1, max(CASE WHEN level = 2 THEN i END) OVER w AS i2 FROM lev WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
b AS (SELECT *, CASE WHEN h IS NULL THEN NULL WHEN coalesce(i2, -1) > coalesce(i1, -1) THEN 2 ELSE 1 END AS at_level, coalesce(CAST(to_json(h) AS VARCHAR), 'null') AS jh,
    '[' || concat_ws(', ', CASE WHEN i1 IS NOT NULL THEN CAST(to_json(h1) AS VARCHAR) END, CASE WHEN i2 > coalesce(i1, -1) THEN CAST(to_json(h2) AS VARCHAR) END) || ']' AS path FROM seen)
"""


def _numbered(rows: str, order: str) -> str:
    """Chunks with their number and the document's facts as the last of their metadata. rows: doc_id, n, content_type, content, meta and what order needs."""
    number = f"row_number() OVER (PARTITION BY doc_id ORDER BY {order}) - 1"
    facts = """', "chunk_index": ' || chunk_index || ', "document_metadata": {"source_type": "txt", "total_input_blocks": ' || n || '}}'"""
    return f"""SELECT doc_id, CAST(chunk_index AS INTEGER) AS chunk_index, content_type, content, meta || {facts} AS metadata, CAST(NULL AS VARCHAR) AS parse_error FROM (SELECT *, {number} AS chunk_index FROM ({rows}))"""


_HEADING = """SELECT doc_id, n, i AS g, 0 AS j, 'heading' AS content_type, title AS content, '{"section_heading": ' || jh || ', "section_level": ' || level || ', "heading_path": ' || path AS meta FROM b WHERE type = 'heading'"""

SENTENCE = BLOCKS + f""",
s AS (SELECT *, max(CASE WHEN type IN ('heading', 'code_block') THEN i END) OVER w AS g, count(CASE WHEN type <> 'heading' THEN 1 END) OVER w - 1 AS number FROM b WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
u AS (SELECT *, unnest(range(len(us))) AS k, unnest(us) AS sentence FROM (SELECT *, CASE WHEN type = 'bullet_list' THEN [content] ELSE {_SENTENCES.format('content')} END AS us FROM s WHERE type NOT IN ('heading', 'code_block'))),
o AS (SELECT *, (row_number() OVER (PARTITION BY doc_id, g ORDER BY i, k) - 1) // 3 AS c FROM u),
q AS (SELECT doc_id, any_value(n) AS n, coalesce(g, -1) AS g, 1 + c AS j, 'sentence' AS content_type, string_agg(sentence, ' ' ORDER BY i, k) AS content,
    '{{"sentences_per_chunk": 3, "actual_sentence_count": ' || count(*) || ', "source_paragraph_index": ' || min(number) || ', "section_heading": ' || arg_min(jh, i) || ', "heading_path": ' || arg_min(path, i) AS meta FROM o GROUP BY doc_id, g, c),
z AS ({_HEADING} UNION ALL SELECT doc_id, n, i, 0, type, content, '{{"section_heading": ' || jh || ', "heading_path": ' || path FROM b WHERE type = 'code_block' UNION ALL SELECT * FROM q)
{_numbered('SELECT * FROM z', 'g, j')}"""

SLIDING_WINDOW = BLOCKS + f""",
w AS (SELECT DISTINCT doc_id, n, unnest(range((greatest(n - 3, 0) + 1) // 2 + 1)) AS w FROM b),
q AS (SELECT w.doc_id, w.n AS n, w, 'sliding_window' AS content_type, string_agg(coalesce(title, content), chr(10) || chr(10) ORDER BY i) AS content,
    '{{"window_size": 3, "overlap": 1, "window_index": ' || w || ', "paragraph_range": [' || min(i) || ', ' || max(i) || '], "section_heading": ' || arg_min(jh, i) || ', "heading_path": ' || arg_min(path, i) || ', "paragraph_count": ' || count(*) AS meta
    FROM w JOIN b ON w.doc_id = b.doc_id AND i >= 2 * w AND i < 2 * w + 3 GROUP BY w.doc_id, w.n, w)
{_numbered('SELECT * FROM q', 'w')}"""

PAGE_AWARE = BLOCKS + f""",
r AS (SELECT *, coalesce(max(CASE WHEN type = 'heading' THEN i END) OVER (PARTITION BY doc_id ORDER BY i), -1) AS g FROM b),
o AS (SELECT *, (row_number() OVER (PARTITION BY doc_id, g ORDER BY i) - 1) // 15 AS c FROM r WHERE type <> 'heading'),
q AS (SELECT doc_id, any_value(n) AS n, g, 1 + c AS j, 'page_aware' AS content_type, string_agg(content, chr(10) || chr(10) ORDER BY i) AS content,
    '{{"page_break_type": "' || CASE WHEN c = 0 AND g >= 0 THEN 'heading_boundary' ELSE 'estimated' END || '", "paragraph_count": ' || count(*) || ', "section_heading": ' || arg_min(jh, i) || ', "heading_path": ' || arg_min(path, i) AS meta FROM o GROUP BY doc_id, g, c),
z AS (SELECT doc_id, n, i AS g, 0 AS j, 'heading' AS content_type, title AS content, '{{"page_break_type": "heading_boundary", "paragraph_count": 0, "section_heading": ' || jh || ', "section_level": ' || level || ', "heading_path": ' || path AS meta FROM b WHERE type = 'heading' UNION ALL SELECT * FROM q)
{_numbered('SELECT * FROM z', 'g, j')}"""

#: What stands under a heading, in parts: each block goes on with the part (c) or begins one; used counts bytes, held blocks.
SECTION = BLOCKS + f""",
r AS (SELECT *, coalesce(max(CASE WHEN type = 'heading' THEN i END) OVER (PARTITION BY doc_id ORDER BY i), -1) AS g FROM b),
k AS (SELECT doc_id, g, list({{'i': i, 's': strlen(content)}} ORDER BY i) AS l FROM r WHERE type <> 'heading' GROUP BY doc_id, g),
f AS (SELECT doc_id, g, list_reduce(list_transform(l, lambda x: {{'starts': [x.i], 'used': x.s, 'held': 1}}), lambda a, x: CASE WHEN a.used + 2 * (a.held - 1) + x.used + 2 > {SECTION_MAX}
    THEN {{'starts': list_append(a.starts, x.starts[1]), 'used': x.used, 'held': 1}} ELSE {{'starts': a.starts, 'used': a.used + x.used, 'held': a.held + 1}} END) AS f FROM k),
o AS (SELECT r.*, len(list_filter(f.f.starts, lambda x: x <= r.i)) AS c FROM r JOIN f ON r.doc_id = f.doc_id AND r.g = f.g WHERE type <> 'heading'),
d AS (SELECT *, CASE WHEN type = 'bullet_list' THEN 'list' WHEN type = 'code_block' THEN type ELSE 'paragraph' END AS kind FROM o),
e AS (SELECT doc_id, g, c, kind, min(i) AS first FROM d GROUP BY doc_id, g, c, kind),
kinds AS (SELECT doc_id, g, c, '["' || string_agg(kind, '", "' ORDER BY first) || '"]' AS kinds FROM e GROUP BY doc_id, g, c),
q AS (SELECT doc_id, any_value(n) AS n, g, c AS j, 'section' AS content_type, {_TRIMMED.format("string_agg(content, chr(10) || chr(10) ORDER BY i)")} AS content, CASE WHEN g < 0 THEN '"Preamble"' ELSE arg_min(jh, i) END AS jh,
    coalesce(arg_min(at_level, i), 0) AS lv, arg_min(path, i) AS path, count(CASE WHEN kind <> 'code_block' THEN 1 END) AS m FROM d GROUP BY doc_id, g, c),
z AS (SELECT doc_id, n, i AS g, 0 AS j, 'heading' AS content_type, title AS content, '{{"section_heading": ' || jh || ', "section_level": ' || level || ', "heading_path": ' || path || ', "paragraph_count": 0, "block_types": ["heading"], "char_count": ' || strlen(title) AS meta FROM b WHERE type = 'heading'
    UNION ALL SELECT doc_id, n, g, j, content_type, content, '{{"section_heading": ' || jh || ', "section_level": ' || lv || ', "heading_path": ' || path || ', "paragraph_count": ' || m || ', "block_types": ' || kinds || ', "char_count": ' || strlen(content) || ', "split_part": null, "split_total": null' FROM q JOIN kinds k USING (doc_id, g) WHERE k.c = j)
{_numbered('SELECT * FROM z', 'g, j')}"""

_META = """'{"section_heading": ' || coalesce({0}, 'null') || ', "footnotes_captions": [], "page_number": null, "document_metadata": {"source_type": "txt"}}'"""

STRUCTURAL = BLOCKS + f""",
r AS (SELECT *, coalesce(max(CASE WHEN type NOT IN {_PROSE} THEN i END) OVER (PARTITION BY doc_id ORDER BY i), -1) AS g FROM b),
s AS (SELECT doc_id, g, i, jh, unnest(range(len(a))) AS k, unnest(a) AS content FROM (SELECT *, CASE WHEN strlen(content) > {PROSE_MAX} THEN list_append(f.o, f.c) ELSE [content] END AS a
    FROM (SELECT doc_id, g, i, jh, content, {_PACKED.replace('line', 'content')} AS f FROM r WHERE type IN {_PROSE}))),
l AS (SELECT doc_id, g, arg_min(jh, i) AS jh, list(content ORDER BY i, k) AS l FROM s GROUP BY doc_id, g),
p AS (SELECT doc_id, g, jh, unnest(range(len(a))) + 1 AS j, unnest(a) AS content FROM (SELECT doc_id, g, jh, list_append(f.o, f.c) AS a FROM (SELECT doc_id, g, jh, {_fold('l', f"strlen(a.c) + 1 + strlen(x.c) + 1 <= {PROSE_MAX}", 'chr(10)')} AS f FROM l))),
z AS (SELECT doc_id, g, j, {_PROSE_TYPE.format('content')} AS type, content, jh, true AS prose FROM (SELECT doc_id, g, j, {_TRIMMED.format('content')} AS content, jh FROM p) WHERE content <> ''
    UNION ALL SELECT doc_id, i, 0, type, coalesce(title, content), CASE WHEN type = 'heading' THEN NULL ELSE jh END, false FROM b WHERE type NOT IN {_PROSE}),
v AS (SELECT doc_id, list({{'type': type, 'content': content, 'jh': jh, 'prose': prose}} ORDER BY g, j) AS l FROM z GROUP BY doc_id),
m AS (SELECT doc_id, list_reduce(list_transform(l, lambda s: {{'o': list_filter([s], lambda q: false), 'c': s}}), lambda a, x: CASE WHEN a.c.prose AND x.c.prose AND strlen(x.c.content) < {PROSE_MIN} AND strlen(a.c.content) + strlen(x.c.content) < {PROSE_MAX + PROSE_MIN}
    THEN {{'o': a.o, 'c': {{'type': a.c.type, 'content': a.c.content || chr(10) || x.c.content, 'jh': a.c.jh, 'prose': true}}}} ELSE {{'o': list_append(a.o, a.c), 'c': x.c}} END) AS f FROM v),
y AS (SELECT doc_id, unnest(range(len(a))) AS chunk_index, unnest(a) AS c FROM (SELECT doc_id, list_append(f.o, f.c) AS a FROM m))
SELECT doc_id, CAST(chunk_index AS INTEGER) AS chunk_index, CASE WHEN c.prose THEN {_PROSE_TYPE.format('c.content')} ELSE c.type END AS content_type, c.content AS content, {_META.replace('{0}', 'c.jh')} AS metadata, CAST(NULL AS VARCHAR) AS parse_error FROM y"""

SQL = {
    "txt_blocks": BLOCKS + "SELECT doc_id, CAST(i AS INTEGER) AS block_index, type AS block_type, content, CAST(level AS INTEGER) AS level FROM b",
    "sentence_mode": SENTENCE,
    "sliding_window_mode": SLIDING_WINDOW,
    "page_aware_mode": PAGE_AWARE,
    "section_mode": SECTION,
    "structural_mode": STRUCTURAL,
}
