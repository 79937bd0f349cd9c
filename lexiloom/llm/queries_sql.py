"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from .quality_rules import POLICIES, RULES, mask

_HOST = "translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

URL_FILTER = f"""
WITH u AS (SELECT page_id, CASE WHEN strpos(coalesce(url, ''), '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, {_HOST} AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
r AS (SELECT *, CASE
    WHEN (host = 'example.net' OR host LIKE '%.example.net') AND path LIKE '/en/%' THEN 'example.net/en/'
    WHEN (host = 'example.com' OR host LIKE '%.example.com') AND path LIKE '/de/%' THEN 'example.com/de/'
    WHEN (host = 'org' OR host LIKE '%.org') AND path LIKE '/fr/%' THEN 'org/fr/'
    WHEN (host = 'net' OR host LIKE '%.net') AND path LIKE '/%' THEN 'net/' END AS rule FROM p)
SELECT page_id, host, path, rule, CASE rule WHEN 'net/' THEN 'block' WHEN 'example.net/en/' THEN 'allow' WHEN 'example.com/de/' THEN 'block' WHEN 'org/fr/' THEN 'allow'
    ELSE CASE WHEN host LIKE '%casino%' OR host LIKE '%porn%' OR host LIKE '%xxx%' OR host LIKE '%-bet.%' OR host LIKE '%viagra%' OR path LIKE '%/ads/%' OR path LIKE '%.exe' OR path LIKE '%.zip' THEN 'block' ELSE 'allow' END END AS verdict
FROM r
"""

_BITS = " + ".join(
    f"CASE WHEN {c} THEN {1 << RULES[r]} ELSE 0 END"
    for r, c in {
        "min_words": "n_words < 10",
        "repeat_words": "100 * n_repeat_words > 20 * n_words",
        "word_length": "n_words > 0 AND (word_chars < 2 * n_words OR word_chars > 20 * n_words)",
        "symbols": "10 * n_symbols > 3 * n_words",
        "dup_lines": "10 * n_dup_lines > 3 * n_lines",
        "shouting": "2 * n_upper > word_chars",
        "max_words": "n_words > 1000000",
    }.items()
)
assert set(POLICIES["v1"]) <= set(RULES)

QUALITY_RULES = rf"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
      list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d),
five AS (SELECT r, i, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT r, w, unnest(range(1, len(w) - 3)) AS i FROM w)),
twice AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS c FROM five) WHERE c > 1),
rep AS (SELECT r, count(DISTINCT i + k) AS n FROM twice, range(0, 5) AS o(k) GROUP BY r),
m AS (SELECT doc_id, cast(len(w) AS BIGINT) AS n_words, cast(length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
      cast(length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols, cast(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines,
      cast(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words, len(l) AS n_lines, length(regexp_replace(t, '[^A-Z]+', '', 'g')) AS n_upper FROM w LEFT JOIN rep USING (r)),
b AS (SELECT *, {_BITS} AS fail_bits FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (fail_bits & {mask("base")}) <> 0 AS base_failed,
    (fail_bits & {mask("v1") | mask("base")}) = 0 AS kept, cast(fail_bits AS INTEGER) AS fail_bits, 'v1' AS policy FROM b
"""

_WORDS = r"list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"

DECONTAMINATION = rf"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, {_WORDS} AS w FROM documents),
i AS (SELECT cast(item_id AS VARCHAR) AS item, {_WORDS} AS w FROM benchmark),
win AS (SELECT DISTINCT item, size, array_to_string(w[k:k + size - 1], ' ') AS g FROM
    (SELECT item, w, least(len(w), 10) AS size, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS k FROM i WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT size FROM win),
doc AS (SELECT r, k, size, array_to_string(w[k:k + size - 1], ' ') AS g FROM (SELECT r, w, size, unnest(range(1, len(w) - size + 2)) AS k FROM d, sizes WHERE len(w) >= size)),
hit AS (SELECT r, k, doc.size AS size, item FROM doc JOIN win USING (size, g)),
n AS (SELECT r, count(DISTINCT k + o) AS n_hit FROM (SELECT DISTINCT r, k, size, unnest(range(0, size)) AS o FROM hit) GROUP BY r),
s AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item FROM hit) GROUP BY r)
SELECT doc_id, cast(len(w) AS BIGINT) AS n_words, cast(coalesce(n_hit, 0) AS BIGINT) AS n_hit, cast(coalesce(n_items, 0) AS BIGINT) AS n_items,
    sha256(coalesce(items, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated FROM d LEFT JOIN n USING (r) LEFT JOIN s USING (r)
"""

_NEAR_WORDS = r"list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '')"

NEAR_DEDUP = rf"""
WITH RECURSIVE d AS (SELECT doc_id, {_NEAR_WORDS} AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[k:k + least(len(w), 4) - 1], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - least(len(w), 4) + 2)) AS k FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY ALL),
link AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
e AS (SELECT a, b FROM link UNION SELECT b, a FROM link),
reach AS (SELECT doc_id AS id, doc_id AS seen FROM documents UNION SELECT id, e.b FROM reach JOIN e ON e.a = reach.seen)
SELECT d.doc_id, cast(coalesce(n.n, 0) AS BIGINT) AS n_shingles, m.c AS component_id, d.doc_id = m.c AS kept
FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT id AS doc_id, min(seen) AS c FROM reach GROUP BY id) m USING (doc_id)
"""

SQL = {"op2_url_filter": URL_FILTER, "op4_quality_rules": QUALITY_RULES, "op6_decontamination": DECONTAMINATION, "op9_near_dedup": NEAR_DEDUP}
