"""SQL of the queries that SQL can express, for DuckDB."""

from __future__ import annotations

from sieveline.llm import chat, decontam, quality

_STOPS = ", ".join(f"'{w}'" for w in sorted(set(quality.STOP_WORDS)))
_RULES = " AND ".join(
    "(" + " AND ".join([f"{r.measure} >= {r.low}"] * (r.low is not None) + [f"{r.measure} <= {r.high}"] * (r.high is not None)) + (f" OR n_words < {r.min_words}" if r.min_words else "") + ")"
    for r in quality.THRESHOLDS
)
_PER = lambda x, y: f"CASE WHEN {y} > 0 THEN {x}::DOUBLE / {y} ELSE 0 END"

OP4 = rf"""
WITH w AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
g AS (SELECT doc_id, i, array_to_string(ws[i:i + 7], ' ') AS k FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 6)) AS i FROM w)),
d AS (SELECT doc_id, i FROM g QUALIFY count(*) OVER (PARTITION BY doc_id, k) > 1),
r AS (SELECT doc_id, count(DISTINCT i + j) AS n FROM d, range(8) AS x(j) GROUP BY 1),
m AS (SELECT w.doc_id, len(ws)::BIGINT AS n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS word_chars,
 length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols,
 list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls, coalesce(r.n, 0)::BIGINT AS n_repeat_words,
 length(t) - length(replace(t, '!', '')) AS shouts, length(regexp_replace(t, '[^\p{{L}}]+', '', 'g')) AS letters, length(regexp_replace(t, '[^\p{{Lu}}]+', '', 'g')) AS uppers,
 len(list_filter(ws, lambda x: lower(x) IN ({_STOPS}))) AS stops
 FROM w LEFT JOIN r USING (doc_id)),
q AS (SELECT *, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, {_PER('word_chars', 'n_words')} AS mean_word_chars, {_PER('n_symbols', 'n_words')} AS symbol_ratio, {_PER('shouts', 'n_words')} AS shout_ratio,
 {_PER('uppers', 'letters')} AS upper_ratio, {_PER('stops', 'n_words')} AS stop_ratio, {_PER('(len(ls) - len(list_distinct(ls)))', 'len(ls)')} AS line_dup_ratio, {_PER('n_repeat_words', 'n_words')} AS repeat_word_ratio FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
 NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND {_RULES} AS kept FROM q
"""

_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP7 = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS ws FROM documents),
b AS (SELECT item_id, ws, least({decontam.N}, len(ws)) AS n FROM (SELECT item_id, {_WORDS} AS ws FROM benchmark) WHERE len(ws) > 0),
g AS (SELECT DISTINCT item_id, n, array_to_string(ws[i:i + n - 1], ' ') AS k FROM (SELECT item_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM b)),
s AS (SELECT DISTINCT n FROM g),
w AS (SELECT doc_id, n, i, array_to_string(ws[i:i + n - 1], ' ') AS k FROM (SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM d, s WHERE len(ws) >= n)),
h AS (SELECT doc_id, item_id, w.n, i FROM w JOIN g ON w.n = g.n AND w.k = g.k),
c AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM h) GROUP BY 1),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS items FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS i FROM h) GROUP BY 1)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN t USING (doc_id)
"""

_Q = lambda x: rf"""('"' || replace(replace(replace(replace(replace({x}, '\', '\\'), '"', '\"'), chr(9), '\t'), chr(10), '\n'), chr(13), '\r') || '"')"""

_ANSWERS = ", ".join(f"'{r}'" for r in chat.ANSWERS)

OP3 = f"""
WITH RECURSIVE c AS (SELECT conv_id, turn, text, CASE role WHEN 'user' THEN 'respond' WHEN 'system' THEN 'configure' ELSE 'note' END AS tool FROM conversations WHERE role NOT IN ({_ANSWERS})),
r AS (SELECT conv_id, turn, text, turn - 1 AS asked FROM conversations WHERE role IN ({_ANSWERS})),
need AS (SELECT c.conv_id, c.turn, max(p.turn) AS prior FROM c LEFT JOIN c p ON p.conv_id = c.conv_id AND p.turn IN (c.turn - 1, c.turn - 2) GROUP BY ALL),
lv AS (SELECT conv_id, turn, 0 AS level FROM need WHERE prior IS NULL UNION ALL SELECT n.conv_id, n.turn, lv.level + 1 FROM need n JOIN lv ON n.conv_id = lv.conv_id AND n.prior = lv.turn),
j AS (SELECT coalesce(c.conv_id, r.conv_id) AS conv_id, 'turn:' || coalesce(c.turn, r.asked) AS call_id, lv.level, c.turn AS call_place, r.turn AS result_place, c.text AS said, r.text AS got, tool,
 CASE WHEN c.turn IS NULL THEN 'orphan' WHEN r.turn IS NULL THEN 'pending' ELSE 'linked' END AS state FROM c FULL JOIN r ON c.conv_id = r.conv_id AND c.turn = r.asked LEFT JOIN lv ON lv.conv_id = c.conv_id AND lv.turn = c.turn)
SELECT conv_id, call_id, state, coalesce(level, -1)::INTEGER AS level, coalesce(call_place, -1) AS call_place, coalesce(result_place, -1) AS result_place, 0::BIGINT AS n_problems,
 '{{' || concat_ws(',', CASE WHEN call_place IS NOT NULL THEN '"arguments":{{"text":' || {_Q('said')} || ',"turn":' || call_place || '}}' END, CASE WHEN result_place IS NOT NULL THEN '"content":' || {_Q('got')} END,
 '"id":' || {_Q('call_id')}, '"name":"' || tool || '"', '"state":"' || state || '"') || '}}' AS json FROM j
"""
