"""SQL (DuckDB) for the queries that SQL can express: exact definitions, without the indexes."""

from __future__ import annotations

import string

WORDS = rf"regexp_extract_all(translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

DECONTAMINATION = f"""
WITH w AS MATERIALIZED (SELECT doc_id, {WORDS} AS ws FROM documents),
b AS (SELECT item_id, {WORDS} AS ws FROM benchmark WHERE text IS NOT NULL),
p AS MATERIALIZED (SELECT DISTINCT item_id, m, array_to_string(ws[i : i + m - 1], ' ') AS p FROM
 (SELECT item_id, ws, least(len(ws), 10) AS m, unnest(range(1, greatest(len(ws) - 9, 1) + 1)) AS i FROM b WHERE len(ws) > 0)),
d AS (SELECT doc_id, m, i, array_to_string(ws[i : i + m - 1], ' ') AS p FROM
 (SELECT doc_id, ws, m, unnest(range(1, len(ws) - m + 2)) AS i FROM w, (SELECT DISTINCT m FROM p))),
h AS MATERIALIZED (SELECT doc_id, i, m, item_id FROM d JOIN p USING (m, p)),
n AS (SELECT doc_id, count(DISTINCT place) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + m)) AS place FROM h) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM h) GROUP BY doc_id)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN t USING (doc_id)
"""

ESCAPED = "replace(replace(replace({0}, '&', '&amp;'), '<', '&lt;'), '[', '&#91;')"
TURN = f"('<s>[INST] ' || {ESCAPED.format('role')} || ' [/INST]' || {ESCAPED.format('text')} || '</s>')"

#: Budget 2048 (bytes of formatted turns), history of 2 turns and 512: the defaults of chat.windows.
CHAT = f"""
WITH r AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
 UNION ALL SELECT -1, t, CASE t WHEN 0 THEN 'user' ELSE 'assistant' END, '</s>[INST] ok [/INST]' FROM range(0, 2) x(t)),
a AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos, strlen{TURN} AS tok, length{TURN} AS chars FROM r),
b AS (SELECT *, pos = 1 AND role = 'system' AS sys FROM a),
c AS (SELECT *, coalesce(max(tok) FILTER (sys) OVER (PARTITION BY conv_id), 0) AS sys_tok, max(chars) FILTER (sys) OVER (PARTITION BY conv_id) AS sys_chars,
 sum(CASE WHEN sys THEN 0 ELSE tok END) OVER (PARTITION BY conv_id ORDER BY pos) AS upto FROM b),
d AS (SELECT *, upto - CASE WHEN sys THEN 0 ELSE tok END AS before, greatest(1, 1536 - sys_tok) AS free FROM c),
e AS (SELECT *, ((greatest(upto, 1) - 1) // free)::BIGINT AS slot FROM d),
f AS (SELECT *, (before // free)::BIGINT < slot AND NOT sys AND max(upto) OVER s - min(before) OVER s > free AS alone FROM e WINDOW s AS (PARTITION BY conv_id, slot)),
g AS (SELECT *, slot * 2 + CASE WHEN alone THEN 0 ELSE 1 END AS span FROM f),
h AS (SELECT *, pos = min(pos) OVER s AS begins, least(512, greatest(0, 2048 - sys_tok - sum(tok) OVER s)) AS spare FROM g WINDOW s AS (PARTITION BY conv_id, span)),
i AS (SELECT *, lead(begins, 1) OVER o AND lead(before, 1) OVER o - before <= lead(spare, 1) OVER o AND NOT sys AS one, lead(begins, 2) OVER o AND lead(before, 2) OVER o - before <= lead(spare, 2) OVER o AND NOT sys AS two,
 begins AND pos > 1 AND sys_chars IS NOT NULL AND lag(span) OVER o <> span AS again FROM h WINDOW o AS (PARTITION BY conv_id ORDER BY pos))
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY pos)) AS turns_sha256,
 coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY pos) FILTER (role = 'assistant'), '')) AS loss_sha256,
 sum(chars * (1 + coalesce(one, false)::INT + coalesce(two, false)::INT) + CASE WHEN again THEN sys_chars ELSE 0 END)::BIGINT AS formatted_chars
FROM i GROUP BY conv_id
"""

JACCARD = f"""
WITH RECURSIVE w AS MATERIALIZED (SELECT doc_id, {WORDS} AS ws FROM documents),
s AS MATERIALIZED (SELECT DISTINCT doc_id, array_to_string(ws[i : i + 4], ' ') AS s FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
e AS MATERIALIZED (SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS common FROM s x JOIN s y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY ALL) JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE common >= 0.8 * (p.n + q.n - common) - 1e-9),
reach AS (SELECT doc_id AS a, doc_id AS b FROM w UNION SELECT reach.a, e.b FROM reach JOIN e ON e.a = reach.b)
SELECT a AS doc_id, min(b) AS class_id, (SELECT count(*) FROM e WHERE e.a = reach.a)::BIGINT AS n_links FROM reach GROUP BY a
"""

LETTERS = rf"regexp_extract_all(translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')"

DIVERGENCE = f"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, {LETTERS} AS ws FROM documents),
w AS (SELECT r, lang, source, unnest(ws) AS term FROM d),
c AS MATERIALIZED (SELECT lang, source, term, count(*) AS n FROM w GROUP BY ALL),
k AS MATERIALIZED (SELECT lang, term, count(*) AS n FROM w GROUP BY ALL HAVING count(DISTINCT r) >= 10),
l AS (SELECT lang, count(*) AS v, sum(n) AS total FROM k GROUP BY lang),
g AS MATERIALIZED (SELECT lang, source, coalesce(total, 0) AS total FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN (SELECT lang, source, sum(c.n) AS total FROM c JOIN k USING (lang, term) GROUP BY ALL) USING (lang, source)),
p AS MATERIALIZED (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, 1 + 1000000000::HUGEINT * (coalesce(c.n, 0) + 2) // (g.total + 2 * l.v) AS p, 1 + 1000000000::HUGEINT * (k.n + 2) // (l.total + 2 * l.v) AS q
 FROM g JOIN k USING (lang) JOIN l USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
x AS (SELECT lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value FROM p a JOIN p b USING (lang, term) WHERE a.source <> b.source GROUP BY ALL),
pairs AS (SELECT lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value FROM g a JOIN g b USING (lang) LEFT JOIN x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source WHERE a.source <> b.source),
terms AS (SELECT lang, source, 'term' AS part, term AS item, (p - q) * (p - q) // (p + q) AS value FROM p WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INT AS rank FROM
 (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms))
WHERE part = 'pair' OR rank <= 10
"""

SEARCH = f"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, {WORDS} AS ws FROM documents),
t AS MATERIALIZED (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(ws) AS term FROM d) GROUP BY ALL),
s AS MATERIALIZED (SELECT count(*) AS docs, sum(len(ws))::BIGINT AS total FROM d WHERE len(ws) > 0),
b AS (SELECT item_id, term, count(*) AS times FROM (SELECT item_id, unnest({WORDS}) AS term FROM benchmark) GROUP BY ALL),
w AS (SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM t, s GROUP BY term, docs),
m AS (SELECT r, doc_id, 75 + (25 * len(ws) * docs) // total AS m FROM d, s WHERE len(ws) > 0),
x AS (SELECT item_id, r, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * m)))::BIGINT AS score FROM b JOIN w USING (term) JOIN t USING (term) JOIN m USING (r) GROUP BY ALL)
SELECT item_id, rank::INT AS rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM x WHERE score > 0) WHERE rank <= 20
"""
