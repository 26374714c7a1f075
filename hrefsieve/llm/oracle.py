"""The queries that SQL can express, as DuckDB SQL."""

TOOL_CALLS = """
WITH RECURSIVE turns AS (
    SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations
    WHERE conv_id IS NOT NULL AND turn IS NOT NULL
),
calls AS (
    SELECT conv_id, turn, text, len(list_filter(string_split(text, ' '), lambda x: x <> '')) AS words,
           (turn // 4) * 2 AS need
    FROM turns WHERE role = 'user'
),
edges AS (
    SELECT c.conv_id, c.turn, n.turn AS need FROM calls c JOIN calls n ON n.conv_id = c.conv_id AND n.turn = c.need AND c.need < c.turn
),
depth AS (
    SELECT conv_id, turn, 0 AS level FROM calls WHERE (conv_id, turn) NOT IN (SELECT (conv_id, turn) FROM edges)
    UNION ALL
    SELECT e.conv_id, e.turn, d.level + 1 FROM edges e JOIN depth d ON d.conv_id = e.conv_id AND d.turn = e.need
),
results AS (SELECT conv_id, turn - 1 AS turn, min(text) AS result FROM turns WHERE role = 'assistant' GROUP BY ALL),
checked AS (
    SELECT c.*, d.level, r.result, CASE WHEN words % 2 = 0 THEN 'lookup' ELSE 'rewrite' END AS tool,
           CASE words % 3 WHEN 0 THEN 'plain' WHEN 1 THEN 'short' ELSE 'loud' END AS style
    FROM calls c JOIN depth d USING (conv_id, turn) LEFT JOIN results r USING (conv_id, turn)
),
judged AS (
    SELECT *, CASE WHEN tool = 'lookup' THEN nullif(concat_ws('; ',
                       CASE WHEN words < 1 THEN '$.limit: below 1' WHEN words > 40 THEN '$.limit: above 40' END,
                       CASE WHEN length(text) < 1 THEN '$.query: too short' END), '')
                   ELSE nullif(concat_ws('; ',
                       CASE WHEN style = 'loud' THEN '$.style: not one of the values' END,
                       CASE WHEN length(text) > 400 THEN '$.text: too long' END), '') END AS problems
    FROM checked
)
SELECT conv_id, turn, 'call-' || turn AS call_id, tool, level,
       CASE WHEN problems IS NOT NULL THEN 'invalid' WHEN result IS NULL THEN 'no_result' ELSE 'ok' END AS status, problems,
       '{"arguments":' || CASE WHEN tool = 'lookup' THEN '{"limit":' || words || ',"query":' || to_json(text) || '}'
                               ELSE '{"style":"' || style || '","text":' || to_json(text) || '}' END
       || ',"depends_on":[' || CASE WHEN need < turn THEN '"call-' || need || '"' ELSE '' END || '],"id":"call-' || turn || '"'
       || CASE WHEN result IS NOT NULL THEN ',"result":' || to_json(result) ELSE '' END || ',"tool":"' || tool || '"}' AS json
FROM judged
"""

NEAR_DUPLICATES = r"""
WITH RECURSIVE words AS MATERIALIZED (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws
    FROM documents
),
shingles AS MATERIALIZED (
    SELECT DISTINCT doc_id, sh FROM (
        SELECT doc_id, unnest(CASE WHEN len(ws) < 2 THEN ws ELSE list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]) END) AS sh FROM words)
),
sizes AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
links AS MATERIALIZED (
    SELECT a.doc_id AS a, b.doc_id AS b
    FROM shingles a JOIN shingles b ON a.sh = b.sh AND a.doc_id < b.doc_id
    JOIN sizes x ON x.doc_id = a.doc_id JOIN sizes y ON y.doc_id = b.doc_id AND 100 * least(x.n, y.n) >= 80 * greatest(x.n, y.n)
    GROUP BY a.doc_id, b.doc_id, x.n, y.n HAVING 100 * count(*) >= 80 * (x.n + y.n - count(*))
),
edges AS MATERIALIZED (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(doc_id, root) AS (
    SELECT doc_id, doc_id FROM words
    UNION SELECT e.b, r.root FROM reach r JOIN edges e ON e.a = r.doc_id
)
SELECT w.doc_id, coalesce(s.n, 0) AS n_shingles, r.root AS component_id, w.doc_id = r.root AS kept
FROM words w LEFT JOIN sizes s USING (doc_id) JOIN (SELECT doc_id, min(root) AS root FROM reach GROUP BY doc_id) r USING (doc_id)
"""

JACCARD_JOIN = r"""
WITH RECURSIVE words AS MATERIALIZED (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws
    FROM documents
),
shingles AS MATERIALIZED (
    SELECT DISTINCT doc_id, sh FROM (
        SELECT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')]
                                   ELSE list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2]) END) AS sh FROM words)
),
sizes AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
links AS MATERIALIZED (
    SELECT a.doc_id AS a, b.doc_id AS b
    FROM shingles a JOIN shingles b ON a.sh = b.sh AND a.doc_id < b.doc_id
    JOIN sizes x ON x.doc_id = a.doc_id JOIN sizes y ON y.doc_id = b.doc_id AND 100 * least(x.n, y.n) >= 90 * greatest(x.n, y.n)
    GROUP BY a.doc_id, b.doc_id, x.n, y.n HAVING 100 * count(*) >= 90 * (x.n + y.n - count(*))
),
edges AS MATERIALIZED (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(doc_id, root) AS (
    SELECT doc_id, doc_id FROM words
    UNION SELECT e.b, r.root FROM reach r JOIN edges e ON e.a = r.doc_id
)
SELECT w.doc_id, coalesce(s.n, 0) AS n_shingles, r.root AS component_id
FROM words w LEFT JOIN sizes s USING (doc_id) JOIN (SELECT doc_id, min(root) AS root FROM reach GROUP BY doc_id) r USING (doc_id)
"""
