"""DuckDB SQL with the same rows as the queries that SQL can express."""

from __future__ import annotations

from .chat import CONTROL

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Components of links(a, b) with a < b among nodes(id): reach(id, root), smallest root wins.
_REACH = """
pair AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach(id, root) AS (SELECT id, id FROM nodes UNION SELECT pair.b, reach.root FROM reach JOIN pair ON pair.a = reach.id WHERE pair.b > reach.root),
component AS (SELECT id, min(root) AS root FROM reach GROUP BY id)"""

JACCARD = rf"""
WITH RECURSIVE d AS (SELECT doc_id, [x FOR x IN regexp_split_to_array(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[\x20\x09-\x0D]+') IF x <> ''] AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) >= 3 THEN list_sort(list_distinct([w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] FOR i IN range(1, len(w) - 1)]))
                          WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE CAST([] AS VARCHAR[]) END AS g FROM d),
c AS (SELECT doc_id, len(g) AS n, CASE WHEN len(g) > 0 THEN min(doc_id) OVER (PARTITION BY g) ELSE doc_id END AS id, g FROM s),
nodes AS (SELECT id, n, g FROM c WHERE doc_id = id),
x AS (SELECT id, n, unnest(g) AS h FROM nodes),
links AS (SELECT a.id AS a, b.id AS b FROM x a JOIN x b ON a.h = b.h AND a.id < b.id AND 100 * least(a.n, b.n) >= 90 * greatest(a.n, b.n)
          GROUP BY a.id, b.id, a.n, b.n HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))),{_REACH}
SELECT doc_id, CAST(n AS BIGINT) AS n_shingles, root AS component_id FROM c JOIN component USING (id)"""

NEAR_VECTORS = f"""
WITH RECURSIVE nodes AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
links AS (SELECT a.id AS a, b.id AS b FROM nodes a JOIN nodes b ON a.id < b.id WHERE list_cosine_similarity(a.v, b.v) >= 0.95),{_REACH}
SELECT id AS vec_id, (SELECT count(*) FROM pair WHERE pair.a = component.id) AS n_links, root AS component_id, id = root AS kept FROM component"""

_BASE32 = " || ".join(f"substr('{_UPPER}234567', 1 + ((CAST('0x' || substr(h, {5 * g + 1}, 5) AS INT) >> {shift}) & 31), 1)" for g in range(8) for shift in (15, 10, 5, 0))

WARC = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS t, sha1(coalesce(html, '')) AS h, min(page_id) OVER (PARTITION BY coalesce(html, '')) AS f FROM pages)
SELECT page_id, CAST(strlen(t) AS BIGINT) AS payload_bytes, {_BASE32} AS payload_digest,
       CASE WHEN page_id = f THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> f THEN f END AS refers_to FROM p"""

_MARKS = "CASE role WHEN 'system' THEN 15 WHEN 'user' THEN 16 WHEN 'assistant' THEN 4 ELSE 19 + length(role) END"
_CONTROLS = "|".join(["\\\\", *("".join("\\" + c if c in "[]/" else c for c in x) for x in CONTROL)])

CHAT = rf"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]')
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(length(text) + len(regexp_extract_all(text, '{_CONTROLS}')) + {_MARKS}) AS BIGINT) AS formatted_chars
FROM t GROUP BY conv_id"""

ORACLE = {"op2_jaccard_join": JACCARD, "op6_nn_descent_neardup": NEAR_VECTORS, "op8_warc_normaliser": WARC, "op9_chat_rendering": CHAT}
