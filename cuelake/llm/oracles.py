"""DuckDB SQL for the operators that SQL can express."""

SQL: dict[str, str] = {}

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

#: The provided pages hold no canonical or refresh links, so only the rules decide here; aliases are
#: tested against a brute-force version.
SQL["op1_url_filter"] = f"""
WITH p AS (
    SELECT page_id,
           CASE WHEN contains(url, '://') THEN {_LOWER.format("regexp_extract(url, '^.*?://([^/?#]*)', 1, 's')")} ELSE '' END AS host,
           CASE WHEN contains(url, '://') THEN regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's') ELSE '' END AS path
    FROM pages),
r(rule_host, rule_path, rule_verdict) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
m AS (
    SELECT p.*, rule_host || rule_path AS rule, rule_verdict,
           row_number() OVER (PARTITION BY page_id ORDER BY length(rule_host || rule_path) DESC NULLS LAST) AS k
    FROM p LEFT JOIN r ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path))
SELECT page_id, host, path, rule, coalesce(rule_verdict, 'allow') AS verdict FROM m WHERE k = 1
"""

_WORDS5 = f"""regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"""

SQL["op5_decontaminate"] = f"""
WITH d AS (SELECT doc_id, {_WORDS5} AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS5} AS w FROM benchmark),
bw AS (
    SELECT DISTINCT item, least(10, len(w)) AS n, array_to_string(w[i : i + least(10, len(w)) - 1], ' ') AS g
    FROM (SELECT item, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
dw AS (
    SELECT doc_id, i, n, array_to_string(w[i : i + n - 1], ' ') AS g
    FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM bw) WHERE len(w) >= n)),
h AS (SELECT doc_id, i, dw.n, item FROM dw JOIN bw ON dw.g = bw.g AND dw.n = bw.n),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM h) GROUP BY doc_id),
it AS (SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM h) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN it USING (doc_id)
"""

SQL["op10_topk"] = """
WITH v AS (
    SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS q
    FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
    SELECT a.vec_id AS query_id, b.vec_id,
           CAST(list_sum(list_transform(list_zip(a.q, b.q), lambda z: z[1] * z[2])) AS BIGINT) AS score
    FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS k FROM s)
SELECT query_id, CAST(k AS INTEGER) AS rank, vec_id, score FROM r WHERE k <= 10
"""

SQL["op7_substring"] = """
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
g AS (SELECT doc_id, i, array_to_string(w[i : i + 34], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS i FROM d WHERE len(w) >= 35)),
r AS (SELECT g FROM g GROUP BY g HAVING count(*) > 1),
gone AS (SELECT DISTINCT doc_id, p FROM (SELECT doc_id, unnest(range(i, i + 35)) AS p FROM g SEMI JOIN r USING (g))),
gl AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id),
k AS (
    SELECT doc_id, string_agg(x, ' ' ORDER BY p) AS kept
    FROM (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS p FROM d) ANTI JOIN gone USING (doc_id, p)
    GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN gl USING (doc_id) LEFT JOIN k USING (doc_id)
"""

SQL["op2_near_dedup"] = f"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (
    SELECT DISTINCT doc_id, hash(CASE WHEN len(w) < 5 THEN w ELSE w[i : i + 4] END) AS g
    FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
r AS (SELECT doc_id AS a, doc_id AS b FROM n UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, least(d.doc_id, coalesce(m, d.doc_id)) AS component_id,
       least(d.doc_id, coalesce(m, d.doc_id)) = d.doc_id AS kept
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT a, min(b) AS m FROM r GROUP BY a) x ON x.a = d.doc_id
"""

#: The plain digests of the table's rows, and the length of the template's blocks.
SQL["op12_chat"] = r"""
WITH t AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
e AS (
    SELECT *, lag(role) OVER w IS DISTINCT FROM role OR row_number() OVER w = 1 AS begins,
           length(replace(replace(replace(replace(text, '\', '\\'), '### ', '#\## '), '<next>', '<\next>'), '</turn>', '<\/turn>')) AS n_text,
           length(replace(replace(replace(replace(role, '\', '\\'), '### ', '#\## '), '<next>', '<\next>'), '</turn>', '<\/turn>')) AS n_role
    FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text))
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(n_text + CASE WHEN begins THEN n_role + 4 + 2 + 8 ELSE 6 END) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""

#: A node is a distinct chain of digests; sums over subtrees meet the nodes below in the rebuilt prefixes of their
#: smallest members.
SQL["op13_trie"] = r"""
WITH RECURSIVE t AS (
    SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) - 1 AS pos,
           sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS k,
           len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS words
    FROM conversations WHERE conv_id IS NOT NULL),
bits(i, v) AS (SELECT 0::BIGINT, 0::BIGINT UNION ALL SELECT i + 1, i + 1 FROM bits WHERE i < 255),
crc AS (
    SELECT i, list_reduce([v, 0, 0, 0, 0, 0, 0, 0, 0], lambda a, b: CASE WHEN a % 2 = 1 THEN xor(a // 2, 3988292384) ELSE a // 2 END) AS v
    FROM bits),
c0 AS (SELECT DISTINCT conv_id, CAST(conv_id AS VARCHAR) AS s FROM t),
walk AS (
    SELECT conv_id, s, 1 AS spot, 4294967295::BIGINT AS v FROM c0
    UNION ALL
    SELECT conv_id, s, spot + 1, xor(crc.v, walk.v // 256) FROM walk JOIN crc ON crc.i = xor(walk.v, ascii(substr(s, spot, 1))) % 256 WHERE spot <= length(s)),
c AS (SELECT conv_id, (4294967295 - v) % 4 AS h FROM walk WHERE spot = length(s) + 1),
r AS (
    SELECT c.conv_id, pos, k, words FROM c JOIN t ON t.conv_id = c.conv_id - c.conv_id % 20 AND pos < h
    UNION ALL SELECT c.conv_id, pos, k, words FROM c JOIN t ON t.conv_id = c.conv_id AND pos >= h),
p AS (
    SELECT conv_id, row_number() OVER w AS depth, string_agg(k, '') OVER w AS prefix, words FROM r
    WINDOW w AS (PARTITION BY conv_id ORDER BY pos ROWS UNBOUNDED PRECEDING)
    UNION ALL SELECT conv_id, 0, '', 0 FROM c),
last AS (SELECT conv_id, max(depth) AS depth FROM p GROUP BY conv_id),
n AS (
    SELECT prefix, any_value(p.depth) AS depth, min(p.conv_id) AS conv_id, count(*) AS n_convs, any_value(words) AS words,
           count(*) FILTER (WHERE last.depth > p.depth) AS longer,
           sha256(coalesce(string_agg(CAST(p.conv_id AS VARCHAR), ',' ORDER BY p.conv_id) FILTER (WHERE last.depth = p.depth), '')) AS ends_sha256
    FROM p JOIN last USING (conv_id) GROUP BY prefix),
below AS (
    SELECT p.prefix, sum((n.n_convs - 1) * n.words) AS saved, count(*) FILTER (WHERE n.longer = 0) AS n_leaves,
           count(*) FILTER (WHERE n.depth = p.depth + 1) AS n_children
    FROM n JOIN p ON p.conv_id = n.conv_id AND p.depth <= n.depth GROUP BY p.prefix)
SELECT n.conv_id, n.depth, up.conv_id AS parent_conv_id, n.n_convs, n_children, n_leaves, CAST(saved AS BIGINT) AS saved_tokens, n.ends_sha256
FROM n JOIN below USING (prefix) LEFT JOIN n AS up ON n.depth > 0 AND up.prefix = left(n.prefix, length(n.prefix) - 64)
"""
