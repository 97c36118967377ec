"""SQL twins of the text queries that SQL can express."""

from __future__ import annotations

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lowered(column: str) -> str:
    return f"translate(coalesce({column}, ''), '{_UPPER}', '{_LOWER}')"


def url_filter(rules: list[tuple[str, str]], default: str) -> str:
    values = ", ".join(f"('{r.partition('/')[0]}', '/{r.partition('/')[2]}', '{v}')" for r, v in rules)
    host = "regexp_extract(rest, '^[^/?#]*')"
    return f"""WITH p AS (SELECT row_number() OVER () AS n, page_id, CASE WHEN instr(coalesce(url, ''), '://') = 0 THEN '' ELSE substr(url, instr(url, '://') + 3) END AS rest FROM pages),
h AS (SELECT n, page_id, {lowered(host)} AS host, regexp_extract(substr(rest, length({host}) + 1), '^[^?#]*') AS path FROM p), r(rhost, rpath, v) AS (VALUES {values})
SELECT page_id, host, path, arg_max(rhost || rpath, length(rhost || rpath)) AS rule, coalesce(arg_max(v, length(rhost || rpath)), '{default}') AS verdict
FROM h LEFT JOIN r ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY n, page_id, host, path"""


DECONTAMINATE = f"""WITH d AS (SELECT row_number() OVER () AS n, doc_id, regexp_extract_all({lowered("text")}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
b AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, regexp_extract_all({lowered("text")}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
pat AS (SELECT DISTINCT item, m, array_to_string(list_slice(w, i, i + m - 1), ' ') AS p FROM (SELECT item, w, least(8, len(w)) AS m, unnest(range(1, len(w) - least(8, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
win AS (SELECT n, m, i, array_to_string(list_slice(w, i, i + m - 1), ' ') AS p FROM (SELECT n, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM d CROSS JOIN (SELECT DISTINCT m FROM pat) WHERE len(w) >= m)),
occ AS (SELECT n, i, m, item FROM win JOIN pat USING (m, p)),
hit AS (SELECT n, count(DISTINCT k) AS n_hit FROM (SELECT n, unnest(range(i, i + m)) AS k FROM occ) GROUP BY n),
its AS (SELECT n, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS sha FROM (SELECT DISTINCT n, item FROM occ) GROUP BY n)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, coalesce(sha, sha256('')) AS items_sha256, coalesce(n_items, 0) >= 2 AS contaminated
FROM d LEFT JOIN hit USING (n) LEFT JOIN its USING (n)"""

JACCARD_JOIN = f"""WITH RECURSIVE d AS (SELECT row_number() OVER () AS n, doc_id, regexp_extract_all({lowered("text")}, '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
g AS (SELECT n, doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: array_to_string(list_slice(w, i, i + 2), ' '))) END AS s FROM d),
x AS (SELECT n, unnest(s) AS t FROM g), c AS (SELECT a.n AS a, b.n AS b, count(*) AS i FROM x a JOIN x b ON a.t = b.t AND a.n < b.n GROUP BY a.n, b.n),
l AS (SELECT a, b FROM c JOIN g ga ON ga.n = a JOIN g gb ON gb.n = b WHERE 100 * i >= 90 * (len(ga.s) + len(gb.s) - i)), e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(n, m) AS (SELECT n, n FROM g UNION SELECT r.n, e.b FROM r JOIN e ON e.a = r.m)
SELECT g.doc_id, CAST(len(g.s) AS BIGINT) AS n_shingles, min(o.doc_id) AS component_id FROM g JOIN r ON r.n = g.n JOIN g o ON o.n = r.m GROUP BY g.n, g.doc_id, len(g.s)"""
