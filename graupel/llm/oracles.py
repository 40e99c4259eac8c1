"""DuckDB SQL of the corpus queries that SQL can express."""

from . import chat, divergence

OP4_SQL = r"""
WITH RECURSIVE c AS (SELECT doc_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[\x09-\x0D ]+'), lambda x: x <> '') AS w FROM documents),
k AS (SELECT doc_id, w, array_to_string(w, ' ') AS key FROM c),
cls AS (SELECT key, min(doc_id) AS class_id, count(*) AS n_copies, any_value(w) AS w FROM k GROUP BY key),
places AS (SELECT class_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM cls WHERE len(w) > 0),
sh AS (SELECT DISTINCT class_id, array_to_string(w[i:i + 4], ' ') AS s FROM places),
sz AS (SELECT class_id, count(*) AS n FROM sh GROUP BY class_id),
pr AS (SELECT a.class_id AS x, b.class_id AS y, count(*) AS c FROM sh a JOIN sh b ON a.s = b.s AND a.class_id < b.class_id GROUP BY 1, 2),
ln AS (SELECT x, y FROM pr JOIN sz p ON p.class_id = x JOIN sz q ON q.class_id = y WHERE 9 * c >= 4 * (p.n + q.n)),
e AS (SELECT x, y FROM ln UNION ALL SELECT y, x FROM ln),
rec AS (SELECT class_id AS a, class_id AS b FROM cls UNION SELECT rec.a, e.y FROM rec JOIN e ON rec.b = e.x),
g AS (SELECT a, min(b) AS group_id FROM rec GROUP BY a),
l AS (SELECT x, count(*) AS n FROM e GROUP BY x)
SELECT doc_id, class_id, n_copies, coalesce(l.n, 0) AS n_links, group_id
FROM k JOIN cls USING (key) JOIN g ON g.a = class_id LEFT JOIN l ON l.x = class_id
"""

OP10_SQL = """
WITH d AS (SELECT doc_id, hex(coalesce(text, '')) AS h FROM documents),
n AS (SELECT doc_id, h, length(h) // 2 AS n FROM d),
j AS (SELECT doc_id, h, n, unnest(range(0, n - 399, 1000)) AS base FROM n),
v AS (SELECT doc_id, base, substring(h, 2 * base + 1, 2798) AS piece, least(1000, n - 399 - base) AS m FROM j),
u AS (SELECT doc_id, base, piece, unnest(range(0, m)) AS i FROM v),
w AS (SELECT doc_id, base + i AS i, md5(substring(piece, 2 * i + 1, 800)) AS m FROM u),
r AS (SELECT m FROM w GROUP BY m HAVING count(*) > 1),
c AS (SELECT doc_id, i FROM w WHERE m IN (SELECT m FROM r)),
g AS (SELECT doc_id, i, CASE WHEN i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) <= 400 THEN 0 ELSE 1 END AS fresh FROM c),
s AS (SELECT doc_id, i, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i) AS k FROM g),
p AS (SELECT doc_id, k, min(i) AS a, max(i) + 400 AS b FROM s GROUP BY doc_id, k),
q AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS before FROM p),
t AS (SELECT q.doc_id, string_agg(substring(h, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) AS head, max(b) AS last, sum(b - a) AS removed, count(*) AS spans
  FROM q JOIN n ON n.doc_id = q.doc_id GROUP BY q.doc_id)
SELECT doc_id, n_bytes, n_removed, n_spans, sha256(unhex(kept)) AS kept_sha256, length(regexp_replace(kept, '([0-7C-F].)|[89AB].', '\\1', 'g')) // 2 AS n_chars_kept
FROM (SELECT n.doc_id, n.n AS n_bytes, CAST(coalesce(removed, 0) AS BIGINT) AS n_removed, coalesce(spans, 0) AS n_spans, CASE WHEN t.doc_id IS NULL THEN h ELSE head || substring(h, 2 * last + 1) END AS kept
FROM n LEFT JOIN t ON t.doc_id = n.doc_id)
"""

ALL = {"op4_jaccard_join": OP4_SQL, "op5_chat_format": chat.OP5_SQL, "op10_suffix_dedup": OP10_SQL, "op12_source_divergence": divergence.OP12_SQL}
