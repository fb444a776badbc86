"""SQL of queries whose operators work otherwise."""

from __future__ import annotations

#: All pairs that share a shingle, then all that links reach: what the near-duplicate operator must find, on small tables.
OP2_SQL = r"""
WITH RECURSIVE base AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents),
sets AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM base WHERE len(w) > 0)),
sizes AS (SELECT doc_id, count(*) AS n, md5(string_agg(s, '|' ORDER BY s)) AS h FROM sets GROUP BY doc_id),
shared AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM sets a JOIN sets b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
links AS (SELECT x, y FROM shared JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y WHERE 100 * c >= 85 * (p.n + q.n - c)),
reach(x, y) AS (SELECT doc_id, doc_id FROM documents UNION SELECT reach.x, links.y FROM reach JOIN links ON reach.y = links.x),
least AS (SELECT x, min(y) AS y FROM reach GROUP BY x),
classes AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY h) AS class_id FROM sizes)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, least.y AS component_id, d.doc_id = least.y AS kept, coalesce(class_id, d.doc_id) AS class_id
FROM documents d JOIN least ON least.x = d.doc_id LEFT JOIN sizes ON sizes.doc_id = d.doc_id LEFT JOIN classes ON classes.doc_id = d.doc_id
"""
