"""Plain SQL with the rows of those operators' queries that SQL can express."""

from __future__ import annotations

_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP2 = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
w AS (SELECT doc_id, words, len(words)::BIGINT AS n, unnest(range(1, len(words) + 1)) AS i FROM d),
s AS (SELECT doc_id, i, words[i] AS word, n, CASE WHEN i + 49 <= n THEN sha256(array_to_string(words[i : i + 49], ' ')) END AS print FROM w),
f AS (SELECT print, min(doc_id) AS first FROM s WHERE print IS NOT NULL GROUP BY print),
r AS (SELECT s.doc_id, s.i, s.word, coalesce(f.first < s.doc_id, false) AS again FROM s LEFT JOIN f USING (print)),
c AS (
    SELECT doc_id, i, word, bool_or(again) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) AS gone
    FROM r
),
k AS (
    SELECT doc_id, count(*) FILTER (WHERE gone) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (WHERE NOT gone) AS kept
    FROM c GROUP BY doc_id
)
SELECT d.doc_id::BIGINT AS doc_id, len(d.words)::BIGINT AS n_words, coalesce(k.n_removed, 0)::BIGINT AS n_removed,
    sha256(coalesce(k.kept, '')) AS kept_sha256
FROM d LEFT JOIN k USING (doc_id)
"""

OP8 = rf"""
WITH b AS (
    SELECT item_id::VARCHAR AS item, regexp_extract_all(coalesce({_LOWER}, ''), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
    FROM benchmark
),
x AS (SELECT item, words, least(len(words), 10) AS k, unnest(range(1, greatest(len(words) - 9, 1) + 1)) AS i FROM b WHERE len(words) > 0),
v AS (SELECT DISTINCT item, k, array_to_string(words[i : i + k - 1], ' ') AS piece FROM x),
d AS (
    SELECT doc_id, regexp_extract_all(coalesce({_LOWER}, ''), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
    FROM documents
),
p AS (SELECT doc_id, words, unnest(range(1, len(words) + 1)) AS i FROM d),
h AS (
    SELECT p.doc_id, p.i, l.k, array_to_string(p.words[p.i : p.i + l.k - 1], ' ') AS piece
    FROM p JOIN (SELECT DISTINCT k FROM v) l ON p.i + l.k - 1 <= len(p.words)
),
m AS (SELECT h.doc_id, h.i, h.k, v.item FROM h JOIN v USING (k, piece)),
n AS (SELECT doc_id, count(DISTINCT place) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS place FROM m) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM m) GROUP BY doc_id)
SELECT d.doc_id, len(d.words)::BIGINT AS n_words, coalesce(n.n_hit, 0)::BIGINT AS n_hit, coalesce(t.n_items, 0)::BIGINT AS n_items,
    sha256(coalesce(t.items, '')) AS items_sha256, coalesce(n.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN t USING (doc_id)
"""

ORACLES = {"op2_substrings": OP2, "op8_decontamination": OP8}
