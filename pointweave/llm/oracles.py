"""DuckDB SQL with the same rows as queries of this folder, where SQL can state them."""

from __future__ import annotations

_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

NEAR_DEDUP = rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, coalesce(regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))
    WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS h FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
i AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS i FROM s x JOIN s y ON x.h = y.h AND x.doc_id <> y.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM i JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * i >= 75 * (p.n + q.n - i)),
r(node, seen) AS (SELECT doc_id, doc_id FROM w UNION SELECT l.b, r.seen FROM r JOIN l ON l.a = r.node),
c AS (SELECT node, min(seen) AS component_id FROM r GROUP BY 1)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, component_id, w.doc_id = component_id AS kept
FROM w JOIN c ON c.node = w.doc_id LEFT JOIN n ON n.doc_id = w.doc_id
"""

SHARDING = """
WITH t AS (
  SELECT list_transform(range(0, 256), lambda n: list_reduce(list_prepend(n::BIGINT, range(0, 8)),
    lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384::BIGINT, c >> 1) ELSE c >> 1 END)) AS tab),
d AS (
  SELECT doc_id, coalesce(text, '') AS text, strlen(coalesce(text, '')) + 1 AS size, substr(md5(coalesce(text, '')), 1, 15) AS key,
    list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda x: ('0x' || x)::BIGINT) AS b FROM documents),
e AS (
  SELECT doc_id, size, key, xor(4294967295::BIGINT, list_reduce(list_prepend(4294967295::BIGINT, b), lambda c, x: xor(tab[(xor(c, x) & 255) + 1], c >> 8))) AS text_crc32 FROM d, t),
g AS (SELECT *, sum(size) OVER (PARTITION BY key) * 800 > sum(size) OVER () AS hot, sum(size) OVER () AS total FROM e),
u AS (SELECT *, CASE WHEN hot THEN coalesce(doc_id, -9223372036854775808) ELSE 0 END AS part FROM g),
m AS (
  SELECT *, sum(size) OVER (PARTITION BY key, part) AS own,
    sum(size) OVER (ORDER BY key, part RANGE UNBOUNDED PRECEDING) AS upto FROM u),
s AS (SELECT *, least(7, (8 * (2 * (upto - own) + own)) // (2 * total))::INTEGER AS shard FROM m)
SELECT doc_id, size::BIGINT AS size, text_crc32, 'bytes' AS law, shard,
  row_number() OVER (PARTITION BY shard ORDER BY md5(coalesce(doc_id::VARCHAR, '')), doc_id, text_crc32, size) - 1 AS slot, NULL::INTEGER AS grown_shard FROM s
"""

TOPK = """
WITH sound AS (
  SELECT row_number() OVER () AS place, vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.place AS query, c.place AS place, q.vec_id AS query_id, c.vec_id,
         list_dot_product(q.v::DOUBLE[], c.v::DOUBLE[])::BIGINT AS score
  FROM sound q JOIN sound c ON c.place <> q.place AND len(c.v) = len(q.v)
  WHERE q.vec_id % 50 = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, vec_id, place) AS rank FROM scored)
WHERE rank <= 5
"""
