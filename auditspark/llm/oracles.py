"""DuckDB SQL for the operators that SQL can express; the others are tested against brute force in tests/llm."""

from __future__ import annotations

SQL = {}

SQL["op6_hyperminhash"] = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(w) < 2 THEN w ELSE list_sort(list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) END AS s
  FROM words
), classes AS (
  SELECT s, min(doc_id) AS c, len(s) AS n FROM sets WHERE len(s) > 0 GROUP BY s
), grams AS (
  SELECT c, n, unnest(s) AS g FROM classes
), linked AS (
  SELECT a.c AS a, b.c AS b
  FROM grams a JOIN grams b ON a.g = b.g AND a.c < b.c AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
  GROUP BY a.c, b.c, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))
), edges AS (
  SELECT a, b FROM linked UNION ALL SELECT b, a FROM linked
), reach(c, r) AS (
  SELECT c, c FROM classes UNION SELECT reach.c, edges.b FROM reach JOIN edges ON reach.r = edges.a
), named AS (
  SELECT c, min(r) AS component FROM reach GROUP BY c
)
SELECT sets.doc_id, CAST(len(sets.s) AS BIGINT) AS n_shingles, coalesce(component, sets.doc_id) AS component_id,
       sets.doc_id = coalesce(component, sets.doc_id) AS kept
FROM sets LEFT JOIN classes ON classes.s = sets.s LEFT JOIN named ON named.c = classes.c
"""

SQL["op9_pivot_topk"] = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, x.vec_id, CAST(list_inner_product(q.e, x.e) AS BIGINT) AS score
  FROM v q JOIN v x ON q.vec_id % 100 = 0 AND q.vec_id <> x.vec_id
), ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 10
"""

SQL["op10_source_mix"] = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(text, '') AS t, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents
), keyed AS (
  SELECT doc_id, source, size,
         -ln((CAST('0x' || substr(md5('17|' || coalesce(CAST(doc_id AS VARCHAR), '') || '|' || t), 1, 12) AS BIGINT) + 1) / CAST(281474976710657 AS DOUBLE))
         / (0.5::DOUBLE + 0.5::DOUBLE / (1 + abs((length(t) - size + 1) / CAST(greatest(size, 1) AS DOUBLE) - 6) / 6)) AS key
  FROM sized
), sources AS (
  SELECT source, sum(size) AS source_size FROM sized GROUP BY source
), weighed AS (
  SELECT *, 1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS w, 3 * source_size AS cap FROM sources
), ranked AS (
  SELECT *, sum(source_size) OVER () - coalesce(sum(cap) OVER before, 0) AS remaining, sum(w) OVER () - coalesce(sum(w) OVER before, 0) AS weights
  FROM weighed WINDOW before AS (ORDER BY CAST(cap AS DOUBLE) / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), level AS (
  SELECT remaining, weights FROM ranked WHERE cap * weights >= remaining * w ORDER BY CAST(cap AS DOUBLE) / w, source NULLS LAST LIMIT 1
), goals AS (
  SELECT source, CAST(source_size AS BIGINT) AS source_size,
         least(CAST(w * (SELECT remaining FROM level) AS DOUBLE) / CAST((SELECT weights FROM level) AS DOUBLE), CAST(cap AS DOUBLE)) AS target
  FROM ranked
), summed AS (
  SELECT k.*, g.source_size, g.target, sum(size) OVER (PARTITION BY k.source ORDER BY key, doc_id NULLS FIRST, size ROWS UNBOUNDED PRECEDING) - size AS start,
         CAST(floor(g.target / greatest(g.source_size, 1)) AS BIGINT) AS epochs
  FROM keyed k JOIN goals g ON k.source IS NOT DISTINCT FROM g.source
)
SELECT doc_id, size, source, source_size, target,
       CAST(epochs * size + greatest(0, least(size, CAST(round(target) AS BIGINT) - epochs * source_size - start)) AS BIGINT) AS taken, key
FROM summed
"""

SQL["op13_bloom_ranking"] = r"""
WITH docs AS (
  SELECT row_number() OVER () AS rid, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') AS terms FROM documents
), lengths AS (
  SELECT rid, doc_id, CAST(len(terms) AS BIGINT) AS n FROM docs WHERE len(terms) > 0
), corpus AS (
  SELECT count(*) AS n_docs, CAST(sum(n) AS BIGINT) AS n_terms FROM lengths
), items AS (
  SELECT row_number() OVER () AS iid, item_id,
         list_distinct(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+')) AS terms
  FROM (SELECT DISTINCT item_id, text FROM benchmark)
), asked AS (
  SELECT iid, item_id, unnest(terms) AS term FROM items
), occurring AS (
  SELECT rid, term, count(*) AS tf FROM (SELECT rid, unnest(terms) AS term FROM docs) WHERE term IN (SELECT term FROM asked) GROUP BY ALL
), weighed AS (
  SELECT term, CAST(floor(1000 * ln((2.0::DOUBLE * (SELECT n_docs FROM corpus) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM occurring GROUP BY term
), scored AS (
  SELECT iid, item_id, l.rid, l.doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * n_docs) // n_terms)))) AS BIGINT) AS score
  FROM asked JOIN occurring USING (term) JOIN weighed USING (term) JOIN lengths l USING (rid), corpus GROUP BY ALL
), ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY iid ORDER BY score DESC, doc_id NULLS FIRST) AS INTEGER) AS rank FROM scored WHERE score > 0
)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 50
"""
