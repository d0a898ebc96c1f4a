"""The rows of the exact pair operators in DuckDB SQL, by plain comparison of everything with everything."""

from __future__ import annotations

COMPONENTS = """both_ways AS MATERIALIZED (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
  reach(node, seen) AS (
    SELECT x, y FROM both_ways UNION SELECT r.node, b.y FROM reach r JOIN both_ways b ON b.x = r.seen
  ), least_of AS (SELECT node, min(seen) AS m FROM reach GROUP BY node)"""

JACCARD = rf"""
WITH RECURSIVE words AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
  ), sets AS (
    SELECT doc_id, CASE WHEN len(w) >= 5 THEN list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')))
      WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE []::VARCHAR[] END AS s FROM words
  ), flat AS (SELECT doc_id, unnest(s) AS g FROM sets),
  common AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM flat a JOIN flat b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
  links AS MATERIALIZED (SELECT x, y FROM common JOIN sets p ON p.doc_id = x JOIN sets q ON q.doc_id = y WHERE 100 * c >= 80 * (len(p.s) + len(q.s) - c)),
  {COMPONENTS}
SELECT doc_id, len(s) AS n_shingles, least(doc_id, coalesce(m, doc_id)) AS component_id FROM sets LEFT JOIN least_of ON node = doc_id
"""

SUBSTRINGS = r"""
WITH words AS (
    SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
  ), windows AS (SELECT doc_id, i, array_to_string(w[i:i + 49], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM words)),
  firsts AS (SELECT g, min(doc_id) AS m FROM windows GROUP BY g),
  gone AS (SELECT DISTINCT doc_id, i + k AS p FROM (SELECT doc_id, i, unnest(range(0, 50)) AS k FROM windows JOIN firsts USING (g) WHERE m < doc_id)),
  kept AS (SELECT f.doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY p) AS t
    FROM (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM words) f ANTI JOIN gone USING (doc_id, p) GROUP BY f.doc_id)
SELECT doc_id, len(w) AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM words LEFT JOIN kept USING (doc_id)
"""

VECTORS = f"""
WITH RECURSIVE sound AS MATERIALIZED (
    SELECT vec_id, label, e, sqrt(list_dot_product(e, e)) AS norm FROM (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings)
    WHERE label IS NOT NULL AND e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0
  ), links AS MATERIALIZED (
    SELECT a.vec_id AS x, b.vec_id AS y FROM sound a JOIN sound b ON a.label = b.label AND a.vec_id < b.vec_id AND len(a.e) = len(b.e)
    WHERE list_dot_product(a.e, b.e) / (a.norm * b.norm) >= 0.98
  ), counted AS (SELECT v, count(*) AS n FROM (SELECT x AS v FROM links UNION ALL SELECT y FROM links) GROUP BY v),
  {COMPONENTS}
SELECT vec_id, coalesce(n, 0) AS n_links, least(vec_id, coalesce(m, vec_id)) AS component_id, least(vec_id, coalesce(m, vec_id)) = vec_id AS kept
FROM embeddings LEFT JOIN counted ON v = vec_id LEFT JOIN least_of ON node = vec_id
"""
