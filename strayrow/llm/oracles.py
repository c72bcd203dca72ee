"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from strayrow.llm.line_dedup import LEAST, RATIO
from strayrow.llm.queries import URL_RULES

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_WORD = r"[^\x20\x09-\x0D]+"

SQL: dict[str, str] = {}

SQL["op1_url_filters"] = f"""
WITH rest AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) END AS r
  FROM pages
), parsed AS (
  SELECT page_id,
         coalesce(translate(regexp_extract(r, '^[^/?#]*'), '{_UPPER}', '{_LOWER}'), '') AS host,
         coalesce(regexp_extract(r, '^[^/?#]*([^?#]*)', 1), '') AS path
  FROM rest
), rules(h, p, v) AS (VALUES {", ".join(map(str, URL_RULES))}), fitting AS (
  SELECT page_id, host, path, h || p AS rule, coalesce(v, 'allow') AS verdict,
         row_number() OVER (PARTITION BY page_id ORDER BY length(h || p) DESC NULLS LAST) AS k
  FROM parsed LEFT JOIN rules
    ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)
)
SELECT page_id, host, path, rule, verdict FROM fitting WHERE k = 1
"""

SQL["op5_quality_rules"] = f"""
WITH docs AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '{_WORD}') AS w
  FROM documents
), windows AS (
  SELECT rid, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g
  FROM (SELECT rid, w, unnest(range(1, len(w) - 1)) AS i FROM docs)
), repeated AS (
  SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS c FROM windows) WHERE c > 1
), covered AS (
  SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS p FROM repeated)
  GROUP BY rid
), lines AS (
  SELECT rid, count(*) AS n_lines, count(*) - count(DISTINCT l) AS n_dup
  FROM (SELECT rid, unnest(string_split(t, chr(10))) AS l FROM docs)
  WHERE regexp_matches(l, '{_WORD}') GROUP BY rid
), counts AS (
  SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words,
         CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
         CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         length(t) - length(regexp_replace(t, '[A-Z]', '', 'g')) AS n_capitals,
         CAST(coalesce(n_dup, 0) AS BIGINT) AS n_dup_lines, coalesce(n_lines, 0) AS n_lines,
         CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words
  FROM docs LEFT JOIN covered USING (rid) LEFT JOIN lines USING (rid)
), judged AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM counts
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed OR 100 * n_symbols > 20 * n_words OR 100 * n_capitals > 30 * word_chars
            OR word_chars < 2 * n_words OR word_chars > 15 * n_words
            OR 100 * n_dup_lines > 50 * n_lines) AS kept
FROM judged
"""

SQL["op6_ngram_jaccard"] = f"""
WITH RECURSIVE words AS (
  SELECT doc_id,
         regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{_WORD}') AS w
  FROM documents
), sets AS (
  SELECT doc_id, CASE
    WHEN len(w) = 0 THEN []
    WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 2),
      lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3])) END AS s
  FROM words
), grams AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sets), links AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 185 * count(*) >= 85 * (a.n + b.n)
), reach(a, b) AS (
  SELECT a, b FROM links UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a
), smallest AS (SELECT a, min(b) AS least FROM reach GROUP BY a)
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles,
       least(doc_id, coalesce(least, doc_id)) AS component_id
FROM sets LEFT JOIN smallest ON a = doc_id
"""

SQL["op7_exact_top_k"] = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS e
  FROM embeddings
  WHERE embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS k FROM scored
)
SELECT query_id, CAST(k AS INTEGER) AS rank, vec_id, score FROM ranked WHERE k <= 20
"""

SQL["op10_line_dedup"] = f"""
WITH docs AS (SELECT row_number() OVER () AS rid, * FROM documents), lines AS (
  SELECT rid, source, unnest(string_split(text, chr(10))) AS l,
         generate_subscripts(string_split(text, chr(10)), 1) AS k
  FROM docs WHERE text IS NOT NULL
), keyed AS (
  SELECT *, trim(l, ' ' || chr(9) || chr(13)) AS t FROM lines
), totals AS (SELECT source, count(DISTINCT text) AS pages FROM docs GROUP BY source), often AS (
  SELECT keyed.source, t, count(DISTINCT docs.text) AS n FROM keyed JOIN docs USING (rid) WHERE t <> ''
  GROUP BY keyed.source, t
), bad AS (
  SELECT often.source, t FROM often JOIN totals ON often.source IS NOT DISTINCT FROM totals.source
  WHERE n >= {LEAST} AND n > pages * CAST({RATIO} AS DOUBLE)
), marked AS (
  SELECT keyed.*, bad.t IS NOT NULL AS dropped FROM keyed LEFT JOIN bad
    ON keyed.source IS NOT DISTINCT FROM bad.source AND keyed.t = bad.t
), cleaned AS (
  SELECT rid, coalesce(string_agg(l, chr(10) ORDER BY k) FILTER (WHERE NOT dropped), '') AS text,
         count(*) AS n_lines, count(*) FILTER (WHERE dropped) AS n_dropped
  FROM marked GROUP BY rid
)
SELECT doc_id, docs.source, cleaned.text, CAST(coalesce(n_lines, 0) AS BIGINT) AS n_lines,
       CAST(coalesce(n_dropped, 0) AS BIGINT) AS n_dropped
FROM docs LEFT JOIN cleaned USING (rid)
"""


def _clustering(k: int = 40, rounds: int = 5) -> str:
    """Lloyd's rounds, one pair of tables for each: all distances, then the floors of the means."""
    parts = [f"""
  kept AS MATERIALIZED (
    SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
    FROM embeddings
    WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
  ), c0 AS MATERIALIZED (
    SELECT CAST(row_number() OVER (ORDER BY sha256('2:' || vec_id)) - 1 AS INTEGER) AS cluster, v AS c
    FROM kept ORDER BY sha256('2:' || vec_id) LIMIT {k}
  )"""]
    for r in range(rounds + 1):
        parts.append(f"""
  a{r} AS MATERIALIZED (
    SELECT vec_id, v, CAST(arg_min(cluster, (d, cluster)) AS INTEGER) AS cluster, min(d) AS distance
    FROM (SELECT vec_id, v, cluster,
                 CAST(list_sum(list_transform(list_zip(v, c), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS BIGINT) AS d
          FROM kept, c{r})
    GROUP BY vec_id, v
  )""")
        if r < rounds:
            parts.append(f"""
  c{r + 1} AS MATERIALIZED (
    SELECT cluster, coalesce(m.c, c{r}.c) AS c
    FROM c{r} LEFT JOIN (
      SELECT cluster, list(s ORDER BY i) AS c
      FROM (SELECT cluster, i,
                   CAST((sum(x) - ((sum(x) % count(*)) + count(*)) % count(*)) // count(*) AS BIGINT) AS s
            FROM (SELECT cluster, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM a{r})
            GROUP BY cluster, i)
      GROUP BY cluster) m USING (cluster)
  )""")
    return f"""
WITH {",".join(parts)}
SELECT vec_id, cluster, distance,
       CAST(sum(distance) OVER (PARTITION BY cluster) AS BIGINT) AS cluster_inertia,
       CAST(sum(distance) OVER () AS BIGINT) AS inertia,
       sha256(array_to_string(c, ',')) AS centroid_sha256
FROM a{rounds} JOIN c{rounds} USING (cluster)
"""


SQL["op12_centroid_clustering"] = _clustering()

SQL["op11_embedding_near_dedup"] = """
WITH RECURSIVE sound AS MATERIALIZED (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), pairs AS MATERIALIZED (
  SELECT a.vec_id AS a, b.vec_id AS b
  FROM sound a JOIN sound b ON a.label = b.label AND len(a.e) = len(b.e) AND a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.e, b.e) >= 0.93
), reach(v, first) AS (
  SELECT a, a FROM pairs
  UNION SELECT pairs.b, reach.first FROM reach JOIN pairs ON pairs.a = reach.v WHERE reach.first < pairs.b
), named AS (SELECT v, min(first) AS first FROM reach GROUP BY v),
linked AS (SELECT a, count(*) AS n FROM pairs GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, coalesce(first, vec_id) AS component_id,
       coalesce(first, vec_id) = vec_id AS kept, CAST(1 AS DOUBLE) AS recall
FROM embeddings LEFT JOIN linked ON vec_id = a LEFT JOIN named ON vec_id = v
"""
