"""SQL for the queries that SQL can express, for DuckDB."""

EXACT_DEDUP = """
SELECT doc_id,
       max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS keep_id,
       count(*) OVER (PARTITION BY coalesce(text, '')) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents
"""

SUBSTRING_DEDUP = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
starts AS (SELECT doc_id, ws, unnest(range(1, len(ws) - 48)) AS p FROM w WHERE len(ws) >= 50),
win AS (SELECT doc_id, p, array_to_string(ws[p:p + 49], ' ') AS h FROM starts),
least AS (SELECT h, min(doc_id) AS md FROM win GROUP BY h),
gone AS (SELECT DISTINCT doc_id, i FROM (SELECT win.doc_id, unnest(range(p, p + 50)) AS i FROM win JOIN least USING (h) WHERE md < win.doc_id)),
words AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM w),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS t, count(*) AS n FROM words ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(kept.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id)
"""

NGRAM_JACCARD_JOIN = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
starts AS (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 2))) AS p FROM w WHERE len(ws) > 0),
sh AS (SELECT DISTINCT doc_id, array_to_string(ws[p:p + 4], ' ') AS s FROM starts),
size AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
shared AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM sh x JOIN sh y ON x.s = y.s AND x.doc_id < y.doc_id GROUP BY 1, 2),
pair AS (SELECT a, b FROM shared JOIN size sa ON sa.doc_id = a JOIN size sb ON sb.doc_id = b WHERE 100 * k >= 80 * (sa.n + sb.n - k)),
link AS (SELECT a, b FROM pair UNION ALL SELECT b, a FROM pair),
reach AS (SELECT doc_id, doc_id AS r FROM w UNION SELECT reach.doc_id, link.b FROM reach JOIN link ON reach.r = link.a)
SELECT w.doc_id, coalesce(any_value(size.n), 0) AS n_shingles, min(r) AS component_id
FROM w LEFT JOIN size USING (doc_id) JOIN reach USING (doc_id) GROUP BY w.doc_id
"""

LINE_DEDUP = r"""
WITH line AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS i FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents)),
keyed AS (SELECT *, translate(trim(line, concat(' ', chr(9), chr(10), chr(11), chr(12), chr(13))), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM line),
common AS (SELECT k, max(doc_id) AS last FROM keyed WHERE length(k) >= 20 GROUP BY k HAVING count(DISTINCT doc_id) >= 3),
judged AS (SELECT doc_id, line, i, last IS NULL OR doc_id = last AS stays FROM keyed LEFT JOIN common USING (k))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (NOT stays) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (stays), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""

_ROUND = """
d{r} AS (SELECT x.id, x.row, c.c, sum((x.x - c.x) * (x.x - c.x)) AS d FROM x JOIN c{r} c USING (i) GROUP BY x.id, x.row, c.c),
a{r} AS (SELECT id, row, min(d) AS d, arg_min(c, (d, c)) AS c FROM d{r} GROUP BY id, row)"""
_MOVE = """,
c{n} AS (SELECT c{r}.c, c{r}.i, coalesce(m.x, c{r}.x) AS x FROM c{r} LEFT JOIN
  (SELECT c, i, (s - ((s % n) + n) % n) // n AS x FROM (SELECT a.c, x.i, sum(x.x) AS s, count(*) AS n FROM x JOIN a{r} a USING (row) GROUP BY a.c, x.i)) m USING (c, i)),"""
CENTROID_CLUSTERING = """
WITH e AS (SELECT vec_id AS id, row_number() OVER (ORDER BY sha256('1:' || vec_id)) AS row, embedding AS v FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda y: y IS NULL OR NOT isfinite(y))) = 0),
x AS (SELECT id, row, generate_subscripts(v, 1) AS i, CAST(floor(64 * CAST(unnest(v) AS DOUBLE)) AS BIGINT) AS x FROM e),
c0 AS (SELECT CAST(row - 1 AS INTEGER) AS c, i, x FROM x WHERE row <= 16),""" + "".join(_ROUND.format(r=r) + (_MOVE.format(r=r, n=r + 1) if r < 3 else "") for r in range(4)) + """,
named AS (SELECT c, sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY i)) AS sha FROM c3 GROUP BY c),
inertia AS (SELECT c, sum(d) AS s FROM a3 GROUP BY c)
SELECT id AS vec_id, a3.c AS cluster, CAST(d AS BIGINT) AS distance, CAST(inertia.s AS BIGINT) AS cluster_inertia,
       CAST((SELECT sum(d) FROM a3) AS BIGINT) AS inertia, sha AS centroid_sha256
FROM a3 JOIN inertia USING (c) JOIN named USING (c)
"""

ORACLES = {"op1_substring_dedup": SUBSTRING_DEDUP, "op2_exact_dedup": EXACT_DEDUP, "op5_ngram_jaccard_join": NGRAM_JACCARD_JOIN, "op11_line_dedup": LINE_DEDUP, "op12_centroid_clustering": CENTROID_CLUSTERING}
