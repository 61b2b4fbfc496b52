"""DuckDB SQL that gives the rows of those queries which SQL can express."""

from __future__ import annotations

#: A-Z lower-cased, nothing else.
ASCII_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def url_filter(rules, listed_labels) -> str:
    text = {r: r.text.replace("'", "''") for r in rules}
    fits = {r: f"((host = '{r.host}' OR ends_with(host, '.{r.host}')) AND starts_with(path, '{r.path}'))" for r in rules}
    ordered = sorted(rules, key=lambda r: (len(r.text), r.text), reverse=True)
    rule = " ".join(f"WHEN {fits[r]} THEN '{text[r]}'" for r in ordered)
    verdict = " ".join(f"WHEN {fits[r]} THEN '{r.verdict}'" for r in ordered)
    labels = ", ".join(f"'{x}'" for x in listed_labels)
    return f"""
    WITH u AS (
      SELECT page_id,
             {ASCII_LOWER.format("coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), '')")} AS host,
             coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
      FROM pages
    ), l AS (SELECT *, list_has_any(string_split(host, '.'), [{labels}]) AS listed FROM u)
    SELECT page_id, host, path, CASE {rule} END AS rule,
           CASE {verdict} WHEN listed THEN 'block' ELSE 'allow' END AS verdict, listed
    FROM l"""


WARC = """
WITH p AS (
  SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages
), g AS (SELECT h, max(page_id) AS best FROM p GROUP BY h)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes,
       array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         1 + (((('0x' || substr(p.h, (1 + 5 * (i // 4))::INT, 5))::BIGINT >> (15 - 5 * (i % 4))::INT) & 31)::INT), 1)), '') AS payload_digest,
       CASE WHEN page_id < best THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id < best THEN best END AS refers_to
FROM p JOIN g ON p.h = g.h"""

NEAR_DUP = r"""
WITH RECURSIVE w AS (
  SELECT row_number() OVER (ORDER BY doc_id) AS r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), s AS (
  SELECT DISTINCT r, md5_number(array_to_string(w[i:i + 4], ' ')) AS x
  FROM w, unnest(range(1, greatest(2, len(w) - 3))) AS u(i) WHERE len(w) > 0
), n AS (SELECT r, count(*) AS n FROM s GROUP BY r
), l AS (
  SELECT a.r AS a, b.r AS b FROM s a JOIN s b ON a.x = b.x AND a.r <> b.r
  JOIN n na ON na.r = a.r JOIN n nb ON nb.r = b.r
  GROUP BY a.r, b.r HAVING 100 * count(*) >= 85 * (any_value(na.n) + any_value(nb.n) - count(*))
), c(r, label) AS (
  SELECT r, r FROM w UNION SELECT l.b, c.label FROM c JOIN l ON l.a = c.r
), m AS (SELECT c.r, min(d.doc_id) AS component_id FROM c JOIN w d ON d.r = c.label GROUP BY c.r)
SELECT doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept
FROM w JOIN m ON m.r = w.r LEFT JOIN n ON n.r = w.r"""


def centroids(k: int, rounds: int) -> str:
    away = "list_sum(list_transform(list_zip(v.p, c.p), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT"
    steps = ""
    for i in range(rounds + 1):
        steps += f""", a{i} AS MATERIALIZED (
  SELECT r, any_value(vec_id) AS vec_id, any_value(v.p) AS p, min({{'d': {away}, 'c': c.c}}) AS m FROM v, c{i} AS c GROUP BY r)"""
        if i < rounds:
            steps += f""", c{i + 1} AS MATERIALIZED (
  SELECT c.c, coalesce(s.p, c.p) AS p FROM c{i} AS c LEFT JOIN (
    SELECT c, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY j) AS p
    FROM (SELECT m.c AS c, j, sum(p[j])::BIGINT AS s, count(*) AS n FROM a{i}, unnest(range(1, 65)) AS u(j) GROUP BY 1, 2) GROUP BY c
  ) s ON s.c = c.c)"""
    return f"""
WITH v AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY vec_id) AS r, vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS p FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64
), c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY h, p) - 1 AS c, p FROM (SELECT sha256('1:' || vec_id) AS h, p FROM v WHERE vec_id IS NOT NULL) ORDER BY h, p LIMIT {k}
){steps}
SELECT vec_id, m.c::INT AS cluster, m.d AS distance, (sum(m.d) OVER (PARTITION BY m.c))::BIGINT AS cluster_inertia,
       (sum(m.d) OVER ())::BIGINT AS inertia, sha256(array_to_string(c.p, ',')) AS centroid_sha256
FROM a{rounds} JOIN c{rounds} AS c ON c.c = m.c"""


PHRASES = r"""
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang,
         unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents
), w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p
), f AS (
  SELECT lang, m, array_to_string(w[i:i + m - 1], ' ') AS phrase, count(*) AS a
  FROM w, unnest([1, 2, 3]) AS s(m), unnest(range(1, len(w) - m + 2)) AS u(i) GROUP BY 1, 2, 3
), n AS (SELECT lang, sum(a)::BIGINT AS n FROM f WHERE m = 1 GROUP BY lang
), c AS (SELECT *, string_split(phrase, ' ') AS w FROM f WHERE m > 1 AND a >= 10
), cuts AS (
  SELECT c.lang, c.phrase, c.a, k, l.a AS l, r.a AS r, (1000000::HUGEINT * c.a * c.a) // (l.a::HUGEINT * r.a) AS score
  FROM c, unnest(range(1, c.m)) AS u(k)
  JOIN f l ON l.lang = c.lang AND l.phrase = array_to_string(c.w[1:k], ' ')
  JOIN f r ON r.lang = c.lang AND r.phrase = array_to_string(c.w[k + 1:], ' ')
), best AS (
  SELECT lang, phrase, a, l, r, score FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
), long AS (
  SELECT lang, array_to_string(w[i:i + 1], ' ') AS phrase, max(a) AS over FROM c, unnest([1, 2]) AS u(i) WHERE m = 3 GROUP BY 1, 2
), kept AS (
  SELECT b.* FROM best b LEFT JOIN long g ON g.lang = b.lang AND g.phrase = b.phrase AND len(string_split(b.phrase, ' ')) = 2
  WHERE g.over IS NULL OR 100 * g.over < 50 * b.a
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score::BIGINT AS score
FROM kept JOIN n USING (lang) QUALIFY rank <= 2000"""
