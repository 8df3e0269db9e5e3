"""DuckDB SQL for the corpus queries that SQL can express."""

#: Lower-cases A-Z alone (lower() would change other letters too).
_LOWER = "translate(coalesce({0}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = f"regexp_extract_all({_LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

_OP5 = f"""
WITH dw AS (SELECT doc_id, {_WORDS.format("text")} AS w FROM documents),
bw AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, {_WORDS.format("text")} AS w FROM benchmark),
win AS (
  SELECT DISTINCT item, least(13, len(w)) AS n, array_to_string(w[k:k + least(13, len(w)) - 1], ' ') AS g
  FROM (SELECT item, w, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS k FROM bw WHERE len(w) > 0)
),
sizes AS (SELECT DISTINCT n FROM win),
occ AS (
  SELECT doc_id, n, k, array_to_string(w[k:k + n - 1], ' ') AS g
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM dw, sizes WHERE len(w) >= n)
),
hit AS (SELECT o.doc_id, o.n, o.k, win.item FROM occ o JOIN win ON o.n = win.n AND o.g = win.g),
cov AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + n)) AS p FROM hit) GROUP BY doc_id),
its AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, item FROM hit) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM dw d LEFT JOIN cov USING (doc_id) LEFT JOIN its USING (doc_id)
"""

_SPACED = "regexp_extract_all({0}, '[^\\x20\\x09-\\x0D]+')"

_OP8 = f"""
WITH d AS MATERIALIZED (
  SELECT doc_id, row_number() OVER () AS r, coalesce(text, '') AS t, CASE WHEN source IS NULL THEN '-' ELSE '+' || source END AS host,
    {_SPACED.format("coalesce(text, '')")} AS w
  FROM documents
),
gram AS (
  SELECT r, k, array_to_string(w[k:k + 4], ' ') AS g
  FROM (SELECT r, w, unnest(range(1, len(w) - 3)) AS k FROM d WHERE len(w) >= 5)
),
twice AS (SELECT r, g FROM gram GROUP BY r, g HAVING count(*) > 1),
rep AS (
  SELECT r, count(DISTINCT p) AS n
  FROM (SELECT r, unnest(range(k, k + 5)) AS p FROM gram JOIN twice USING (r, g)) GROUP BY r
),
line AS (SELECT doc_id, r, host, unnest(string_split(t, chr(10))) AS x FROM d),
dup AS (SELECT r, count(*) - count(DISTINCT x) AS n FROM line WHERE regexp_matches(x, '[^\\x20\\x09-\\x0D]') GROUP BY r),
norm AS (SELECT coalesce('d' || doc_id, 'r' || r) AS doc, r, host, array_to_string({_WORDS.format("x")}, ' ') AS y, len({_SPACED.format("x")}) AS n FROM line),
common AS (SELECT host, y FROM norm WHERE y <> '' GROUP BY host, y HAVING count(DISTINCT doc) > 100),
cut AS (SELECT r, sum(n) AS n FROM norm JOIN common USING (host, y) GROUP BY r),
m AS (
  SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
    CAST(len(regexp_extract_all(t, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
    CAST(coalesce(dup.n, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words,
    CAST(len(w) - coalesce(cut.n, 0) AS BIGINT) AS n_left
  FROM d LEFT JOIN dup USING (r) LEFT JOIN rep USING (r) LEFT JOIN cut USING (r)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed, n_left,
  NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND n_left >= 0.5 * n_words AS kept
FROM m
"""

_HOST = "nullif(rtrim(regexp_extract(lower(trim(url)), '^https?://(?:[^/?#@\\s]*@)?([^/?#:@\\s]+)', 1), '.'), '')"
_PATH = "regexp_extract(trim(url), '^[A-Za-z]+://[^/?#]*(/[^?#]*)', 1)"

_OP9 = f"""
WITH cap AS (
  SELECT page_id, url, CAST(DATE '2024-01-01' + CAST((page_id * 37) % 366 AS INTEGER) AS DATE) AS fetched_at, {_HOST} AS host, {_PATH} AS path
  FROM pages
),
h AS (
  SELECT host, CAST('0x' || substr(md5(host), 1, 3) AS INTEGER) AS a, CAST('0x' || substr(md5(host), 4, 3) AS INTEGER) AS b,
    CAST('0x' || substr(md5(host), 7, 3) AS INTEGER) AS c
  FROM (SELECT DISTINCT host FROM cap WHERE host IS NOT NULL)
),
entry AS (
  SELECT host AS pattern, 'block' AS action, b % 300 AS d FROM h WHERE a % 3 = 0
  UNION ALL SELECT host, 'remove', b % 300 + 20 + c % 60 FROM h WHERE a % 3 = 0 AND c % 2 = 0
  UNION ALL SELECT host, 'block', b % 300 + 100 + c % 60 FROM h WHERE a % 6 = 0 AND c % 2 = 0
  UNION ALL SELECT host || '/en', 'allow', c % 366 FROM h WHERE a % 2 = 0
  UNION ALL SELECT host || '/fr', 'block', b % 200 FROM h WHERE a % 5 = 0
  UNION ALL SELECT DISTINCT 'example.org', 'block', 180 FROM h WHERE host LIKE '%.example.org'
),
one AS (
  SELECT lower(pattern) AS pattern, CAST(DATE '2024-01-01' + CAST(d AS INTEGER) AS DATE) AS listed_at, max(action) AS action
  FROM entry GROUP BY ALL
),
iv AS (SELECT *, lead(listed_at) OVER (PARTITION BY pattern ORDER BY listed_at) AS ended FROM one),
seg AS (SELECT *, regexp_extract_all(path, '[^/]+')[1:8] AS segs, string_split(host, '.') AS labels FROM cap),
k AS (
  SELECT page_id, fetched_at, i AS rank, lower(array_to_string(labels[len(labels) - i + 1:], '.')) AS key
  FROM (SELECT *, unnest(range(1, len(labels) + 1)) AS i FROM seg)
  UNION ALL
  SELECT page_id, fetched_at, 100 + i, lower(host || '/' || array_to_string(segs[1:i], '/'))
  FROM (SELECT *, unnest(range(1, len(segs) + 1)) AS i FROM seg)
),
best AS (
  SELECT page_id, arg_max({{'p': pattern, 'a': action, 'l': listed_at}}, rank) AS x
  FROM k JOIN iv ON key = pattern AND action <> 'remove' AND fetched_at >= listed_at AND (ended IS NULL OR fetched_at < ended)
  GROUP BY page_id
)
SELECT page_id, url, fetched_at, host, x.p AS pattern, x.a AS action, x.l AS listed_at, host IS NOT NULL AND coalesce(x.a <> 'block', true) AS kept
FROM cap LEFT JOIN best USING (page_id)
"""

ORACLE_SQL = {
    "op5_decontaminate": _OP5,
    "op8_line_rules": _OP8,
    "op9_url_filter": _OP9,
}
