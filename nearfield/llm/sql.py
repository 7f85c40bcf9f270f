"""DuckDB SQL for the queries that SQL can express."""


def extendible_hashing(limit: int) -> str:
    return f"""
WITH RECURSIVE docs AS (
  SELECT doc_id, coalesce(strlen(text), 0)::BIGINT AS n,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS h
  FROM documents),
tree(d, p, total, low, high) AS (
  SELECT 0, 0::BIGINT, sum(n)::BIGINT, min(h), max(h) FROM docs HAVING count(*) > 0
  UNION ALL
  SELECT t.d + 1, x.h >> (59 - t.d), sum(x.n)::BIGINT, min(x.h), max(x.h)
  FROM tree t JOIN docs x ON (CASE WHEN t.d = 0 THEN 0 ELSE x.h >> (60 - t.d) END) = t.p
  WHERE t.total > {limit} AND t.low < t.high
  GROUP BY t.d, x.h >> (59 - t.d)),
leaves AS (SELECT * FROM tree WHERE total <= {limit} OR low = high)
SELECT x.doc_id, CASE WHEN l.d = 0 THEN '' ELSE lpad(bin(l.p), l.d, '0') END AS shard,
       l.d::INTEGER AS shard_depth, x.n AS shard_row_bytes
FROM docs x JOIN leaves l ON (CASE WHEN l.d = 0 THEN 0 ELSE x.h >> (60 - l.d) END) = l.p
"""


WARC = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS body, coalesce(url, '') AS url FROM pages),
r AS (
  SELECT page_id, body, sha1(body) AS h, first_value(page_id) OVER w AS lead, row_number() OVER w AS k
  FROM p WINDOW w AS (PARTITION BY body ORDER BY page_id, url)),
d AS (
  SELECT *, [('0x' || substr(h, (5 * i + 1)::BIGINT, 5))::BIGINT for i in range(0, 8)] AS v FROM r)
SELECT page_id, strlen(body)::BIGINT AS payload_bytes,
       array_to_string([
         substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((x >> 15) & 31) + 1, 1) ||
         substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((x >> 10) & 31) + 1, 1) ||
         substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((x >> 5) & 31) + 1, 1) ||
         substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (x & 31) + 1, 1) for x in v], '') AS payload_digest,
       CASE WHEN k = 1 THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN k = 1 THEN NULL ELSE lead END AS refers_to
FROM d
"""

JACCARD = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, [x for x in string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \t\n\x0B\f\r]+') if x <> ''] AS w
  FROM documents),
g AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
         ELSE list_distinct([w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] for i in range(1, len(w) - 1)]) END AS s
  FROM w),
n AS (SELECT doc_id, len(s)::BIGINT AS n FROM g),
e AS (SELECT doc_id, unnest(s) AS s FROM g),
i AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared
  FROM e a JOIN e b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (
  SELECT a, b FROM i JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE 100 * shared >= 90 * (x.n + y.n - shared)),
edge AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
reach(doc_id, other) AS (
  SELECT doc_id, doc_id FROM n
  UNION
  SELECT r.doc_id, edge.b FROM reach r JOIN edge ON r.other = edge.a)
SELECT n.doc_id, n.n AS n_shingles, min(r.other) AS component_id
FROM n JOIN reach r ON n.doc_id = r.doc_id GROUP BY ALL
"""

MIXTURE = """
WITH d AS (
  SELECT doc_id, text, source, coalesce(source, '') AS s,
         ('0x' || substr(md5('mix-1:' || coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT / 4503599627370496.0 AS u
  FROM documents),
r AS (
  SELECT s, (1.0 / count(*) OVER ()) * sum(count(*)) OVER () / count(*) AS rate FROM d GROUP BY s),
t AS (
  SELECT s, k, sum(exp(-rate + k * ln(rate) - lgamma(k + 1))) OVER (PARTITION BY s ORDER BY k) AS below
  FROM r, (SELECT unnest(range(0, 2000)) AS k) WHERE k <= rate + 12 * sqrt(rate) + 40),
c AS (SELECT doc_id, text, source, count(*) FILTER (WHERE below <= u) AS n FROM d JOIN t USING (s) GROUP BY ALL),
x AS (SELECT *, unnest(range(0, n)) AS copy FROM c)
SELECT doc_id, source, copy, n AS n_copies,
       ('0x' || substr(md5('mix-1:shuffle:' || coalesce(doc_id::VARCHAR, '') || ':' || copy), 1, 15))::BIGINT AS shuffle_key,
       md5(text) AS text_md5
FROM x
"""

LINES = r"""
WITH t AS (SELECT doc_id, string_split(text, chr(10)) AS a FROM documents),
l AS (
  SELECT doc_id, number, [x for x in string_split_regex(line, '[ \t\r\f\x0B]+') if x <> ''] AS w
  FROM (SELECT doc_id, unnest(a) AS line, unnest(range(len(a))) AS number FROM t)),
q AS (
  SELECT doc_id, number, doc_id * 10000000 + number AS p, len(w) < 4 AS short,
         CASE WHEN len(w) < 4 THEN regexp_extract_all(array_to_string(w, ' '), '(?s).') ELSE w END AS s
  FROM l WHERE len(w) > 0),
k AS (SELECT *, array_to_string(s, chr(31)) AS whole FROM q),
f AS (SELECT short, whole, any_value(s) AS s, min(p) AS p FROM k GROUP BY short, whole),
v AS (
  SELECT short, whole, p, i, array_to_string(list_concat(s[:i - 1], s[i + 1:]), chr(31)) AS rest
  FROM (SELECT *, unnest(range(1, len(s) + 1)) AS i FROM f)),
near AS (
  SELECT short, whole FROM (SELECT *, min(p) OVER (PARTITION BY short, rest, i) AS m FROM v) WHERE m < p
  UNION SELECT v.short, v.whole FROM v JOIN f ON v.short = f.short AND v.rest = f.whole WHERE f.p < v.p
  UNION SELECT f.short, f.whole FROM v JOIN f ON v.short = f.short AND v.rest = f.whole WHERE v.p < f.p),
e AS (
  SELECT k.doc_id, k.number, f.p < k.p AS exact, n.whole IS NOT NULL AS near
  FROM k JOIN f ON k.short = f.short AND k.whole = f.whole LEFT JOIN near n ON k.short = n.short AND k.whole = n.whole)
SELECT d.doc_id, count(e.number)::BIGINT AS n_lines, count(e.number) FILTER (WHERE exact)::BIGINT AS n_exact,
       count(e.number) FILTER (WHERE near AND NOT exact)::BIGINT AS n_near,
       coalesce(sum(CASE WHEN exact OR near THEN 0 ELSE number + 1 END), 0)::BIGINT AS kept_places
FROM documents d LEFT JOIN e USING (doc_id) GROUP BY d.doc_id
"""
