"""DuckDB SQL of the queries that SQL can express on whole tables."""

ORACLES: dict[str, str] = {}

ORACLES["op2_quality_ledger"] = r"""
WITH t AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS x FROM documents),
w AS (SELECT r, doc_id, x, regexp_extract_all(x, '[^\x20\x09-\x0D]+') AS words, list_filter(string_split(x, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS lines FROM t),
p AS (SELECT r, unnest(range(1, len(words) - 1)) AS i, words FROM w WHERE len(words) > 2),
g AS (SELECT r, i, count(*) OVER (PARTITION BY r, words[i], words[i + 1], words[i + 2]) AS n FROM p),
c AS (SELECT r, count(DISTINCT i + k) AS n FROM g, (VALUES (0), (1), (2)) AS o(k) WHERE n > 1 GROUP BY r),
m AS (SELECT w.doc_id, len(words)::BIGINT AS n_words, coalesce(list_sum(list_transform(words, lambda v: length(v))), 0)::BIGINT AS word_chars,
        length(regexp_replace(x, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
        coalesce(c.n, 0)::BIGINT AS n_repeat_words, len(lines)::BIGINT AS n_lines, len(list_filter(words, lambda v: regexp_matches(v, '\p{L}')))::BIGINT AS n_alpha
      FROM w LEFT JOIN c USING (r)),
b AS (SELECT *, (CASE WHEN n_words < 50 THEN 1 ELSE 0 END + CASE WHEN 100 * n_repeat_words > 50 * n_words THEN 2 ELSE 0 END
        + CASE WHEN 100 * n_symbols > 10 * n_words THEN 4 ELSE 0 END + CASE WHEN 100 * n_dup_lines > 40 * n_lines THEN 8 ELSE 0 END
        + CASE WHEN 100 * word_chars < 250 * n_words THEN 16 ELSE 0 END + CASE WHEN 100 * word_chars > 1200 * n_words THEN 32 ELSE 0 END
        + CASE WHEN 100 * n_alpha < 70 * n_words THEN 64 ELSE 0 END)::BIGINT AS fail_bits FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  fail_bits = 0 AS kept, fail_bits, 'v3' AS policy FROM b
"""

ORACLES["op3_line_windows"] = r"""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS i FROM documents),
n AS (SELECT doc_id, i, trim(line, ' ' || chr(9) || chr(13)) AS t, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS k FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
w AS (SELECT a.doc_id, a.k, a.i AS i1, b.i AS i2, c.i AS i3, first_value((a.doc_id, a.k)) OVER (PARTITION BY a.t, b.t, c.t ORDER BY a.doc_id, a.k) AS f
      FROM n a JOIN n b ON b.doc_id = a.doc_id AND b.k = a.k + 1 JOIN n c ON c.doc_id = a.doc_id AND c.k = a.k + 2),
g AS (SELECT DISTINCT doc_id, unnest([i1, i2, i3]) AS i FROM w WHERE (doc_id, k) <> f)
SELECT l.doc_id, count(*)::BIGINT AS n_lines, count(g.i)::BIGINT AS n_removed, coalesce(string_agg(g.i::VARCHAR, ',' ORDER BY l.i) FILTER (g.i IS NOT NULL), '') AS removed,
  coalesce(string_agg(l.line, chr(10) ORDER BY l.i) FILTER (g.i IS NULL), '') AS text
FROM l LEFT JOIN g ON g.doc_id = l.doc_id AND g.i = l.i GROUP BY l.doc_id
"""

ORACLES["op7_subspace_join"] = """
WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e, sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS n FROM embeddings),
k AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND list_dot_product(a.e, b.e) / (a.n * b.n) >= 0.93),
r(a, b) AS (SELECT a, b FROM k UNION SELECT r.a, k.b FROM r JOIN k ON k.a = r.b)
SELECT v.vec_id, (SELECT count(*) FROM k WHERE k.a = v.vec_id)::BIGINT AS n_links, least(v.vec_id, coalesce(m.b, v.vec_id)) AS component_id,
  v.vec_id <= coalesce(m.b, v.vec_id) AS kept
FROM v LEFT JOIN (SELECT a, min(b) AS b FROM r GROUP BY a) m ON m.a = v.vec_id
"""

ORACLES["op8_url_filter"] = r"""
WITH RECURSIVE rules(v, h, p) AS (VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')),
u AS (SELECT page_id, url, html, coalesce(lower(regexp_extract(url, '://([^/?#]*)', 1)), '') AS host, coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
tags AS (SELECT url, host, unnest(regexp_extract_all(html, '(?i)<(?:link|meta)\b[^>]*>')) AS tag FROM u),
t AS (SELECT url, host, regexp_extract(tag, '(?i)\bhref\s*=\s*["'']?([^"''\s>]+)', 1) AS target FROM tags WHERE regexp_matches(tag, '(?i)<link.*\brel\s*=\s*["'']?canonical\b')
      UNION ALL SELECT url, host, regexp_extract(tag, '(?i)\bcontent\s*=\s*["'']?[^"''>]*?url\s*=\s*[''"]?([^"''\s>]+)', 1) FROM tags WHERE regexp_matches(tag, '(?i)<meta.*\bhttp-equiv\s*=\s*["'']?refresh\b')),
f AS (SELECT url, CASE WHEN regexp_matches(target, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN target WHEN target LIKE '//%' THEN split_part(url, '://', 1) || ':' || target
        WHEN target LIKE '/%' THEN split_part(url, '://', 1) || '://' || host || target END AS x FROM t),
e AS (SELECT lower(regexp_extract(url, '://([^/?#]*)', 1)) || regexp_extract(url, '://[^/?#]*([^?#]*)', 1) AS a, lower(regexp_extract(x, '://([^/?#]*)', 1)) || regexp_extract(x, '://[^/?#]*([^?#]*)', 1) AS b FROM f WHERE x IS NOT NULL),
k AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
c(a, b) AS (SELECT a, b FROM k UNION SELECT c.a, k.b FROM c JOIN k ON k.a = c.b),
node AS (SELECT DISTINCT b AS x, split_part(b, '/', 1) AS h, substr(b, length(split_part(b, '/', 1)) + 1) AS p FROM k),
own AS (SELECT x, arg_max(v, length(rules.h || rules.p)) AS v FROM node JOIN rules ON (node.h = rules.h OR node.h LIKE '%.' || rules.h) AND starts_with(node.p, rules.p) GROUP BY x),
d AS (SELECT c.a, min(own.v) AS v FROM c JOIN own ON own.x = c.b GROUP BY c.a),
best AS (SELECT page_id, arg_max(rules.h || rules.p, length(rules.h || rules.p)) AS rule, arg_max(v, length(rules.h || rules.p)) AS v
         FROM u JOIN rules ON (u.host = rules.h OR u.host LIKE '%.' || rules.h) AND starts_with(u.path, rules.p) GROUP BY page_id)
SELECT u.page_id, host, path, best.rule AS rule, coalesce(best.v, d.v, 'allow') AS verdict FROM u LEFT JOIN best USING (page_id) LEFT JOIN d ON d.a = u.host || u.path
"""

ORACLES["op12_filter_audit"] = r"""
WITH t AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS x, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
l AS (SELECT doc_id, max(coalesce(quality = 1, false)) AS good, max(coalesce(toxic = 1, false)) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
m AS (SELECT part, (CASE WHEN len(w) < 100 THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(w)) < 80 * len(w) THEN 'B' ELSE '' END
        || CASE WHEN 100 * length(regexp_replace(x, '[^A-Z]', '', 'g')) > 10 * length(x) THEN 'C' ELSE '' END || CASE WHEN regexp_matches(x, '[#$%&*|]') THEN 'D' ELSE '' END
        || CASE WHEN t.doc_id > min(t.doc_id) OVER (PARTITION BY x) THEN 'E' ELSE '' END) AS fails, coalesce(l.good, false) AS good, coalesce(l.toxic, false) AS toxic
      FROM t LEFT JOIN l ON l.doc_id = t.doc_id),
g AS (SELECT part, fails, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM m GROUP BY part, fails),
f(x) AS (VALUES ('A'), ('B'), ('C'), ('D'), ('E')),
o AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM f a JOIN f b ON b.x <> a.x JOIN f c ON c.x NOT IN (a.x, b.x) JOIN f d ON d.x NOT IN (a.x, b.x, c.x) JOIN f e ON e.x NOT IN (a.x, b.x, c.x, d.x)),
p AS (SELECT g.*, filter_order, coalesce(list_min(list_transform(string_split(NULLIF(fails, ''), ''), lambda v: strpos(filter_order, v))), 6) AS gone FROM g, o),
s AS (SELECT part, filter_order, step::INTEGER AS step, substr(filter_order, step, 1) AS letter, sum(n) FILTER (gone > step) AS kept, sum(n) FILTER (gone = step) AS removed,
        sum(n) FILTER (gone < step AND contains(fails, substr(filter_order, step, 1))) AS redundant, sum(n) FILTER (fails = substr(filter_order, step, 1)) AS unique_fails,
        sum(good) FILTER (gone = step) AS good_lost, sum(toxic) FILTER (gone = step) AS toxic_lost
      FROM p, (VALUES (1), (2), (3), (4), (5)) AS k(step) GROUP BY part, filter_order, step)
SELECT part, filter_order, step, coalesce(kept, 0)::BIGINT AS kept, coalesce(removed, 0)::BIGINT AS removed, coalesce(redundant, 0)::BIGINT AS redundant,
  coalesce(unique_fails, 0)::BIGINT AS unique_fails, coalesce(good_lost, 0)::BIGINT AS good_lost, coalesce(toxic_lost, 0)::BIGINT AS toxic_lost,
  sum(coalesce(removed, 0)) OVER (PARTITION BY part, letter)::BIGINT AS shapley FROM s
"""
