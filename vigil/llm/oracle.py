"""The registered queries of this package as DuckDB SQL over whole tables, where SQL can express them."""

SQL: dict[str, str] = {}

SQL["op11_url_filter"] = r"""
WITH urls AS (
  SELECT row_number() OVER () AS rid, page_id, CASE WHEN strpos(coalesce(url, ''), '://') > 0
         THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest
  FROM pages),
cut AS (SELECT rid, page_id, regexp_extract(rest, '^[^/?#]*') AS h, rest FROM urls),
parts AS (
  SELECT rid, page_id, translate(h, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(substr(rest, length(h) + 1), '^[^?#]*') AS path
  FROM cut),
rules(rhost, rpath, rverdict) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'),
  ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
best AS (
  SELECT rid, max_by(rhost || rpath, length(rhost || rpath)) AS rule, max_by(rverdict, length(rhost || rpath)) AS rverdict
  FROM parts JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)
  GROUP BY rid)
SELECT page_id, host, path, rule,
       coalesce(rverdict, CASE WHEN length(host) <= 253 AND regexp_matches(host, '(^|[.-])(ads|adult|bets|casino|pills|spam)($|[.-])')
                               THEN 'block' ELSE 'allow' END) AS verdict
FROM parts LEFT JOIN best USING (rid)
"""

SQL["op12_filter_audit"] = r"""
WITH texts AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents),
cut AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws, min(doc_id) OVER (PARTITION BY t) AS low FROM texts),
marked AS (
  SELECT doc_id, part,
         CASE WHEN len(ws) < 100 THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(ws)) < 80 * len(ws) THEN 'B' ELSE '' END
         || CASE WHEN 100 * len(regexp_extract_all(t, '[A-Z]')) > 10 * length(t) THEN 'C' ELSE '' END
         || CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END || CASE WHEN doc_id > low THEN 'E' ELSE '' END AS fails
  FROM cut),
known AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
masks AS (
  SELECT part, fails, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic, count(*) AS n
  FROM marked LEFT JOIN known USING (doc_id) GROUP BY ALL),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
orders AS (
  SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM letters a, letters b, letters c, letters d, letters e
  WHERE a.x NOT IN (b.x, c.x, d.x, e.x) AND b.x NOT IN (c.x, d.x, e.x) AND c.x NOT IN (d.x, e.x) AND d.x <> e.x),
gone AS (
  SELECT *, list_min([CASE WHEN contains(fails, x) THEN strpos(filter_order, x) ELSE 6 END for x in ['A', 'B', 'C', 'D', 'E']]) AS place
  FROM masks, orders),
steps AS (
  SELECT part, filter_order, step, filter_order[step] AS x,
         coalesce(sum(n) FILTER (place > step), 0) AS kept, coalesce(sum(n) FILTER (place = step), 0) AS removed,
         coalesce(sum(n) FILTER (contains(fails, filter_order[step]) AND place < step), 0) AS redundant,
         coalesce(sum(n) FILTER (fails = filter_order[step]), 0) AS unique_fails,
         coalesce(sum(n) FILTER (place = step AND good), 0) AS good_lost, coalesce(sum(n) FILTER (place = step AND toxic), 0) AS toxic_lost
  FROM gone, (SELECT unnest([1, 2, 3, 4, 5])::INTEGER AS step) GROUP BY part, filter_order, step)
SELECT part, filter_order, step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant,
       unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost,
       (sum(removed) OVER (PARTITION BY part, x))::BIGINT AS shapley
FROM steps
"""

SQL["op13_collocations"] = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(
           translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS p
  FROM documents),
cut AS MATERIALIZED (SELECT row_number() OVER () AS piece, lang, regexp_extract_all(p, '[^\x20\x09]+') AS ws FROM pieces),
places AS MATERIALIZED (SELECT piece, lang, unnest(ws) AS w, generate_subscripts(ws, 1) AS k FROM cut),
runs AS MATERIALIZED (
  SELECT lang, w, lead(w) OVER p AS w2, lead(w, 2) OVER p AS w3 FROM places WINDOW p AS (PARTITION BY piece ORDER BY k)),
counts AS MATERIALIZED (
  SELECT lang, 1 AS size, w AS g, count(*) AS f FROM runs GROUP BY ALL
  UNION ALL SELECT lang, 2, w || ' ' || w2, count(*) FROM runs WHERE w2 IS NOT NULL GROUP BY ALL
  UNION ALL SELECT lang, 3, w || ' ' || w2 || ' ' || w3, count(*) FROM runs WHERE w3 IS NOT NULL GROUP BY ALL),
totals AS (SELECT lang, sum(f)::BIGINT AS n FROM counts WHERE size = 1 GROUP BY lang),
cuts AS MATERIALIZED (
  SELECT lang, size, g, f, k, array_to_string(string_split(g, ' ')[:k], ' ') AS g1, array_to_string(string_split(g, ' ')[k + 1:], ' ') AS g2
  FROM counts, (SELECT unnest([1, 2]) AS k) WHERE size >= 2 AND f >= 10 AND k < size),
scored AS (
  SELECT c.lang, c.size, c.g, c.f AS a, k, x.f AS l, y.f AS r, (1000000::HUGEINT * c.f * c.f // (x.f::HUGEINT * y.f))::BIGINT AS score
  FROM cuts c JOIN counts x ON x.lang = c.lang AND x.g = c.g1 JOIN counts y ON y.lang = c.lang AND y.g = c.g2),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, k) = 1),
inner_pairs AS (
  SELECT lang, p, max(f) AS longer FROM (
    SELECT lang, CASE k WHEN 1 THEN g2 ELSE g1 END AS p, f FROM cuts WHERE size = 3) GROUP BY ALL),
ranked AS (
  SELECT b.lang, b.g AS phrase, a, l, r, score, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, b.g) AS rank
  FROM best b LEFT JOIN inner_pairs i ON b.lang = i.lang AND b.g = i.p
  WHERE NOT coalesce(b.size = 2 AND 100 * longer >= 50 * a, false))
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN totals USING (lang) WHERE rank <= 2000
"""
