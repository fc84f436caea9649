"""DuckDB SQL of the queries that SQL can express, over whole tables."""

ORACLES: dict[str, str] = {}

ORACLES["op6_url_filter"] = r"""
WITH rules(rule_host, rule_path, rule_verdict) AS (
  VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')
), parts AS (
  SELECT row_number() OVER () AS r, page_id,
         translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages
), ranked AS (
  SELECT r, page_id, host, path, rule_host || rule_path AS rule, rule_verdict,
         row_number() OVER (PARTITION BY r ORDER BY length(rule_host || rule_path) DESC NULLS LAST, length(rule_host) DESC, rule_verdict DESC) AS k
  FROM parts LEFT JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
)
SELECT page_id, host, path, rule, coalesce(rule_verdict, 'allow') AS verdict FROM ranked WHERE k = 1
"""

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLES["op9_decontamination"] = rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT item_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), win AS (
  SELECT DISTINCT item_id, k, array_to_string(w[i : i + k - 1], ' ') AS g
  FROM (SELECT item_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM (SELECT *, least(13, len(w)) AS k FROM b WHERE len(w) > 0))
), grams AS (
  SELECT r, k, i, array_to_string(w[i : i + k - 1], ' ') AS g
  FROM (SELECT r, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d JOIN (SELECT DISTINCT k FROM win) ON len(w) >= k)
), hits AS (
  SELECT r, i, k, item_id FROM grams JOIN win USING (k, g)
), words_hit AS (
  SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + k)) AS p FROM hits) GROUP BY r
), items AS (
  SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS listed FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS item FROM hits WHERE item_id IS NOT NULL) GROUP BY r
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(listed, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN words_hit USING (r) LEFT JOIN items USING (r)
"""

ORACLES["op3_near_duplicates"] = rf"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS w FROM documents
), sh AS (
  SELECT DISTINCT doc_id, array_to_string(w[i : i + k - 1], ' ') AS g
  FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM (SELECT *, least(5, len(w)) AS k FROM d WHERE len(w) > 0))
), size AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
both_ AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM sh a JOIN sh b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
link AS (
  SELECT x, y FROM both_ JOIN size p ON p.doc_id = x JOIN size q ON q.doc_id = y WHERE 100 * c >= 80 * (p.n + q.n - c)
), edge AS (SELECT x AS a, y AS b FROM link UNION ALL SELECT y, x FROM link),
reach AS (
  SELECT doc_id AS node, doc_id AS root FROM d UNION SELECT edge.b, reach.root FROM reach JOIN edge ON edge.a = reach.node
)
SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, root AS component_id
FROM d LEFT JOIN size USING (doc_id) JOIN (SELECT node, min(root) AS root FROM reach GROUP BY node) ON node = d.doc_id
"""


def _level(name: str, of: str, parent: str, path: str, weight: str) -> str:
    """Shares of one level by exact integer filling: full children first, the others at the level of the first that is not."""
    up = f"PARTITION BY {parent}" if parent else ""
    budget = "(SELECT total FROM budget)" if not parent else "p.share"
    join = f"JOIN {of} p USING ({parent})" if parent else ""
    return f"""
n_{name} AS (SELECT {path}, CAST(sum(tokens) * 2 AS HUGEINT) AS cap, CAST(any_value({weight}) AS HUGEINT) AS w FROM leaf GROUP BY {path}),
b_{name} AS (SELECT n.*, CAST({budget} AS HUGEINT) AS budget FROM n_{name} n {join}),
f_{name} AS (
  SELECT *, budget - coalesce(sum(cap) OVER (fill ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS room, sum(w) OVER (fill ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS ws
  FROM b_{name} WHERE w > 0 AND cap > 0 WINDOW fill AS ({up} ORDER BY CAST(cap AS DOUBLE) / CAST(w AS DOUBLE), {path})
), o_{name} AS (
  SELECT *, max(CASE WHEN greatest(room, 0) * w // ws < cap THEN room END) OVER ({up}) AS l, max(CASE WHEN greatest(room, 0) * w // ws < cap THEN ws END) OVER ({up}) AS lw FROM f_{name}
), {name} AS (
  SELECT {path}, CASE WHEN greatest(room, 0) * w // ws < cap THEN greatest(l, 0) * w // lw ELSE cap END AS share FROM o_{name}
)"""


ORACLES["op1_source_mixing"] = (
    r"""
WITH u AS (
  SELECT doc_id, lang, source, 'domain' || (CAST('0x' || substr(md5(coalesce(source, '')), 1, 1) AS BIGINT) % 4) AS dom, coalesce(lang, '') AS lan, coalesce(source, '') AS src,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS tokens
  FROM documents
), leaf AS (SELECT dom, lan, src, sum(tokens) AS tokens FROM u WHERE tokens > 0 GROUP BY ALL),
budget AS (SELECT sum(tokens) * 75 // 100 AS total FROM leaf),"""
    + _level("l1", "", "", "dom", "1") + ","
    + _level("l2", "l1", "dom", "dom, lan", "CASE lan WHEN 'en' THEN 4 WHEN 'de' THEN 2 WHEN 'fr' THEN 2 WHEN 'es' THEN 2 ELSE 1 END") + ","
    + _level("l3", "l2", "dom, lan", "dom, lan, src", "1")
    + r""",
plan AS (SELECT dom, lan, src, CAST(share // tokens AS BIGINT) AS whole, CAST(share % tokens AS BIGINT) AS rest FROM l3 JOIN leaf USING (dom, lan, src)),
placed AS (
  SELECT u.*, whole, rest, coalesce(sum(tokens) OVER (PARTITION BY dom, lan, src ORDER BY CAST('0x' || substr(md5('42:' || whole || ':' || doc_id), 1, 15) AS BIGINT), CAST(doc_id AS VARCHAR) ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
  FROM u JOIN plan USING (dom, lan, src) WHERE tokens > 0
)
SELECT doc_id, lang, source, CAST(e AS BIGINT) AS mix_epoch, CAST(tokens AS BIGINT) AS mix_tokens FROM (SELECT *, unnest(range(whole)) AS e FROM placed)
UNION ALL
SELECT doc_id, lang, source, whole, CAST(least(tokens, rest - start) AS BIGINT) FROM placed WHERE start < rest
"""
)
