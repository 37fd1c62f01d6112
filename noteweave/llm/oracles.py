"""The training-data queries as SQL for DuckDB, where SQL can express them."""

from __future__ import annotations

TOP_K = """
WITH q AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
scored AS (
  SELECT a.vec_id AS query_id, b.vec_id AS vec_id,
    CAST(list_sum(list_transform(list_zip(a.v, b.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM (SELECT DISTINCT vec_id, v FROM q WHERE vec_id % 50 = 0) a JOIN q b ON a.vec_id <> b.vec_id
)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM scored QUALIFY rank <= 5
"""

URL_FILTERS = """
WITH p AS (
  SELECT row_number() OVER () AS id, page_id,
    CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest
  FROM pages
),
parts AS (
  SELECT id, page_id,
    translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM p
),
rules(rule_host, rule_path, rule_verdict) AS (
  VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')
),
fits AS (
  SELECT id, rule_host || rule_path AS rule, rule_verdict FROM parts JOIN rules
  ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
),
best AS (SELECT * FROM fits QUALIFY row_number() OVER (PARTITION BY id ORDER BY length(rule) DESC, rule DESC) = 1),
judged AS (
  SELECT page_id, host, path, rule, rule_verdict,
    regexp_matches(host || path, '^(?:[^/]*\\.)?ads\\.') AS ads,
    regexp_matches(host || path, '/(?:account/)?login(?:/|$)') AS login
  FROM parts LEFT JOIN best USING (id)
)
SELECT page_id, host, path, rule,
  CASE WHEN rule IS NOT NULL THEN rule_verdict WHEN ads OR login THEN 'block' ELSE 'allow' END AS verdict,
  CASE WHEN rule IS NOT NULL THEN NULL WHEN ads THEN 'advertising hosts' WHEN login THEN 'login pages' END AS pattern
FROM judged
"""


def _shared(source: str, parent: str, name: str) -> str:
    """Water-filling among siblings, as in ``mixing.shared``: adds got."""
    over = f"PARTITION BY {parent} " if parent else ""
    return f"""
  SELECT *, CASE WHEN filled THEN room ELSE least(room, CAST(floor(
      CAST(budget - coalesce(sum(CASE WHEN filled THEN room END) OVER ({over}), 0) AS DOUBLE) * CAST(weight AS DOUBLE)
      / CAST(sum(CASE WHEN NOT filled THEN weight END) OVER ({over}) AS DOUBLE)) AS BIGINT)) END AS got
  FROM (
    SELECT *, CAST(room AS DOUBLE) * CAST(sum(weight) OVER ({over} ORDER BY room / weight, {name} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE)
      <= CAST(budget - coalesce(sum(room) OVER ({over} ORDER BY room / weight, {name} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE) * CAST(weight AS DOUBLE) AS filled
    FROM {source} WHERE weight > 0 AND room > 0
  )"""


def _case(column: str, weights: dict[str, int], other: int) -> str:
    whens = " ".join(f"WHEN '{k}' THEN {v}" for k, v in weights.items())
    return f"CASE {column} {whens} ELSE {other} END" if whens else str(other)


def mix_sql(domain: str, share: float, weights, max_epochs: int, seed: int) -> str:
    """Budgets by the same formulas; each prefix by a running sum over its leaf."""
    return f"""
WITH RECURSIVE rows_ AS (
  SELECT doc_id, lang, source, coalesce({domain}, '(none)') AS d, coalesce(lang, '(none)') AS l, coalesce(source, '(none)') AS s,
    (length(text) + 3) // 4 AS n_tokens
  FROM documents WHERE length(text) > 0
),
leaves AS (SELECT d, l, s, CAST(sum(n_tokens) AS BIGINT) AS tokens, CAST(sum(n_tokens) * {max_epochs} AS BIGINT) AS room FROM rows_ GROUP BY d, l, s),
lang0 AS (SELECT d, l, CAST(sum(room) AS BIGINT) AS room, {_case("l", weights.lang, weights.other)} AS weight FROM leaves
  WHERE {_case("s", weights.source, weights.other)} > 0 GROUP BY d, l),
domain0 AS (SELECT d, CAST(sum(room) AS BIGINT) AS room, {_case("d", weights.domain, weights.other)} AS weight,
  (SELECT CAST(floor(CAST(sum(tokens) AS DOUBLE) * {share}) AS BIGINT) FROM leaves) AS budget FROM lang0 WHERE weight > 0 GROUP BY d),
domain1 AS ({_shared("domain0", "", "d")}),
lang1 AS (SELECT lang0.*, domain1.got AS budget FROM lang0 JOIN domain1 USING (d)),
lang2 AS ({_shared("lang1", "d", "l")}),
source1 AS (SELECT leaves.*, {_case("s", weights.source, weights.other)} AS weight, lang2.got AS budget FROM leaves JOIN lang2 USING (d, l)),
source2 AS ({_shared("source1", "d, l", "s")}),
plan AS (SELECT d, l, s, got // tokens AS epochs, got % tokens AS need FROM source2),
placed AS (
  SELECT rows_.*, epochs, need,
    sum(n_tokens) OVER (PARTITION BY d, l, s ORDER BY md5('{seed}|' || (epochs + 1) || '|' || doc_id), n_tokens ROWS UNBOUNDED PRECEDING) - n_tokens AS before
  FROM rows_ JOIN plan USING (d, l, s)
),
taken AS (SELECT *, CAST(greatest(0, least(n_tokens, need - before)) AS BIGINT) AS partial_ FROM placed)
SELECT doc_id, d AS domain, lang, source, epoch, n_tokens, CASE WHEN epoch <= epochs THEN n_tokens ELSE partial_ END AS taken
FROM (SELECT *, unnest(range(1, CAST(epochs + CASE WHEN partial_ > 0 THEN 1 ELSE 0 END AS BIGINT) + 1)) AS epoch FROM taken)
"""


AUDIT = """
WITH split AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t,
    list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w
  FROM documents
),
failed AS (
  SELECT doc_id, part, {
    'A': len(w) < 200,
    'B': 100 * len(list_distinct(w)) < 50 * len(w),
    'C': 100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 2 * length(t),
    'D': regexp_matches(t, '[#$%&*|]'),
    'E': coalesce(min(doc_id) OVER (PARTITION BY t) < doc_id, FALSE)
  } AS f FROM split
),
judged AS (SELECT doc_id, max(CAST(quality = 1 AS INTEGER)) AS good, max(CAST(toxic = 1 AS INTEGER)) AS toxic FROM labels GROUP BY doc_id),
masks AS (
  SELECT part, concat(CASE WHEN f.A THEN 'A' END, CASE WHEN f.B THEN 'B' END, CASE WHEN f.C THEN 'C' END, CASE WHEN f.D THEN 'D' END, CASE WHEN f.E THEN 'E' END) AS mask,
    count(*) AS n, coalesce(sum(good), 0) AS good, coalesce(sum(toxic), 0) AS toxic
  FROM failed LEFT JOIN judged USING (doc_id) GROUP BY ALL
),
l(x) AS (VALUES ('A'), ('B'), ('C'), ('D'), ('E')),
orders AS (
  SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM l a JOIN l b ON b.x <> a.x JOIN l c ON c.x NOT IN (a.x, b.x)
  JOIN l d ON d.x NOT IN (a.x, b.x, c.x) JOIN l e ON e.x NOT IN (a.x, b.x, c.x, d.x)
),
steps AS (SELECT filter_order, CAST(step AS INTEGER) AS step, substr(filter_order, step, 1) AS own, substr(filter_order, 1, step - 1) AS before
  FROM orders, range(1, 6) AS s(step)),
met AS (
  SELECT part, filter_order, step, own, n, good, toxic, contains(mask, own) AS fails, mask = own AS alone,
    translate(mask, before, '') <> mask AS gone FROM masks, steps
),
counted AS (
  SELECT part, filter_order, step, own,
    coalesce(sum(n) FILTER (NOT fails AND NOT gone), 0) AS kept, coalesce(sum(n) FILTER (fails AND NOT gone), 0) AS removed,
    coalesce(sum(n) FILTER (fails AND gone), 0) AS redundant, coalesce(sum(n) FILTER (alone), 0) AS unique_fails,
    coalesce(sum(good) FILTER (fails AND NOT gone), 0) AS good_lost, coalesce(sum(toxic) FILTER (fails AND NOT gone), 0) AS toxic_lost
  FROM met GROUP BY ALL
)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
  CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
  CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley
FROM counted
"""


def cluster_sql(k: int, rounds: int, dimensions: int, scale: int, seed: int) -> str:
    """Assignment and floored means, one round after the other, over (vector, dimension) rows."""
    steps = [
        f"""
rows_ AS MATERIALIZED (
  SELECT row_number() OVER () AS id, vec_id, list_transform(embedding, lambda x: CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE len(embedding) = {dimensions} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
cells AS MATERIALIZED (SELECT id, unnest(range({dimensions})) AS d, unnest(v) AS x FROM rows_),
c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY sha256('{seed}:' || vec_id), v) - 1 AS c, v FROM rows_ QUALIFY c < {k}
)"""
    ]
    for n in range(rounds + 1):
        steps.append(f"""
a{n} AS MATERIALIZED (
  SELECT id, c, CAST(list_sum(list_transform(list_zip(r.v, m.v), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS BIGINT) AS distance
  FROM rows_ r, c{n} m QUALIFY row_number() OVER (PARTITION BY id ORDER BY distance, c) = 1
)""")
        if n < rounds:
            steps.append(f"""
m{n} AS MATERIALIZED (
  SELECT c, list((total - ((total % n) + n) % n) // n ORDER BY d) AS v FROM (SELECT c, d, sum(x) AS total, count(*) AS n FROM a{n} JOIN cells USING (id) GROUP BY c, d) GROUP BY c
),
c{n + 1} AS MATERIALIZED (SELECT c, CAST(coalesce(m{n}.v, c{n}.v) AS BIGINT[]) AS v FROM c{n} LEFT JOIN m{n} USING (c))""")
    return f"""
WITH {",".join(steps)}
SELECT vec_id, CAST(c AS INTEGER) AS cluster, distance, CAST(sum(distance) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia,
  CAST(sum(distance) OVER () AS BIGINT) AS inertia, sha256(array_to_string(centre, ',')) AS centroid_sha256
FROM rows_ JOIN a{rounds} USING (id) JOIN (SELECT c, v AS centre FROM c{rounds}) USING (c)
"""
