"""Comparison SQL, for DuckDB, of the queries that SQL can express."""

from __future__ import annotations

from tablecheck.llm.mixing import OTHER, Targets

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def vector_links(least: float = 0.98) -> str:
    """Every pair of equal labels, and labels spread over links until nothing changes."""
    return f"""
WITH RECURSIVE v AS (
  SELECT row_number() OVER () AS r, vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings
), ok AS (
  SELECT * FROM v WHERE label IS NOT NULL AND vec_id IS NOT NULL AND e IS NOT NULL AND len(e) > 0
    AND len(list_filter(e, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0
), unit AS (
  SELECT r, vec_id, label, len(e) AS d, list_transform(e, lambda x: x / sqrt(list_sum(list_transform(e, lambda y: y * y)))) AS e FROM ok
), links AS (
  SELECT a.vec_id AS u, b.vec_id AS v FROM unit a JOIN unit b ON a.label = b.label AND a.d = b.d AND a.r <> b.r AND list_dot_product(a.e, b.e) >= {least}
), reach(id, to_id) AS (
  SELECT u, v FROM links UNION SELECT reach.id, links.v FROM reach JOIN links ON reach.to_id = links.u
), roots AS (SELECT id, min(to_id) AS low FROM reach GROUP BY id), degrees AS (SELECT u, count(*) AS n FROM links GROUP BY u)
SELECT v.vec_id, coalesce(n, 0) AS n_links, least(v.vec_id, coalesce(low, v.vec_id)) AS component_id, least(v.vec_id, coalesce(low, v.vec_id)) = v.vec_id AS kept
FROM v LEFT JOIN degrees ON v.vec_id = u LEFT JOIN roots ON v.vec_id = id
"""


def host_reputation(rules, prior) -> str:
    """Rules as one CASE from the longest, and the three levels of priors one after the other."""
    fits = [(r, f"(host = '{r.host}' OR ends_with(host, '.{r.host}')) AND starts_with(path, '{r.path}')") for r in sorted(rules, key=lambda r: -len(r.name))]
    rule = "CASE " + " ".join(f"WHEN {fit} THEN '{r.name}'" for r, fit in fits) + " END"
    verdict = "CASE " + " ".join(f"WHEN {fit} THEN '{r.verdict}'" for r, fit in fits) + " END"

    def level(name: str, children: str, key: str) -> str:
        return f"""
{name}_sums AS (
  SELECT {key}, sum(n) AS n, sum(bad) AS bad, count(*) FILTER (n > 0) AS k, sum(bad * bad / nullif(n, 0)) AS squares, sum(n * n) AS nn, min(pr) AS pr, min(pw) AS pw
  FROM {children} GROUP BY {key}
), {name}_between AS (
  SELECT *, bad / nullif(n, 0) AS q, (squares - n * (bad / nullif(n, 0)) ** 2 - (k - 1) * (bad / nullif(n, 0)) * (1 - bad / nullif(n, 0))) / nullif(n - nn / nullif(n, 0), 0) AS variance FROM {name}_sums
), {name} AS (
  SELECT {key}, n, bad, (bad + pr * pw) / (n + pw) AS pr,
    least(greatest(coalesce(CASE WHEN k >= 2 AND n > k AND variance > 0 THEN q * (1 - q) / variance - 1 END, {prior.weight}), {prior.weight}), {prior.most}) AS pw FROM {name}_between
)"""

    return f"""
WITH after AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) END AS rest FROM pages
), parsed AS (
  SELECT page_id, coalesce(translate(regexp_extract(rest, '^[^/?#]*'), '{UPPER}', '{LOWER}'), '') AS host, coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM after
), ruled AS (SELECT *, {rule} AS rule, {verdict} AS by_rule FROM parsed
), hosts AS (
  SELECT host, array_to_string(string_split(host, '.')[-2:], '.') AS domain, string_split(host, '.')[-1] AS suffix,
    CAST(count(by_rule) AS DOUBLE) AS n, CAST(coalesce(sum(CAST(by_rule = 'block' AS INT)), 0) AS DOUBLE) AS bad FROM ruled GROUP BY host
), tops AS (SELECT suffix, sum(n) AS n, sum(bad) AS bad, 1 AS one, {prior.rate} AS pr, {prior.weight} AS pw FROM hosts GROUP BY suffix
), {level("world", "tops", "one")}, below AS (
  SELECT domain, hosts.suffix, sum(hosts.n) AS n, sum(hosts.bad) AS bad, min(world.pr) AS pr, min(world.pw) AS pw FROM hosts, world GROUP BY domain, hosts.suffix
), {level("suffixes", "below", "suffix")}, leaves AS (
  SELECT host, domain, hosts.n, hosts.bad, pr, pw FROM hosts JOIN suffixes USING (suffix)
), {level("domains", "leaves", "domain")}, final AS (
  SELECT host, hosts.n, hosts.bad, (hosts.bad + pr * pw) / (hosts.n + pw) AS mean, hosts.n + pw AS total FROM hosts JOIN domains USING (domain)
)
SELECT page_id, ruled.host, path, rule,
  coalesce(by_rule, CASE WHEN mean - {prior.deviations} * sqrt(mean * (1 - mean) / (total + 1)) >= {prior.limit} THEN 'block' ELSE 'allow' END) AS verdict,
  CAST(n AS BIGINT) AS n, CAST(bad AS BIGINT) AS n_bad
FROM ruled JOIN final ON ruled.host = final.host
"""


def mixing(targets: Targets) -> str:
    """The fitting unrolled, one step of one margin after the other."""
    margins = targets.margins()

    def category(column: str, listed: dict) -> str:
        named = ", ".join(f"'{k}'" for k in listed if k != OTHER)
        return f"CASE WHEN {column} IN ({named}) THEN {column} ELSE '{OTHER}' END"

    def share(name: str) -> str:
        return f"CASE {name}_group " + " ".join(f"WHEN '{k}' THEN {float(v)!r}" for k, v in margins[name].items()) + " ELSE 0.0 END"

    targeted = ", ".join(f"{share(name)} / (SELECT sum({share(name)}) FROM (SELECT DISTINCT {name}_group FROM cells)) AS {name}_target" for name in margins)
    steps, last = [], "w0"
    for i in range(targets.rounds):
        for name in margins:
            steps.append(f"w{len(steps) + 1} AS MATERIALIZED (SELECT * REPLACE (coalesce(share * {name}_target / nullif(sum(share) OVER (PARTITION BY {name}_group), 0), 0) AS share) FROM {last})")
            last = f"w{len(steps)}"
    return rf"""
WITH counted AS (
  SELECT *, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS n_tokens FROM documents
), marked AS (
  SELECT *, {category("source", margins["source"])} AS source_group, {category("lang", margins["lang"])} AS lang_group,
    CASE WHEN n_tokens < 50 THEN 'short' WHEN len(regexp_extract_all(coalesce(text, ''), '[#*$%&|<>]')) * 10 >= n_tokens THEN 'markup'
      WHEN regexp_matches(coalesce(text, ''), '(?i)licen[cs]e|copyright') THEN 'legal' WHEN contains(coalesce(text, ''), '@') THEN 'contact'
      WHEN n_tokens >= 2000 THEN 'long' ELSE 'prose' END AS topic_group FROM counted
), cells AS MATERIALIZED (
  SELECT source_group, lang_group, topic_group, sum(n_tokens) AS tokens FROM marked GROUP BY ALL HAVING sum(n_tokens) > 0
), w0 AS MATERIALIZED (SELECT *, CAST(tokens AS DOUBLE) / sum(tokens) OVER () AS share, {targeted} FROM cells
), {", ".join(steps)}, rates AS (
  SELECT source_group, lang_group, topic_group, share * {float(targets.rate)!r} * CAST(sum(tokens) OVER () AS DOUBLE) / CAST(tokens AS DOUBLE) AS ratio FROM {last}
), final AS (
  SELECT doc_id, n_tokens, source_group, lang_group, topic_group, coalesce(ratio, 0.0) AS ratio,
    CAST(('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), text, '')), 1, 8)) AS BIGINT) / 4294967296.0 AS uniform
  FROM marked LEFT JOIN rates USING (source_group, lang_group, topic_group)
)
SELECT doc_id, n_tokens, source_group, lang_group, topic_group, round(least(ratio, 1.0), 9) AS probability, round(greatest(ratio, 1.0), 9) AS weight, uniform < least(ratio, 1.0) AS chosen FROM final
"""


def hard_negatives(p) -> str:
    """Every anchor against every row."""
    return f"""
WITH own AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
), whole AS (
  SELECT vec_id, label, list_transform(e, lambda x: floor({p.scale} * x)) AS v FROM own
  WHERE len(list_filter(e, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
), one AS (
  SELECT vec_id, label, v FROM whole QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY label, v) = 1
), scored AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS alike, CAST(list_dot_product(a.v, b.v) AS BIGINT) AS score
  FROM one a JOIN one b ON a.vec_id <> b.vec_id WHERE a.vec_id % {p.every} = 0
), positive AS (
  SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM scored WHERE alike
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= {p.positives}
), ranked AS (
  SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other_id) AS INTEGER) AS rank, other_id AS negative_id,
    positive_score, score AS negative_score
  FROM positive JOIN scored USING (anchor_id) WHERE NOT alike AND {p.low} * positive_score <= 100 * score AND 100 * score <= {p.high} * positive_score
)
SELECT * FROM ranked WHERE rank <= {p.negatives}
"""


def filter_audit(limits) -> str:
    """Every order applied from left to right."""
    space = r"[^\x20\x09-\x0D]+"
    return f"""
WITH RECURSIVE words AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{space}') AS w FROM documents
), failed AS (
  SELECT doc_id, part, [
    len(w) < {limits.words}, 100 * len(list_distinct(w)) < {limits.distinct} * len(w),
    100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > {limits.upper} * length(text), regexp_matches(text, '[{limits.symbols}]'),
    coalesce(min(doc_id) OVER (PARTITION BY text) < doc_id, false)] AS f FROM words
), marks AS (
  SELECT doc_id, max(CAST(coalesce(quality = 1, false) AS INT)) AS good, max(CAST(coalesce(toxic = 1, false) AS INT)) AS toxic FROM labels GROUP BY doc_id
), rows AS (
  SELECT part, f, count(*) AS n, coalesce(sum(good), 0) AS good, coalesce(sum(toxic), 0) AS toxic FROM failed LEFT JOIN marks USING (doc_id) GROUP BY part, f
), orders(o) AS (
  SELECT '' UNION ALL SELECT o || c FROM orders, unnest(['A', 'B', 'C', 'D', 'E']) t(c) WHERE strpos(o, c) = 0
), steps AS (
  SELECT o AS filter_order, CAST(s AS INTEGER) AS step, strpos('ABCDE', substr(o, s, 1)) AS own, list_filter([1, 2, 3, 4, 5], lambda i: strpos(substr(o, 1, s - 1), substr('ABCDE', i, 1)) > 0) AS gone
  FROM orders, unnest([1, 2, 3, 4, 5]) t(s) WHERE length(o) = 5
), applied AS (
  SELECT part, filter_order, step, own, n, good, toxic, f[own] AS fails, len(list_filter(f, lambda x: x)) AS n_fails,
    len(list_filter(gone, lambda i: f[i])) > 0 AS earlier FROM rows, steps
), counted AS (
  SELECT part, filter_order, step, own, sum(n) FILTER (NOT fails AND NOT earlier) AS kept, sum(n) FILTER (fails AND NOT earlier) AS removed, sum(n) FILTER (fails AND earlier) AS redundant,
    sum(n) FILTER (fails AND n_fails = 1) AS unique_fails, sum(good) FILTER (fails AND NOT earlier) AS good_lost, sum(toxic) FILTER (fails AND NOT earlier) AS toxic_lost
  FROM applied GROUP BY part, filter_order, step, own
)
SELECT part, filter_order, step, {", ".join(f"CAST(coalesce({c}, 0) AS BIGINT) AS {c}" for c in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost"))},
  CAST(sum(coalesce(removed, 0)) OVER (PARTITION BY part, own) AS BIGINT) AS shapley FROM counted
"""
