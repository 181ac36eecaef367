"""DuckDB SQL of the queries that SQL can express."""

from __future__ import annotations

import math

from custvalue.llm import collocations, mixing, urls
from custvalue.llm import queries as Q

VALID = """valid AS (
  SELECT vec_id, max(embedding) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
  GROUP BY vec_id)"""


def topk_sql(k: int = 5, step: int = 50) -> str:
    return f"""WITH {VALID},
scaled AS (SELECT vec_id, list_transform(v, lambda x: floor(256 * x::DOUBLE)) AS v FROM valid),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
  FROM scaled q JOIN scaled c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % {step} = 0),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM ranked WHERE rank <= {k}"""


def _strength(level: str, s: urls.Reputation) -> str:
    """Prior strength of a level with n, x and the mean m above, as one row (v)."""
    low, high = 1 / (1 + s.most_strength), 1 / (1 + s.least_strength)
    return f"""SELECT CASE WHEN k < 2 THEN {s.most_strength} ELSE round(1 / least({high!r}, greatest({low!r},
    CASE WHEN free > 0 THEN (s - (k - 1)) / free ELSE 0 END)) - 1, 9) END AS v FROM (
    SELECT count(*) AS k, sum(n) - sum(n * n) / sum(n) - (count(*) - 1) AS free,
    sum(n * pow(x / n - m, 2) / (m * (1 - m))) AS s FROM {level} WHERE n > 0 AND m * (1 - m) > 0)"""


def url_filter_sql(rules=Q.URL_RULES, s: urls.Reputation = urls.Reputation()) -> str:
    ordered = sorted(rules, key=lambda r: (-len(r.pattern), -len(r.host)))
    fit = " ".join(
        f"WHEN (host = '{r.host}' OR ends_with(host, '.{r.host}')) AND starts_with(path, '{r.path}') THEN '{r.pattern}'"
        for r in ordered
    )
    action = " ".join(f"WHEN rule = '{r.pattern}' THEN '{r.action}'" for r in rules)
    listed = ", ".join(f"'{x}'" for x in s.suffixes)
    limit = f"{s.worse} * b / (1 + ({s.worse} - 1) * b)" if s.max_bad is None else f"{s.max_bad}"
    return rf"""WITH rest AS (
  SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS r FROM pages),
split AS (
  SELECT page_id, translate(regexp_extract(coalesce(r, ''), '^[^/?#]*', 0), '{urls.UPPER}', '{urls.LOWER}') AS host,
  regexp_extract(coalesce(r, ''), '^[^/?#]*([^?#]*)', 1) AS path FROM rest),
ruled AS (SELECT *, CASE {fit} END AS rule FROM split),
known AS (
  SELECT doc_id AS page_id, max(greatest(toxic, 1 - quality)) AS bad FROM labels
  WHERE doc_id IS NOT NULL AND greatest(toxic, 1 - quality) IS NOT NULL GROUP BY doc_id),
counted AS (
  SELECT host, count(bad)::DOUBLE AS n, coalesce(sum(bad), 0)::DOUBLE AS x
  FROM split LEFT JOIN known USING (page_id) GROUP BY host),
bare AS (SELECT *, regexp_replace(regexp_replace(host, '^.*@', ''), ':[0-9]*$', '') AS b FROM counted),
two AS (
  SELECT *, regexp_extract(b, '([^.]+\.[^.]+)$', 1) IN ({listed}) AS long_suffix,
  regexp_matches(b, '^[0-9]+(\.[0-9]+){{3}}$') AS address, string_split(b, '.') AS labels FROM bare),
hosts0 AS (
  SELECT host, n, x,
  CASE WHEN address THEN '' WHEN long_suffix THEN regexp_extract(b, '([^.]+\.[^.]+)$', 1)
    ELSE regexp_extract(b, '([^.]*)$', 1) END AS suffix,
  CASE WHEN address OR len(labels) <= CASE WHEN long_suffix THEN 3 ELSE 2 END THEN b
    ELSE array_to_string(labels[-CASE WHEN long_suffix THEN 3 ELSE 2 END:], '.') END AS domain FROM two),
domains0 AS (SELECT domain, suffix, sum(n) AS n, sum(x) AS x FROM hosts0 GROUP BY ALL),
suffixes AS (
  SELECT suffix, sum(n) AS n, sum(x) AS x, (SELECT (sum(x) + 0.5) / (sum(n) + 1) FROM domains0) AS m
  FROM domains0 GROUP BY suffix),
s1 AS ({_strength("suffixes", s)}),
domains AS (
  SELECT d.*, (f.x + v * f.m) / (f.n + v) AS m FROM domains0 d JOIN suffixes f USING (suffix), s1),
s2 AS ({_strength("domains", s)}),
hosts AS (SELECT h.*, (d.x + v * d.m) / (d.n + v) AS m FROM hosts0 h JOIN domains d USING (domain), s2),
s3 AS ({_strength("hosts", s)}),
rated AS (SELECT host, n, x, v, (x + v * m) / (n + v) AS mean FROM hosts, s3),
base AS (SELECT (coalesce(sum(x), 0) + 0.5) / (coalesce(sum(n), 0) + 1) AS b FROM domains0),
bounded AS (
  SELECT host, n, x, greatest(0, mean - {s.z} * sqrt(mean * (1 - mean) / (n + v + 1))) AS bound, {limit} AS "limit" FROM rated, base)
SELECT page_id, host, path, rule, CASE {action} WHEN bound > "limit" THEN 'block' ELSE 'allow' END AS verdict,
  n::BIGINT AS n, x::BIGINT AS bad, round(bound, 6) AS bound, round("limit", 6) AS "limit"
FROM ruled JOIN bounded USING (host)"""


def mixing_sql(mix: mixing.Mix = mixing.Mix()) -> str:
    common, bits = math.lcm(*mix.weights), mixing.HASH_BITS
    turn = " ".join(f"WHEN {i} THEN {w}" for i, w in enumerate(mix.weights))
    mark = lambda c: f"CASE WHEN {c} IS NULL THEN '-' ELSE '+' || md5({c}::VARCHAR) END"
    part = lambda at: f"('0x' || substr(key, {at}, {bits // 4}))::BIGINT"
    copies = f"(floor(rate) + CASE WHEN ((h + step * seed) % {1 << bits}) / {1 << bits}::DOUBLE < rate - floor(rate) THEN 1 ELSE 0 END)"
    return rf"""WITH keyed AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '{mixing.WORDS}')), 0)::BIGINT AS size,
  md5({mark("doc_id")} || {mark("source")} || {mark("text")}) AS key FROM documents),
measured AS (SELECT doc_id, source, size, {part(1)} AS h, {part(1 + bits // 4)} AS step FROM keyed),
sums AS (SELECT source, sum(size)::BIGINT AS source_size FROM measured GROUP BY source),
placed AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS pos FROM sums),
weighed AS (
  SELECT *, source_size * {mix.most} AS cap, CASE pos % {len(mix.weights)} {turn} END AS weight,
  {mix.share!r}::DOUBLE * (sum(source_size * {mix.most}) OVER ())::DOUBLE / {mix.most} AS words FROM placed),
levels AS (
  SELECT *, sum(cap) OVER w AS caps, sum(weight) OVER w AS weights, sum(weight) OVER () AS all_weights,
  cap * ({common} // weight) AS level FROM weighed
  WINDOW w AS (ORDER BY cap * ({common} // weight), pos ROWS UNBOUNDED PRECEDING)),
decided AS (SELECT *, caps * {common} + level * (all_weights - weights) <= words * {common} AS stops FROM levels),
used AS (
  SELECT coalesce(sum(cap) FILTER (stops), 0)::DOUBLE AS used, coalesce(sum(weight) FILTER (NOT stops), 0)::DOUBLE AS sharing
  FROM decided),
targets AS (
  SELECT source, source_size, CASE WHEN stops THEN cap::DOUBLE ELSE (words - used) * weight / greatest(1, sharing) END AS target
  FROM decided, used),
rates AS (
  SELECT *, CASE WHEN source_size > 0 THEN least({mix.most}::DOUBLE, target / source_size) ELSE 0 END AS rate FROM targets),
tried AS (
  SELECT r.source, seed, abs(sum(size * {copies}) - max(target)) AS off
  FROM measured m JOIN rates r ON m.source IS NOT DISTINCT FROM r.source, range({mix.seeds}) t(seed) GROUP BY r.source, seed),
chosen AS (SELECT source, arg_min(seed, (off, seed)) AS seed FROM tried GROUP BY source)
SELECT doc_id, size, r.source_size, r.target, (size * {copies})::BIGINT AS taken
FROM measured m JOIN rates r ON m.source IS NOT DISTINCT FROM r.source
JOIN chosen c ON m.source IS NOT DISTINCT FROM c.source"""


def collocations_sql(s: collocations.Settings = collocations.Settings()) -> str:
    """Phrases of two and three words."""
    return rf"""WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
    translate(coalesce(text, ''), '{collocations.UPPER}', '{collocations.LOWER}'), '[.,;:!?
-
]')) AS piece FROM documents),
words AS (SELECT lang, regexp_extract_all(piece, '[^ 	]+') AS w FROM pieces),
totals AS (SELECT lang, sum(len(w))::BIGINT AS n FROM words GROUP BY lang),
spans AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM words),
grams AS (SELECT lang, size, array_to_string(w[i:i + size - 1], ' ') AS p FROM spans, range(1, 4) t(size) WHERE i + size - 1 <= len(w)),
counts AS MATERIALIZED (SELECT lang, size, p, count(*) AS f FROM grams GROUP BY ALL HAVING count(*) >= {s.least}),
parted AS (
  SELECT lang, p, f AS a, k, array_to_string(string_split(p, ' ')[1:k], ' ') AS head,
  array_to_string(string_split(p, ' ')[k + 1:], ' ') AS rest
  FROM (SELECT *, unnest(range(1, size)) AS k FROM counts WHERE size > 1)),
cuts AS (
  SELECT c.lang, c.p, a, k, x.f AS l, y.f AS r, (1000000::HUGEINT * a * a) // (x.f::HUGEINT * y.f) AS score
  FROM parted c JOIN counts x ON x.lang = c.lang AND x.p = head JOIN counts y ON y.lang = c.lang AND y.p = rest),
lowest AS (
  SELECT lang, p, a, least.l AS l, least.r AS r, least.score AS score FROM (
    SELECT lang, p, a, arg_min({{'l': l, 'r': r, 'score': score}}, (score, k)) AS least FROM cuts GROUP BY ALL)),
inside AS (
  SELECT lang, p, max(f) AS longer FROM (
    SELECT lang, regexp_replace(p, ' [^ ]*$', '') AS p, f FROM counts WHERE size = 3
    UNION ALL SELECT lang, regexp_replace(p, '^[^ ]* ', ''), f FROM counts WHERE size = 3)
  GROUP BY ALL),
kept AS (
  SELECT o.*, o.p AS phrase FROM lowest o LEFT JOIN inside i ON o.lang = i.lang AND o.p = i.p
  WHERE i.longer IS NULL OR 100 * i.longer < {s.inside_percent} * o.a),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT lang, rank, phrase, a, l, r, n, score::BIGINT AS score FROM ranked JOIN totals USING (lang) WHERE rank <= {s.first}"""


def statements() -> dict[str, str]:
    return {
        "op1_topk": topk_sql(),
        "op8_url_filter": url_filter_sql(),
        "op12_collocations": collocations_sql(),
        "op13_mixing": mixing_sql(),
    }
