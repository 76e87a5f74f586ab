"""DuckDB SQL for the operators' queries that SQL can express."""

from __future__ import annotations

from .quality_lines import BOILERPLATE_PATTERN, NAVIGATION_PATTERN
from .url_filters import ALLOW_RULES, BLOCK_RULES, BLOCKED_HOSTS

WORDS = r"regexp_extract_all({0}, '[^\x20\x09-\x0D]+')"
LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

MIXING = rf"""
WITH d AS (SELECT doc_id, source, len({WORDS.format("coalesce(text, '')")})::BIGINT AS size,
    ('0x' || substr(md5('20240|' || coalesce(doc_id::VARCHAR, '') || '|' || coalesce(text, '')), 1, 13))::BIGINT AS key FROM documents),
s AS (SELECT source, sum(size)::DOUBLE AS size, row_number() OVER (ORDER BY source IS NULL, source) - 1 AS k FROM d GROUP BY source),
w AS (SELECT *, CASE k % 3 WHEN 0 THEN 5.0 WHEN 1 THEN 2.0 ELSE 1.0 END::DOUBLE AS w FROM s),
o AS (SELECT *, row_number() OVER (ORDER BY size / w, k) AS place, (1.5 * sum(size) OVER () - coalesce(sum(2 * size) OVER (ORDER BY size / w, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(w) OVER (ORDER BY size / w, k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w WHERE size > 0),
f AS (SELECT min(place) AS place FROM o WHERE level * w < 2 * size), v AS (SELECT level FROM o JOIN f USING (place)),
t AS (SELECT w.source, w.size, CASE WHEN w.size = 0 THEN 0.0 WHEN o.place < coalesce((SELECT place FROM f), 1e18) THEN 2 * w.size ELSE (SELECT level FROM v) * w.w END AS target FROM w LEFT JOIN o ON w.k = o.k),
x AS (SELECT d.*, t.size AS source_size, t.target, CASE WHEN t.size > 0 THEN floor(t.target / t.size) ELSE 0 END AS copies, coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
    FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size::BIGINT AS source_size, round(target, 6) AS target,
    (copies * size + greatest(0, least(size, floor(round(target - copies * source_size, 6) - before))))::BIGINT AS taken FROM x
"""


def _fits(rule: str) -> str:
    host, _, path = rule.partition("/")
    return f"(host = '{host}' OR host LIKE '%.{host}') AND starts_with(path, '/{path}')"


_RULES = sorted((*BLOCK_RULES, *ALLOW_RULES), key=lambda r: -len(r))
URL_FILTERS = rf"""
WITH p AS (SELECT page_id, coalesce({LOWER.format(r"regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1)")}, '') AS host, coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path FROM pages),
r AS (SELECT *, CASE {" ".join(f"WHEN {_fits(r)} THEN '{r}'" for r in _RULES)} END AS rule FROM p)
SELECT page_id, host, path, rule, CASE WHEN rule IN ({", ".join(f"'{r}'" for r in ALLOW_RULES)}) THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
    WHEN {" OR ".join(f"host = '{h}' OR host LIKE '%.{h}'" for h in BLOCKED_HOSTS)} THEN 'block' ELSE 'allow' END AS verdict FROM r
"""

REPEATS = rf"""
WITH w AS (SELECT doc_id, {WORDS.format("coalesce(text, '')")} AS w FROM documents),
g AS (SELECT doc_id, k, md5(array_to_string(w[k + 1 : k + 35], ' ')) AS h FROM (SELECT doc_id, w, unnest(range(len(w) - 34)) AS k FROM w WHERE len(w) >= 35)),
r AS (SELECT doc_id, k FROM g WHERE h IN (SELECT h FROM g GROUP BY h HAVING count(*) > 1)),
c AS (SELECT DISTINCT doc_id, k + j AS p FROM r CROSS JOIN (SELECT unnest(range(35)) AS j)),
x AS (SELECT doc_id, unnest(w) AS word, unnest(range(len(w))) AS p FROM w),
kept AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY p) AS t FROM x ANTI JOIN c USING (doc_id, p) GROUP BY doc_id)
SELECT w.doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM w LEFT JOIN kept USING (doc_id)
"""

def _quoted(text: str) -> str:
    return text.replace("'", "''")


_NAV, _BOIL = _quoted(NAVIGATION_PATTERN), _quoted(BOILERPLATE_PATTERN)
_END = r"(?:[.!?:;,\")\]}]|''|…|”|’|»|。)$"

QUALITY = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), b AS (SELECT doc_id, t, {WORDS.format("t")} AS w FROM d),
l AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM d), lw AS (SELECT doc_id, line, {WORDS.format("line")} AS w, regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g') AS body FROM l),
lv AS (SELECT doc_id, line, len(w) AS n, len(list_filter(w, lambda x: x IN ('|', '»', '›', '·', '•'))) AS bars, len(list_filter(w, lambda x: regexp_matches(x, '[#*$%&|<>]{{2,}}|[#$%&]$|!!$'))) AS marks, regexp_matches(body, '{_END}') AS done, lower(body) AS low FROM lw WHERE len(w) > 0),
bad AS (SELECT doc_id, n, line, (bars >= 3 OR (bars > 0 AND 2 * bars + 2 >= n)) OR marks >= greatest(2, 0.25 * n) OR (n < 4 AND NOT done) OR (n <= 6 AND NOT done AND regexp_matches(low, '{_NAV}')) OR (n <= 12 AND regexp_matches(low, '{_BOIL}')) AS bad FROM lv),
ls AS (SELECT doc_id, count(*) - count(DISTINCT line) AS dup, sum(n) FILTER (bad) AS lost FROM bad GROUP BY doc_id),
g AS (SELECT doc_id, k, md5(array_to_string(w[k + 1 : k + 8], ' ')) AS h FROM (SELECT doc_id, w, unnest(range(len(w) - 7)) AS k FROM b WHERE len(w) >= 8)),
r AS (SELECT doc_id, k FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, h) AS m FROM g) WHERE m > 1),
rw AS (SELECT doc_id, count(DISTINCT k + j) AS n FROM r CROSS JOIN (SELECT unnest(range(8)) AS j) GROUP BY doc_id),
q AS (SELECT b.doc_id, len(w)::BIGINT AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, coalesce(dup, 0)::BIGINT AS n_dup_lines, coalesce(rw.n, 0)::BIGINT AS n_repeat_words, coalesce(lost, 0)::BIGINT AS n_lost_words
    FROM b LEFT JOIN ls USING (doc_id) LEFT JOIN rw USING (doc_id)), f AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM q)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, n_lost_words, NOT base_failed AND n_lost_words <= 0.5 * n_words AS kept FROM f
"""

def _jaccard(size: int, percent: int, columns: str) -> str:
    return rf"""
WITH RECURSIVE w AS (SELECT doc_id, {WORDS.format(LOWER.format("coalesce(text, '')"))} AS w FROM documents),
s AS (SELECT DISTINCT doc_id, CASE WHEN len(w) >= {size} THEN array_to_string(w[k + 1 : k + {size}], ' ') ELSE array_to_string(w, ' ') END AS g FROM (SELECT doc_id, w, unnest(range(greatest(1, len(w) - {size - 1}))) AS k FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n, md5(string_agg(g, chr(31) ORDER BY g)) AS sig FROM s GROUP BY doc_id), c AS (SELECT doc_id, n, min(doc_id) OVER (PARTITION BY sig) AS class_id FROM n),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS common FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * common >= {percent} * (a.n + b.n - common)), e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r(doc_id, root) AS (SELECT doc_id, doc_id FROM documents UNION SELECT e.y, r.root FROM r JOIN e ON e.x = r.doc_id), m AS (SELECT doc_id, min(root) AS component_id FROM r GROUP BY doc_id)
SELECT m.doc_id, coalesce(c.n, 0)::BIGINT AS n_shingles, {columns} FROM m LEFT JOIN c USING (doc_id)
"""


def _resampling(buckets: int = 10_000, percent: int = 25) -> str:
    """CRC-32 by its table, byte by byte, over every distinct feature."""
    table = "list_transform(range(256), lambda k: list_reduce(list_prepend(k, range(8)), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END))"
    words = f"regexp_extract_all({LOWER.format("coalesce(text, '')")}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
    features = "list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))"
    return rf"""
WITH crc AS MATERIALIZED (SELECT {table} AS t),
d AS MATERIALIZED (SELECT doc_id, len(w) AS n_words, {features} AS f FROM (SELECT doc_id, {words} AS w FROM documents)),
m AS MATERIALIZED (SELECT unnest({features}) AS f FROM (SELECT {words} AS w FROM benchmark)),
o AS MATERIALIZED (SELECT doc_id, unnest(f) AS f FROM d),
u AS (SELECT f, hex(encode(f)) AS h FROM (SELECT f FROM o UNION SELECT f FROM m)),
b AS MATERIALIZED (SELECT f, xor(list_reduce(list_prepend(4294967295, list_transform(range(0, len(h), 2), lambda i: ('0x' || h[i + 1 : i + 2])::BIGINT)),
    lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295) % {buckets} AS bucket FROM u CROSS JOIN crc),
s AS (SELECT bucket, count(*) AS s FROM o JOIN b USING (f) GROUP BY bucket), t AS (SELECT bucket, count(*) AS t FROM m JOIN b USING (f) GROUP BY bucket),
n AS (SELECT (SELECT count(*) FROM o)::DOUBLE AS n_s, (SELECT count(*) FROM m)::DOUBLE AS n_t),
g AS (SELECT bucket, floor(1000 * ln(((coalesce(t, 0) + 1)::DOUBLE * (n_s + {buckets})) / ((s + 1)::DOUBLE * (n_t + {buckets}))))::BIGINT AS gain FROM s LEFT JOIN t USING (bucket) CROSS JOIN n),
w AS (SELECT doc_id, floor(sum(gain)::DOUBLE / count(*))::BIGINT AS weight FROM o JOIN b USING (f) JOIN g USING (bucket) GROUP BY doc_id),
x AS (SELECT doc_id, n_words, len(f)::BIGINT AS n_features, coalesce(weight, 0) AS weight, ('0x' || substr(sha256('7:' || doc_id), 1, 8))::BIGINT AS h FROM d LEFT JOIN w USING (doc_id)),
y AS (SELECT *, weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score, n_words >= 20 AS able FROM x),
r AS (SELECT *, row_number() OVER (PARTITION BY able ORDER BY score DESC, doc_id) AS place, count(*) FILTER (able) OVER () AS n FROM y)
SELECT doc_id, n_features, weight, score, CASE WHEN able AND place <= {percent} * n // 100 THEN place END AS rank FROM r
"""


def _clusters(k: int = 8, rounds: int = 10, dimension: int = 64) -> str:
    """One assignment and one set of means for each round."""
    steps = [
        f"""v AS MATERIALIZED (SELECT vec_id, sha256('3:' || vec_id) AS h, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS v FROM embeddings
    WHERE len(embedding) = {dimension} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
        f"c0 AS MATERIALIZED (SELECT (row_number() OVER (ORDER BY h) - 1)::INT AS c, v FROM (SELECT * FROM v ORDER BY h LIMIT {k}))",
    ]
    for r in range(rounds + 1):
        apart = "list_sum(list_transform(list_zip(v.v, c.v), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT"
        steps.append(f"a{r} AS MATERIALIZED (SELECT vec_id, v, b.c, b.d FROM (SELECT v.vec_id, v.v, min({{'d': {apart}, 'c': c.c}}) AS b FROM v CROSS JOIN c{r} c GROUP BY v.vec_id, v.v))")
        if r < rounds:
            steps.append(f"""c{r + 1} AS MATERIALIZED (SELECT c, list(m ORDER BY p) AS v FROM (SELECT c, p, ((sum(x) - ((sum(x) % count(*)) + count(*)) % count(*)) // count(*))::BIGINT AS m
    FROM (SELECT c, unnest(v) AS x, unnest(range({dimension})) AS p FROM a{r}) GROUP BY c, p) GROUP BY c UNION ALL SELECT c, v FROM c{r} WHERE c NOT IN (SELECT c FROM a{r}))""")
    return f"""
WITH {", ".join(steps)}
SELECT vec_id, c AS cluster, d AS distance, sum(d) OVER (PARTITION BY c)::BIGINT AS cluster_inertia, sum(d) OVER ()::BIGINT AS inertia, sha256(array_to_string(n.v, ',')) AS centroid_sha256
FROM a{rounds} a JOIN c{rounds} n USING (c)
"""


ORACLES = {
    "op4_source_mixing": MIXING,
    "op5_url_filters": URL_FILTERS,
    "op6_substring_dedup": REPEATS,
    "op8_quality_rules": QUALITY,
    "op9_ngram_jaccard_join": _jaccard(5, 75, "coalesce(c.class_id, m.doc_id) AS class_id, component_id"),
    "op11_minhash_near_dedup": _jaccard(2, 80, "component_id, m.doc_id = component_id AS kept"),
    "op12_importance_resampling": _resampling(),
    "op13_centroid_clustering": _clusters(),
}
