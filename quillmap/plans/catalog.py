"""All queries of the library over the test tables, each with the SQL that checks it.

Roles: a row of `embeddings` is a chunk vector of the article `label`, in the order of `vec_id`; a
document is an article; a turn of a conversation is a chunk. Numbers are rounded to nine places and
counts are long, so that both sides agree in type and value.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vectors as V
from ..operators import articles as A
from ..operators import chunking as C
from ..operators import exact as X
from ..operators import geometry as G
from ..operators import layout as L
from ..operators import pairs as P
from ..operators import retrieval as N
from ..operators import runs as R
from ..operators import summary as S

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
DIMENSION = 64


def _query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = lambda spark, sf_dir: _tidy(fn(spark, sf_dir))
        if sql:
            ORACLES[fn.__name__] = sql
        return fn

    return add


def _tidy(df: DataFrame) -> DataFrame:
    out = []
    for name, kind in df.dtypes:
        c = F.col(f"`{name}`")
        if kind in ("double", "float"):
            c = F.round(c.cast("double"), 9) + F.lit(0.0)
        elif kind in ("int", "smallint", "tinyint") or kind.startswith("decimal"):
            c = c.cast("long")
        out.append(c.alias(name))
    return df.select(*out)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _vectors(spark, sf_dir) -> DataFrame:
    return _table(spark, sf_dir, "embeddings").select(F.col("label").alias("article"), F.col("vec_id").alias("position"), "embedding")


def _articles(spark, sf_dir) -> DataFrame:
    return _table(spark, sf_dir, "documents").select(F.col("doc_id").alias("article_id"), F.col("text").alias("content"), "source")


def _chunks(spark, sf_dir) -> DataFrame:
    return _table(spark, sf_dir, "conversations").select(F.lit("turns").alias("chunking_run_id"), F.col("conv_id").alias("article_id"), F.col("turn").alias("chunk_index"), "text")


# ---- SQL building blocks --------------------------------------------------------------------

E = "e AS (SELECT label, vec_id, embedding::DOUBLE[] AS v FROM embeddings)"
UNIT = "u AS (SELECT label, vec_id, list_transform(v, lambda x: x / greatest(sqrt(list_dot_product(v, v)), 1e-12)) AS v FROM e)"
U = f"{E}, {UNIT}"
STEPS = E + ", t AS (SELECT label, vec_id, v, lead(v) OVER (PARTITION BY label ORDER BY vec_id) AS w FROM e), s AS (SELECT label, vec_id, list_cosine_similarity(v, w) AS c FROM t WHERE w IS NOT NULL)"
ALL_PAIRS = "p AS (SELECT a.label AS la, b.label AS lb, list_dot_product(a.v, b.v) AS c FROM u a JOIN u b ON a.vec_id < b.vec_id)"
COMP = "c AS (SELECT label, k, avg(x) AS m FROM (SELECT label, unnest(v) AS x, unnest(range(64)) AS k FROM u) GROUP BY label, k), cv AS (SELECT label, list(m ORDER BY k) AS m FROM c GROUP BY label)"
SPREAD = "sp AS (SELECT u.label, avg(list_distance(u.v, cv.m)) AS s FROM u JOIN cv USING (label) GROUP BY u.label)"
RATIO = "r AS (SELECT a.label, max(CASE WHEN d > 0 THEN (sa + sb) / d END) AS ratio, min(d) AS nearest, count(*) FILTER (d = 0) AS twins FROM (SELECT a.label, sa.s AS sa, sb.s AS sb, list_distance(a.m, b.m) AS d FROM cv a JOIN cv b ON a.label <> b.label JOIN sp sa ON sa.label = a.label JOIN sp sb ON sb.label = b.label) a GROUP BY a.label)"
WORDS = r"regexp_extract_all({t}, '[\p{{L}}\p{{Nl}}\p{{No}}]+')"


def _words(t: str) -> str:
    return WORDS.format(t=t)


def _only(t: str, chars: str) -> str:
    return f"length(regexp_replace({t}, '[^{chars}]', '', 'g'))"


def _ratio(a: str, b: str) -> str:
    return f"CASE WHEN ({b}) = 0 THEN 0.0 ELSE ({a})::DOUBLE / ({b}) END"


# ---- vectors --------------------------------------------------------------------------------


@_query(f"""WITH {STEPS}, {UNIT}, {ALL_PAIRS}, m AS (SELECT avg(c) AS a, avg(c) FILTER (la = lb) AS same FROM p)
SELECT count(*) AS num_transitions, round(avg(c), 9) AS mean_transition_cosine, round(stddev_pop(c), 9) AS cosine_volatility, round(max(a), 9) AS drop_threshold,
round(avg((c < a)::INT::DOUBLE), 9) AS semantic_drop_rate, (SELECT count(*) FILTER (n > 1) FROM (SELECT count(*) AS n FROM e GROUP BY label)) AS num_articles,
(SELECT count(*) FILTER (la = lb) FROM p) AS num_pairwise, round(max(same), 9) AS mean_pairwise_cosine FROM s, m""")
def intra_consistency(spark, sf_dir):
    return G.intra_consistency(_vectors(spark, sf_dir), dimension=DIMENSION)


@_query(f"WITH {STEPS} SELECT label::BIGINT AS article, vec_id AS position, round(c, 9) AS cosine FROM s")
def transition_cosines(spark, sf_dir):
    return G.transitions(_vectors(spark, sf_dir))


@_query(f"""WITH {U}, {ALL_PAIRS} SELECT (SELECT count(*) FROM e) AS n_vectors, (SELECT count(DISTINCT label) FROM e) AS n_articles,
round(avg(c), 9) AS mean_all, round(avg(c) FILTER (la = lb), 9) AS mean_same, round(avg(c) FILTER (la <> lb), 9) AS mean_cross FROM p""")
def pair_means(spark, sf_dir):
    return G.pair_means(_vectors(spark, sf_dir), DIMENSION)


@_query(f"""WITH {E}, n AS (SELECT sqrt(list_dot_product(v, v)) AS n FROM e) SELECT count(*) AS count, count(*) AS finite, count(*) FILTER (abs(n - 1) <= 1e-5) AS normalised,
round(min(n), 9) AS min, round(max(n), 9) AS max, round(avg(n), 9) AS mean, round(avg(n * n), 9) AS mean_square FROM n""")
def norm_stats(spark, sf_dir):
    return G.norm_stats(_vectors(spark, sf_dir)).drop("std")  # all lengths are 1: the deviation is rounding noise


@_query("""WITH d AS (SELECT doc_id, n_chars::DOUBLE AS a, length(source)::DOUBLE AS b FROM documents), n AS (SELECT sqrt(a * a + b * b) AS n FROM d)
SELECT count(*) AS count, count(*) AS finite, count(*) FILTER (abs(n - 1) <= 1e-5) AS normalised, round(min(n), 9) AS min, round(max(n), 9) AS max, round(avg(n), 6) AS mean, round(stddev_pop(n), 6) AS std FROM n""")
def norm_stats_spread(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents").select(F.array(F.col("n_chars").cast("double"), F.length("source").cast("double")).alias("embedding"))
    return G.norm_stats(docs).select("count", "finite", "normalised", "min", "max", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"))


@_query(f"""WITH {E} SELECT sum(len(list_filter(v, lambda x: x < 0)))::BIGINT AS negative_components, count(*) FILTER (list_min(v) < 0) AS affected_rows,
round(min(list_min(v)), 9) AS min_component, count(*) FILTER (list_dot_product(v, v) = 0) AS zero_norm_rows FROM e""")
def component_diagnostics(spark, sf_dir):
    return G.component_diagnostics(_vectors(spark, sf_dir))


@_query(f"WITH {U} SELECT vec_id AS position, round(list_sum(v), 9) AS component_sum, round(list_dot_product(v, v), 9) AS square FROM u")
def normalised_vectors(spark, sf_dir):
    u = G.unit_vectors(_vectors(spark, sf_dir))
    return u.select("position", V.total(F.col("embedding")).alias("component_sum"), V.square_norm(F.col("embedding")).alias("square"))


@_query()
def pca_ratios(spark, sf_dir):
    return G.pca_ratios(_vectors(spark, sf_dir))


@_query()
def projection_2d(spark, sf_dir):
    return G.project_2d(_vectors(spark, sf_dir), "position")


@_query(f"WITH {U}, {COMP} SELECT label::BIGINT AS article, (SELECT count(*) FROM u WHERE u.label = cv.label) AS n, round(list_sum(m), 9) AS component_sum, round(sqrt(list_dot_product(m, m)), 9) AS length FROM cv")
def article_centroids(spark, sf_dir):
    c = G.centroids(G.unit_vectors(_vectors(spark, sf_dir)), DIMENSION, ["article"])
    return c.select("article", "n", V.total(F.col("centroid")).alias("component_sum"), V.norm(F.col("centroid")).alias("length"))


DB_SQL = f"""WITH {U}, {COMP}, {SPREAD}, {RATIO}, o AS (SELECT *, row_number() OVER (ORDER BY ratio) AS k, count(*) OVER () AS n FROM r)
SELECT count(*) AS n_clusters, round(avg(ratio), 9) AS index, round(avg(ratio) FILTER (k <= greatest(1, floor(n * 0.99))), 9) AS trimmed_index, round(quantile_cont(ratio, 0.5), 9) AS median_ratio,
round(quantile_cont(ratio, 0.95), 9) AS p95_ratio, round(quantile_cont(ratio, 0.99), 9) AS p99_ratio, round(max(ratio), 9) AS max_ratio,
round(sum(ratio) FILTER (k > n - ceil(n * 0.01)) / sum(ratio), 9) AS top_1_percent_share, round(min(nearest), 9) AS min_centroid_distance, round(quantile_cont(nearest, 0.01), 9) AS p01_centroid_distance, (sum(twins) / 2)::BIGINT AS exact_twin_pairs FROM o"""


@_query(DB_SQL)
def davies_bouldin(spark, sf_dir):
    return G.davies_bouldin(_vectors(spark, sf_dir), dimension=DIMENSION)


_COHORTS = f"""WITH {U}, p AS (SELECT label FROM embeddings GROUP BY label HAVING count(*) >= 5), k AS (SELECT label, seed, row_number() OVER (PARTITION BY seed ORDER BY md5(seed || '|' || label)) AS k FROM p, (SELECT unnest([42, 43, 44, 45, 46]) AS seed)),
h AS (SELECT seed, label FROM k WHERE k <= greatest(2, (SELECT count(*) // 2 FROM p))), {COMP}, {SPREAD},
r AS (SELECT a.seed, a.label, max(CASE WHEN d > 0 THEN (sa + sb) / d END) AS ratio FROM (SELECT x.seed, x.label, sa.s AS sa, sb.s AS sb, list_distance(ca.m, cb.m) AS d FROM h x JOIN h y ON x.seed = y.seed AND x.label <> y.label
JOIN cv ca ON ca.label = x.label JOIN cv cb ON cb.label = y.label JOIN sp sa ON sa.label = x.label JOIN sp sb ON sb.label = y.label) a GROUP BY a.seed, a.label),
o AS (SELECT *, row_number() OVER (PARTITION BY seed ORDER BY ratio) AS k, count(*) OVER (PARTITION BY seed) AS n FROM r), z AS (SELECT seed, avg(ratio) AS i, avg(ratio) FILTER (k <= greatest(1, floor(n * 0.99))) AS t FROM o GROUP BY seed)
SELECT count(*) AS n_cohorts, round(avg(i), 9) AS mean_index, round(stddev_pop(i), 9) AS std_index, round(avg(t), 9) AS mean_trimmed, round(stddev_pop(t), 9) AS std_trimmed FROM z"""


@_query(_COHORTS)
def davies_bouldin_cohorts(spark, sf_dir):
    pool = G.eligible(_vectors(spark, sf_dir)).select("article")
    out = G.cohort_davies_bouldin(_vectors(spark, sf_dir), pool, max(2, pool.count() // 2), [42, 43, 44, 45, 46], dimension=DIMENSION)
    return out.drop("cohort_scores", "cohort_trimmed_scores")


@_query(f"""WITH {U}, sums AS (SELECT label, k, sum(x) AS m FROM (SELECT label, unnest(v) AS x, unnest(range(64)) AS k FROM u) GROUP BY label, k), sv AS (SELECT label, list(m ORDER BY k) AS m FROM sums GROUP BY label),
n AS (SELECT label, count(*) AS n FROM u GROUP BY label), d AS (SELECT u.vec_id, u.label AS own, sv.label AS other, n.n, 1 - list_dot_product(u.v, sv.m) / n.n AS mean_d FROM u, sv JOIN n ON n.label = sv.label),
x AS (SELECT vec_id, max(CASE WHEN own = other THEN mean_d * n / (n - 1) END) AS a, min(CASE WHEN own <> other THEN mean_d END) AS b FROM d GROUP BY vec_id)
SELECT round(avg((b - a) / greatest(a, b)), 9) AS silhouette FROM x""")
def silhouette(spark, sf_dir):
    return spark.createDataFrame([(G.silhouette(_vectors(spark, sf_dir)),)], "silhouette double")


@_query("SELECT label::BIGINT AS article, count(*) AS n_chunks FROM embeddings GROUP BY label HAVING count(*) >= 50")
def eligible_articles(spark, sf_dir):
    return G.eligible(_vectors(spark, sf_dir), 50)


def _two_runs(spark, sf_dir) -> DataFrame:
    """Two runs over the articles: all vectors, and every vector with a positive first component."""
    v = _table(spark, sf_dir, "embeddings").select(F.col("label").alias("article_id"), "embedding")
    return v.select(F.lit("full").alias("embedding_run_id"), "article_id").unionByName(v.where(F.get("embedding", F.lit(0)) > 0).select(F.lit("half").alias("embedding_run_id"), "article_id"))


@_query("SELECT label::BIGINT AS article_id FROM embeddings GROUP BY label HAVING count(*) >= 20 AND count(*) FILTER (embedding[1] > 0) >= 20")
def shared_eligible(spark, sf_dir):
    counts = _two_runs(spark, sf_dir).groupBy("embedding_run_id", "article_id").agg(F.count("*").alias("n_chunks"))
    return G.shared_eligible(counts, ["full", "half"], 20)


DEGRADATION = """WITH e AS (SELECT label, vec_id, embedding::DOUBLE[] AS v, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS k FROM embeddings),
c AS (SELECT e.label, e.v, d.n_chars::DOUBLE AS w FROM e JOIN documents d ON d.doc_id = e.vec_id WHERE e.k > 1),
s AS (SELECT label, k, sum(x * w) AS s FROM (SELECT label, w, unnest(v) AS x, unnest(range(64)) AS k FROM c) GROUP BY label, k),
t AS (SELECT label, list(s ORDER BY k) AS s FROM s GROUP BY label), n AS (SELECT label, count(*) AS n_chunks, sum(w) AS total_length FROM c GROUP BY label HAVING count(*) >= 5),
r AS (SELECT n.label, n_chunks, total_length, list_cosine_similarity(a.v, t.s) AS sim FROM n JOIN t USING (label) JOIN e a ON a.label = n.label AND a.k = 1)
"""


def _degradation(spark, sf_dir) -> DataFrame:
    v = _vectors(spark, sf_dir)
    first = v.groupBy("article").agg(F.min("position").alias("first"))
    marked = v.join(first, "article")
    whole = marked.where("position = first").select("article", "embedding")
    lengths = _table(spark, sf_dir, "documents").select(F.col("doc_id").alias("position"), F.col("n_chars").alias("chunk_length"))
    return G.degradation(whole, marked.where("position != first").join(lengths, "position"), DIMENSION)


@_query(DEGRADATION + "SELECT label::BIGINT AS article, n_chunks, total_length, round(sim, 9) AS similarity, round(1 - sim, 9) AS degradation FROM r")
def representation_degradation(spark, sf_dir):
    return _degradation(spark, sf_dir)


@_query(DEGRADATION + """SELECT count(*) AS n_articles, round(avg(n_chunks), 9) AS mean_chunks, round(avg(total_length), 9) AS mean_total_length, round(avg(sim), 9) AS mean_similarity,
round(median(sim), 9) AS median_similarity, round(avg(1 - sim), 9) AS mean_degradation, round(median(1 - sim), 9) AS median_degradation FROM r""")
def degradation_summary(spark, sf_dir):
    return G.degradation_summary(_degradation(spark, sf_dir))


# ---- neighbours and retrieval ---------------------------------------------------------------

FOUND = f"""WITH {U}, n AS (SELECT a.vec_id AS query, a.label AS la, b.vec_id AS doc, b.label AS lb, round(list_dot_product(a.v, b.v), 9) AS similarity FROM u a JOIN u b ON a.vec_id <> b.vec_id),
f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY similarity DESC, doc) AS rank FROM n) WHERE rank <= 100)"""


@_query(FOUND + " SELECT query, doc, rank, similarity FROM f WHERE rank <= 10")
def nearest_neighbours(spark, sf_dir):
    e = _table(spark, sf_dir, "embeddings")
    return N.nearest(e, e, 10, "vec_id", "vec_id", same=True)


@_query(FOUND + """, d AS (SELECT unnest([1, 3, 5, 10, 20, 100]) AS depth), r AS (SELECT vec_id AS query, count(*) OVER (PARTITION BY label) - 1 AS n FROM u),
i AS (SELECT depth, n, sum(1 / log2(k + 1)) AS best FROM d, (SELECT DISTINCT n FROM r WHERE n > 0), (SELECT unnest(range(1, 101)) AS k) WHERE k <= least(depth, n) GROUP BY 1, 2),
h AS (SELECT query, rank, row_number() OVER (PARTITION BY query ORDER BY rank) AS hits FROM f WHERE la = lb),
s AS (SELECT query, depth, sum(1 / log2(rank + 1)) AS dcg, sum(hits / rank) AS precisions, count(*) AS found, min(rank) AS first FROM h JOIN d ON rank <= depth GROUP BY 1, 2)
SELECT d.depth::BIGINT AS depth, count(*) AS n_queries, round(avg(coalesce(dcg / best, 0)), 9) AS ndcg, round(avg(coalesce(precisions / r.n, 0)), 9) AS map, round(avg(coalesce(found / r.n, 0)), 9) AS recall,
round(avg(coalesce(found / d.depth, 0)), 9) AS precision, round(avg(coalesce(1 / first, 0)), 9) AS mrr FROM r JOIN d ON r.n > 0 JOIN i ON i.depth = d.depth AND i.n = r.n LEFT JOIN s ON s.query = r.query AND s.depth = d.depth GROUP BY 1""")
def retrieval_by_label(spark, sf_dir):
    e = _table(spark, sf_dir, "embeddings")
    found = N.nearest(e, e, max(N.DEPTHS), "vec_id", "vec_id", same=True)
    return N.measures(N.judged_by_label(found, e, max(N.DEPTHS), "vec_id"))


@_query()
def neighbour_layout(spark, sf_dir):
    return L.Layout().project(_table(spark, sf_dir, "embeddings"), "vec_id")


# ---- pairs, histograms, Naive Bayes ---------------------------------------------------------


@_query()
def sampled_pair_mean(spark, sf_dir):
    pairs = P.sampled_pairs(_vectors(spark, sf_dir), ["position"], 10_000)
    return pairs.agg(F.count("*").alias("n_pairs"), F.avg("cosine").alias("mean"))


@_query()
def three_distributions(spark, sf_dir):
    rows = P.three_distributions(_vectors(spark, sf_dir), ["article", "position"], 5_000)
    return rows.groupBy("distribution").agg(F.count("*").alias("n"), F.avg("cosine").alias("mean"), F.stddev_pop("cosine").alias("std"))


SIMILARITIES = f"""WITH {U}, x AS (SELECT 'negative' AS distribution, list_dot_product(a.v, b.v) AS c FROM u a JOIN u b ON a.label < b.label UNION ALL
SELECT 'positive', list_dot_product(a.v, b.v) FROM u a JOIN u b ON a.label = b.label AND a.vec_id < b.vec_id UNION ALL
SELECT 'transition', list_cosine_similarity(v, w) FROM (SELECT v, lead(v) OVER (PARTITION BY label ORDER BY vec_id) AS w FROM u) WHERE w IS NOT NULL)
"""


@_query(SIMILARITIES + "SELECT distribution, count(*) AS n, round(avg(c), 9) AS mean, round(stddev_pop(c), 9) AS std FROM x GROUP BY distribution")
def exact_distributions(spark, sf_dir):
    return X.summary(_vectors(spark, sf_dir))


@_query(SIMILARITIES + """, b AS (SELECT min(c) AS lo, (max(c) - min(c)) / 20 AS w FROM x), g AS (SELECT distribution, greatest(0, least(19, floor((c - lo) / w)))::BIGINT AS bin, count(*) AS count FROM x, b GROUP BY 1, 2),
t AS (SELECT distribution, sum(count) AS total FROM g GROUP BY 1), f AS (SELECT t.distribution, k::BIGINT AS bin, coalesce(g.count, 0) AS count, total FROM t CROSS JOIN (SELECT unnest(range(20)) AS k) LEFT JOIN g ON g.distribution = t.distribution AND g.bin = k)
SELECT distribution, bin, round(lo + bin * w, 9) AS "left", round(lo + (bin + 1) * w, 9) AS "right", count::BIGINT AS count, round(count / (total * w), 6) AS density FROM f, b""")
def similarity_histogram(spark, sf_dir):
    h = X.histogram(_vectors(spark, sf_dir), 20, padding=1e-6)
    return h.withColumn("density", F.round("density", 6))


def _trains(a, b):
    """Pairs are split by the parity of their articles; their class is 1 within an article."""
    return (a + b) % 4 < 2


LABELLED = f"""WITH {U}, x AS (SELECT round(list_dot_product(a.v, b.v), 9) AS x, (a.label = b.label)::INT AS y, (a.label + b.label) % 4 < 2 AS train FROM u a JOIN u b ON a.label < b.label OR (a.label = b.label AND a.vec_id < b.vec_id))"""
CONFUSION = "round(avg((y = p)::INT::DOUBLE), 9) AS accuracy, count(*) FILTER (y = 0 AND p = 0) AS tn, count(*) FILTER (y = 0 AND p = 1) AS fp, count(*) FILTER (y = 1 AND p = 0) AS fn, count(*) FILTER (y = 1 AND p = 1) AS tp"


@_query(LABELLED + f""", g AS (SELECT avg(x) FILTER (y = 0) AS m0, avg(x) FILTER (y = 1) AS m1, var_pop(x) FILTER (y = 0) AS v0, var_pop(x) FILTER (y = 1) AS v1 FROM x WHERE train),
h AS (SELECT m0, m1, v0 + greatest(greatest(v0, v1) * 1e-9, 1e-12) AS v0, v1 + greatest(greatest(v0, v1) * 1e-9, 1e-12) AS v1 FROM g),
q AS (SELECT y, CASE WHEN -0.5 * (ln(2 * pi() * v1) + (x - m1) * (x - m1) / v1) > -0.5 * (ln(2 * pi() * v0) + (x - m0) * (x - m0) / v0) THEN 1 ELSE 0 END AS p FROM x, h WHERE NOT train) SELECT {CONFUSION} FROM q""")
def gaussian_naive_bayes(spark, sf_dir):
    return X.gaussian_naive_bayes(_vectors(spark, sf_dir), _trains)


@_query(LABELLED + f""", i AS (SELECT *, greatest(0, least(99, ceil((greatest(-1.0, least(1.0, x)) + 1) / 0.02) - 1))::INT AS b FROM x), n AS (SELECT count(*) FILTER (y = 0) AS t0, count(*) FILTER (y = 1) AS t1 FROM i WHERE train),
c AS (SELECT k AS b, coalesce(sum((y = 0)::INT), 0) AS n0, coalesce(sum((y = 1)::INT), 0) AS n1 FROM (SELECT unnest(range(100)) AS k) LEFT JOIN (SELECT * FROM i WHERE train) j ON j.b = k GROUP BY k),
q AS (SELECT i.y, CASE WHEN ln((n1 + 1.0) / (t1 + 100.0)) > ln((n0 + 1.0) / (t0 + 100.0)) THEN 1 ELSE 0 END AS p FROM i JOIN c USING (b), n WHERE NOT i.train) SELECT {CONFUSION} FROM q""")
def histogram_naive_bayes(spark, sf_dir):
    return X.histogram_naive_bayes(_vectors(spark, sf_dir), _trains)


@_query()
def naive_bayes_evaluation(spark, sf_dir):
    return P.naive_bayes(_vectors(spark, sf_dir))


@_query("WITH d AS (SELECT doc_id, lang, source FROM documents), n AS (SELECT lang, source, count(*) AS n FROM d GROUP BY 1, 2), m AS (SELECT lang, min(n) AS least FROM n GROUP BY 1) SELECT source, lang, least AS n FROM n JOIN m USING (lang)")
def balanced_classes(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents").select("doc_id", "lang", "source")
    return P.balanced(docs, ["lang"], "source", F.xxhash64("doc_id")).groupBy("source", "lang").agg(F.count("*").alias("n"))


# ---- articles -------------------------------------------------------------------------------

METRICS = f"""length(text) AS n_chars, len({_words('text')}) AS n_words, {_ratio(_only('text', chr(92) + 'p{L}'), 'length(text)')} AS letter_ratio, {_ratio(_only('text', 'aeiouAEIOU'), _only('text', chr(92) + 'p{L}'))} AS vowel_ratio,
{_ratio(f'list_sum(list_transform({_words("text")}, lambda w: length(w)))', f'len({_words("text")})')} AS average_word_length"""
REASON = "CASE WHEN n_chars < 400 THEN 'too_short' WHEN n_words < 80 THEN 'too_few_words' WHEN letter_ratio < 0.60 THEN 'too_many_non_letters' WHEN vowel_ratio < 0.25 THEN 'too_few_vowels' WHEN average_word_length < 3.5 THEN 'average_word_too_short' END"


@_query(f"WITH m AS (SELECT doc_id, {METRICS} FROM documents) SELECT doc_id AS article_id, {REASON} IS NULL AS is_valid, {REASON} AS cleaning_reason FROM m")
def validate_articles(spark, sf_dir):
    return A.validate(_articles(spark, sf_dir)).select("article_id", "is_valid", "cleaning_reason")


@_query(f"WITH m AS (SELECT doc_id, {METRICS} FROM documents) SELECT count(*) AS n_articles, count(*) FILTER ({REASON} IS NULL) AS n_valid, count(*) FILTER ({REASON} IS NOT NULL) AS n_invalid FROM m")
def validation_counts(spark, sf_dir):
    return A.validation_counts(A.validate(_articles(spark, sf_dir)))


@_query("SELECT doc_id AS article_id, row_number() OVER (PARTITION BY text ORDER BY doc_id) = 1 AS is_valid, CASE WHEN row_number() OVER (PARTITION BY text ORDER BY doc_id) > 1 THEN 'duplicate' END AS cleaning_reason FROM documents")
def exact_duplicates(spark, sf_dir):
    docs = _articles(spark, sf_dir).withColumn("is_valid", F.lit(True)).withColumn("cleaning_reason", F.lit(None).cast("string"))
    return A.mark_duplicates(docs).select("article_id", "is_valid", "cleaning_reason")


# White space in the Unicode sense, written out: \s is ASCII here.
SPACE = r"[\x{09}-\x{0D}\x{1C}-\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def _strip(t: str) -> str:
    return f"regexp_replace({t}, '^{SPACE}+|{SPACE}+$', '', 'g')"


def _parts(split: str) -> str:
    return f"list_filter(list_transform({split}, lambda s: {_strip('s')}), lambda s: s <> '')"


SENTENCES = _parts(f"string_split(regexp_replace({_strip('text')}, '([.!?]){SPACE}+', '\\1\x1f', 'g'), '\x1f')")
PARAGRAPHS = _parts(f"regexp_split_to_array({_strip('text')}, '(\\r?\\n{SPACE}*){{2,}}')")
TOKENS = f"list_filter(regexp_split_to_array(text, '{SPACE}+'), lambda s: s <> '')"
# Written after the definitions of the metrics: lengths of paragraphs and sentences are in words, those of words in characters.
STRUCTURE_BASE = f"""x AS (SELECT doc_id, text AS t, {_words('text')} AS words, {PARAGRAPHS} AS pars, {SENTENCES} AS sents, len({TOKENS}) AS tokens FROM documents WHERE length(text) > 0),
b AS (SELECT doc_id, t, words, tokens, list_transform(pars, lambda p: len({_words('p')})) AS pl, list_transform(sents, lambda p: len({_words('p')})) AS sl, list_transform(words, lambda w: length(w)) AS wl, length(t) AS n,
length(regexp_replace(t, '\\s', '', 'g')) AS solid, {_only('t', r'\p{L}')} AS letters, {_only('t', r'\p{N}')} AS numbers, length(regexp_replace(t, '[\\p{{L}}\\p{{N}}\\s]', '', 'g')) AS specials, {_only('t', 'aeiouAEIOU')} AS vowels FROM x)"""


def _of_lengths(name: str, lengths: str) -> dict[str, str]:
    return {
        f"mean_words_per_{name}": f"coalesce(list_avg({lengths}), 0.0)",
        f"max_words_per_{name}": f"coalesce(list_max({lengths}), 0)::BIGINT",
        f"short_{name}_ratio": _ratio(f"len(list_filter({lengths}, lambda k: k <= 3))", f"len({lengths})"),
    }


STRUCTURE_COLUMNS = {
    "characters": "n::BIGINT",
    "non_whitespace_characters": "solid::BIGINT",
    "letters": "letters::BIGINT",
    "numeric_characters": "numbers::BIGINT",
    "special_symbol_characters": "specials::BIGINT",
    "words": "len(words)::BIGINT",
    "tokens": "tokens::BIGINT",
    "paragraphs": "len(pl)::BIGINT",
    "sentences": "len(sl)::BIGINT",
    **_of_lengths("paragraph", "pl"),
    **_of_lengths("sentence", "sl"),
    "mean_characters_per_word": "coalesce(list_avg(wl), 0.0)",
    "median_characters_per_word": "coalesce(list_median(wl), 0.0)::DOUBLE",
    "max_characters_per_word": "coalesce(list_max(wl), 0)::BIGINT",
    "tokens_per_word": _ratio("tokens", "len(words)"),
    "type_token_ratio": _ratio("len(list_distinct(list_transform(words, lambda w: replace(lower(w), 'ß', 'ss'))))", "len(words)"),
    "letter_character_ratio": _ratio("letters", "n"),
    "vowel_letter_ratio": _ratio("vowels", "letters"),
    "numeric_character_ratio": _ratio("numbers", "n"),
    "special_symbol_character_ratio": _ratio("specials", "n"),
    "numeric_or_special_character_ratio": _ratio("numbers + specials", "n"),
    "consonant_vowel_ratio": "CASE WHEN vowels > 0 THEN (letters - vowels)::DOUBLE / vowels END",
    **{f"estimated_token_chunks_{k}": f"ceil(tokens / {k}.0)::BIGINT" for k in (32, 64, 128, 256)},
}
STRUCTURE_SQL = ", ".join(f"{v} AS {k}" if v.endswith("BIGINT") else f"round({v}, 9) AS {k}" for k, v in STRUCTURE_COLUMNS.items())


@_query(f"WITH {STRUCTURE_BASE} SELECT doc_id AS article_id, {STRUCTURE_SQL} FROM b")
def text_structure(spark, sf_dir):
    return A.text_structure(_articles(spark, sf_dir))


def _q(p: float) -> str:
    return f"quantile_cont(x, {p})"


_POINTS = {"p01": 0.01, "p05": 0.05, "q1": 0.25, "median": 0.5, "q3": 0.75, "p95": 0.95, "p99": 0.99}
_FENCES = {
    "iqr": "q3 - q1",
    "iqr_lower_fence": "q1 - 1.5 * (q3 - q1)",
    "iqr_upper_fence": "q3 + 1.5 * (q3 - q1)",
    "mean_minus_3_std": "mean - 3 * standard_deviation",
    "mean_plus_3_std": "mean + 3 * standard_deviation",
    "median_absolute_deviation": "mad",
    "robust_lower_fence": "median - 3 * 1.4826 * mad",
    "robust_upper_fence": "median + 3 * 1.4826 * mad",
}
_SUMMARY = ["mean", "standard_deviation", "minimum", *_POINTS, "maximum", *_FENCES]


@_query(f"""WITH {STRUCTURE_BASE}, m AS (SELECT {", ".join(f"({v})::DOUBLE AS {k}" for k, v in STRUCTURE_COLUMNS.items())} FROM b), l AS (UNPIVOT m ON {", ".join(STRUCTURE_COLUMNS)} INTO NAME metric VALUE x),
s AS (SELECT metric, count(x) AS count, avg(x) AS mean, stddev_pop(x) AS standard_deviation, min(x) AS minimum, max(x) AS maximum, {", ".join(f"{_q(p)} AS {k}" for k, p in _POINTS.items())} FROM l GROUP BY metric),
d AS (SELECT l.metric, quantile_cont(abs(x - median), 0.5) AS mad FROM l JOIN s USING (metric) GROUP BY l.metric)
SELECT metric, count, {", ".join(f"round({_FENCES.get(k, k)}, 6) AS {k}" for k in _SUMMARY)} FROM s JOIN d USING (metric)""")
def structure_summary(spark, sf_dir):
    out = A.metric_summary(A.text_structure(_articles(spark, sf_dir)), list(STRUCTURE_COLUMNS))
    return out.select("metric", "count", *[F.round(n, 6).alias(n) for n in _SUMMARY])


_JUDGED = ("letter_character_ratio", "vowel_letter_ratio", "mean_characters_per_word", "tokens_per_word")
OUTLIERS = f"""WITH {STRUCTURE_BASE}, m AS (SELECT doc_id, {", ".join(f"{STRUCTURE_COLUMNS[k]} AS {k}" for k in (*_JUDGED, "numeric_or_special_character_ratio"))} FROM b),
l AS (UNPIVOT (SELECT {", ".join(_JUDGED)} FROM m) ON {", ".join(_JUDGED)} INTO NAME metric VALUE x), s AS (SELECT metric, quantile_cont(x, 0.5) AS med FROM l GROUP BY metric),
d AS (SELECT l.metric, any_value(med) AS med, quantile_cont(abs(x - med), 0.5) AS mad FROM l JOIN s USING (metric) GROUP BY l.metric), bd AS (SELECT metric, med - 4.5 * 1.4826 * mad AS lo, med + 4.5 * 1.4826 * mad AS hi FROM d)"""


def _outside(metric: str, direction: str) -> str:
    limit = f"(SELECT {'lo' if direction == 'low' else 'hi'} FROM bd WHERE metric = '{metric}')"
    return f"CASE WHEN {metric} {'<' if direction == 'low' else '>'} {limit} THEN 'outlier_{direction}_{metric}' END"


_TESTS = [("letter_character_ratio", "low"), *[(m, d) for m in _JUDGED[1:3] for d in ("low", "high")], ("tokens_per_word", "high")]
CLASSIFIED = OUTLIERS + f""", o AS (SELECT m.*, list_filter([{", ".join(_outside(*t) for t in _TESTS)}], lambda x: x IS NOT NULL) AS f FROM m),
k AS (SELECT doc_id, list_concat(CASE WHEN numeric_or_special_character_ratio > 0.10 THEN ['numeric_or_special_ratio_above_limit'] ELSE [] END, CASE WHEN len(f) >= 2 THEN f ELSE [] END) AS r FROM o)"""


def _structured(spark, sf_dir) -> DataFrame:
    return A.text_structure(_articles(spark, sf_dir)).select("article_id", *A.JUDGED, F.lit(True).alias("is_valid"))


@_query(OUTLIERS + " SELECT metric, round(lo, 9) AS lower, round(hi, 9) AS upper FROM bd")
def robust_bounds(spark, sf_dir):
    return A.robust_bounds(_structured(spark, sf_dir))


@_query(CLASSIFIED + " SELECT doc_id AS article_id, array_to_string(r, ';') AS reasons, len(r) > 0 AS invalidate FROM k")
def statistical_outliers(spark, sf_dir):
    return A.classify_outliers(_structured(spark, sf_dir)).select("article_id", "reasons", "invalidate")


@_query(CLASSIFIED + " SELECT reason, count(*) AS n FROM (SELECT unnest(r) AS reason FROM k) GROUP BY reason")
def outlier_reason_counts(spark, sf_dir):
    return A.reason_counts(A.classify_outliers(_structured(spark, sf_dir)))


def _newspapers(spark, sf_dir) -> DataFrame:
    """A Markdown text for each document: of odd ones, the text between headings, of which some say
    nothing, with the source as a second article; of even ones, the text without a heading."""
    even = F.concat(F.lit("\r\n"), "text", F.lit("\r\n#\r\n"))
    odd = F.concat(F.lit("before\n  # First #\n"), "text", F.lit("\n#  \n## Second\r\n"), F.coalesce("source", F.lit("")), F.lit("\n# Third\n"))
    content = F.when(F.col("doc_id") % 2 == 0, even).otherwise(odd)
    return _table(spark, sf_dir, "documents").select(F.col("doc_id").alias("newspaper_id"), content.alias("content"))


@_query("""WITH d AS (SELECT doc_id, trim(text, E' \\n') AS body, source FROM documents WHERE text IS NOT NULL),
a AS (SELECT doc_id, 0 AS k, NULL AS title, body || E'\\r\\n#' AS content FROM d WHERE doc_id % 2 = 0 AND body <> '' UNION ALL SELECT doc_id, 0, NULL, '#' FROM d WHERE doc_id % 2 = 0 AND body = ''
UNION ALL SELECT doc_id, 1, 'First #', body FROM d WHERE doc_id % 2 = 1 UNION ALL SELECT doc_id, 2, '# Second', source FROM d WHERE doc_id % 2 = 1)
SELECT doc_id AS newspaper_id, row_number() OVER (PARTITION BY doc_id ORDER BY k) - 1 AS article_index, title, content FROM a WHERE content <> ''""")
def split_newspapers(spark, sf_dir):
    return A.split_articles(_newspapers(spark, sf_dir))


@_query("""WITH a AS (SELECT doc_id, 'article_' || substr(sha256('{"article_index": 0, "content": ' || to_json(text) || ', "newspaper_id": ' || to_json(source) || ', "title": null}'), 1, 24) AS article_id FROM documents),
b AS (SELECT doc_id, article_id, 'newspaper_' || substr(sha256(source), 1, 24) AS newspaper_id FROM a JOIN documents USING (doc_id)) SELECT doc_id, article_id, newspaper_id FROM b""")
def content_ids(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents")
    return docs.select("doc_id", A.article_id(F.lit(0), "text", "source", F.lit(None).cast("string")).alias("article_id"), A.newspaper_id(F.col("source")).alias("newspaper_id"))


@_query("SELECT doc_id, regexp_replace(text, '^(\\S+) ', '\\1 ') AS text FROM documents")
def images_removed(spark, sf_dir):
    marked = F.regexp_replace("text", r"^(\S+) ", r'$1 ![a scan](images/p(1).jpg "page") ')
    return _table(spark, sf_dir, "documents").select("doc_id", T.remove_markdown_images(marked).alias("text"))


# ---- chunks ---------------------------------------------------------------------------------

def _window_sql(parts: str, count: int, overlap: int) -> str:
    step = count - overlap
    return f"""WITH p AS (SELECT doc_id, {parts} AS p FROM documents), w AS (SELECT doc_id, p, unnest(range(0, greatest(1, len(p) - {overlap}), {step})) AS k FROM p WHERE len(p) > 0)
SELECT doc_id AS article_id, (k / {step})::BIGINT AS chunk_index, array_to_string(p[k + 1 : k + {count}], ' ') AS text FROM w"""


@_query("SELECT doc_id AS article_id, 0::BIGINT AS chunk_index, trim(text, E' \\n') AS text FROM documents WHERE trim(text, E' \\n') <> ''")
def chunk_noop(spark, sf_dir):
    return C.chunk(_articles(spark, sf_dir), "noop")


BROKEN = _parts(f"regexp_split_to_array({_strip("replace(text, '. ', E'.\\n\\n')")}, '(\\r?\\n{SPACE}*){{2,}}')")


@_query(f"""WITH p AS (SELECT doc_id, {BROKEN} AS p FROM documents)
SELECT doc_id AS article_id, unnest(range(len(p)))::BIGINT AS chunk_index, unnest(p) AS text FROM p""")
def chunk_paragraph(spark, sf_dir):
    spaced = _articles(spark, sf_dir).withColumn("content", F.replace("content", F.lit(". "), F.lit(".\n\n")))
    return C.chunk(spaced, "paragraph")


@_query(_window_sql(SENTENCES, 1, 0))
def chunk_sentence(spark, sf_dir):
    return C.chunk(_articles(spark, sf_dir), "sentence")


@_query(_window_sql(SENTENCES, 4, 1))
def chunk_sentence_4_1(spark, sf_dir):
    return C.chunk(_articles(spark, sf_dir), "sentence", sentence_count=4, sentence_overlap=1)


@_query(_window_sql(TOKENS, 128, 0))
def chunk_token_128(spark, sf_dir):
    return C.chunk(_articles(spark, sf_dir), "token", token_count=128)


@_query(_window_sql(TOKENS, 256, 64))
def chunk_token_256_64(spark, sf_dir):
    return C.chunk(_articles(spark, sf_dir), "token", token_count=256, token_overlap=64)


@_query()
def chunk_recursive_1000_100(spark, sf_dir):
    return C.chunk(_articles(spark, sf_dir), "split", chunk_size=1000, chunk_overlap=100)


def _overlapping(spark, sf_dir) -> DataFrame:
    return C.chunk(_articles(spark, sf_dir), "token", token_count=40, token_overlap=10).withColumn("chunking_run_id", F.lit("token_40_10"))


OVERLAP = _window_sql(TOKENS, 40, 10).replace("WITH p", "WITH p", 1)
OVERLAPS = f"""WITH c AS ({OVERLAP}), t AS (SELECT *, lead(text) OVER (PARTITION BY article_id ORDER BY chunk_index) AS n FROM c), o AS (SELECT article_id, chunk_index, length(n) AS len, coalesce(list_max(list_filter(range(1, least(length(text), length(n)) + 1), lambda k: right(text, k) = left(n, k))), 0) AS overlap FROM t WHERE n IS NOT NULL)"""


@_query(OVERLAPS + " SELECT 'token_40_10' AS chunking_run_id, article_id, chunk_index, overlap::BIGINT AS overlap, round(overlap / len, 9) AS overlap_share FROM o")
def chunk_overlaps(spark, sf_dir):
    return C.chunk_overlaps(_overlapping(spark, sf_dir), ["chunking_run_id", "article_id"])


@_query(OVERLAPS + f""", a AS (SELECT article_id, count(*) AS n FROM c GROUP BY 1), l AS (SELECT length(text) AS ch, len({_words('text')}) AS w FROM c)
SELECT 'token_40_10' AS chunking_run_id, (SELECT count(*) FROM a) AS num_articles, (SELECT count(*) FROM c) AS num_chunks, (SELECT round(avg(n), 9) FROM a) AS mean_chunks_per_article, (SELECT quantile_cont(n::DOUBLE, 0.5) FROM a) AS median_chunks_per_article,
(SELECT round(avg(ch), 9) FROM l) AS mean_characters, (SELECT quantile_cont(ch::DOUBLE, 0.5) FROM l) AS median_characters, (SELECT round(quantile_cont(ch::DOUBLE, 0.95), 9) FROM l) AS p95_characters, (SELECT round(avg(w), 9) FROM l) AS mean_words,
(SELECT quantile_cont(w::DOUBLE, 0.5) FROM l) AS median_words, count(*) AS num_transitions, count(*) FILTER (overlap > 0) AS num_overlapping_transitions, round(100 * avg((overlap > 0)::INT::DOUBLE), 9) AS overlap_transition_percent,
round(100 * avg(overlap / len) FILTER (overlap > 0), 9) AS mean_positive_overlap_percent FROM o""")
def chunk_summary(spark, sf_dir):
    return C.chunk_summary(_overlapping(spark, sf_dir))


CHUNK_BINS = """WITH x AS (SELECT role AS run, length(text)::DOUBLE AS x FROM conversations WHERE length(text) > 0), b AS (SELECT min(x) AS lo, (max(x) - min(x)) / 50 AS w FROM x), g AS (SELECT run, greatest(0, least(49, floor((x - lo) / w)))::BIGINT AS bin, count(*) AS count FROM x, b GROUP BY 1, 2),
t AS (SELECT run, sum(count) AS total FROM g GROUP BY 1), f AS (SELECT t.run, k::BIGINT AS bin, coalesce(g.count, 0) AS count, total FROM t CROSS JOIN (SELECT unnest(range(50)) AS k) LEFT JOIN g ON g.run = t.run AND g.bin = k)"""


@_query(CHUNK_BINS + ' SELECT run, bin, round(lo + bin * w, 9) AS "left", round(lo + (bin + 1) * w, 9) AS "right", count::BIGINT AS count, round(count / (total * w), 9) AS density FROM f, b')
def chunk_length_histogram(spark, sf_dir):
    turns = _table(spark, sf_dir, "conversations").select(F.col("role").alias("run"), T.chunk_metric(F.col("text"), "char").alias("x")).where("x > 0")
    return P.histogram(turns, ["run"], "x", 50)


@_query(CHUNK_BINS + " SELECT run, bin, round(count / (total * w), 9) AS density FROM f, b")
def chunk_histogram_area(spark, sf_dir):
    turns = _table(spark, sf_dir, "conversations").select(F.col("role").alias("run"), T.chunk_metric(F.col("text"), "char").alias("x")).where("x > 0")
    h = P.histogram(turns, ["run"], "x", 50)
    return P.area_normalised(h.withColumn("density", 3 * F.col("density")), ["run"]).select("run", "bin", "density")


@_query("SELECT round(avg(length(text)) * count(*) / 1048576) AS megabytes, count(*) AS n_chunks FROM conversations")
def chunk_memory(spark, sf_dir):
    s = _chunks(spark, sf_dir).agg(F.avg(F.length("text")).alias("mean_characters"), F.count("*").alias("num_chunks"))
    return C.chunk_memory(s).select("megabytes", F.col("num_chunks").alias("n_chunks"))


# ---- store ----------------------------------------------------------------------------------


@_query("""SELECT c.conv_id * 100 + c.turn AS chunk_id, coalesce(l.quality = 1, FALSE) AS is_valid FROM conversations c LEFT JOIN labels l ON l.doc_id = c.conv_id""")
def propagated_validation(spark, sf_dir):
    turns = _table(spark, sf_dir, "conversations")
    chunks = turns.select((F.col("conv_id") * 100 + F.col("turn")).alias("chunk_id"), F.col("conv_id").alias("article_id"))
    flags = _table(spark, sf_dir, "labels").select(F.col("doc_id").alias("article_id"), (F.col("quality") == 1).alias("is_valid"))
    return A.propagate_validation(chunks.select("chunk_id"), chunks, flags).select("chunk_id", "is_valid")


@_query("SELECT doc_id AS chunk_id FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings) AND length(text) <= 3000")
def unembedded_chunks(spark, sf_dir):
    chunks = _table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), "text")
    done = _table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.lit("run").alias("embedding_run_id"))
    return C.unembedded(chunks, done, "run", 3000).select("chunk_id")


@_query("SELECT doc_id AS chunk_id FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings) AND length(text) > 3000")
def oversized_chunks(spark, sf_dir):
    chunks = _table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), "text")
    done = _table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.lit("run").alias("embedding_run_id"))
    return C.oversized(chunks, done, "run", 3000).select("chunk_id")


def _runs(spark, sf_dir) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Three runs of a model: whole articles, and two chunkings."""
    v = _table(spark, sf_dir, "embeddings")
    runs = spark.createDataFrame([(f"run_{k}", "model", f'{{"chunking_run_id": "{c}"}}', k) for k, c in enumerate(("noop", "token_window_32", "paragraph"))], "embedding_run_id string, model_id string, config_json string, created_at int")
    chunkings = spark.createDataFrame([("noop", "noop"), ("token_window_32", "token"), ("paragraph", "paragraph")], "chunking_run_id string, method string")
    rows = v.select(F.concat(F.lit("run_"), (F.col("label") % 3).cast("string")).alias("embedding_run_id"), (F.get("embedding", F.lit(0)) > 0).alias("is_valid"))
    return runs, chunkings, rows


@_query("""WITH r(k, c, m) AS (VALUES (0, 'noop', 'noop'), (1, 'token_window_32', 'token'), (2, 'paragraph', 'paragraph')) SELECT 'run_' || k AS embedding_run_id, 'model' AS model_id, c AS chunking_run_id, m AS chunking_method,
(SELECT count(*) FROM embeddings WHERE label % 3 = k AND embedding[1] > 0) AS embedding_count, k::BIGINT AS created_at FROM r""")
def embedding_runs(spark, sf_dir):
    return R.describe_runs(*_runs(spark, sf_dir))


@_query("SELECT count(*) AS n_batches, count(*) FILTER (doc_id % 4 = 0 OR doc_id % 4 = 1) AS n_running, count(*) FILTER (doc_id % 4 = 2 AND n_chars % 2 = 0) AS n_to_import FROM documents")
def remote_batch_status(spark, sf_dir):
    d = _table(spark, sf_dir, "documents")
    status = F.when(F.col("doc_id") % 4 == 0, F.lit(None)).when(F.col("doc_id") % 4 == 1, "in_progress").when(F.col("doc_id") % 4 == 2, "completed").otherwise("failed")
    batches = d.select(F.lit("run").alias("embedding_run_id"), status.alias("status"), F.when(F.col("n_chars") % 2 == 1, F.lit(1)).alias("imported_at"), F.lit("file").alias("output_file_id"), F.lit(None).cast("string").alias("error_file_id"))
    return R.batch_status(batches, "run")


# ---- summaries ------------------------------------------------------------------------------


def _summaries(spark, sf_dir) -> dict[str, DataFrame]:
    """Tables keyed by model (language) and strategy (source) with means that stand for metrics."""
    d = _table(spark, sf_dir, "documents")
    keyed = d.select(F.col("lang").alias("model_id"), F.col("source").alias("chunking_strategy"), (F.col("n_chars") % 100 / 100).alias("x"), (F.col("doc_id") % 100 / 100).alias("y"))
    g = keyed.groupBy(*S.KEYS)
    return {"degradation": g.agg(F.avg(F.col("x") / 10).alias("mean")), "anisotropy": g.agg(F.avg(F.col("y") / 2).alias("negative"), F.avg(F.col("x") / 2 + F.col("y") / 2).alias("positive"))}


MERGED = "WITH g AS (SELECT lang AS model_id, source AS chunking_strategy, avg((n_chars % 100) / 100 / 10) AS d, avg((doc_id % 100) / 100 / 2) AS n, avg((n_chars % 100) / 100 / 2 + (doc_id % 100) / 100 / 2) AS p FROM documents GROUP BY 1, 2)"


@_query(MERGED + """ SELECT model_id, chunking_strategy, round(d, 9) AS degradation_mean, round(n, 9) AS anisotropy_negative, round(p, 9) AS anisotropy_positive,
round(CASE WHEN d >= 0 AND p - n >= 0 AND d + (p - n) > 0 THEN d / (d + (p - n)) END, 9) AS degradation_share, round(CASE WHEN d >= 0 AND 1 - n > 0 THEN ((1 - n) - d) / (1 - n) END, 9) AS retained FROM g""")
def merged_metrics(spark, sf_dir):
    m = S.merge(_summaries(spark, sf_dir))
    d, n, p = F.col("degradation_mean"), F.col("anisotropy_negative"), F.col("anisotropy_positive")
    return m.withColumn("degradation_share", S.degradation_share(d, n, p)).withColumn("retained", S.retained_similarity(d, n))


@_query(MERGED + """, k AS (SELECT m, 'src' || s AS s FROM (SELECT unnest(['de', 'en', 'es', 'fr', 'xx']) AS m), (SELECT unnest(range(22)) AS s)) SELECT k.m AS model_id, k.s AS chunking_strategy, round(d, 9) AS mean FROM k LEFT JOIN g ON g.model_id = k.m AND g.chunking_strategy = k.s""")
def summary_grid(spark, sf_dir):
    return S.complete_grid(_summaries(spark, sf_dir)["degradation"], ["de", "en", "es", "fr", "xx"], [f"src{k}" for k in range(22)])


@_query("""WITH s AS (SELECT unnest(['{"token_count": 128, "token_overlap": 32}', '{"token_count": 64}', '{}']) AS c, unnest(['token', 'token_window', 'sentence']) AS m, unnest(['token_window_128_overlap_32', 'token_window_64', 'sentence']) AS strategy, unnest(['Token window (128 tokens, 32 overlap)', 'Token window (64 tokens)', 'Sentence']) AS label)
SELECT lang, m AS method, strategy, label, count(*) AS n FROM documents, s GROUP BY ALL""")
def strategy_names(spark, sf_dir):
    runs = spark.createDataFrame([("token", '{"token_count": 128, "token_overlap": 32}'), ("token_window", '{"token_count": 64}'), ("sentence", "{}")], "method string, config string")
    counts = _table(spark, sf_dir, "documents").groupBy("lang").agg(F.count("*").alias("n"))
    strategy = T.build_strategy(F.col("method"), F.col("config"))
    return counts.crossJoin(F.broadcast(runs)).select("lang", "method", strategy.alias("strategy"), T.format_strategy(strategy).alias("label"), "n")  # languages by three runs
