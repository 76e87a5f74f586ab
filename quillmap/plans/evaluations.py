"""Evaluations of embedding runs in a store: one result row for each run, in one job for all runs
where the measure allows it."""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import text as T
from ..operators import chunking as C
from ..operators import geometry as G
from ..operators import pairs as P
from ..operators import retrieval as N
from ..operators import runs as R
from ..sources.steps import cut
from ..sources.tables import CHUNK_COLUMNS, SIMILARITY_COLUMNS, Store

# Defaults of the evaluations.
SAMPLE_SIZE, ANISOTROPY_SAMPLE, PAIR_SAMPLE = 100_000, 10_000, 100_000
MIN_CHUNKS, COHORT_SIZE, COHORT_SEEDS, TRIM, BLOCK = 5, 10_000, (42, 43, 44, 45, 46), 0.01, 512
TOLERANCE, CHUNK_BINS, SIMILARITY_BINS = 1e-5, 4_000, 100


def run_table(store: Store) -> DataFrame:
    """Embedding runs with their chunking run, method and number of valid embeddings, newest first."""
    return R.describe_runs(store.read("embedding_runs"), store.read("chunking_runs"), store.read("embeddings"))


def vectors_of(store: Store, run_id: str) -> DataFrame:
    """article, position, embedding, chunk_length of a run's valid embeddings, in the order of chunks."""
    chunks = store.read("chunks").select("chunk_id", F.col("article_id").alias("article"), F.col("chunk_index").alias("position"), F.length("text").alias("chunk_length"))
    return store.valid_embeddings([run_id]).select("chunk_id", "embedding").join(chunks, "chunk_id").drop("chunk_id")


def _labelled(row: DataFrame, run) -> DataFrame:
    first = [F.lit(run["embedding_run_id"]).alias("embedding_run_id"), F.lit(run["model_id"]).alias("model_id"), F.lit(run["chunking_run_id"]).alias("chunking_run_id")]
    return row.select(*first, *row.columns)


def _over_runs(store: Store, run_ids: list[str] | None, measure) -> DataFrame:
    runs = run_table(store)
    chosen = [R.require_run(runs, r) for r in run_ids] if run_ids else R.non_noop_runs(runs).where("embedding_count > 0").collect()
    if not chosen:
        raise ValueError("no embedding runs to evaluate")
    return reduce(DataFrame.unionByName, [_labelled(measure(r), r) for r in chosen])


def anisotropy(store: Store, run_ids: list[str] | None = None, sample_size: int | None = None, seed: int = 42) -> DataFrame:
    """Mean cosine over all pairs and shares of variance. The mean is exact; with `sample_size`, it is
    that of as many random pairs."""

    def measure(run) -> DataFrame:
        v = vectors_of(store, run["embedding_run_id"]).cache()
        if sample_size is None:
            mean = G.pair_means(v).select("n_vectors", F.col("mean_all").alias("mean_pairwise_cosine"))
        else:
            mean = P.sampled_pairs(v, ["article", "position"], sample_size, seed).agg(F.avg("cosine").alias("mean_pairwise_cosine")).select(F.lit(v.count()).alias("n_vectors"), "mean_pairwise_cosine")
        return mean.crossJoin(F.broadcast(G.pca_ratios(v)))  # one row by one

    return _over_runs(store, run_ids, measure)


def intra_consistency(store: Store, run_ids: list[str] | None = None, drop_threshold: float | None = None) -> DataFrame:
    return _over_runs(store, run_ids, lambda run: G.intra_consistency(vectors_of(store, run["embedding_run_id"]), drop_threshold))


#: Columns of the diagnostics and what they are called for all eligible articles.
FULL_NAMES = {
    "index": "davies_bouldin_full_index",
    "trimmed_index": "davies_bouldin_full_trimmed_index",
    "median_ratio": "davies_bouldin_full_median_ratio",
    "p95_ratio": "davies_bouldin_full_p95_ratio",
    "p99_ratio": "davies_bouldin_full_p99_ratio",
    "max_ratio": "davies_bouldin_full_maximum_ratio",
    "top_1_percent_share": "davies_bouldin_full_top_1pct_contribution",
    "min_centroid_distance": "davies_bouldin_full_min_centroid_distance",
    "p01_centroid_distance": "davies_bouldin_full_p01_nearest_centroid_distance",
    "exact_twin_pairs": "davies_bouldin_full_exact_centroid_pair_count",
}
COHORT_NAMES = {
    "mean_index": "davies_bouldin_index",
    "std_index": "davies_bouldin_std",
    "mean_trimmed": "davies_bouldin_trimmed_index",
    "std_trimmed": "davies_bouldin_trimmed_std",
    "cohort_scores": "davies_bouldin_scores_json",
    "cohort_trimmed_scores": "davies_bouldin_trimmed_scores_json",
}


def _cohort_pool(store: Store, run_id: str, wanted: list[str], min_chunks: int) -> DataFrame:
    """Articles with enough chunks in every cohort run."""
    if run_id not in wanted:
        raise ValueError(f"the cohort runs must include the evaluated run: {run_id}")
    counts = [vectors_of(store, r).groupBy(F.col("article").alias("article_id")).agg(F.count("*").alias("n_chunks")).withColumn("embedding_run_id", F.lit(r)) for r in wanted]
    shared = G.shared_eligible(reduce(DataFrame.unionByName, counts), wanted, min_chunks)
    return cut(shared.select(F.col("article_id").alias("article")))


def inter_separability(
    store: Store,
    run_ids: list[str] | None = None,
    metrics: tuple[str, ...] = ("davies_bouldin",),
    min_chunks: int = MIN_CHUNKS,
    cohort_size: int = COHORT_SIZE,
    seeds: tuple[int, ...] = COHORT_SEEDS,
    trim: float = TRIM,
    block: int = BLOCK,
    cohort_run_ids: list[str] | None = None,
    skip_full: bool = False,
) -> DataFrame:
    """Davies-Bouldin over seeded cohorts of articles that are eligible in every cohort run (by
    default, in the run itself), and over all articles of the run with enough chunks; and the
    silhouette, if asked for. A cohort larger than the pool, a run outside the cohort runs, and a run
    that lacks articles of the pool are errors."""
    if unknown := set(metrics) - {"davies_bouldin", "silhouette"}:
        raise ValueError(f"unknown metrics: {sorted(unknown)}")
    runs = run_table(store)
    for r in cohort_run_ids or ():
        R.require_run(runs, r)

    def measure(run) -> DataFrame:
        run_id = run["embedding_run_id"]
        wanted = list(dict.fromkeys(cohort_run_ids or [run_id]))
        every = vectors_of(store, run_id)
        v = cut(every.join(G.eligible(every, min_chunks).select("article"), "article", "left_semi"))
        n, articles = v.agg(F.count("*"), F.count_distinct("article")).first()
        if articles < 2:
            raise ValueError(f"{run_id}: {articles} articles with {min_chunks} chunks or more; two are needed")
        fixed = {"num_articles": articles, "num_chunks": n, "min_chunks_threshold": min_chunks, "davies_bouldin_block_size": block}
        fixed |= {"cohort_embedding_run_ids_json": json.dumps(wanted), "davies_bouldin_trim_fraction": trim}
        out = v.sparkSession.range(1).select(*[F.lit(x).alias(k) for k, x in fixed.items()])
        if "davies_bouldin" in metrics:
            pool = _cohort_pool(store, run_id, wanted, min_chunks)
            if lost := pool.join(v.select("article").distinct(), "article", "left_anti").count():
                raise ValueError(f"{run_id} is incomplete for {lost} articles of the shared cohort")
            some = G.cohort_davies_bouldin(v, pool, cohort_size, list(seeds), trim)
            sizes = {"davies_bouldin_cohort_pool_size": pool.count(), "davies_bouldin_cohort_size": cohort_size, "davies_bouldin_seeds_json": json.dumps(list(seeds))}
            some = some.drop("n_cohorts").withColumnsRenamed(COHORT_NAMES).withColumns({k: F.lit(x) for k, x in sizes.items()})
            out = out.crossJoin(F.broadcast(some))  # one row by one
            if not skip_full:
                full = G.davies_bouldin(v, trim, block).drop("n_clusters").withColumnsRenamed(FULL_NAMES)
                out = out.crossJoin(F.broadcast(full))
        else:
            out = out.withColumns({c: F.lit(None).cast("double") for c in ("davies_bouldin_index", "davies_bouldin_std")})
        return out.withColumn("silhouette_score", F.lit(G.silhouette(v) if "silhouette" in metrics else None).cast("double"))

    return _over_runs(store, run_ids or cohort_run_ids, measure)


def representation_degradation(store: Store, model_id: str | None = None, run_id: str | None = None, article_run_id: str | None = None, min_chunks: int = MIN_CHUNKS) -> DataFrame:
    """Every chunked run of a model (or one run) against the model's vectors of whole articles."""
    runs = run_table(store)
    chosen = R.chunk_runs(runs, model_id, run_id)
    base = R.article_run(runs, chosen[0]["model_id"], article_run_id)
    whole = vectors_of(store, base["embedding_run_id"]).select("article", "embedding").cache()
    d = G.dimension_of(whole)
    return reduce(DataFrame.unionByName, [_labelled(G.degradation_summary(G.degradation(whole, vectors_of(store, r["embedding_run_id"]), d, min_chunks)), r) for r in chosen])


def naive_bayes(store: Store, run_ids: list[str] | None = None, limit: int = P.PAIR_LIMIT, test_share: float = P.TEST_SHARE, seed: int = P.SEED) -> DataFrame:
    return _over_runs(store, run_ids, lambda run: P.naive_bayes(vectors_of(store, run["embedding_run_id"]), limit, test_share, seed))


def retrieval(store: Store, run_ids: list[str] | None = None, depths: tuple[int, ...] = N.DEPTHS, block: int = BLOCK) -> DataFrame:
    """How well chunks find the other chunks of their article: exact neighbours among all chunks of a
    run, one row for each depth."""

    def measure(run) -> DataFrame:
        v = cut(vectors_of(store, run["embedding_run_id"]).select(F.concat_ws("/", F.col("article").cast("string"), F.format_string("%010d", "position")).alias("id"), "article", "embedding"))
        found = N.nearest(v, v, max(depths), "id", "id", same=True, block=block)
        return N.measures(N.judged_by_label(found, v, max(depths), "id", "article"), depths)

    return _over_runs(store, run_ids, measure)


def norms(store: Store, model_id: str, chunking_run_id: str, tolerance: float = TOLERANCE) -> DataFrame:
    """Statistics of lengths of the one run of a model over a chunking; no join with the chunks."""
    rows = run_table(store).where((F.col("model_id") == model_id) & (F.col("chunking_run_id") == chunking_run_id)).collect()
    if len(rows) != 1:
        raise ValueError(f"{len(rows)} runs of {model_id} for {chunking_run_id}")
    return _labelled(G.norm_stats(store.valid_embeddings([rows[0]["embedding_run_id"]]).select("embedding"), tolerance), rows[0])


def _histogram_rows(h: DataFrame, columns: list[tuple[str, str]], log_x: bool, count: str) -> DataFrame:
    """As histogram files have them: `count` is the number of values of the whole distribution."""
    keys = [c for c in h.columns if c.startswith(("chunking_run", "embedding_run")) or c in ("distribution", "method", "model_id")]
    total = F.sum("count").over(W.partitionBy(*keys))  # a row for each bin
    left, right = F.col("left"), F.col("right")
    center = F.sqrt(left * right) if log_x else (left + right) / 2
    more = {"bin_index": F.col("bin"), "bin_left": left, "bin_right": right, "bin_center": center, count: total, "log_x": F.lit(int(log_x))}
    return h.withColumns(more).select(*[F.col(c).cast(t).alias(c) for c, t in columns])


def similarity_histograms(
    store: Store, run_ids: list[str], names: list[str] | None = None, bins: int = SIMILARITY_BINS, log_x: bool = False, limit: int = P.PAIR_LIMIT, seed: int = P.SEED
) -> DataFrame:
    """Histograms of the three distributions of each run, with the same edges for all."""
    runs, parts = run_table(store), []
    for r, name in _named(run_ids, names):
        run = R.require_run(runs, r)
        labels = {"embedding_run_id": r, "embedding_run_name": name, "model_id": run["model_id"]}
        parts.append(P.three_distributions(vectors_of(store, r), ["article", "position"], limit, seed).withColumns({k: F.lit(x) for k, x in labels.items()}))
    rows = cut(reduce(DataFrame.unionByName, parts))
    keys = ["embedding_run_id", "embedding_run_name", "model_id", "distribution"]
    return _histogram_rows(P.histogram(rows, keys, "cosine", bins, log_x, 1e-6), SIMILARITY_COLUMNS, log_x, "pair_count")


def chunk_histograms(store: Store, run_ids: list[str], names: list[str] | None = None, metric: str = "char", bins: int = CHUNK_BINS, log_x: bool = False) -> DataFrame:
    """Histograms of the chunks' lengths in each run, with the same edges for all."""
    mapping = F.create_map(*[F.lit(x) for p in _named(run_ids, names) for x in p])
    runs = store.read("chunking_runs").select("chunking_run_id", "method")
    chunks = store.read("chunks").where(F.col("chunking_run_id").isin(run_ids)).join(F.broadcast(runs), "chunking_run_id")  # a row a run
    named = mapping[F.col("chunking_run_id")].alias("chunking_run_name")
    values = chunks.select("chunking_run_id", named, "method", T.chunk_metric(F.col("text"), metric).alias("x")).where("x > 0")
    h = P.histogram(values, ["chunking_run_id", "chunking_run_name", "method"], "x", bins, log_x).withColumn("metric", F.lit(metric))
    return _histogram_rows(h, CHUNK_COLUMNS, log_x, "chunk_count")


def _named(ids: list[str], names: list[str] | None) -> list[tuple[str, str]]:
    if names is not None and len(names) != len(ids):
        raise ValueError("give one name for each run")
    return list(zip(ids, names or [""] * len(ids)))


def chunk_summaries(store: Store, run_ids: list[str] | None = None) -> DataFrame:
    """One row for the first run of each method and configuration, of all runs or of those given."""
    runs = store.read("chunking_runs")
    if run_ids:
        known = {r[0] for r in runs.select("chunking_run_id").where(F.col("chunking_run_id").isin(run_ids)).collect()}
        if unknown := [r for r in dict.fromkeys(run_ids) if r not in known]:
            raise ValueError(f"unknown chunking runs: {', '.join(unknown)}")
        runs = runs.where(F.col("chunking_run_id").isin(run_ids))
    runs = C.first_runs(runs).select("chunking_run_id", "method", "config_json")
    chunks = store.read("chunks").join(F.broadcast(runs.select("chunking_run_id", F.col("method").alias("_method"))), "chunking_run_id")
    return runs.join(C.chunk_summary(chunks, token_chunks=F.col("_method") == "token"), "chunking_run_id")
