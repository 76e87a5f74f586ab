"""Reports: summary tables with their LaTeX, the merged table, and series for plots."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import chunking as C
from ..operators import summary as S

# The metrics of each report, with titles and formats.
METRICS = {
    "anisotropy": {"mean_pairwise_cosine": ("Mean cosine", "decimal"), "pc1": ("PC1", "percent"), "pc5": ("PC5", "percent"), "pc10": ("PC10", "percent")},
    "intra_consistency": {"mean_transition_cosine": ("Transition mean", "decimal"), "mean_pairwise_cosine": ("Pair mean", "decimal"), "mean_cosine_volatility": ("Volatility", "decimal"), "semantic_drop_rate": ("Drop rate", "percent")},
    "inter_separability": {"davies_bouldin_index": ("Davies-Bouldin", "decimal"), "davies_bouldin_std": ("Deviation", "decimal"), "davies_bouldin_trimmed_index": ("Trimmed", "decimal"), "davies_bouldin_trimmed_std": ("Trimmed deviation", "decimal"), "davies_bouldin_full_index": ("Full", "decimal"), "davies_bouldin_full_trimmed_index": ("Full trimmed", "decimal"), "silhouette_score": ("Silhouette", "decimal")},
    "representation_degradation": {"mean_degradation": ("Mean", "decimal"), "median_degradation": ("Median", "decimal"), "n_articles": ("Articles", "integer")},
    "naive_bayes": {"gaussian_negative_positive": ("Gaussian N/P", "percent"), "gaussian_negative_transition": ("Gaussian N/T", "percent"), "histogram_negative_positive": ("Histogram N/P", "percent"), "histogram_negative_transition": ("Histogram N/T", "percent")},
}


# Display names of chunking runs, in the order of the table.
CHUNK_NAMES = {
    "noop": "No-op", "paragraph": "P", "sentence": "S1/0", "sentence_4_0": "S4/0", "sentence_4": "S4/1", "token_32": "T32/0", "token_128_0": "T128/0", "token_128": "T128/16",
    "token_256_0": "T256/0", "token_256_32": "T256/32", "token_256_64": "T256/64", "token_256_128": "T256/128", "token_256_192": "T256/192",
    "recursive_400_0": "R400/0", "recursive_400": "R400/64", "recursive_1000_0": "R1000/0", "recursive_1000": "R1000/100",
}


def prepare(kind: str, results: DataFrame) -> DataFrame:
    """Results as the report names them: one row for each run."""
    if kind == "intra_consistency":
        return results.withColumnRenamed("cosine_volatility", "mean_cosine_volatility")
    if kind == "naive_bayes":
        keyed = results.withColumn("k", F.concat_ws("_", "classifier", "task"))
        return keyed.groupBy("embedding_run_id").pivot("k", list(METRICS[kind])).agg(F.first("accuracy"))
    return results


def summarise(kind: str, results: DataFrame, runs: DataFrame, models: list[str], strategies: list[str]) -> DataFrame:
    """The grid of models and strategies; cells without a result are null. Runs over whole articles
    don't belong to the grid."""
    named = S.with_identity(prepare(kind, results), runs)
    metrics = [m for m in METRICS[kind] if m in named.columns]
    table = S.check_unique(named.where(F.col("chunking_strategy") != "noop").select(*S.KEYS, *metrics))
    return S.ordered(S.complete_grid(table, models, [s for s in strategies if s != "noop"]), models, strategies)


def latex(kind: str, grid: DataFrame, caption: str, label: str, swap_columns: bool = False) -> str:
    """Grouped by model, or by strategy with `swap_columns`."""
    first, second = S.KEYS[::-1] if swap_columns else S.KEYS
    titles = {"model_id": "Model", "chunking_strategy": "Chunking"}
    metrics = {m: t for m, t in METRICS[kind].items() if m in grid.columns}
    rows = grid.orderBy(first, second) if swap_columns else grid
    columns = {first: titles[first], second: titles[second]} | {m: t for m, (t, _) in metrics.items()}
    return S.latex_table(rows, columns, caption, label, {m: f for m, (_, f) in metrics.items()}, group_by=first)


def merged(tables: dict[str, DataFrame]) -> DataFrame:
    """All summaries side by side with the derived metrics: the share of degradation in the distance
    between positive and negative similarities, and the similarity that is retained."""
    out = S.merge(tables)
    d, n, p = F.col("representation_degradation_mean_degradation"), F.col("anisotropy_mean_pairwise_cosine"), F.col("intra_consistency_mean_pairwise_cosine")
    return out.withColumn("degradation_share", S.degradation_share(d, n, p)).withColumn("retained_similarity", S.retained_similarity(d, n))


# The columns of the merged table, by group.
MERGED_GROUPS = {
    "intra_consistency": {"mean_transition_cosine": "MTCS", "mean_pairwise_cosine": "MPCS", "semantic_drop_rate": "SDR"},
    "inter_separability": {"davies_bouldin_trimmed_index": "DBI"},
    "anisotropy": {"mean_pairwise_cosine": "MNCS", "pc1": "PC1", "pc5": "PC5", "pc10": "PC10"},
    "representation_degradation": {"mean_degradation": "MRD"},
}


def merged_latex(table: DataFrame, caption: str, label: str, groups: list[str] | None = None) -> str:
    """The merged table; `groups` is the order of the groups of columns, and must name each once."""
    columns = {"model_id": "Model", "chunking_strategy": "Chunking"}
    there = [g for g in MERGED_GROUPS if any(f"{g}_{m}" in table.columns for m in MERGED_GROUPS[g])]
    for group in S.column_order(there, groups):
        columns |= {f"{group}_{m}": t for m, t in MERGED_GROUPS[group].items() if f"{group}_{m}" in table.columns}
    columns |= {c: t for c, t in {"degradation_share": "Share", "retained_similarity": "Retained"}.items() if c in table.columns}
    numbers = dict.fromkeys(list(columns)[2:], "decimal")
    return S.latex_table(table.orderBy("model_id", "chunking_strategy"), columns, caption, label, numbers, group_by="model_id", width=r"\textwidth")


def chunk_table(summaries: DataFrame, caption: str, label: str, order: list[str] | None = None) -> str:
    """LaTeX of the chunking runs under their display names, in the order of the table; runs that it
    doesn't know come last, by their ids."""
    own = F.col("chunking_run_id")
    rows = C.chunk_memory(summaries).orderBy(S.rank_in(own, order or list(CHUNK_NAMES)), "chunking_run_id")
    names = F.create_map(*[F.lit(x) for pair in CHUNK_NAMES.items() for x in pair])
    rows = rows.withColumn("chunking_run_id", F.coalesce(F.try_element_at(names, own), own))
    columns = {
        "chunking_run_id": "Chunking",
        "num_chunks": "Chunks",
        "mean_chunks_per_article": "per article",
        "mean_characters": "Characters",
        "mean_words": "Words",
        "overlap_transition_percent": "Overlapping",
        "megabytes": "MB",
    }
    whole = ("num_chunks", "megabytes")
    numbers = {c: "integer" if c in whole else "decimal" for c in columns if c != "chunking_run_id"}
    return S.latex_table(rows, columns, caption, label, numbers)


def overlap_series(table: DataFrame, metric: str, size: int = 256) -> DataFrame:
    """model_id, overlap, value: how a metric changes with the overlap of windows of one size."""
    return S.overlap_series(table, size).select("model_id", "overlap", F.col(metric).alias("value"))
