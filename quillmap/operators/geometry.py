"""Geometry of embeddings: pair means, transitions, principal components, separability, degradation.

Input is a table of vectors (`embedding`), grouped by article (`article`) and ordered in it
(`position`). Means over pairs come from sums of unit vectors, n·d instead of n² operations, with
aggregates that Spark combines before it shuffles.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import vectors as V
from ..sources.steps import cut, ship
from . import blocks as B
from .components import principal
from .ranks import ranked
from .selection import median, percentiles


def unit_vectors(vectors: DataFrame) -> DataFrame:
    return vectors.withColumn("embedding", V.unit(V.doubles(F.col("embedding"))))


def dimension_of(vectors: DataFrame) -> int:
    row = vectors.select(F.size("embedding").alias("d")).first()
    return row["d"] if row else 0


# ---- norms and components -------------------------------------------------------------------


def norm_sums(vectors: DataFrame, tolerance: float = 1e-5) -> DataFrame:
    """One row of counts, sums and extremes of lengths; lengths that aren't finite are only counted.
    Such rows of several parts can be merged."""
    n = vectors.select(V.norm(V.doubles(F.col("embedding"))).alias("n"))
    n = n.select(F.when(V.finite(F.col("n")), F.col("n")).alias("f"), V.is_unit(F.col("n"), tolerance).alias("u"))
    return n.agg(
        F.count("*").alias("count"),
        F.count("f").alias("finite"),
        F.count_if("u").alias("normalised"),
        F.coalesce(F.sum("f"), F.lit(0.0)).alias("norm_sum"),
        F.coalesce(F.sum(F.col("f") * F.col("f")), F.lit(0.0)).alias("norm_squared_sum"),
        F.min("f").alias("min"),
        F.max("f").alias("max"),
    )


def merged_norm_sums(parts: DataFrame) -> DataFrame:
    """The row of `norm_sums` for all parts together."""
    added = [F.sum(c).alias(c) for c in ("count", "finite", "normalised", "norm_sum", "norm_squared_sum")]
    return parts.agg(*added, F.min("min").alias("min"), F.max("max").alias("max"))


def norm_stats(vectors: DataFrame, tolerance: float = 1e-5) -> DataFrame:
    """Counts, moments and extremes of lengths."""
    return finished_norms(norm_sums(vectors, tolerance))


def finished_norms(sums: DataFrame) -> DataFrame:
    """Mean, mean square and population deviation from sums; null without finite lengths."""
    out = sums.withColumn("mean", F.try_divide("norm_sum", "finite")).withColumn("mean_square", F.try_divide("norm_squared_sum", "finite"))
    spread = F.sqrt(F.greatest(F.lit(0.0), F.col("mean_square") - F.col("mean") * F.col("mean")))
    return out.drop("norm_sum", "norm_squared_sum").withColumn("std", F.when(F.col("finite") > 0, spread))


def component_diagnostics(vectors: DataFrame) -> DataFrame:
    v = V.doubles(F.col("embedding"))
    per = vectors.select(V.negative_components(v).alias("n"), F.array_min(v).alias("low"), (V.norm(v) == 0).alias("zero"))
    return per.agg(
        F.sum("n").cast("long").alias("negative_components"),
        F.count_if(F.col("n") > 0).alias("affected_rows"),
        F.min("low").alias("min_component"),
        F.count_if("zero").alias("zero_norm_rows"),
    )


# ---- means over pairs -----------------------------------------------------------------------


def group_sums(units: DataFrame, keys: list[str], dimension: int) -> DataFrame:
    """n, s (sum of the vectors), q (sum of their squared lengths) for each group."""
    return units.groupBy(*keys).agg(F.count("*").alias("n"), V.vector_sum(F.col("embedding"), dimension).alias("s"), F.sum(V.square_norm(F.col("embedding"))).alias("q"))


def pair_means(vectors: DataFrame, dimension: int | None = None) -> DataFrame:
    """Exact mean cosine over all pairs, pairs within an article, and pairs across articles."""
    d = dimension or dimension_of(vectors)
    groups = group_sums(unit_vectors(vectors), ["article"], d)
    own = groups.withColumn("w", V.square_norm(F.col("s")) - F.col("q"))
    pairs_in = F.sum(F.col("n") * (F.col("n") - 1)).alias("pairs_in")
    sums = [F.sum(c).alias(c) for c in ("n", "q", "w")]
    one = own.agg(*sums, V.vector_sum(F.col("s"), d).alias("s"), pairs_in, F.count("*").alias("n_articles"))
    one = one.withColumn("t", V.square_norm(F.col("s")) - F.col("q")).withColumn("pairs", F.col("n") * (F.col("n") - 1))
    return one.select(
        F.col("n").alias("n_vectors"), "n_articles",
        F.try_divide("t", "pairs").alias("mean_all"),
        F.try_divide("w", "pairs_in").alias("mean_same"),
        F.try_divide(F.col("t") - F.col("w"), F.col("pairs") - F.col("pairs_in")).alias("mean_cross"),
    )


def transitions(vectors: DataFrame) -> DataFrame:
    """article, position, cosine of each vector and the next one of its article."""
    own = W.partitionBy("article").orderBy("position")
    v = vectors.select("article", "position", V.doubles(F.col("embedding")).alias("v"))
    return v.withColumn("w", F.lead("v").over(own)).where("w is not null").select("article", "position", V.cosine(F.col("v"), F.col("w")).alias("cosine"))


def intra_consistency(vectors: DataFrame, drop_threshold: float | None = None, dimension: int | None = None) -> DataFrame:
    """One row: mean, deviation and drop rate of transitions, mean over pairs within articles.
    Without a threshold, transitions below the mean over all pairs count as drops."""
    if drop_threshold is not None and not -1 <= drop_threshold <= 1:
        raise ValueError("drop threshold must be in [-1, 1]")
    means = cut(pair_means(vectors, dimension))
    limit = means.select(F.col("mean_all") if drop_threshold is None else F.lit(float(drop_threshold)))
    t = transitions(vectors).withColumn("limit", limit.scalar())
    steps = t.agg(
        F.count("*").alias("num_transitions"),
        F.avg("cosine").alias("mean_transition_cosine"),
        F.stddev_pop("cosine").alias("cosine_volatility"),
        F.first("limit").alias("drop_threshold"),
        F.avg((F.col("cosine") < F.col("limit")).cast("double")).alias("semantic_drop_rate"),
    )
    sizes = vectors.groupBy("article").agg(F.count("*").alias("n"))
    pairs = sizes.agg(F.count_if(F.col("n") > 1).alias("num_articles"), F.sum(F.expr("n * (n - 1) div 2")).alias("num_pairwise"))
    return steps.crossJoin(F.broadcast(pairs)).crossJoin(F.broadcast(means.select(F.col("mean_same").alias("mean_pairwise_cosine"))))  # three rows of one


# ---- principal components -------------------------------------------------------------------


def pca_ratios(vectors: DataFrame, most: int = 10, dimension: int | None = None) -> DataFrame:
    """Shares of variance of the first 1, 5 and 10 components of the unit vectors; null for fewer
    than two rows, or without variance. No d x d matrix is made where d is large (see `components`)."""
    spark, ddl = vectors.sparkSession, "pc1 double, pc5 double, pc10 double"
    units = cut(unit_vectors(vectors.where("embedding is not null")).select("embedding"))
    d = dimension or dimension_of(units)
    found = principal(units, most, d) if d else None
    if found is None or not found.total:
        return spark.createDataFrame([(None, None, None)], ddl)
    shares = found.shares()
    return spark.createDataFrame([tuple(float(shares[min(k, len(shares)) - 1]) for k in (1, 5, 10))], ddl)


def project_2d(vectors: DataFrame, id_col: str) -> DataFrame:
    """x and y on the first two principal components; of vectors of one component, y is 0. Fewer than
    two vectors are at 0."""
    v = vectors.select(id_col, V.doubles(F.col("embedding")).alias("embedding")).where("embedding is not null")
    d = dimension_of(v)
    found = principal(v, 2, d) if d else None
    axes = found.vectors.T.tolist() if found else []
    place = [V.dot(F.col("embedding"), F.array(*map(F.lit, axes[k]))) if k < len(axes) else F.lit(0.0) for k in (0, 1)]
    return v.select(id_col, place[0].alias("x"), place[1].alias("y"))


# ---- separability ---------------------------------------------------------------------------


def eligible(vectors: DataFrame, min_chunks: int = 5, keys: tuple[str, ...] = ("article",)) -> DataFrame:
    return vectors.groupBy(*keys).agg(F.count("*").alias("n_chunks")).where(F.col("n_chunks") >= min_chunks)


def shared_eligible(counts: DataFrame, runs: list[str], min_chunks: int) -> DataFrame:
    """article_id of articles with enough chunks in every run, from embedding_run_id, article_id, n_chunks."""
    wanted = list(dict.fromkeys(runs))
    good = counts.where(F.col("embedding_run_id").isin(wanted) & (F.col("n_chunks") >= min_chunks))
    return good.groupBy("article_id").agg(F.count_distinct("embedding_run_id").alias("n")).where(F.col("n") == len(wanted)).select("article_id").orderBy("article_id")


def centroids(units: DataFrame, dimension: int, keys: list[str]) -> DataFrame:
    g = group_sums(units, keys, dimension)
    pair = F.struct(F.col("s"), F.col("n").cast("double").alias("n"))
    return g.select(*keys, "n", F.transform(F.array(pair), lambda p: F.transform(p["s"], lambda x: x / p["n"]))[0].alias("centroid"))


PIVOTS, PIVOT_BYTES = 4_096, 32 << 20  #: what every task holds to deal centroids into blocks
NEAR_BLOCKS = 3  #: blocks that a block meets before others are ruled out


def _near_pivots(full: DataFrame, dimension: int, block: int, salt: int = 42) -> DataFrame:
    """Add `cell`, the nearest pivot. Of centroids drawn by a hash, eight for each block but no more
    than `PIVOTS`, nor `PIVOT_BYTES` of them, a quarter become pivots: each time the one that is
    farthest from those before, so that groups without a pivot are few. Another salt draws others."""
    blocks = -(-full.count() // block)
    most = max(1, min(PIVOTS, PIVOT_BYTES // (8 * dimension), 8 * blocks))
    drawn = full.select("centroid").orderBy(F.xxhash64(F.lit(salt), "article"), "article").limit(most).collect()
    drawn = np.array([r["centroid"] for r in drawn]).reshape(-1, dimension)
    chosen, apart = [0], ((drawn - drawn[:1]) ** 2).sum(1)
    while len(chosen) < min(2 * blocks, len(drawn) // 4) and apart.max() > 0:
        chosen.append(int(apart.argmax()))
        apart = np.minimum(apart, ((drawn - drawn[chosen[-1]]) ** 2).sum(1))
    pivots = drawn[chosen] if len(drawn) else np.zeros((1, dimension))
    half = (pivots**2).sum(1) / 2
    columns = full.columns

    def run(batches):
        for batch in batches:
            x = batch.column(columns.index("centroid")).flatten().to_numpy(zero_copy_only=False).reshape(-1, dimension)
            cell = [int(k) for at in range(0, len(x), B.BLOCK) for k in (x[at : at + B.BLOCK] @ pivots.T - half).argmax(1)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell, pa.int32())], names=[*columns, "cell"])

    return full.mapInArrow(run, ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in full.schema), "cell int"]))


def _compared(cohort: str | None):
    """Rows for `over_rows`: all pairs of two blocks of centroids, for both sides."""

    def compare(row: dict) -> dict:
        names, spreads = (row["article_a"], row["article_b"]), (row["spread_a"], row["spread_b"])
        x, y = B.matrix(row["flat_a"], len(names[0])), B.matrix(row["flat_b"], len(names[1]))
        distance = np.stack([np.sqrt(((y - v) ** 2).sum(1)) for v in x])
        own = row["i"] == row["j"]
        same = np.eye(len(x), dtype=bool) if own else np.zeros(distance.shape, bool)
        with np.errstate(divide="ignore", invalid="ignore"):
            ratio = np.where((distance == 0) | same, -np.inf, (spreads[0][:, None] + spreads[1][None, :]) / distance)
        near, twins = np.where(same, np.inf, distance), (distance == 0) & ~same
        sides = (1,) if own else (1, 0)
        out = {
            "article": np.concatenate([names[1 - k] for k in sides]),
            "k": np.concatenate([np.full(len(names[1 - k]), row["ij"[1 - k]]) for k in sides]),
            "ratio": np.concatenate([ratio.max(k) for k in sides]),
            "nearest": np.concatenate([near.min(k) for k in sides]),
            "twins": np.concatenate([twins.sum(k) for k in sides]),
            "compared": np.concatenate([np.full(distance.shape[1 - k], distance.shape[k] - own) for k in sides]),
        }
        return out | ({cohort: [row[cohort]] * len(out["article"])} if cohort else {})

    return compare


def _block_pairs_left(blocks: DataFrame, keys: list[str], block: int, wanted) -> DataFrame:
    """(i, j, distance), i < j: pairs of blocks of one cohort that wanted(distance of centres, row) asks
    for; the centres are compared block by block themselves."""
    columns = ["k", "radius", "spread", "worst", "far"]
    packs = B.packed(blocks, columns, "centre", keys, block)

    def run(row: dict) -> dict:
        x, y = B.matrix(row["flat_a"], len(row["k_a"])), B.matrix(row["flat_b"], len(row["k_b"]))
        distance = np.stack([np.sqrt(((y - v) ** 2).sum(1)) for v in x])
        a, b = np.nonzero(wanted(distance, row) & ((row["i"] != row["j"]) | (row["k_a"][:, None] < row["k_b"][None, :])))
        apart = distance[a, b]
        a, b = row["k_a"][a], row["k_b"][b]
        return {"i": np.minimum(a, b), "j": np.maximum(a, b), "distance": apart}

    schema = pa.schema([("i", pa.int64()), ("j", pa.int64()), ("distance", pa.float64())])
    return B.over_rows(B.block_pairs(packs, columns, keys), run, schema, "i long, j long, distance double")


def cluster_ratios(vectors: DataFrame, dimension: int | None = None, block: int = 512, cohort: str | None = None) -> DataFrame:
    """For each article: spread (mean distance to its centroid), worst ratio to another article,
    distance to the nearest other centroid, number of articles with the same centroid, and number of
    centroids that it was compared with.

    Centroids are dealt into blocks by the nearest of some pivots, and a block has a centre, a radius
    and a largest spread. Each block first meets itself and its nearest blocks; that gives every
    article a ratio and a distance. Two blocks are held against each other only if

        (largest spreads) / (distance of the centres less both radii)

    can reach the smallest of the ratios in one of them, or the distance that is left its largest
    nearest distance. Where articles lie in groups, few pairs are left; where they don't, all are,
    which is the work of the plain index. With `cohort`, a column, articles are compared within
    their cohort only."""
    keys = [cohort] if cohort else []
    d = dimension or dimension_of(vectors)
    units = unit_vectors(vectors)
    c = cut(centroids(units, d, [*keys, "article"]))
    apart = F.avg(V.distance(F.col("embedding"), F.col("centroid"))).alias("spread")
    spread = units.join(c, [*keys, "article"]).groupBy(*keys, "article").agg(apart)
    full = cut(c.drop("n").join(spread, [*keys, "article"]))
    kind = full.schema["article"].dataType.simpleString()
    columns = [("article", B.arrow_type(kind)), ("k", pa.int64()), ("ratio", pa.float64()), ("nearest", pa.float64()), ("twins", pa.int64()), ("compared", pa.int64())]
    ddl = f"article {kind}, k long, ratio double, nearest double, twins long, compared long"
    if cohort:
        own = full.schema[cohort].dataType.simpleString()
        columns, ddl = [(cohort, B.arrow_type(own)), *columns], f"{cohort} {own}, {ddl}"
    ship(vectors.sparkSession)
    cells = B.packed(_near_pivots(full, d, block), ["article", "spread"], "centroid", [*keys, "cell"], block)
    blocks = cut(cells.select(*keys, F.monotonically_increasing_id().alias("k"), "article", "spread", "flat"))

    def shape(row: dict) -> dict:
        x = B.matrix(row["flat"], len(row["article"]))
        centre = x.mean(0)
        radius = np.sqrt(((x - centre) ** 2).sum(1)).max()
        return {"k": [row["k"]], "centre": [centre], "radius": [radius], "spread": [row["spread"].max()]} | ({cohort: [row[cohort]]} if cohort else {})

    shaped = pa.schema([("k", pa.int64()), ("centre", pa.list_(pa.float64())), ("radius", pa.float64()), ("spread", pa.float64()), *([columns[0]] if cohort else [])])
    shapes = B.over_rows(blocks, shape, shaped, "k long, centre array<double>, radius double, spread double" + (f", {cohort} {own}" if cohort else ""))
    shapes = cut(shapes)

    def held(pairs: DataFrame) -> DataFrame:
        """The blocks of these pairs against each other."""
        left, right = (blocks.select(F.col("k").alias(k), *[F.col(c).alias(f"{c}_{s}") for c in ("article", "spread", "flat")]) for k, s in ("ia", "jb"))
        left = left.join(blocks.select(F.col("k").alias("i"), *keys), "i") if keys else left
        rows = pairs.join(left, "i").join(right, "j")
        return cut(B.over_rows(rows, _compared(cohort), pa.schema(columns), ddl))

    # of all distances of centres, each two packs of blocks give the smallest; of these, the smallest count
    def nearest_blocks(distance: np.ndarray, row: dict) -> np.ndarray:
        out = np.zeros(distance.shape, bool)
        if row["i"] == row["j"]:
            distance = distance + np.diag(np.full(len(distance), np.inf))
        for axis in (0, 1):
            place = np.argsort(np.argsort(distance, axis=axis, kind="stable"), axis=axis, kind="stable")
            out |= place < NEAR_BLOCKS
        return out & np.isfinite(distance)

    unknown = shapes.withColumns({"worst": F.lit(0.0), "far": F.lit(0.0)})
    near = cut(_block_pairs_left(unknown, keys, block, nearest_blocks))
    both = near.unionByName(near.select(F.col("j").alias("i"), F.col("i").alias("j"), "distance"))
    place = F.row_number().over(W.partitionBy("i").orderBy("distance", "j"))  # limited to a few before the shuffle
    both = both.withColumn("place", place).where(F.col("place") <= NEAR_BLOCKS)
    near = both.select(F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j"))
    first = blocks.select(F.col("k").alias("i"), F.col("k").alias("j")).unionByName(near)
    first = cut(first.distinct())
    found = held(first)
    per = found.groupBy(*keys, "article", "k").agg(F.max("ratio").alias("ratio"), F.min("nearest").alias("nearest"))
    reached = per.groupBy("k").agg(F.min("ratio").alias("worst"), F.max("nearest").alias("far"))

    def reachable(distance: np.ndarray, row: dict) -> np.ndarray:
        left = np.maximum(distance * (1 - 1e-9) - row["radius_a"][:, None] - row["radius_b"][None, :], 0)
        with np.errstate(divide="ignore", invalid="ignore"):
            bound = (row["spread_a"][:, None] + row["spread_b"][None, :]) * (1 + 1e-9) / left
        bound = np.where(left > 0, bound, np.inf)
        return (bound >= np.minimum(row["worst_a"][:, None], row["worst_b"][None, :])) | (left <= np.maximum(row["far_a"][:, None], row["far_b"][None, :]))

    rest = _block_pairs_left(shapes.join(reached, "k"), keys, block, reachable).drop("distance").join(first, ["i", "j"], "left_anti")
    every = found.unionByName(held(rest))
    worst = F.max("ratio").alias("ratio"), F.min("nearest").alias("nearest"), F.sum("twins").alias("twins"), F.sum("compared").alias("compared")
    out = every.groupBy(*keys, "article").agg(*worst).join(full.select(*keys, "article", "spread"), [*keys, "article"])
    return out.withColumn("ratio", F.when(F.col("ratio") == float("-inf"), 0.0).otherwise(F.col("ratio")))


def ratio_diagnostics(ratios: DataFrame, trim: float = 0.01, keys: tuple[str, ...] = ()) -> DataFrame:
    """The index and what makes it up: trimmed mean, percentiles, share of the largest, nearest
    centroids, exact twins. For the trimmed mean and the share of the largest, articles are numbered
    by their ratio over ranges, so no task sorts them all."""
    if not 0 <= trim < 1:
        raise ValueError("trim must be in [0, 1)")
    by, ratios = list(keys), cut(ratios)
    points = percentiles(ratios, by, "ratio", {"median_ratio": 0.5, "p95_ratio": 0.95, "p99_ratio": 0.99})
    near = percentiles(ratios, by, "nearest", {"p01_centroid_distance": 0.01})
    base = ratios.groupBy(*by).agg(
        F.count("*").alias("n_clusters"),
        F.avg("ratio").alias("index"),
        F.max("ratio").alias("max_ratio"),
        F.sum("ratio").alias("total"),
        F.min("nearest").alias("min_centroid_distance"),
        (F.sum("twins") / 2).cast("long").alias("exact_twin_pairs"),
    )
    placed = ranked(ratios.select(*by, "article", "ratio"), by, ["ratio", "article"])
    sizes = base.select(*by, "n_clusters")
    joined = placed.join(sizes, by) if by else placed.crossJoin(F.broadcast(sizes))  # one row
    keep = F.greatest(F.lit(1), F.floor(F.col("n_clusters") * (1 - trim))).cast("long")
    top = F.ceil(F.col("n_clusters") * 0.01).cast("long")
    low, high = F.col("rank") < keep, F.col("rank") >= F.col("n_clusters") - top
    sums = joined.groupBy(*by).agg(F.sum(F.when(low, F.col("ratio"))).alias("low_sum"), F.sum(F.when(high, F.col("ratio"))).alias("high_sum"))
    full = base.join(sums, by) if by else base.crossJoin(F.broadcast(sums))  # one row
    for some in (points, near):  # a row a key
        full = full.join(F.broadcast(some), by or F.lit(True), "left")
    return full.select(
        *by, "n_clusters", "index", (F.col("low_sum") / keep).alias("trimmed_index"),
        "median_ratio", "p95_ratio", "p99_ratio", "max_ratio",
        F.coalesce(F.try_divide("high_sum", "total"), F.lit(0.0)).alias("top_1_percent_share"), "min_centroid_distance", "p01_centroid_distance", "exact_twin_pairs",
    )


def davies_bouldin(vectors: DataFrame, trim: float = 0.01, block: int = 512, dimension: int | None = None) -> DataFrame:
    """One row of diagnostics; fewer than two rows give none."""
    counts = vectors.agg(F.count("*").alias("n"), F.count_distinct("article").alias("k")).first()
    if counts["n"] < 2:
        return ratio_diagnostics(cluster_ratios(vectors, 1), trim).where("false")
    if not 2 <= counts["k"] < counts["n"]:
        raise ValueError("the index needs at least two clusters and fewer clusters than samples")
    return ratio_diagnostics(cluster_ratios(vectors, dimension, block), trim)


def cohorts(pool: DataFrame, size: int, seeds: list[int]) -> DataFrame:
    """seed, article: for each seed, `size` of the pool's articles, those first in a seeded order. The
    pool isn't gathered; the result has one row for each article and seed that is chosen."""
    n = pool.count()
    if not 0 < size <= n:
        raise ValueError(f"cohort of {size} from {n} articles")
    keyed = pool.select("article").crossJoin(F.broadcast(pool.sparkSession.createDataFrame([(s,) for s in seeds], "seed int")))  # a few seeds
    order = F.md5(F.concat_ws("|", F.col("seed").cast("string"), F.col("article").cast("string")))
    return ranked(keyed.withColumn("order", order), ["seed"], ["order"]).where(F.col("rank") < size).select("seed", "article")


def cohort_scores(vectors: DataFrame, pool: DataFrame, size: int, seeds: list[int], trim: float = 0.01, dimension: int | None = None) -> DataFrame:
    """A row of diagnostics for each seeded cohort, in one job over (seed, article)."""
    chosen = cut(cohorts(pool, size, seeds))
    return ratio_diagnostics(cluster_ratios(vectors.join(chosen, "article"), dimension, cohort="seed"), trim, ("seed",))


def cohort_davies_bouldin(vectors: DataFrame, pool: DataFrame, size: int, seeds: list[int], trim: float = 0.01, dimension: int | None = None) -> DataFrame:
    """Mean and population deviation of the index and the trimmed index over seeded cohorts, with
    each cohort's values in the order of the seeds."""
    per = cohort_scores(vectors, pool, size, seeds, trim, dimension)
    place = F.array_position(F.array(*map(F.lit, seeds)), F.col("seed"))
    values = lambda c: F.transform(F.array_sort(F.collect_list(F.struct(place.alias("k"), c))), lambda x: x[c])
    return per.agg(
        F.count("*").alias("n_cohorts"),
        F.avg("index").alias("mean_index"),
        F.stddev_pop("index").alias("std_index"),
        F.avg("trimmed_index").alias("mean_trimmed"),
        F.stddev_pop("trimmed_index").alias("std_trimmed"),
        F.to_json(values("index")).alias("cohort_scores"),
        F.to_json(values("trimmed_index")).alias("cohort_trimmed_scores"),
    )


def silhouette(vectors: DataFrame, dimension: int | None = None, block: int = 512) -> float | None:
    """Cosine silhouette of articles as clusters; none for fewer than two. Mean distances to a cluster
    come from the sum of its vectors; blocks of vectors meet blocks of sums in numpy. A vector that is
    alone in its cluster counts 0."""
    if vectors.select("article").distinct().limit(2).count() < 2:
        return None
    d = dimension or dimension_of(vectors)
    kind = vectors.schema["article"].dataType.simpleString()
    units = unit_vectors(vectors).select("article", "embedding", F.monotonically_increasing_id().alias("row"))
    points = cut(B.packed(cut(units), ["article", "row"], "embedding", [], block))
    sums = cut(B.packed(group_sums(units, ["article"], d), ["article", "n"], "s", [], block))

    def distances(own: dict, other: dict) -> dict:
        counts = other["n"].astype(float)
        mean = 1 - B.matrix(own["flat"], len(own["row"])) @ B.matrix(other["flat"], len(counts)).T / counts
        same = own["article"][:, None] == other["article"][None, :]
        with np.errstate(divide="ignore", invalid="ignore"):
            inside = np.where(counts > 1, mean * counts / (counts - 1), np.nan)
        away = np.where(same, np.inf, mean).min(1)
        return {"row": own["row"], "a": np.where(same.any(1), np.where(same, inside, 0).sum(1), -np.inf), "b": away}

    def run(met: Iterator) -> Iterator[dict]:
        for _, cell in groupby(met, lambda m: m[0]):
            lists: dict[int, dict] = {}
            for _, own, other in cell:
                now = distances(own, other)
                held = lists.setdefault(id(own), now)
                held["a"], held["b"] = np.maximum(held["a"], now["a"]), np.minimum(held["b"], now["b"])  # nan, of a lone vector, stays
            yield from lists.values()

    schema = pa.schema([("row", pa.int64()), ("a", pa.float64()), ("b", pa.float64())])
    found = B.meetings(points, sums, run, schema, "row long, a double, b double")
    each = found.groupBy("row").agg(F.max("a").alias("a"), F.min("b").alias("b"))  # nan, of a lone vector, is the largest
    value = F.when(F.isnan("a"), 0.0).otherwise(F.coalesce(F.try_divide(F.col("b") - F.col("a"), F.greatest("a", "b")), F.lit(0.0)))
    return each.agg(F.avg(value)).first()[0]


# ---- representation degradation -------------------------------------------------------------


def weighted_centroids(chunks: DataFrame, dimension: int, weight_col: str = "chunk_length") -> DataFrame:
    """Per article: mean of the raw vectors, weighted by length. Weights must be positive."""
    w = F.when(F.col(weight_col) > 0, F.col(weight_col).cast("double")).otherwise(F.raise_error(F.lit("chunk lengths must be positive")).cast("double"))
    weighted = chunks.withColumn("_w", w)
    sums = F.array(*[F.sum(F.get("embedding", F.lit(k)).cast("double") * F.col("_w")) for k in range(dimension)])
    g = weighted.groupBy("article").agg(F.count("*").alias("n_chunks"), F.sum("_w").alias("total_length"), sums.alias("s"))
    pair = F.struct("s", "total_length")
    return g.select("article", "n_chunks", "total_length", F.transform(F.array(pair), lambda p: F.transform(p["s"], lambda x: x / p["total_length"]))[0].alias("centroid"))


def degradation(articles: DataFrame, chunks: DataFrame, dimension: int, min_chunks: int = 5) -> DataFrame:
    """article, n_chunks, total_length, similarity and degradation against the whole article's vector."""
    c = weighted_centroids(chunks, dimension).where(F.col("n_chunks") >= min_chunks)
    whole = articles.select("article", V.doubles(F.col("embedding")).alias("_v"))
    s = V.clamped_cosine(F.col("_v"), F.col("centroid"))
    return c.join(whole, "article").select("article", "n_chunks", "total_length", s.alias("similarity"), (1 - s).alias("degradation"))


def degradation_summary(rows: DataFrame) -> DataFrame:
    rows = cut(rows)
    one = rows.agg(
        F.count("*").alias("n_articles"),
        F.avg("n_chunks").alias("mean_chunks"),
        F.avg("total_length").alias("mean_total_length"),
        F.avg("similarity").alias("mean_similarity"),
        F.avg("degradation").alias("mean_degradation"),
    )
    for name in ("similarity", "degradation"):
        one = one.join(F.broadcast(median(rows, [], name, f"median_{name}")), F.lit(True), "left")  # one row
    return one.select("n_articles", "mean_chunks", "mean_total_length", "mean_similarity", "median_similarity", "mean_degradation", "median_degradation")
