"""Samples of pairs, their similarities, histograms, and Naive Bayes over similarity distributions."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import vectors as V
from ..sources.steps import cut
from . import blocks as B
from . import geometry as G
from .ranks import numbered, ranked
from .sampling import permuted, running, sampled_ranks, triangle_pair, weighted_picks

# Fixed values of the evaluation.
PAIR_LIMIT, TEST_SHARE, SEED, NB_BINS, SMOOTHING, VARIANCE_FACTOR = 100_000, 0.2, 42, 100, 1.0, 1e-9
SPLITS = ("train", "test")
DISTRIBUTIONS = ("negative", "positive", "transition")


# ---- which pairs ----------------------------------------------------------------------------


def pair_of_rank(n: int, rank: int) -> tuple[int, int]:
    """The rank-th unordered pair (i < j) of range(n), row by row; whole numbers only."""
    total = n * (n - 1) // 2
    if not 0 <= rank < total:
        raise ValueError(f"rank {rank} is outside [0, {total})")
    back = total - 1 - rank  # counted from the end, row sizes are 1, 2, 3, ...
    row = (math.isqrt(8 * back + 1) - 1) // 2
    i = n - 2 - row
    return i, n - 1 - (back - row * (row + 1) // 2)


def sample_ranks(total: int, k: int, seed: int) -> list[int]:
    """The ranks that `sampled_ranks` makes on executors."""
    return permuted(np.arange(min(k, total)), total, seed).tolist() if k < total else list(range(total))


def indexed(vectors: DataFrame, order: list[str]) -> DataFrame:
    """Unit vectors with `idx`: 0, 1, ... in the given order."""
    names = [*order, *[c for c in ("article",) if c not in order], "embedding"]
    return cut(numbered(G.unit_vectors(vectors).select(*names), order))


def sampled_pairs(vectors: DataFrame, order: list[str], limit: int, seed: int = SEED) -> DataFrame:
    """Cosines of up to `limit` unordered pairs of rows, uniform without repetition; all of them if
    there aren't more. Executors make the ranks themselves; rows are fetched by two joins on indexes."""
    units = indexed(vectors, order)
    return _cosines(units, _any_pairs(units, limit, seed))


def _any_pairs(units: DataFrame, limit: int, seed: int) -> DataFrame:
    n = units.count()
    i, j = triangle_pair(F.lit(n).cast("long"), F.col("rank"))
    return cut(sampled_ranks(units.sparkSession, n * (n - 1) // 2, limit, seed).select(i.alias("i"), j.alias("j")))


def _cosines(units: DataFrame, pairs: DataFrame) -> DataFrame:
    a = units.select(F.col("idx").alias("i"), F.col("article").alias("article_a"), F.col("embedding").alias("va"))
    b = units.select(F.col("idx").alias("j"), F.col("article").alias("article_b"), F.col("embedding").alias("vb"))
    joined = pairs.join(a, "i").join(b, "j")
    return joined.select("i", "j", "article_a", "article_b", V.dot(F.col("va"), F.col("vb")).alias("cosine"))


def article_ranges(units: DataFrame) -> DataFrame:
    """a (first index), n of each article; indexes must be in article order."""
    return units.groupBy("article").agg(F.min("idx").alias("a"), F.count("*").alias("n")).select("a", "n")


def _picked(ranges: DataFrame, weight: str, limit: int, seed: int) -> DataFrame:
    """a, n, rank of up to `limit` of all the pairs that articles have, `weight` each, uniform without
    repetition; articles are numbered on by their pairs."""
    heavy = ranges.withColumn("w", F.expr(weight).cast("long")).where("w > 0")
    return cut(weighted_picks(running(heavy, "a", "w"), "w", limit, seed))


def same_article_pairs(units: DataFrame, limit: int, seed: int) -> DataFrame:
    """i, j: a uniform sample from the union of the pairs within articles: larger articles weigh more."""
    i, j = triangle_pair(F.col("n"), F.col("rank"))
    return _picked(article_ranges(units), "n * (n - 1) div 2", limit, seed).select((F.col("a") + i).alias("i"), (F.col("a") + j).alias("j"))


def transition_pairs(units: DataFrame, limit: int, seed: int) -> DataFrame:
    """i, j: neighbours in an article; all, or a uniform sample."""
    return _picked(article_ranges(units), "n - 1", limit, seed).select((F.col("a") + F.col("rank")).alias("i"), (F.col("a") + F.col("rank") + 1).alias("j"))


def cross_article_pairs(units: DataFrame, limit: int, seed: int) -> DataFrame:
    """i, j: a uniform sample of pairs from different articles; all of them if there aren't more. An
    article's pairs are those of its rows with all rows behind its last one, so none is drawn in vain."""
    n = units.count()
    ranges = article_ranges(units).withColumn("behind", F.lit(n) - F.col("a") - F.col("n"))
    found = _picked(ranges, "n * behind", limit, seed)
    after = F.pmod("rank", "behind")
    return found.select((F.col("a") + F.expr("rank div behind")).alias("i"), (F.col("a") + F.col("n") + after).alias("j"))


def three_distributions(vectors: DataFrame, order: list[str], limit: int = PAIR_LIMIT, seed: int = SEED) -> DataFrame:
    """distribution, cosine for plots: here a negative pair is any pair, even of one article."""
    units = indexed(vectors, order)
    some = {
        "negative": _any_pairs(units, limit, seed),
        "positive": same_article_pairs(units, limit, seed + 1),
        "transition": transition_pairs(units, limit, seed + 2),
    }
    parts = [_cosines(units, pairs).select(F.lit(name).alias("distribution"), "cosine") for name, pairs in some.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def exact_similarities(vectors: DataFrame, block: int = B.BLOCK) -> DataFrame:
    """distribution, article_a, article_b, cosine of every pair of different articles (negative),
    every pair within one (positive) and every neighbouring pair (transition). All pairs are what
    this is for: it is the exact mode for tables of some thousand vectors; samples, and the sums of
    `exact`, are for others. Blocks of vectors are multiplied as matrices, each pair of blocks once."""
    from . import exact

    kind = vectors.schema["article"].dataType.simpleString()
    schema = pa.schema([("distribution", pa.string()), ("article_a", B.arrow_type(kind)), ("article_b", B.arrow_type(kind)), ("cosine", pa.float64())])

    def run(met: Iterator) -> Iterator[dict]:
        for a, b, cosine in exact.products(met):
            i, j = np.nonzero(~np.isnan(cosine))
            first, second = a[i, 0], b[0, j]
            swap = first > second
            pair = np.where(swap, second, first), np.where(swap, first, second)
            yield {"distribution": np.where(first == second, "positive", "negative"), "article_a": pair[0], "article_b": pair[1], "cosine": cosine[i, j]}

    found = B.all_pairs(exact.blocks_of(vectors, block), run, schema, f"distribution string, article_a {kind}, article_b {kind}, cosine double")
    article = F.col("article")
    steps = G.transitions(vectors).select(F.lit("transition").alias("distribution"), article.alias("article_a"), article.alias("article_b"), "cosine")
    return found.unionByName(steps)


# ---- histograms -----------------------------------------------------------------------------


@dataclass(frozen=True)
class Axis:
    low: float
    width: float
    bins: int
    log_x: bool

    def place(self, x: Column) -> Column:
        at = F.floor(((F.log(x) if self.log_x else x) - self.low) / self.width)
        return F.greatest(F.lit(0), F.least(F.lit(self.bins - 1), at)).cast("int")

    def edge(self, k: int) -> float:
        return (math.exp if self.log_x else float)(self.low + k * self.width)


def axis(low: float | None, high: float | None, bins: int, log_x: bool = False, padding: float = 0.5, share_padding: float = 0.01) -> Axis | None:
    """Bins from low to high; none without values."""
    if low is None:
        return None
    if log_x and low <= 0:
        raise ValueError("a logarithmic axis needs positive values")
    if low == high:
        if log_x:
            low, high = low * 0.99, high * 1.01
        else:
            pad = max(abs(low) * share_padding, padding)
            low, high = low - pad, high + pad
    f = math.log if log_x else float
    return Axis(f(low), (f(high) - f(low)) / bins, bins, log_x)


def histogram(values: DataFrame, keys: list[str], value_col: str, bins: int, log_x: bool = False, padding: float = 0.5, share_padding: float = 0.01) -> DataFrame:
    """keys, bin, left, right, count, density: the same edges for all keys, every bin listed. Counts
    are made before the shuffle; the edges are the only numbers that the driver gets."""
    if bins < 1:
        raise ValueError("bins must be positive")
    x = F.col(value_col).cast("double")
    rows = values.select(*keys, x.alias("x")).where("x is not null")
    edges = axis(*rows.agg(F.min("x"), F.max("x")).first(), bins, log_x, padding, share_padding)
    if edges is None:
        kinds = {"bin": "int", "left": "double", "right": "double", "count": "long", "density": "double"}
        empty = [F.lit(None).cast(t).alias(c) for c, t in kinds.items()]
        return rows.select(*keys, *empty).where("false")
    binned = rows.withColumn("bin", edges.place(F.col("x")))
    return filled(cut(binned.groupBy(*keys, "bin").agg(F.count("*").alias("count"))), keys, edges)  # keys x bins


def filled(counts: DataFrame, keys: list[str], axis: Axis) -> DataFrame:
    """The histogram of counts (keys, bin, count), every bin listed."""
    totals = counts.groupBy(*keys).agg(F.sum("count").alias("total"))
    edges = [(k, axis.edge(k), axis.edge(k + 1)) for k in range(axis.bins)]
    grid = totals.crossJoin(F.broadcast(counts.sparkSession.createDataFrame(edges, "bin int, left double, right double")))  # keys x bins
    full = grid.join(counts, [*keys, "bin"], "left")
    count = F.coalesce("count", F.lit(0))
    return full.select(*keys, "bin", "left", "right", count.alias("count"), (count / (F.col("total") * (F.col("right") - F.col("left")))).alias("density"))


def area_normalised(histograms: DataFrame, keys: list[str]) -> DataFrame:
    """Densities whose bars have an area of 1 for each key; none with an area of 0."""
    area = F.sum(F.col("density") * (F.col("right") - F.col("left"))).over(W.partitionBy(*keys))
    checked = F.when(area > 0, area).otherwise(F.raise_error(F.lit("histogram area must be positive")).cast("double"))
    return histograms.withColumn("density", F.col("density") / checked)


# ---- Naive Bayes ----------------------------------------------------------------------------


def test_count(n: int, share: float, least: int) -> int:
    """How many of n articles test, with `least` at least on both sides; halves are rounded to even."""
    return min(max(round(n * share), least), n - least) if least else min(round(n * share), n)


def split_articles(vectors: DataFrame, test_share: float = TEST_SHARE, seed: int = SEED) -> DataFrame:
    """article, split: which articles train and which test; articles with several chunks and single
    ones apart. The first in a seeded order test; the driver gets two counts."""
    sizes = vectors.groupBy("article").agg(F.count("*").alias("n"))
    out = None
    for several, least, own in ((True, 2, seed + 10), (False, 0, seed + 20)):
        some = cut(sizes.where("n > 1" if several else "n = 1").select("article"))
        n = some.count()
        if several and n < 4:
            raise ValueError("at least four articles with several chunks are needed")
        order = F.md5(F.concat(F.lit(f"{own}|"), F.col("article").cast("string")))
        tests = F.col("k") < test_count(n, test_share, least)
        part = numbered(some.withColumn("order", order), ["order"], "k").select("article", F.when(tests, "test").otherwise("train").alias("split"))
        out = part if out is None else out.unionByName(part)
    return out


def test_limit(limit: int, share: float = TEST_SHARE) -> int:
    return min(max(1, round(limit * share)), limit - 1)


def split_similarities(vectors: DataFrame, limit: int = PAIR_LIMIT, test_share: float = TEST_SHARE, seed: int = SEED) -> DataFrame:
    """split, distribution, cosine: articles are split, then pairs are drawn inside each part."""
    parts = cut(split_articles(vectors, test_share, seed))
    limits = {"test": test_limit(limit, test_share)}
    limits["train"] = limit - limits["test"]
    out = None
    for split in SPLITS:
        own = vectors.join(parts.where(F.col("split") == split), "article").select("article", "position", "embedding")
        units = indexed(own, ["article", "position"])
        for k, (name, pick) in enumerate(zip(DISTRIBUTIONS, (cross_article_pairs, same_article_pairs, transition_pairs))):
            found = _cosines(units, pick(units, limits[split], seed + k))
            rows = found.select(F.lit(split).alias("split"), F.lit(name).alias("distribution"), "cosine")
            out = rows if out is None else out.unionByName(rows)
    return cut(out)


def balanced(rows: DataFrame, keys: list[str], class_col: str, order: Column) -> DataFrame:
    """As many rows of each class as the smaller has, those first in the order. Rows are ranged over
    partitions and numbered there, so no class is sorted by one task."""
    counts = rows.groupBy(*keys, class_col).agg(F.count("*").alias("_n"))
    least = counts.groupBy(*keys).agg(F.min("_n").alias("_least"))
    placed = ranked(rows.withColumn("_order", order), [*keys, class_col], ["_order"], "_rank")
    joined = placed.join(least, keys) if keys else placed.crossJoin(F.broadcast(least))  # one row
    return joined.where("_rank < _least").drop("_rank", "_order", "_least")


def gaussian_model(rows: DataFrame, x: str = "x", label: str = "y", factor: float = VARIANCE_FACTOR) -> DataFrame:
    """One row: mean and smoothed variance of class 0 and class 1."""
    one = rows.agg(*[f(F.when(F.col(label) == k, F.col(x))).alias(f"{n}{k}") for k in (0, 1) for n, f in (("mean", F.avg), ("var", F.var_pop))])
    return smoothed(one, factor)


def smoothed(one: DataFrame, factor: float = VARIANCE_FACTOR) -> DataFrame:
    eps = F.greatest(F.greatest("var0", "var1") * factor, F.lit(1e-12))
    return one.select("mean0", "mean1", (F.col("var0") + eps).alias("var0"), (F.col("var1") + eps).alias("var1"))


def gaussian_predict(rows: DataFrame, model: DataFrame, x: str = "x") -> DataFrame:
    """Add predicted; a tie is class 0."""
    joined = rows.crossJoin(F.broadcast(model))  # a model is one row
    log = lambda k: -0.5 * (F.log(2 * F.lit(math.pi) * F.col(f"var{k}")) + (F.col(x) - F.col(f"mean{k}")) ** 2 / F.col(f"var{k}"))
    return joined.withColumn("predicted", F.when(log(1) > log(0), 1).otherwise(0)).drop(*model.columns)


def similarity_bin(x: Column, bins: int = NB_BINS) -> Column:
    """Bins over [-1, 1], open on the left and closed on the right."""
    width = 2.0 / bins
    return F.greatest(F.lit(0), F.least(F.lit(bins - 1), F.ceil((F.greatest(F.lit(-1.0), F.least(F.lit(1.0), x)) + 1) / width) - 1)).cast("int")


def histogram_model(rows: DataFrame, x: str = "x", label: str = "y", bins: int = NB_BINS, smoothing: float = SMOOTHING) -> DataFrame:
    """bin, log0, log1: smoothed log probabilities of each bin in each class."""
    if smoothing <= 0:
        raise ValueError("smoothing must be positive")
    counts = rows.groupBy(similarity_bin(F.col(x), bins).alias("bin")).agg(*[F.count_if(F.col(label) == k).alias(f"n{k}") for k in (0, 1)])
    return log_shares(rows.sparkSession, counts, bins, smoothing)


def log_shares(spark: SparkSession, counts: DataFrame, bins: int, smoothing: float) -> DataFrame:
    """bin, log0, log1 of counts (bin, n0, n1)."""
    grid = spark.range(bins).select(F.col("id").cast("int").alias("bin")).join(counts, "bin", "left").fillna(0, ["n0", "n1"])
    sums = grid.agg(F.sum("n0").alias("t0"), F.sum("n1").alias("t1"))
    full = grid.crossJoin(F.broadcast(sums))  # one row of sums
    return full.select("bin", *[F.log((F.col(f"n{k}") + smoothing) / (F.col(f"t{k}") + smoothing * bins)).alias(f"log{k}") for k in (0, 1)])


def histogram_predict(rows: DataFrame, model: DataFrame, x: str = "x", bins: int = NB_BINS) -> DataFrame:
    joined = rows.withColumn("bin", similarity_bin(F.col(x), bins)).join(F.broadcast(model), "bin")
    return joined.withColumn("predicted", F.when(F.col("log1") > F.col("log0"), 1).otherwise(0)).drop("bin", "log0", "log1")


def confusion(predicted: DataFrame, label: str = "y", keys: tuple[str, ...] = ()) -> DataFrame:
    hit = lambda y, p: F.count_if((F.col(label) == y) & (F.col("predicted") == p))
    accuracy = F.avg((F.col(label) == F.col("predicted")).cast("double")).alias("accuracy")
    return predicted.groupBy(*keys).agg(accuracy, hit(0, 0).alias("tn"), hit(0, 1).alias("fp"), hit(1, 0).alias("fn"), hit(1, 1).alias("tp"))


def classify(train: DataFrame, test: DataFrame) -> DataFrame:
    """accuracy and confusion counts of both classifiers; x is a similarity, y its class."""
    g = confusion(gaussian_predict(test, gaussian_model(train))).select(F.lit("gaussian").alias("classifier"), "*")
    h = confusion(histogram_predict(test, histogram_model(train))).select(F.lit("histogram").alias("classifier"), "*")
    return g.unionByName(h)


def naive_bayes(vectors: DataFrame, limit: int = PAIR_LIMIT, test_share: float = TEST_SHARE, seed: int = SEED) -> DataFrame:
    """task (negative_positive, negative_transition), classifier, accuracy and counts."""
    rows = split_similarities(vectors, limit, test_share, seed)
    out = None
    for k, other in enumerate(DISTRIBUTIONS[1:]):
        xy = rows.where(F.col("distribution").isin("negative", other)).select("split", F.col("cosine").alias("x"), (F.col("distribution") == other).cast("int").alias("y"))
        even = balanced(xy, ["split"], "y", F.xxhash64(F.lit(seed + 30 + 10 * k), "x"))
        part = classify(even.where("split = 'train'"), even.where("split = 'test'")).select(F.lit(f"negative_{other}").alias("task"), "*")
        out = part if out is None else out.unionByName(part)
    return out
