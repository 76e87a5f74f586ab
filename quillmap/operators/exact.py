"""Results over the similarities of all pairs: moments, histograms and Naive Bayes.

All pairs are what this is for, so the work is quadratic; but no pair leaves its task. Blocks of vectors
are multiplied as matrices, each pair of blocks once, and a task gives sums of what it met: a row for each
distribution, or for each bin of one. Pairs of articles without a name aren't made.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.steps import cut
from . import blocks as B
from . import geometry as G
from . import pairs as P

NAMES = ("negative", "positive")
MOMENTS = pa.schema([("part", pa.int64()), ("n", pa.int64()), ("mean", pa.float64()), ("squares", pa.float64()), ("low", pa.float64()), ("high", pa.float64())])
COUNTS = pa.schema([("part", pa.int64()), ("bin", pa.int64()), ("count", pa.int64())])

#: Whether pairs of these articles (a column and a row of names) are wanted, as booleans
Wanted = Callable[[np.ndarray, np.ndarray], np.ndarray]


def blocks_of(vectors: DataFrame, block: int = B.BLOCK) -> DataFrame:
    """Unit vectors in blocks, on files: all readers see them in one order."""
    units = G.unit_vectors(vectors).where("article is not null").select("article", "position", "embedding")
    return cut(B.packed(units, ["article", "position"], "embedding", [], block).drop("position"))


def products(met: Iterator) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Articles of both sides, as a column and a row, and the cosines; inside a block, pairs that are
    met a second time and a row with itself are nan."""
    for _, one, two in met:
        a, b = one["article"], two["article"]
        cosine = B.matrix(one["flat"], len(a)) @ B.matrix(two["flat"], len(b)).T
        if one is two:
            cosine[np.tril_indices(len(a))] = np.nan
        yield a[:, None], b[None, :], cosine


def _parts(met: Iterator, wanted: Wanted | None, decimals: int | None) -> Iterator[tuple[int, np.ndarray]]:
    """(0 or 1, cosines) of pairs of different articles and of one."""
    for (a, b, cosine), whole in ((p, not np.isnan(p[2][-1, 0])) for p in products(met)):
        same = a == b
        chosen = wanted(a, b) if wanted else True
        if not whole:
            chosen = chosen & ~np.isnan(cosine)
        if decimals is not None:
            cosine = np.round(cosine, decimals)
        for part, mask in ((0, ~same & chosen), (1, same & chosen)):
            if (x := cosine[mask]).size:
                yield part, x


def moments(blocks: DataFrame, wanted: Wanted | None = None, decimals: int | None = None) -> DataFrame:
    """part (0: different articles, 1: one), n, mean, squares (sum of squared deviations), low, high."""

    def run(met: Iterator) -> Iterator[dict]:
        sums: dict[int, tuple] = {}
        for part, x in _parts(met, wanted, decimals):
            n, mean = len(x), x.mean()
            apart = x - mean
            squares, low, high = apart @ apart, x.min(), x.max()
            if part in sums:
                m, other, rest, least, most = sums[part]
                gap = mean - other
                squares += rest + gap * gap * n * m / (n + m)
                n, mean, low, high = n + m, other + gap * n / (n + m), min(low, least), max(high, most)
            sums[part] = (n, mean, squares, low, high)
        if sums:
            rows = [(part, *values) for part, values in sums.items()]
            yield {f.name: list(c) for f, c in zip(MOMENTS, zip(*rows))}

    found = B.all_pairs(blocks, run, MOMENTS, "part long, n long, mean double, squares double, low double, high double")
    return merged(cut(found), ["part"])


def merged(found: DataFrame, keys: list[str]) -> DataFrame:
    """One row a key from rows of a task each."""
    total = F.sum("n")
    means = found.groupBy(*keys).agg((F.sum(F.col("mean") * F.col("n")) / total).alias("_mean"))  # two or three rows
    gap = F.col("mean") - F.col("_mean")
    each = found.join(F.broadcast(means), keys)
    sums = total.alias("n"), F.first("_mean").alias("mean"), F.sum(F.col("squares") + gap * gap * F.col("n")).alias("squares")
    return each.groupBy(*keys).agg(*sums, F.min("low").alias("low"), F.max("high").alias("high"))


def counts(blocks: DataFrame, place: Callable[[np.ndarray], np.ndarray], bins: int, wanted: Wanted | None = None, decimals: int | None = None) -> DataFrame:
    """part, bin, count; place gives the bins of an array of cosines."""

    def run(met: Iterator) -> Iterator[dict]:
        sums = np.zeros((2, bins), np.int64)
        for part, x in _parts(met, wanted, decimals):
            sums[part] += np.bincount(place(x), minlength=bins)
        part, at = np.nonzero(sums)
        yield {"part": part, "bin": at, "count": sums[part, at]}

    found = B.all_pairs(blocks, run, COUNTS, "part long, bin long, count long")
    return found.groupBy("part", "bin").agg(F.sum("count").alias("count"))


def _named(df: DataFrame) -> DataFrame:
    return df.withColumn("distribution", F.when(F.col("part") == 1, NAMES[1]).otherwise(NAMES[0])).drop("part")


def _transitions(vectors: DataFrame) -> DataFrame:
    return G.transitions(vectors).select(F.lit("transition").alias("distribution"), "cosine")


def summary(vectors: DataFrame, block: int = B.BLOCK) -> DataFrame:
    """distribution, n, mean, std of the rows of `exact_similarities`."""
    std = F.sqrt(F.col("squares") / F.col("n")).alias("std")
    pairs = _named(moments(blocks_of(vectors, block))).select("distribution", "n", "mean", std)
    steps = _transitions(vectors).groupBy("distribution").agg(F.count("*").alias("n"), F.avg("cosine").alias("mean"), F.stddev_pop("cosine").alias("std"))
    return pairs.unionByName(steps)


def histogram(vectors: DataFrame, bins: int, padding: float = 0.5, block: int = B.BLOCK) -> DataFrame:
    """`histogram` of the rows of `exact_similarities` by distribution."""
    blocks = blocks_of(vectors, block)
    steps = cut(_transitions(vectors))
    ends = moments(blocks).select("low", "high").unionByName(steps.agg(F.min("cosine").alias("low"), F.max("cosine").alias("high")))
    axis = P.axis(*ends.agg(F.min("low"), F.max("high")).first(), bins, padding=padding)
    if axis is None:
        return P.histogram(steps, ["distribution"], "cosine", bins)
    low, width = axis.low, axis.width

    def place(x: np.ndarray) -> np.ndarray:
        return np.clip(np.floor((x - low) / width), 0, bins - 1).astype(np.int64)

    pairs = _named(counts(blocks, place, bins)).select("distribution", F.col("bin").cast("int").alias("bin"), "count")
    own = steps.groupBy("distribution", axis.place(F.col("cosine")).alias("bin")).agg(F.count("*").alias("count"))
    return P.filled(cut(pairs.unionByName(own)), ["distribution"], axis)


def _not(wanted: Wanted) -> Wanted:
    return lambda a, b: ~wanted(a, b)


def gaussian_naive_bayes(vectors: DataFrame, train: Wanted, decimals: int = 9, block: int = B.BLOCK) -> DataFrame:
    """accuracy and confusion counts for all pairs that don't train; class 1 is a pair of one article."""
    blocks = blocks_of(vectors, block)
    fitted = moments(blocks, train, decimals).groupBy().pivot("part", [0, 1]).agg(F.first("mean").alias("mean"), F.first(F.col("squares") / F.col("n")).alias("var"))
    one = P.smoothed(fitted.select(*[F.col(f"{k}_{c}").alias(f"{c}{k}") for k in (0, 1) for c in ("mean", "var")])).first()
    if one is None or None in tuple(one):
        mean, var = (np.nan, np.nan), (np.nan, np.nan)
    else:
        mean, var = (one["mean0"], one["mean1"]), (one["var0"], one["var1"])

    def predicted(x: np.ndarray) -> np.ndarray:
        log = [-0.5 * (np.log(2 * np.pi * v) + (x - m) ** 2 / v) for m, v in zip(mean, var)]
        return (log[1] > log[0]).astype(np.int64)

    return _confusion(counts(blocks, predicted, 2, _not(train), decimals).withColumnRenamed("bin", "predicted"))


def histogram_naive_bayes(vectors: DataFrame, train: Wanted, decimals: int = 9, bins: int = P.NB_BINS, smoothing: float = P.SMOOTHING, block: int = B.BLOCK) -> DataFrame:
    """As `gaussian_naive_bayes`, from counts by bin: pairs are made once for both parts."""
    blocks = blocks_of(vectors, block)
    width = 2.0 / bins

    def place(x: np.ndarray) -> np.ndarray:
        return np.clip(np.ceil((np.clip(x, -1.0, 1.0) + 1) / width) - 1, 0, bins - 1).astype(np.int64)

    fitted = counts(blocks, place, bins, train, decimals).groupBy("bin").pivot("part", [0, 1]).agg(F.first("count"))
    known = fitted.select("bin", *[F.col(str(k)).alias(f"n{k}") for k in (0, 1)])
    model = P.log_shares(blocks.sparkSession, known, bins, smoothing)
    tested = counts(blocks, place, bins, _not(train), decimals).join(F.broadcast(model), "bin")  # a row a bin
    return _confusion(tested.withColumn("predicted", F.when(F.col("log1") > F.col("log0"), 1).otherwise(0)))


def _confusion(rows: DataFrame) -> DataFrame:
    """rows: part, predicted, count."""
    hit = lambda y, p: F.coalesce(F.sum(F.when((F.col("part") == y) & (F.col("predicted") == p), F.col("count"))), F.lit(0))
    right = F.sum(F.when(F.col("part") == F.col("predicted"), F.col("count")).otherwise(0))
    return rows.agg((right / F.sum("count")).alias("accuracy"), hit(0, 0).alias("tn"), hit(0, 1).alias("fp"), hit(1, 0).alias("fn"), hit(1, 1).alias("tp"))
