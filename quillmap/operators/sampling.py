"""Samples without repetition from spaces too large to list: a keyed permutation of the ranks.

Of `total` things, numbered from 0, a sample of k is the image of 0 .. k - 1 under a permutation of
range(total): a Feistel network over the smallest even number of bits that holds them, walked again
until the value is inside. Executors permute their own part of 0 .. k - 1, so no list or set of ranks
is on the driver, nothing is drawn twice, and a larger sample has the smaller one inside.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..sources.steps import cut, ship

ROUNDS = 6
MOST_RANKS = 1 << 62
_U = np.uint64


def _mixed(x: np.ndarray) -> np.ndarray:
    """Each input bit reaches all output bits."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def permuted(index: np.ndarray, total: int, seed: int) -> np.ndarray:
    """The places of these indexes under the seed's permutation of range(total)."""
    if not 0 < total <= MOST_RANKS:
        raise ValueError(f"{total} ranks")
    half = _U(max(1, ((total - 1).bit_length() + 1) // 2))
    mask = (_U(1) << half) - _U(1)
    keys = _mixed(np.arange(1, ROUNDS + 1, dtype=_U) + _mixed(np.array([seed % (1 << 64)], _U)))
    out = np.array(index, _U)
    walk = np.arange(len(out))
    while len(walk):
        x = out[walk]
        left, right = x >> half, x & mask
        for key in keys:
            left, right = right, left ^ (_mixed(right + key) & mask)
        out[walk] = left << half | right
        walk = walk[out[walk] >= _U(total)]
    return out.astype(np.int64)


def sampled_ranks(spark: SparkSession, total: int, k: int, seed: int) -> DataFrame:
    """`rank`: k distinct ones of range(total), made by the executors; all if there aren't more."""
    if k >= total:
        return spark.range(max(total, 0)).select(F.col("id").alias("rank"))
    ship(spark)

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(permuted(batch.column(0).to_numpy(), total, seed))], names=["rank"])

    return spark.range(max(k, 0)).mapInArrow(run, "rank long")


def triangle_pair(n: Column, rank: Column) -> tuple[Column, Column]:
    """The rank-th unordered pair (i < j) of range(n), row by row. Counted from the end, row sizes are
    1, 2, 3, ..., so a square root finds the row but for its rounding, which whole numbers mend."""
    back = _half(n * (n - 1)) - 1 - rank
    near = F.floor((F.sqrt(8 * back.cast("double") + 1) - 1) / 2).cast("long")
    size = lambda r: _half(r * (r + 1))
    row = F.when(size(near) > back, near - 1).when(size(near + 1) <= back, near + 1).otherwise(near)
    return n - 2 - row, n - 1 - (back - size(row))


def _half(even: Column) -> Column:
    return F.shiftright(even, 1)


def weighted_picks(spans: DataFrame, weight: str, k: int, seed: int) -> DataFrame:
    """Of the things that spans have, `weight` each, k at random without repetition, or all: the rows
    of spans with `rank`, counted from 0 in each. Spans are numbered on over ranges of their order
    (`first`, `weight`: rows with a running total); ranks and spans meet in slots of equal numbers of
    ranks, so that large spans are in several slots and many small ones share one."""
    spark = spans.sparkSession
    total, n = spans.agg(F.sum(weight), F.count("*")).first()
    if not total or k < 1:
        return spans.withColumn("rank", F.lit(0).cast("long")).where("false")
    width = max(1, -(-total // max(1_024, n // 64)))
    slot = lambda c: ((c - F.pmod(c, F.lit(width))) / F.lit(width)).cast("long")  # noqa: E731  exact up to 2^53 slots
    ends = F.col("first") + F.col(weight) - 1
    dealt = spans.withColumn("_slot", F.explode(F.sequence(slot(F.col("first")), slot(ends))))
    ranks = sampled_ranks(spark, total, k, seed).select(F.col("rank").alias("_rank"), slot(F.col("rank")).alias("_slot"))
    joined = dealt.join(ranks, "_slot").where((F.col("_rank") >= F.col("first")) & (F.col("_rank") <= ends))
    return joined.withColumn("rank", F.col("_rank") - F.col("first")).drop("_rank", "_slot")


def running(spans: DataFrame, order: str, weight: str) -> DataFrame:
    """Add `first`: the sum of the weights before, in the order, over ranges of it. The window without
    a key has one row for each partition."""
    ranged = cut(spans.repartitionByRange(order).withColumn("_part", F.spark_partition_id()))
    ahead = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    starts = ranged.groupBy("_part").agg(F.sum(weight).alias("_own")).select("_part", F.coalesce(F.sum("_own").over(ahead), F.lit(0)).alias("_start"))
    upto = W.partitionBy("_part").orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    placed = ranged.withColumn("first", F.coalesce(F.sum(weight).over(upto), F.lit(0))).join(F.broadcast(starts), "_part")
    return cut(placed.withColumn("first", F.col("first") + F.col("_start")).drop("_part", "_start"))
