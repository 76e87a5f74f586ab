"""Numbering rows in an order without one task that sorts or holds them all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..sources.steps import cut


def numbered(rows: DataFrame, order: list[str | Column], name: str = "idx") -> DataFrame:
    """Add 0, 1, 2, ... in the order: rows are ranged over partitions, counted there, and numbered from
    where their partition begins. The order should be total; rows that it doesn't tell apart share a
    partition. The window and the broadcast have one row for each partition."""
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    held = cut(ranged.withColumn("_place", F.monotonically_increasing_id()))  # partition << 33 | row
    part = F.shiftright("_place", 33)
    counts = held.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    ahead = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    starts = counts.select("_part", F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_start"))
    inside = F.col("_place").bitwiseAND(F.lit((1 << 33) - 1))
    joined = held.join(F.broadcast(starts), part == F.col("_part"))
    return joined.withColumn(name, F.col("_start") + inside).drop("_place", "_part", "_start")


def ranked(rows: DataFrame, keys: list[str], order: list[str | Column], name: str = "rank") -> DataFrame:
    """Add 0, 1, 2, ... within each key. A key's rows may lie in several partitions."""
    every = numbered(rows, [*keys, *order], name)
    first = F.min(name).alias("_first")
    if not keys:
        return every.crossJoin(F.broadcast(every.agg(first))).withColumn(name, F.col(name) - F.col("_first")).drop("_first")  # one row
    least = every.groupBy(*keys).agg(first)
    return every.join(least, keys).withColumn(name, F.col(name) - F.col("_first")).drop("_first")
