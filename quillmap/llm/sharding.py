"""Sharding by rendezvous hashing of stable record keys over weighted shards.

Every pair of record key and shard has a pseudo-random number u in (0, 1); the record goes to the
shard with the smallest -ln(u) / weight, which gives shards shares in proportion to their weights.
A new shard takes records only into itself, in proportion to its weight. Slots number the records
of a shard without gaps in the order of the key's digest; they come from counts over buckets of
that order and a sort within buckets, so no shard is sorted by one task.

Defined results: a null key is the key "null"; a null text has no bytes; rows with equal keys go to
the same shard and get slots of their own; an empty table gives an empty table; other columns of
the input don't matter.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import cut

SHARDS = 24
ROW_BYTES = 8
BUCKET_ROWS = 20_000


def _unit(key: Column, shard: int) -> Column:
    """52 bits of a digest as a number in (0, 1)."""
    return (F.conv(F.substring(F.md5(F.concat(key, F.lit(f"/{shard}"))), 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)


def rendezvous(key: Column, weights: list[float], more: list[float] | None = None) -> Column:
    """struct(shard, grown): the shard among `weights`, and among these with `more` added."""
    scores = [F.struct((-F.log(_unit(key, k)) / F.lit(float(w))).alias("score"), F.lit(k).alias("shard")) for k, w in enumerate([*weights, *(more or [])])]
    first = F.array_min(F.array(*scores[: len(weights)]))
    if not more:
        return F.struct(first["shard"].alias("shard"), F.lit(None).cast("int").alias("grown"))
    both = F.array(first, *scores[len(weights) :])
    return F.struct(first["shard"].alias("shard"), F.array_min(both)["shard"].alias("grown"))


def assign(docs: DataFrame, shards: int = SHARDS, weights: list[float] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for every row."""
    weights = weights or [1.0] * shards
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    key = F.coalesce(F.col(id_col).cast("string"), F.lit("null"))
    slim = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        (F.octet_length(text) + ROW_BYTES).cast("long").alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
        F.md5(key).alias("digest"),
        rendezvous(key, weights, [1.0]).alias("to"),
    )
    slim = cut(slim.select("doc_id", "size", "text_crc32", "digest", "to.shard", F.col("to.grown").alias("grown_shard")))
    buckets = max(1, math.ceil(slim.count() / (shards * BUCKET_ROWS)))
    place = F.floor(F.conv(F.substring("digest", 1, 8), 16, 10).cast("double") / float(1 << 32) * buckets)
    slim = slim.withColumn("bucket", place)
    ahead = W.partitionBy("shard").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    counts = slim.groupBy("shard", "bucket").agg(F.count("*").alias("n"))
    starts = counts.select("shard", "bucket", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("start"))
    within = W.partitionBy("shard", "bucket").orderBy("digest", "doc_id", "text_crc32", "size")
    slot = (F.col("start") + F.row_number().over(within) - 1).cast("long")
    return slim.join(starts, ["shard", "bucket"]).select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", slot.alias("slot"), "grown_shard")
