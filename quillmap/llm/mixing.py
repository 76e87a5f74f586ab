"""Mixing sources to target weights: capped water-filling, then seeded repetitions.

Each source's share of the budget is proportional to its weight, but clamped at `max_epochs` times
the source's size; what clamped sources leave is shared again by weight until none is above. A
source with target t and size s repeats every document floor(t / s) times; the rest is one more
copy of the documents that come first in a seeded order, up to a threshold in that order. The
threshold is found from sums over buckets of the order and a sort of one bucket, so no source is
gathered or sorted as a whole, and documents are never shuffled.

Defined results: a null text has size 0; a null source is a source of its own, last in order;
sizes of 0 take nothing; equal rows (same id and text) share the order key and are treated alike;
an empty table gives an empty table; `repeat` keeps all columns, `plan` has only its own.
The driver holds one number for each source; the table of sources is broadcast up to
`BROADCAST_ROWS` of them and joined otherwise.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import cut

SPACES = "\\x20\\x09-\\x0D"
BROADCAST_ROWS = 50_000


def word_count(text: Column) -> Column:
    """Number of runs of other characters than ASCII white space; null counts as empty."""
    dense = F.regexp_replace(F.coalesce(text, F.lit("")), f"[{SPACES}]+", " ")
    gaps = F.length(dense) - F.length(F.replace(dense, F.lit(" "), F.lit("")))
    last = F.when(dense.endswith(" ") | (dense == ""), 0).otherwise(1)
    first = F.when(dense.startswith(" "), 1).otherwise(0)
    return (gaps + last - first).cast("long")


@dataclass(frozen=True)
class Mix:
    """Parameters: weights go round over the sources in code point order."""

    weights: tuple[float, ...] = (5.0, 2.0, 1.0)
    budget: float = 1.5  #: times the size of all documents
    max_epochs: float = 2.0
    seed: int = 20_240
    bucket_rows: int = 4_096  #: documents to a bucket of the order, on average


def water_fill(sizes: list[float], weights: list[float], total: float, max_epochs: float) -> list[float]:
    """Targets by weight, none above max_epochs times its size; they sum to `total` where the caps allow."""
    caps = [max_epochs * s for s in sizes]
    targets, open_ = [0.0] * len(sizes), [k for k, c in enumerate(caps) if c > 0]
    left = total
    while open_:
        weight = math.fsum(weights[k] for k in open_)
        full = [k for k in open_ if weights[k] * left >= caps[k] * weight]
        if not full:
            for k in open_:
                targets[k] = left * weights[k] / weight
            break
        for k in full:
            targets[k] = caps[k]
        left = max(0.0, total - math.fsum(targets[k] for k in range(len(sizes)) if targets[k] >= caps[k] > 0))
        open_ = [k for k in open_ if targets[k] == 0.0]
    return targets


_RATES = "rank int, key string, absent boolean, source_size long, target double, copies long, rest double, buckets long"


def _ordered(docs: DataFrame, mix: Mix, id_col: str, text_col: str, source_col: str) -> list[Column]:
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    digest = F.md5(F.concat_ws("|", F.lit(str(mix.seed)), F.coalesce(F.col(id_col).cast("string"), F.lit("")), text))
    order = F.conv(F.substring(digest, 1, 13), 16, 10).cast("long")
    return [F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), word_count(text).alias("size"), order.alias("order")]


def _beside(rows: DataFrame, sources: DataFrame, n: int, on: Column | list[str]) -> DataFrame:
    """Rows with what their source has. A small table of sources is sent to all; a large one is
    joined, and Spark splits the partition of a source with many rows."""
    return rows.join(F.broadcast(sources) if n <= BROADCAST_ROWS else sources, on)


def _rates(slim: DataFrame, mix: Mix) -> tuple[DataFrame, int]:
    """One row for each source: target, whole copies, and the threshold for one copy more."""
    spark = slim.sparkSession
    sources = slim.groupBy("source").agg(F.sum("size").alias("size"), F.count("*").alias("n")).collect()
    sources.sort(key=lambda r: (r["source"] is None, (r["source"] or "").encode()))
    sizes = [float(r["size"]) for r in sources]
    weights = [mix.weights[k % len(mix.weights)] for k in range(len(sizes))]
    targets = water_fill(sizes, weights, mix.budget * math.fsum(sizes), mix.max_epochs)
    rows = []
    for k, (r, target) in enumerate(zip(sources, targets)):
        copies = math.floor(target / r["size"]) if r["size"] else 0
        rest = round(target - copies * r["size"], 6)
        buckets = max(1, math.ceil(r["n"] / mix.bucket_rows))
        rows.append((k, r["source"], r["source"] is None, int(r["size"]), target, copies, rest, buckets))
    rates, n = spark.createDataFrame(rows, _RATES), len(rows)
    spread = _beside(slim, rates, n, F.col("source").eqNullSafe(F.col("key")))
    bucket = F.floor(F.col("order") / (1 << 52) * F.col("buckets")).alias("bucket")
    spread = spread.select("rank", "size", "order", "rest", bucket)
    ahead = W.partitionBy("rank").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    sums = spread.groupBy("rank", "bucket").agg(F.sum("size").alias("size"), F.first("rest").alias("rest"))
    sums = sums.withColumn("before", F.coalesce(F.sum("size").over(ahead), F.lit(0)))
    edge = sums.where("before <= rest and rest < before + size").select("rank", "bucket", "before")  # one bucket a source
    ahead = W.partitionBy("rank").orderBy("order").rowsBetween(W.unboundedPreceding, -1)
    steps = _beside(spread, edge, n, ["rank", "bucket"]).groupBy("rank", "order", "before", "rest").agg(F.sum("size").alias("tied"))
    steps = steps.withColumn("reached", F.col("before") + F.coalesce(F.sum("tied").over(ahead), F.lit(0)))
    over = (F.col("rest") - F.col("reached")).alias("over")
    threshold = steps.where("reached <= rest and rest < reached + tied").select("rank", F.col("order").alias("limit"), "tied", over)
    return cut(rates.join(threshold, "rank", "left")), n


def plan(docs: DataFrame, mix: Mix = Mix(), id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """doc_id, size, source_size, target, taken: the words of each document that the mix takes,
    repeats counted. The document at the threshold gives as many words as its source still lacks."""
    slim = cut(docs.select(*_ordered(docs, mix, id_col, text_col, source_col)))
    rates, n = _rates(slim, mix)
    joined = _beside(slim, rates, n, F.col("source").eqNullSafe(F.col("key")))
    order, limit, size = F.col("order"), F.col("limit"), F.col("size")
    part = F.floor(F.col("over") * size / F.col("tied"))
    extra = F.when(order < limit, size).when(order == limit, part).otherwise(F.lit(0)).cast("long")
    target = F.round("target", 6).alias("target")
    return joined.select("doc_id", "size", "source_size", target, (F.col("copies") * size + extra).alias("taken"))


def repeat(docs: DataFrame, mix: Mix = Mix(), id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The documents, each as often as the mix takes it; here the document at the threshold comes
    whole or not at all, whichever is nearer. The input's columns travel inside a struct, so none of
    them can clash with a name used here."""
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.struct(*_ordered(docs, mix, id_col, text_col, source_col)).alias("mix"))
    rates, n = _rates(cut(keyed.select("mix.*")), mix)
    small = rates.select("key", "copies", "limit", "over", "tied")
    joined = _beside(keyed, small, n, F.col("mix.source").eqNullSafe(F.col("key")))
    order, limit = F.col("mix.order"), F.col("limit")
    more = F.when(order < limit, 1).when((order == limit) & (2 * F.col("over") >= F.col("tied")), 1).otherwise(0)
    times = (F.col("copies") + more).cast("long")
    out = joined.select("row", F.explode(F.when(times > 0, F.sequence(F.lit(1).cast("long"), times))))
    return out.select("row.*")
