"""Connected components by alternating large and small stars."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.joins import salted_join
from .common import cut

PART = 200_000  #: edges that one task makes a forest of


def _forest(batches):
    """Edges (u, v) to the smallest node v that each node reaches inside its own task's edges."""
    root: dict[int, int] = {}

    def find(v: int) -> int:
        while (up := root.setdefault(v, v)) != v:
            root[v] = v = root.setdefault(up, up)
        return v

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            a, b = find(a), find(b)
            if a != b:
                root[max(a, b)] = min(a, b)
    pairs = [p for p in ((v, find(v)) for v in root) if p[0] != p[1]]
    for at in range(0, len(pairs) or 1, 1 << 16):
        some = pairs[at : at + (1 << 16)]
        yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in some], pa.int64()) for k in (0, 1)], names=["u", "v"])


def _to_least(edges: DataFrame) -> DataFrame:
    """Each node of an edge list (u, v), the smallest of itself and its neighbours, and their number."""
    least = F.least(F.min("v"), F.first("u")).alias("m")
    return cut(edges.groupBy("u").agg(least, F.count("*").alias("n_rows")))


def components(links: DataFrame) -> DataFrame:
    """(rep, label): the smallest node that a node of an edge list (a, b) can reach, for all nodes but
    the smallest ones themselves. Edges are dealt into parts of some `PART`, each of which a task
    makes a forest of stars; while there is more than one part, alternating large and small stars
    join them. Each node's neighbours are aggregated, never gathered, and a hub's edges are dealt
    over several tasks. Links are read twice: write what is costly to compute."""
    edges, n, before = links.select("a", "b"), links.count(), None
    while True:
        parts = max(1, -(-n // PART))
        edges = cut(edges.repartition(parts).mapInArrow(_forest, "u long, v long"), again=True)
        if parts == 1:
            return edges.select(F.col("u").alias("rep"), F.col("v").alias("label"))
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = _to_least(both)
        large = salted_join(both.where("v > u"), least.select("u", "m"), ["u"], "v", least)
        large = large.select(F.col("v").alias("u"), F.col("m").alias("v"))
        least = _to_least(large)  # u > v: each node's smallest neighbour
        to_least = [F.struct(F.col(c).alias("u"), F.col("m").alias("v")) for c in ("v", "u")]
        small = salted_join(large, least.select("u", "m"), ["u"], "v", least).select(F.explode(F.array(*to_least)).alias("e")).select("e.*")
        edges = cut(small.where("u != v").distinct(), again=True)
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if before == state:
            return edges.groupBy("u").agg(F.min("v").alias("label")).select(F.col("u").alias("rep"), "label")
        before, n = state, state[0]


def with_labels(rows: DataFrame, labels: DataFrame, rep: str, label: str) -> DataFrame:
    """Add the component of a node: what `components` says, or else the node itself."""
    own = labels.select(F.col("rep").alias(rep), F.col("label").alias("_known"))
    return rows.join(own, rep, "left").withColumn(label, F.coalesce("_known", rep)).drop("_known")


def merged(labels: DataFrame, links: DataFrame) -> DataFrame:
    """Components after more links: only the components that these join are looked at."""
    ends = with_labels(with_labels(links, labels, "a", "x"), labels, "b", "y")
    joined = cut(components(ends.where("x != y").select(F.col("x").alias("a"), F.col("y").alias("b"))))
    moved = joined.select(F.col("rep").alias("label"), F.col("label").alias("to"))
    kept = salted_join(labels, moved, ["label"], "rep", how="left").select("rep", F.coalesce("to", "label").alias("label"))
    return cut(kept.unionByName(joined), again=True)
