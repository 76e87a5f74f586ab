"""Clusters of vectors around centroids, in exact integers (Lloyd's rounds), screened by block norms.

Components are scaled and floored to integers. Every vector is cut into segments, and of each segment
its sum and the norm of what is left without its mean are kept: 2 numbers for `SEGMENT` components.
For two vectors with segment sums s, t and rests of norm p, q, Cauchy-Schwarz gives

    distance^2 >= sum over segments of (s - t)^2 / SEGMENT + (p - q)^2

so of two such compressed vectors and both squared norms one small product bounds the distance from
below. A vector gets the exact distance to the centroid with the smallest bound, and then to those
only whose bound isn't above it. Bounds are doubles, lowered by more than their rounding; distances,
sums and means are whole numbers, so results don't depend on partitions or their order.

Vectors are packed once, some thousands to a row with their compressed forms, and written to the
shared folder. A round reads them, and each task gives k x d sums; of these, k x d numbers reach the
driver. Nothing else does, whatever the number of vectors.

Defined results: vectors that are null, of another length, or with a null, NaN or infinite component
are left out; a null id is kept and gets a null vec_id, but starts no centroid; repeated rows count
each; of equal distances the centroid with the smaller number wins; with fewer than k vectors there
are as many centroids as vectors; an empty table, or one without a usable vector, gives an empty
table; other columns are ignored. Scaled components of 2^27 and more in magnitude end the job with an
error (their squared distances don't fit a long).
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, ship

SEGMENT = 8
LIMIT = 1 << 27  #: of a scaled component
ROWS = 4_096  #: vectors to a packed row
SLACK = 1e-12  #: of the squared norms: more than the rounding of a bound

_PACKED = pa.schema([("ids", pa.list_(pa.int64())), ("ints", pa.binary()), ("short", pa.binary())])


def compressed(ints: np.ndarray) -> np.ndarray:
    """For each row: its segment sums over sqrt(segment length), the norms of the rests, and last the
    squared norm. A row's product with another one's, without the last, is at least their own product."""
    n, d = ints.shape
    starts = np.arange(0, d, SEGMENT)
    lengths = np.diff(np.append(starts, d))
    sums = np.add.reduceat(ints, starts, axis=1)
    squares = np.add.reduceat(ints * ints, starts, axis=1)
    rest = np.sqrt(np.maximum(squares - sums.astype(float) ** 2 / lengths, 0))
    return np.concatenate([sums / np.sqrt(lengths), rest, squares.sum(1, dtype=float)[:, None]], axis=1)


def nearest(ints: np.ndarray, short: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(number of the nearest centre, exact squared distance, distances computed) for each row."""
    own = compressed(centres)
    both = short[:, -1:] + own[:, -1]
    bound = both * (1 - SLACK) - 2 * (short[:, :-1] @ own[:, :-1].T)
    best = bound.argmin(1)
    distance = ((ints - centres[best]) ** 2).sum(1)
    first, made = best.copy(), len(ints)
    for j, centre in enumerate(centres):
        left = np.flatnonzero((bound[:, j] <= distance) & (first != j))
        d = ((ints[left] - centre) ** 2).sum(1)
        nearer = (d < distance[left]) | ((d == distance[left]) & (j < best[left]))
        distance[left[nearer]], best[left[nearer]] = d[nearer], j
        made += len(left)
    return best, distance, made


@dataclass(frozen=True)
class Clusters:
    """What to cluster: components are floor(scale * x); the first centroids are the k vectors whose
    lower-case hexadecimal sha256 of seed and id is smallest."""

    k: int = 8
    rounds: int = 10
    dimension: int = 64
    scale: float = 1024.0
    seed: str = "3:"

    def usable(self, vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
        """vec_id and v, doubles, of the vectors that count."""
        v = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
        fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
        return v.where((F.size("v") == self.dimension) & fine)

    def _scaled(self, flat: np.ndarray) -> np.ndarray:
        x = np.floor(flat.reshape(-1, self.dimension) * self.scale)
        if len(x) and np.abs(x).max() >= LIMIT:
            raise ValueError(f"a component is {LIMIT} or more after scaling")
        return x.astype(np.int64)

    def packed(self, vectors: DataFrame) -> DataFrame:
        """Rows of some thousands of vectors: ids, components, compressed forms; of `usable` rows."""

        def run(batches):
            for batch in batches:
                for at in range(0, batch.num_rows, ROWS):
                    part = batch.slice(at, ROWS)
                    ints = self._scaled(part.column(1).flatten().to_numpy(zero_copy_only=False))
                    row = [[part.column(0).to_pylist()], [ints.astype(np.int32).tobytes()], [compressed(ints).tobytes()]]
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(row, _PACKED)], schema=_PACKED)

        return vectors.mapInArrow(run, "ids array<long>, ints binary, short binary")

    def _opened(self, batches):
        for batch in batches:
            for ids, ints, short in zip(*batch.columns):
                i = np.frombuffer(ints.as_buffer(), np.int32).reshape(-1, self.dimension).astype(np.int64)
                yield ids.values, i, np.frombuffer(short.as_buffer()).reshape(len(i), -1)

    def first(self, vectors: DataFrame) -> np.ndarray:
        """The k vectors that centroids start as."""
        key = F.sha2(F.concat(F.lit(self.seed), F.col("vec_id").cast("string")), 256)
        head = vectors.where("vec_id is not null").orderBy(key, "v").limit(self.k).select("v").collect()  # k rows
        return self._scaled(np.array([r["v"] for r in head], float))

    def moved(self, blocks: DataFrame, centres: np.ndarray) -> np.ndarray:
        """The centroids after one round; of each, d sums and a count reach the driver."""
        k, d = centres.shape

        def run(batches):
            sums = np.zeros((k, d + 1), np.int64)
            for _, ints, short in self._opened(batches):
                best, _, _ = nearest(ints, short, centres)
                order = np.argsort(best, kind="stable")
                held, at = np.unique(best[order], return_index=True)
                sums[held, :d] += np.add.reduceat(ints[order], at, axis=0)
                sums[:, d] += np.bincount(best, minlength=k)
            c, p = np.nonzero(sums)
            yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int32)), pa.array(p.astype(np.int32)), pa.array(sums[c, p])], names=["c", "p", "s"])

        found = blocks.mapInArrow(run, "c int, p int, s long").groupBy("c", "p").agg(F.sum("s").alias("s"))
        total = np.zeros((k, d + 1), np.int64)
        for c, p, s in found.collect():  # k x (d + 1) numbers at most
            total[c, p] = s
        count = total[:, d:]
        return np.where(count > 0, total[:, :d] // np.maximum(count, 1), centres)

    def assigned(self, blocks: DataFrame, centres: np.ndarray) -> DataFrame:
        """vec_id, cluster, distance."""

        def run(batches):
            for ids, ints, short in self._opened(batches):
                best, distance, _ = nearest(ints, short, centres)
                yield pa.RecordBatch.from_arrays([ids, pa.array(best.astype(np.int32)), pa.array(distance)], names=["vec_id", "cluster", "distance"])

        return blocks.mapInArrow(run, "vec_id long, cluster int, distance long")

    def fit(self, vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> tuple[DataFrame, np.ndarray]:
        """The packed vectors and the final centroids."""
        ship(vectors.sparkSession)
        usable = self.usable(vectors, id_col, vector_col)
        centres = self.first(usable)
        blocks = cut(self.packed(usable))
        if len(centres):
            for _ in range(self.rounds):
                centres = self.moved(blocks, centres)
        return blocks, centres

    def report(self, vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
        """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 for each usable vector."""
        blocks, centres = self.fit(vectors, id_col, vector_col)
        if not len(centres):
            return vectors.sparkSession.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
        rows = self.assigned(blocks, centres)
        sums = rows.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(20,0)")).alias("s")).collect()  # k rows
        inertia = {r["cluster"]: int(r["s"]) for r in sums}
        total = sum(inertia.values())
        hashes = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres.tolist()]
        named = [(c, s, total, hashes[c]) for c, s in inertia.items()]
        clusters = vectors.sparkSession.createDataFrame(named, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
        return rows.join(F.broadcast(clusters), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")  # k rows
