"""Leading principal components by random range finding in blocks, without a d x d matrix.

With the vectors as rows of X, the covariance C is only met in products C V with thin blocks V of
d x l numbers: each task adds up x (x . V) over its vectors, Spark sums the tasks' d x l numbers, and
the driver, which gets these alone, makes the next block orthogonal to all before it (a block Krylov
space, which starts from seeded random numbers). The leading eigenvalues of C within the space grow
towards those of C; passes go on until they stay. Where d is small, the first block has all d
columns, and one pass is exact.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..sources.steps import ship

BLOCK_NUMBERS = 1 << 16  #: of a block: it has l = BLOCK_NUMBERS / d columns, and `OVERSAMPLE` more than asked for at least
OVERSAMPLE = 10
TOLERANCE, PASSES = 1e-8, 60
PIECE = 64  #: numbers to a row on the way to their sums


@dataclass(frozen=True)
class Spectrum:
    n: int  #: vectors
    total: float  #: variance over all directions
    values: np.ndarray  #: largest eigenvalues of the covariance, the largest first
    vectors: np.ndarray  #: a column for each, with its largest component positive
    passes: int

    def shares(self) -> np.ndarray:
        """What part of the variance the first 1, 2, ... components have; nan without variance."""
        with np.errstate(invalid="ignore", divide="ignore"):
            return np.cumsum(self.values) / self.total


def _products(rows: DataFrame, block: np.ndarray) -> tuple[np.ndarray, np.ndarray, float, int]:
    """Sums over all vectors x: x (x . block), x, x . x, 1."""
    d, width = block.shape
    size = d * (width + 1) + 2

    def run(batches):
        sums, tail = np.zeros((d, width + 1)), np.zeros(2)
        for batch in batches:
            x = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
            sums[:, :width] += x.T @ (x @ block)
            sums[:, width] += x.sum(0)
            tail += (x**2).sum(), len(x)
        flat = np.zeros(-(-size // PIECE) * PIECE)
        flat[:size] = np.concatenate([sums.ravel(), tail])
        if tail[1]:
            numbers = pa.FixedSizeListArray.from_arrays(pa.array(flat), PIECE).cast(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat) // PIECE, dtype=np.int32)), numbers], names=["k", "v"])

    added = rows.mapInArrow(run, "k int, v array<double>").groupBy("k").agg(V.vector_sum(F.col("v"), PIECE).alias("v"))
    flat = np.zeros(-(-size // PIECE) * PIECE)
    for k, v in added.collect():  # d x (l + 1) numbers
        flat[k * PIECE : (k + 1) * PIECE] = v
    sums = flat[: d * (width + 1)].reshape(d, width + 1)
    return sums[:, :width], sums[:, width], float(flat[size - 2]), int(flat[size - 1])


def _orthonormal(block: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """What the block adds to an orthonormal basis; directions that it doesn't add are left out."""
    scale = np.linalg.norm(block, axis=0).max(initial=0)
    for _ in range(2):  # once more, for what rounding left
        block = block - basis @ (basis.T @ block)
    u, s, _ = np.linalg.svd(block, full_matrices=False)
    u = u[:, s > 1e-10 * scale]
    return u - basis @ (basis.T @ u) if basis.shape[1] else u


def principal(vectors: DataFrame, k: int, dimension: int, vector_col: str = "embedding", tolerance: float = TOLERANCE, most_passes: int = PASSES, seed: int = 0) -> Spectrum | None:
    """The k leading components of the vectors (all of one dimension, none null); none for fewer than
    two vectors. Vectors are read once a pass: write them first if they are costly to compute."""
    ship(vectors.sparkSession)
    rows = vectors.select(F.col(vector_col).cast("array<double>").alias("x"))
    d, k = dimension, min(k, dimension)
    width = min(d, max(k + OVERSAMPLE, BLOCK_NUMBERS // d))
    block = np.eye(d) if width == d else np.linalg.qr(np.random.default_rng(seed).normal(size=(d, width)))[0]
    basis, images, before = np.zeros((d, 0)), np.zeros((d, 0)), np.full(k, np.inf)
    for passes in range(1, most_passes + 1):
        products, total, squares, n = _products(rows, block)
        if n < 2:
            return None
        image = (products - np.outer(total, total @ block) / n) / (n - 1)
        variance = max(0.0, (squares - total @ total / n) / (n - 1))
        basis, images = np.hstack([basis, block]), np.hstack([images, image])
        inner = basis.T @ images
        values, inside = np.linalg.eigh((inner + inner.T) / 2)
        values, inside = np.maximum(values[::-1][:k], 0), inside[:, ::-1][:, :k]
        block = _orthonormal(image, basis)
        still = np.abs(values - before).max() <= tolerance * max(values.max(initial=0), 1e-300)
        if still or not block.shape[1] or basis.shape[1] >= d:
            break
        before = values
    found = basis @ inside
    largest = found[np.abs(found).argmax(0), np.arange(found.shape[1])]
    return Spectrum(n, variance, values, found * np.where(largest < 0, -1, 1), passes)
