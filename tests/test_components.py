import numpy as np
import pytest
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector

from quillmap.operators import components as C
from quillmap.operators import geometry as G


def frame(spark, x, parts=3):
    return spark.createDataFrame([(k, v) for k, v in enumerate(x.tolist())], "id long, embedding array<double>").repartition(parts)


def spectrum(x, k):
    values, vectors = np.linalg.eigh(np.cov(x.T))
    return values[::-1][:k], vectors[:, ::-1][:, :k], values.sum()


def decaying(rng, n, d, rate):
    basis = np.linalg.qr(rng.normal(size=(d, d)))[0]
    return rng.normal(size=(n, d)) * rate ** np.arange(d) @ basis.T + rng.normal(size=d)


def same_axes(a, b):
    assert np.abs(np.abs((a * b).sum(0)) - 1).max() < 1e-6


def test_one_pass_where_the_block_has_all_columns(spark):
    x = decaying(np.random.default_rng(1), 300, 12, 0.8)
    got = C.principal(frame(spark, x), 5, 12)
    values, vectors, total = spectrum(x, 5)
    assert got.passes == 1 and got.n == 300
    assert got.values == pytest.approx(values) and got.total == pytest.approx(total)
    same_axes(got.vectors, vectors)


@pytest.mark.parametrize("rate", [0.7, 0.95, 1.0])
def test_thin_blocks_find_the_same(spark, monkeypatch, rate):
    monkeypatch.setattr(C, "BLOCK_NUMBERS", 1)
    x = decaying(np.random.default_rng(2), 500, 60, rate)
    got = C.principal(frame(spark, x), 4, 60)
    values, vectors, total = spectrum(x, 4)
    assert got.values == pytest.approx(values, rel=1e-7) and got.total == pytest.approx(total)
    if rate < 1:
        same_axes(got.vectors, vectors)
    assert 1 < got.passes <= 6 and (got.vectors[np.abs(got.vectors).argmax(0), np.arange(4)] > 0).all()


def test_large_dimension(spark):
    """4,096 components: thin blocks only, no matrix of 4,096 x 4,096."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(60, 12)) * 0.6 ** np.arange(12) @ rng.normal(size=(12, 4_096)) + 0.01 * rng.normal(size=(60, 4_096))
    got = C.principal(frame(spark, x), 10, 4_096)
    centred = x - x.mean(0)
    values = np.linalg.svd(centred, compute_uv=False) ** 2 / 59
    assert got.shares() == pytest.approx(np.cumsum(values)[:10] / values.sum(), rel=1e-6)


def test_shares_of_the_library(spark, sf_dir):
    v = spark.read.parquet(f"{sf_dir.replace('sf0.001', 'sf0.1')}/embeddings.parquet")
    model = PCA(k=10, inputCol="v", outputCol="p").fit(G.unit_vectors(v).select(array_to_vector("embedding").alias("v")))
    shares = np.cumsum(model.explainedVariance.toArray())
    r = G.pca_ratios(v).first()
    assert [r["pc1"], r["pc5"], r["pc10"]] == pytest.approx([shares[0], shares[4], shares[9]], abs=1e-6)


def test_few_rows_and_low_rank(spark):
    one = frame(spark, np.ones((1, 3)))
    assert C.principal(one, 2, 3) is None and G.pca_ratios(one.where("false")).first()["pc1"] is None
    assert G.pca_ratios(frame(spark, np.ones((5, 3)))).first()["pc1"] is None  # no variance
    line = frame(spark, np.outer(np.arange(6.0), [1.0, 2.0, 2.0, 0.0]) + 1)
    got = C.principal(line, 3, 4)
    assert got.shares() == pytest.approx([1, 1, 1]) and got.values[1:] == pytest.approx([0, 0], abs=1e-12)


def test_projection(spark):
    x = decaying(np.random.default_rng(4), 80, 7, 0.6)
    rows = sorted(G.project_2d(frame(spark, x), "id").collect())
    axes = spectrum(x, 2)[1]
    axes = axes * np.where(axes[np.abs(axes).argmax(0), [0, 1]] < 0, -1, 1)
    assert np.array([[r["x"], r["y"]] for r in rows]) == pytest.approx(x @ axes)
    assert G.project_2d(frame(spark, x).where("false"), "id").collect() == []
    assert [(r["x"], r["y"]) for r in G.project_2d(frame(spark, x[:1]), "id").collect()] == [(0.0, 0.0)]
    assert all(r["y"] == 0 for r in G.project_2d(frame(spark, x[:, :1]), "id").collect())
