import numpy as np
import pytest
from pyspark.sql import functions as F

from quillmap.operators import geometry as G


def brute(vectors):
    """article -> (ratio, nearest, twins), by all pairs."""
    names = sorted({a for a, _ in vectors})
    unit = lambda v: np.array(v, float) / max(np.sqrt((np.array(v, float) ** 2).sum()), 1e-12)
    own = {a: np.array([unit(v) for b, v in vectors if b == a]) for a in names}
    centre = {a: x.mean(0) for a, x in own.items()}
    spread = {a: np.sqrt(((own[a] - centre[a]) ** 2).sum(1)).mean() for a in names}
    out = {}
    for a in names:
        d = {b: float(np.sqrt(((centre[a] - centre[b]) ** 2).sum())) for b in names if b != a}
        ratios = [(spread[a] + spread[b]) / x for b, x in d.items() if x > 0]
        out[a] = (max(ratios, default=0.0), min(d.values(), default=float("inf")), sum(x == 0 for x in d.values()))
    return out


def grouped(seed, groups, articles, chunks, d, apart):
    """Articles around the corners of a few groups, chunks close to their article."""
    rng = np.random.default_rng(seed)
    out = []
    for g in range(groups):
        corner = rng.normal(size=d)
        corner /= np.sqrt((corner**2).sum())
        for a in range(articles):
            middle = corner + rng.normal(size=d) * apart
            out += [(g * articles + a, (middle + rng.normal(size=d) * apart / 10).astype(np.float32).tolist()) for _ in range(chunks)]
    return out


def frame(spark, rows):
    return spark.createDataFrame(rows, "article long, embedding array<float>").repartition(4)


def check(found, want):
    assert len(found) == len(want)
    for r in found:
        ratio, nearest, twins = want[r["article"]]
        assert (r["ratio"], r["nearest"], r["twins"]) == (pytest.approx(ratio, rel=1e-9), pytest.approx(nearest, rel=1e-7, abs=1e-9), twins)


def test_groups_are_ruled_out_and_nothing_is_lost(spark):
    rows = grouped(1, 60, 20, 3, 24, 0.01)
    found = G.cluster_ratios(frame(spark, rows), 24, block=20).collect()
    check(found, brute(rows))
    n = 60 * 20
    assert sum(r["compared"] for r in found) < 0.1 * n * (n - 1)


@pytest.mark.parametrize("block", [3, 16, 512])
def test_without_groups_all_pairs_count(spark, block):
    rng = np.random.default_rng(2)
    rows = [(a, v.tolist()) for a in range(50) for v in rng.normal(size=(int(rng.integers(1, 5)), 8)).astype(np.float32)]
    rows += [(100 + k, v) for k in range(3) for a, v in rows if a == 7]  # the same centroid four times
    rows += [(200, [0.0] * 8), (201, [0.0] * 8)]
    check(G.cluster_ratios(frame(spark, rows), 8, block=block).collect(), brute(rows))


def test_cohorts_are_apart(spark):
    rows = grouped(3, 6, 12, 2, 10, 0.02)
    v = frame(spark, rows)
    dealt = spark.createDataFrame([(s, a) for s in (1, 2) for a in range(72) if a % 3 != s], "seed int, article long")
    found = G.cluster_ratios(v.join(dealt, "article"), 10, block=7, cohort="seed").collect()
    for s in (1, 2):
        check([r for r in found if r["seed"] == s], brute([(a, x) for a, x in rows if a % 3 != s]))


def test_one_article_and_names(spark):
    rows = [("only", [1.0, 2.0]), ("only", [2.0, 1.0])]
    df = spark.createDataFrame(rows, "article string, embedding array<float>")
    r = G.cluster_ratios(df, 2).first()
    assert (r["article"], r["ratio"], r["twins"], r["compared"]) == ("only", 0.0, 0, 0)
    two = spark.createDataFrame([("a", [1.0, 0.0]), ("a", [1.0, 0.1]), ("b", [0.0, 1.0])], "article string, embedding array<float>")
    assert G.cluster_ratios(two, 2).agg(F.sum("compared")).first()[0] == 2
