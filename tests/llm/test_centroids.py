import collections
import hashlib
import math

import numpy as np
import pytest

from quillmap.llm import centroids

SCHEMA = "vec_id long, embedding array<float>, cluster int, distance long, c int, s long, v string"


def expected(rows, k=8, rounds=10, d=64):
    kept = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows if v is not None and len(v) == d and all(x is not None and math.isfinite(x) for x in v)]
    apart = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    named = sorted((x for x in kept if x[0] is not None), key=lambda x: (hashlib.sha256(f"3:{x[0]}".encode()).hexdigest(), x[1]))
    centres = [v for _, v in named[:k]]
    assign = lambda: [min((apart(v, c), j) for j, c in enumerate(centres)) for _, v in kept]
    for _ in range(rounds):
        found = assign()
        for j in range(len(centres)):
            own = [v for (_, v), (_, c) in zip(kept, found) if c == j]
            if own:
                centres[j] = [sum(x) // len(own) for x in zip(*own)]
    found = assign()
    inertia = collections.Counter()
    for dist, c in found:
        inertia[c] += dist
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres]
    return collections.Counter((i, c, dist, inertia[c], inertia.total(), digest[c]) for (i, _), (dist, c) in zip(kept, found))


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 1, 2, 3, 4, "x") for i, v in rows], SCHEMA).repartition(3)


def report(spark, rows, **more):
    return collections.Counter(tuple(r) for r in centroids.Clusters(**more).report(frame(spark, rows)).collect())


def vectors(seed, n, d=64, spread=1.0, groups=8):
    rng = np.random.default_rng(seed)
    middle = rng.normal(size=(groups, d)) * spread
    out = middle[rng.integers(0, groups, n)] + rng.normal(size=(n, d)) * 0.1
    return out.astype(np.float32).tolist()


def test_odd_rows(spark):
    v = vectors(1, 120)
    rows = [(k, x) for k, x in enumerate(v)] + [(k, v[k]) for k in range(20)]  # repeated rows
    rows += [(1_000, None), (1_001, []), (1_002, v[0][:63]), (1_003, [*v[0], 1.0]), (1_004, [None, *v[0][1:]]), (1_005, [float("nan"), *v[0][1:]]), (1_006, [float("-inf"), *v[0][1:]]), (None, v[3]), (5, v[9]), (1_007, [0.0] * 64), (1_008, [-0.0] * 64), (1_009, [-1e-9] * 64)]
    got = report(spark, rows)
    assert got == expected(rows) and len(got) > 100


def test_few_and_no_vectors(spark):
    v = vectors(2, 3)
    rows = list(enumerate(v))
    assert report(spark, rows) == expected(rows)
    assert not report(spark, [(1, None), (2, [])])
    assert not report(spark, [])
    assert not report(spark, [(None, v[0])])


def test_ties_and_empty_clusters(spark):
    same = [1.0] * 64
    rows = [(k, same) for k in range(40)] + [(100 + k, [1.0 + (k == j) for j in range(64)]) for k in range(6)]
    got = report(spark, rows)
    assert got == expected(rows) and len({r[1] for r in got}) < 8


def test_other_sizes(spark):
    v = vectors(3, 90, d=11, groups=4)
    rows = list(enumerate(v))
    assert report(spark, rows, k=5, rounds=4, dimension=11) == expected(rows, 5, 4, 11)


def test_too_large(spark):
    with pytest.raises(Exception, match="after scaling"):
        report(spark, [(1, [1e6] * 64)])


@pytest.mark.parametrize("d", [64, 13])
def test_bounds_are_bounds_and_screen(d):
    rng = np.random.default_rng(4)
    x = rng.integers(-(1 << 26), 1 << 26, (300, d))
    y = np.concatenate([x[:20], x[20:60] + rng.integers(-2, 3, (40, d))])
    a, b = centroids.compressed(x), centroids.compressed(y)
    bound = (a[:, -1:] + b[:, -1]) * (1 - centroids.SLACK) - 2 * a[:, :-1] @ b[:, :-1].T
    exact = ((x[:, None] - y[None]) ** 2).sum(2)
    assert (bound <= exact).all()
    v = (np.array(vectors(5, 2_000, d, spread=3.0)) * 1024).astype(np.int64)
    best, distance, made = centroids.nearest(v, centroids.compressed(v), v[:30])
    exact = ((v[:, None] - v[None, :30]) ** 2).sum(2)
    assert (best == exact.argmin(1)).all() and (distance == exact.min(1)).all()
    assert made < 0.5 * 30 * len(v)  # most distances weren't computed
