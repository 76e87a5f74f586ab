import collections
import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillmap.operators import geometry as G
from quillmap.operators import pairs as P
from quillmap.operators import sampling as S


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 3_000), st.integers(0, 1 << 40))
def test_permutations(total, seed):
    assert sorted(S.permuted(np.arange(total), total, seed).tolist()) == list(range(total))


def test_large_spaces_and_limits():
    total = (1 << 61) + 12_345
    got = S.permuted(np.arange(10_000), total, 3)
    assert len(set(got.tolist())) == 10_000 and got.min() >= 0 and got.max() < total
    assert abs(got.astype(float).mean() / total - 0.5) < 4 / math.sqrt(12 * 10_000)
    assert S.permuted(np.arange(100), total, 3).tolist() == got[:100].tolist()
    with pytest.raises(ValueError):
        S.permuted(np.arange(1), 1 << 63, 0)


def test_every_rank_is_as_likely():
    counts = collections.Counter()
    for seed in range(4_000):
        counts.update(S.permuted(np.arange(3), 11, seed).tolist())
    expected = 4_000 * 3 / 11
    assert sum((counts[k] - expected) ** 2 / expected for k in range(11)) < 29.6  # chi-square, 10 degrees, 0.1 %
    pairs = collections.Counter(tuple(sorted(S.permuted(np.arange(2), 6, seed).tolist())) for seed in range(3_000))
    assert len(pairs) == 15 and sum((n - 200) ** 2 / 200 for n in pairs.values()) < 36.1  # 14 degrees


@pytest.mark.parametrize("n", [2, 3, 5, 64, 1_000])
def test_triangle_pairs(spark, n):
    i, j = S.triangle_pair(F.lit(n).cast("long"), F.col("id"))
    total = n * (n - 1) // 2
    rows = spark.range(0, total, max(1, total // 300)).select("id", i.alias("i"), j.alias("j")).collect()
    assert [(r["i"], r["j"]) for r in rows] == [P.pair_of_rank(n, r["id"]) for r in rows]


def test_triangle_pairs_of_billions_of_rows(spark):
    n = 3_000_000_000
    total = n * (n - 1) // 2
    ranks = [0, 1, n - 2, n - 1, total // 3, total // 2, total - 2, total - 1, 10**18, 4 * 10**18 + 7]
    i, j = S.triangle_pair(F.lit(n).cast("long"), F.col("r"))
    rows = spark.createDataFrame([(r,) for r in ranks], "r long").select("r", i.alias("i"), j.alias("j")).collect()
    assert [(r["i"], r["j"]) for r in rows] == [P.pair_of_rank(n, r["r"]) for r in rows]


def units_of(spark, sizes):
    rows = [(f"a{a:03d}", k) for a, n in enumerate(sizes) for k in range(n)]
    return spark.createDataFrame([(a, k, i) for i, (a, k) in enumerate(rows)], "article string, position int, idx long").repartition(3), [a for a, _ in rows]


@pytest.mark.parametrize("limit", [37, 10**6])
def test_pairs_of_each_kind(spark, limit):
    units, names = units_of(spark, [5, 1, 1, 30, 2, 9])
    n = len(names)
    every = [(i, j) for i in range(n) for j in range(i + 1, n)]
    kinds = {
        P.cross_article_pairs: [(i, j) for i, j in every if names[i] != names[j]],
        P.same_article_pairs: [(i, j) for i, j in every if names[i] == names[j]],
        P.transition_pairs: [(i, i + 1) for i in range(n - 1) if names[i] == names[i + 1]],
    }
    for pick, want in kinds.items():
        got = [(r["i"], r["j"]) for r in pick(units, limit, 5).collect()]
        assert len(got) == len(set(got)) == min(limit, len(want)) and set(got) <= set(want)
        assert pick(units, 0, 5).collect() == []


def test_each_pair_is_as_likely(spark):
    units, names = units_of(spark, [1, 6, 2, 3])
    cross = sum(names[i] != names[j] for i in range(12) for j in range(i + 1, 12))
    counts = collections.Counter()
    for seed in range(12):
        counts.update((r["i"], r["j"]) for r in P.cross_article_pairs(units, 25, seed).collect())
    expected = 300 / cross
    assert sum((counts[p] - expected) ** 2 / expected for p in counts) + (cross - len(counts)) * expected < cross + 5 * math.sqrt(2 * cross)


def test_sampled_means_are_near_the_exact_ones(spark):
    rng = np.random.default_rng(6)
    rows = [(a, k, v.tolist()) for a in range(40) for k, v in enumerate(rng.normal(size=(int(rng.integers(1, 12)), 6)) + rng.normal(size=6))]
    vectors = spark.createDataFrame(rows, "article long, position int, embedding array<double>")
    exact = G.pair_means(vectors, 6).first()
    units = P.indexed(vectors, ["article", "position"])
    for pairs, want in ((P._any_pairs(units, 3_000, 1), "mean_all"), (P.same_article_pairs(units, 400, 2), "mean_same"), (P.cross_article_pairs(units, 3_000, 3), "mean_cross")):
        r = P._cosines(units, pairs).agg(F.avg("cosine").alias("m"), F.stddev("cosine").alias("s"), F.count("*").alias("n")).first()
        assert abs(r["m"] - exact[want]) < 3 * r["s"] / math.sqrt(r["n"])


def test_nothing_to_draw_from(spark):
    units, _ = units_of(spark, [1])
    for pick in (P.cross_article_pairs, P.same_article_pairs, P.transition_pairs):
        assert pick(units, 5, 1).collect() == [] and pick(units.where("false"), 5, 1).collect() == []
    assert P._any_pairs(units, 5, 1).collect() == [] and P._any_pairs(units.where("false"), 5, 1).collect() == []
