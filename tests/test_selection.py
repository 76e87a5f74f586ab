import math
import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillmap.operators import selection

FRACTIONS = {"low": 0.0, "p01": 0.01, "q1": 0.25, "half": 0.5, "p95": 0.95, "high": 1.0}


def spark_percentiles(df, keys):
    q = F.percentile("x", F.array(*map(F.lit, FRACTIONS.values()))).alias("q")
    return df.groupBy(*keys).agg(q).where("q is not null").select(*keys, *[F.get("q", F.lit(k)).alias(n) for k, n in enumerate(FRACTIONS)])


def same(got, want, keys):
    read = lambda df: sorted(map(repr, (tuple(r) for r in df.select(*keys, *FRACTIONS).collect())))
    assert read(got) == read(want)


@pytest.fixture
def small(monkeypatch):
    monkeypatch.setattr(selection, "BOUND", 20)
    monkeypatch.setattr(selection, "GRID", 16)
    monkeypatch.setattr(selection, "ACCURACY", 200)


def test_several_keys_with_ties_nulls_and_extremes(spark, small):
    rng = random.Random(1)
    rows = [("a", rng.choice([0.5, 0.25, rng.random()])) for _ in range(3_000)] + [("b", rng.gauss(0, 1) ** 9 * 1e30) for _ in range(2_000)]
    rows += [("c", 7.0)] * 900 + [("d", None)] * 5 + [("e", 1.5)] + [(None, rng.random()) for _ in range(400)]
    rows += [("f", float(k % 3)) for k in range(1_000)] + [("g", x) for x in [math.inf, -math.inf, 0.0, -0.0] * 50 + [rng.random() for _ in range(300)]]
    df = spark.createDataFrame(rows, "k string, x double").repartition(5)
    same(selection.percentiles(df, ["k"], "x", FRACTIONS), spark_percentiles(df, ["k"]), ["k"])
    some = df.where("k in ('a', 'b')")
    same(selection.percentiles(some, [], "x", FRACTIONS), spark_percentiles(some, []), [])


def test_no_values(spark):
    df = spark.createDataFrame([("a", None)], "k string, x double")
    assert selection.percentiles(df, ["k"], "x", FRACTIONS).collect() == []
    assert selection.percentiles(df.where("false"), [], "x", FRACTIONS).collect() == []


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.floats(allow_nan=True, width=32), min_size=1, max_size=120))
def test_order_statistics_are_those_of_a_sort(spark, small, values):
    df = spark.createDataFrame([(v,) for v in values], "x double")
    sizes, found = selection.order_statistics(df, [], "x", lambda n: list(range(n)))
    want = sorted((float(v) for v in values), key=selection._order)
    assert sizes == {(): len(values)}
    assert [repr(found[()][k] + 0.0) for k in range(len(values))] == [repr(v + 0.0) for v in want]


def test_ten_million_distinct_values(spark):
    """No task holds more than a population: the largest is below BOUND values, of 10 million."""
    n = 10_000_000
    df = spark.range(0, n, 1, 8).select(((F.col("id") * 7_368_787) % n / 4.0).alias("x"))  # a permutation
    seen = []
    before = selection._sorted

    def watched(x, keys, some):
        seen.extend(p.n for p in some)
        return before(x, keys, some)

    selection._sorted = watched
    try:
        got = selection.percentiles(df, [], "x", FRACTIONS).first()
    finally:
        selection._sorted = before
    for name, p in FRACTIONS.items():
        assert got[name] == pytest.approx(p * (n - 1) / 4.0, rel=1e-12, abs=1e-9)
    assert seen and max(seen) <= selection.BOUND


def test_no_percentile_aggregate_in_the_plans(spark, monkeypatch):
    from quillmap.operators import articles, geometry

    def refuse(*_):
        raise AssertionError("percentile holds all distinct values of a group")

    monkeypatch.setattr(F, "percentile", refuse)
    rows = spark.createDataFrame([(k, k / 3.0, 0.5, True, 4.0, 1.0) for k in range(30)], "article long, letter_character_ratio double, vowel_letter_ratio double, is_valid boolean, mean_characters_per_word double, tokens_per_word double")
    assert articles.metric_summary(rows, ["letter_character_ratio"]).first()["median"] == pytest.approx(29 / 6)
    assert articles.robust_bounds(rows).count() == 4
    ratios = rows.select("article", F.col("letter_character_ratio").alias("ratio"), F.col("vowel_letter_ratio").alias("nearest"), F.lit(0).alias("twins"))
    assert geometry.ratio_diagnostics(ratios).first()["median_ratio"] == pytest.approx(29 / 6)
    both = rows.select("article", F.lit(2).alias("n_chunks"), F.lit(3.0).alias("total_length"), F.col("letter_character_ratio").alias("similarity"), F.col("vowel_letter_ratio").alias("degradation"))
    assert geometry.degradation_summary(both).first()["median_similarity"] == pytest.approx(29 / 6)
    assert geometry.degradation_summary(both.where("false")).first()["n_articles"] == 0
