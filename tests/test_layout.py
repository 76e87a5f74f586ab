import numpy as np
import pytest
from pyspark.sql import functions as F

from quillmap.operators import geometry as G
from quillmap.operators import layout as L
from quillmap.operators import retrieval as N
from quillmap.operators.layout import Layout, trustworthiness

SMALL = Layout(k=8, sample=8, power_steps=8, rounds=2, epochs=20, block=40)


def groups(seed, n, d, many):
    rng = np.random.default_rng(seed)
    middle = rng.normal(size=(many, d))
    return (middle[np.arange(n) % many] + 0.25 * rng.normal(size=(n, d))).astype(np.float32)


def frame(spark, x):
    return spark.createDataFrame([(f"v{k:04d}", v.tolist()) for k, v in enumerate(x)], "name string, embedding array<float>").repartition(3)


@pytest.fixture(scope="module")
def table(spark):
    return frame(spark, groups(1, 240, 16, 9)).persist()


@pytest.fixture(scope="module")
def graph(spark, table):
    units = SMALL.indexed(table, "name")
    return units, SMALL.graph(units).persist()


def test_the_graph_is_nearly_the_exact_one(spark, graph):
    units, edges = graph
    exact = {(r["query"], r["doc"]): r["similarity"] for r in N.nearest(units, units, 8, "idx", "idx", same=True).collect()}
    got = {(r["u"], r["v"]): r["s"] for r in edges.collect()}
    assert len(got) == 240 * 8 and all(u != v for u, v in got)
    assert len(got.keys() & exact.keys()) >= 0.97 * len(exact)
    assert all(got[p] == pytest.approx(exact[p], abs=2e-9) for p in got.keys() & exact.keys())


def test_weights_by_their_definition(graph):
    _, edges = graph
    near = {}
    for r in edges.collect():
        near.setdefault(r["u"], []).append((r["v"], np.sqrt(max(0, 2 - 2 * r["s"]))))
    own = {}
    for u, pairs in near.items():
        d = np.array([x for _, x in pairs])
        rest = np.maximum(d - d[d > 0].min(), 0)
        low, high = 1e-9, 1e3
        for _ in range(200):
            middle = (low + high) / 2
            low, high = (low, middle) if np.exp(-rest / middle).sum() > np.log2(8) else (middle, high)
        own |= {(u, v): w for (v, _), w in zip(pairs, np.exp(-rest / low))}
    got = {(r["u"], r["v"]): r["w"] for r in SMALL.weights(edges).collect()}
    assert got.keys() == {(min(p), max(p)) for p in own}
    for (u, v), w in got.items():
        a, b = own.get((u, v), 0.0), own.get((v, u), 0.0)
        assert w == pytest.approx(a + b - a * b, abs=1e-6)


def test_start_is_made_of_eigenvectors(spark, graph):
    units, edges = graph
    weights = Layout(k=8, power_steps=120).weights(edges)
    n = units.count()
    a = np.zeros((n, n))
    for r in weights.collect():
        a[r["u"], r["v"]] = a[r["v"], r["u"]] = r["w"]
    degree = np.sqrt(a.sum(1))
    values = np.linalg.eigvalsh(a / np.outer(degree, degree))[::-1]
    places = {r["idx"]: (r["x"], r["y"]) for r in Layout(k=8, power_steps=25).start(units, weights).collect()}
    xy = np.array([places[k] for k in range(n)])
    kept = [v @ (a / np.outer(degree, degree)) @ v / (v @ v) for v in xy.T]
    assert np.abs(xy).max() <= 10.001 and min(kept) > 0.9 * values[2]  # nearly invariant under the graph
    assert np.abs(xy.T @ degree).max() / np.linalg.norm(degree) < 0.05 * np.linalg.norm(xy)


def test_layout_keeps_neighbourhoods_better_than_the_plane_of_most_variance(spark, table):
    first = SMALL.project(table, "name").persist()
    assert first.count() == 240 and first.where("isnan(x) or isnan(y) or x is null").count() == 0
    own, plane = trustworthiness(table, first, "name"), trustworthiness(table, G.project_2d(table, "name"), "name")
    assert own > plane and own > 0.85
    again = {r["name"]: (r["x"], r["y"]) for r in SMALL.project(table, "name").collect()}
    assert {r["name"]: (r["x"], r["y"]) for r in first.collect()} == again


def test_blocks_of_the_plane_move_together(spark, table):
    several = Layout(k=8, sample=8, power_steps=8, rounds=2, epochs=15, block=40, plane_block=90)
    places = several.project(table, "name")
    assert places.count() == 240 and trustworthiness(table, places, "name") > 0.8


def test_trustworthiness_by_its_definition(spark):
    rng = np.random.default_rng(5)
    x, y, n, k = rng.normal(size=(50, 6)), rng.normal(size=(50, 2)), 50, 5
    v = frame(spark, x.astype(np.float32))
    places = spark.createDataFrame([(f"v{i:04d}", float(a), float(b)) for i, (a, b) in enumerate(y)], "name string, x double, y double")
    u = x.astype(np.float32).astype(float)
    u /= np.linalg.norm(u, axis=1)[:, None]
    excess = 0
    for i in range(n):
        others = [j for j in range(n) if j != i]
        high = sorted(others, key=lambda j: -(u[i] @ u[j]))
        low = sorted(others, key=lambda j: ((y[i] - y[j]) ** 2).sum())[:k]
        excess += sum(max(0, high.index(j) + 1 - k) for j in low)
    assert trustworthiness(v, places, "name", k) == pytest.approx(1 - 2 / (n * k * (2 * n - 3 * k - 1)) * excess)


@pytest.mark.parametrize("n", [0, 1, 2, 5])
def test_few_vectors(spark, n):
    df = frame(spark, groups(2, n, 4, 2)) if n else frame(spark, groups(2, 1, 4, 2)).where("false")
    odd = df.unionByName(spark.createDataFrame([(None, [1.0, 0.0, 0.0, 0.0]), ("none", None)], "name string, embedding array<float>"))
    rows = SMALL.project(odd, "name").collect()
    assert len(rows) == n and all(np.isfinite([r["x"], r["y"]]).all() for r in rows)
    if n:
        assert df.select(F.count_distinct("name")).first()[0] == n


def shuffled(spark):
    """Bytes that all stages so far have shuffled."""
    sc = spark.sparkContext
    sc._jsc.sc().listenerBus().waitUntilEmpty()
    none, quantiles = sc._jvm.java.util.ArrayList(), sc._gateway.new_array(sc._jvm.double, 0)
    stages = sc._jsc.sc().statusStore().stageList(None, False, False, quantiles, none)
    return sum(stages.apply(k).shuffleWriteBytes() for k in range(stages.size()))


def test_a_vector_is_sent_once_to_a_group_of_meetings(spark):
    n, d = 600, 256
    units = SMALL.indexed(frame(spark, np.random.default_rng(3).normal(size=(n, d)).astype(np.float32)), "name")
    edges = spark.createDataFrame([(u, (u + k * k) % n, -1.0 + k / 100) for u in range(n) for k in range(1, 9)], "u long, v long, s double").persist()
    edges.count()
    before = shuffled(spark)
    SMALL.descend(units, edges, 0)
    assert shuffled(spark) - before < 17 * n * d * 8 / 4  # 17 members, each with its vector, in doubles


def test_groups_of_meetings_are_bounded():
    assert [L._groups(n, 256 * n, 41) for n in (0, 1, 257, 100_000)] == [1, 1, 2, L.GROUPS]
    for n in (10**6, 10**7, 10**9):
        many = L._groups(n, 256 * n, 41)
        assert 256 * n * (1 - (1 - 1 / many) ** 41) <= L.HELD and many <= max(L.GROUPS, 2 * 41 * 256 * n / L.HELD)


def test_the_graph_of_doubles(spark):
    x = groups(4, 120, 8, 3).astype(float) + 1e-12
    units = SMALL.indexed(spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "name int, embedding array<double>"), "name")
    exact = {(r["query"], r["doc"]) for r in N.nearest(units, units, 8, "idx", "idx", same=True).collect()}
    assert len(exact & {(r["u"], r["v"]) for r in SMALL.graph(units).collect()}) >= 0.97 * len(exact)
