import collections
import hashlib
import itertools
import json
import math

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillmap.functions import vectors as V
from quillmap.operators import blocks as B
from quillmap.operators import chunking as C
from quillmap.operators import exact as X
from quillmap.operators import geometry as G
from quillmap.operators import pairs as P
from quillmap.operators import runs as R
from quillmap.operators import summary as S
from quillmap.operators.ranks import numbered, ranked

SCHEMA = "article string, position int, embedding array<double>"


def _vectors(spark, groups):
    return spark.createDataFrame([(a, k, list(map(float, v))) for a, vs in groups.items() for k, v in enumerate(vs)], SCHEMA)


def test_norms(spark):
    r = G.norm_stats(spark.createDataFrame([([1.0, 0.0],), ([3.0, 4.0],), ([float("nan"), 0.0],)], "embedding array<double>")).first()
    assert (r["count"], r["finite"], r["normalised"], r["min"], r["mean"], r["mean_square"], r["max"], r["std"]) == (3, 2, 1, 1, 3, 13, 5, 2)


def test_components(spark):
    r = G.component_diagnostics(spark.createDataFrame([([1.0, -0.5],), ([0.0, 2.0],), ([-0.25, -1.0],)], "embedding array<double>")).first()
    assert tuple(r) == (3, 2, -1.0, 0)


def test_zero_vector_stays_zero(spark):
    assert spark.createDataFrame([([0.0, 0.0],)], "v array<double>").select(V.unit(F.col("v"))).first()[0] == [0.0, 0.0]


def test_pair_means_by_enumeration(spark):
    rng = np.random.default_rng(1)
    groups = {a: rng.normal(size=(n, 4)) for a, n in (("a", 3), ("b", 1), ("c", 4))}
    got = G.pair_means(_vectors(spark, groups)).first()
    flat = [(a, v / np.linalg.norm(v)) for a, vs in groups.items() for v in vs]
    cos = [(x[0] == y[0], float(x[1] @ y[1])) for x, y in itertools.combinations(flat, 2)]
    mean = lambda xs: sum(xs) / len(xs)
    assert got["mean_all"] == pytest.approx(mean([c for _, c in cos]))
    assert got["mean_same"] == pytest.approx(mean([c for s, c in cos if s]))
    assert got["mean_cross"] == pytest.approx(mean([c for s, c in cos if not s]))


def test_transitions_of_a_fixture(spark):
    t = G.transitions(_vectors(spark, {"x": [(1, 0), (1, 1), (0, 1)], "y": [(1, 0), (0, 1)]}))
    assert sorted(r["cosine"] for r in t.collect()) == pytest.approx([0.0, 2**-0.5, 2**-0.5])
    with pytest.raises(ValueError):
        G.intra_consistency(_vectors(spark, {"x": [(1, 0)]}), drop_threshold=2.0)


def test_davies_bouldin_of_near_twins(spark):
    v = _vectors(spark, {"a": [(1, 0), (0.99, 0.01)], "b": [(1, 1e-6), (0.99, 0.010001)], "c": [(0, 1), (0.01, 0.99)]})
    r = G.davies_bouldin(v, trim=0.34, block=2).first()
    assert r["min_centroid_distance"] < 1e-5 and r["max_ratio"] > 1000
    assert r["trimmed_index"] < r["index"] and r["top_1_percent_share"] > 0.3
    with pytest.raises(ValueError):
        G.davies_bouldin(_vectors(spark, {"a": [(1, 0), (0, 1)]}))


def test_davies_bouldin_and_silhouette_by_numpy(spark):
    rng = np.random.default_rng(2)
    groups = {f"g{k}": rng.normal(size=(5, 6)) + 3 * rng.normal(size=6) for k in range(7)}
    v = _vectors(spark, groups)
    units = {a: x / np.linalg.norm(x, axis=1, keepdims=True) for a, x in groups.items()}
    c = {a: x.mean(0) for a, x in units.items()}
    s = {a: np.linalg.norm(x - c[a], axis=1).mean() for a, x in units.items()}
    worst = [max((s[a] + s[b]) / np.linalg.norm(c[a] - c[b]) for b in c if b != a) for a in c]
    assert G.davies_bouldin(v, block=3).first()["index"] == pytest.approx(np.mean(worst))
    flat, label = np.concatenate(list(units.values())), np.repeat(np.arange(7), 5)
    d = 1 - flat @ flat.T
    score = []
    for i in range(len(flat)):
        mean = [d[i, label == k].sum() / ((label == k).sum() - (k == label[i])) for k in range(7)]
        b = min(m for k, m in enumerate(mean) if k != label[i])
        score.append((b - mean[label[i]]) / max(b, mean[label[i]]))
    assert G.silhouette(v) == pytest.approx(np.mean(score))
    covariance = np.linalg.eigvalsh(np.cov(flat.T))[::-1]
    assert G.pca_ratios(v).first()["pc1"] == pytest.approx(covariance[0] / covariance.sum())


def seeded(ids, size, seed):
    return sorted(ids, key=lambda a: hashlib.md5(f"{seed}|{a}".encode()).hexdigest())[:size]


def test_cohorts(spark):
    ids = [f"article-{k:02d}" for k in range(20)]
    rng = np.random.default_rng(3)
    v = _vectors(spark, {a: rng.normal(size=(3, 4)) for a in ids})
    pool = v.select("article").distinct()
    got = {(r["seed"], r["article"]) for r in G.cohorts(pool, 8, [42, 43]).collect()}
    assert got == {(s, a) for s in (42, 43) for a in seeded(ids, 8, s)}
    with pytest.raises(ValueError):
        G.cohorts(pool, 21, [42])
    r = G.cohort_davies_bouldin(v, pool, 8, [43, 42]).first()
    one = [G.davies_bouldin(v.where(F.col("article").isin(seeded(ids, 8, s)))).first()["index"] for s in (43, 42)]
    assert r["mean_index"] == pytest.approx(np.mean(one)) and r["std_index"] == pytest.approx(np.std(one))
    assert json.loads(r["cohort_scores"]) == pytest.approx(one)


def test_silhouette_with_lone_vectors(spark):
    v = _vectors(spark, {"a": [(1, 0), (1, 0.1)], "b": [(0, 1)], "c": [(0, 1), (0.1, 1)]})
    own = {"a": [(1, 0), (1, 0.1)], "b": [(0, 1)], "c": [(0, 1), (0.1, 1)]}
    unit = lambda x: np.array(x) / np.linalg.norm(x)
    score = []
    for a, xs in own.items():
        for k, x in enumerate(xs):
            mean = {b: np.mean([1 - unit(x) @ unit(y) for j, y in enumerate(ys) if (b, j) != (a, k)]) for b, ys in own.items() if len(ys) > 1 or b != a}
            if a not in mean:
                score.append(0.0)
                continue
            b = min(m for c, m in mean.items() if c != a)
            score.append((b - mean[a]) / max(b, mean[a]))
    assert G.silhouette(v, block=2) == pytest.approx(np.mean(score))
    assert G.silhouette(v.where("article = 'a'")) is None


def test_norm_sums_can_be_merged(spark):
    rows = [([1.0, 0.0],), ([3.0, 4.0],), ([float("nan"), 0.0],), ([0.6, 0.8],)]
    whole = spark.createDataFrame(rows, "embedding array<double>")
    parts = [G.norm_sums(spark.createDataFrame(rows[k : k + 2], "embedding array<double>")) for k in (0, 2)]
    assert G.finished_norms(G.merged_norm_sums(parts[0].unionByName(parts[1]))).first() == G.norm_stats(whole).first()


def test_ranks_in_groups(spark):
    rng = np.random.default_rng(4)
    rows = [(f"k{rng.integers(0, 3)}", float(x), k) for k, x in enumerate(rng.permutation(300))]
    df = spark.createDataFrame(rows, "key string, x double, id int").repartition(5)
    want = {i: sorted(x for k2, x, _ in rows if k2 == k).index(x) for k, x, i in rows}
    assert {r["id"]: r["rank"] for r in ranked(df, ["key"], ["x"]).collect()} == want
    assert {r["id"]: r["idx"] for r in numbered(df, ["x"]).collect()} == {i: sorted(x for _, x, _ in rows).index(x) for _, x, i in rows}
    even = P.balanced(df.withColumn("c", F.col("id") % 7 == 0), ["key"], "c", F.col("x"))
    sizes = {(r["key"], r["c"]): r["count"] for r in even.groupBy("key", "c").count().collect()}
    assert all(sizes[k, True] == sizes[k, False] == sum(k2 == k and i % 7 == 0 for k2, _, i in rows) for k in ("k0", "k1", "k2"))


def test_shared_eligibility(spark):
    rows = [("1", "a", 2), ("1", "b", 2), ("1", "c", 1), ("2", "a", 2), ("2", "b", 1), ("2", "c", 2)]
    df = spark.createDataFrame(rows, "embedding_run_id string, article_id string, n_chunks int")
    assert [r[0] for r in G.shared_eligible(df, ["1", "2"], 2).collect()] == ["a"]


def test_weighted_degradation(spark):
    chunks = spark.createDataFrame([("a", [1.0, 0.0], 1), ("a", [0.0, 1.0], 3)], "article string, embedding array<double>, chunk_length int")
    whole = spark.createDataFrame([("a", [0.0, 2.0])], "article string, embedding array<double>")
    r = G.degradation(whole, chunks, 2, min_chunks=2).first()
    assert r["similarity"] == pytest.approx(0.75 / math.hypot(0.25, 0.75)) and r["total_length"] == 4


def test_ranks_are_a_bijection():
    for n in range(2, 12):
        assert [P.pair_of_rank(n, r) for r in range(n * (n - 1) // 2)] == list(itertools.combinations(range(n), 2))
    n = 10**9
    assert P.pair_of_rank(n, n * (n - 1) // 2 - 1) == (n - 2, n - 1)
    with pytest.raises(ValueError):
        P.pair_of_rank(4, 6)


def test_pair_samples(spark):
    sizes = {"a": 3, "b": 2, "c": 2, "d": 1}
    rows = [(article, k) for article, n in sizes.items() for k in range(n)]
    units = spark.createDataFrame([(a, k, i) for i, (a, k) in enumerate(rows)], "article string, position int, idx long")
    every = list(itertools.combinations(range(8), 2))
    cross = [(i, j) for i, j in every if rows[i][0] != rows[j][0]]
    pairs = lambda df: sorted((r["i"], r["j"]) for r in df.collect())
    assert pairs(P.cross_article_pairs(units, 100, 1)) == cross
    some = pairs(P.cross_article_pairs(units, 8, 1))
    assert len(set(some)) == 8 and set(some) <= set(cross)
    assert pairs(P.same_article_pairs(units, 100, 1)) == [(i, j) for i, j in every if (i, j) not in cross]
    assert len(set(pairs(P.same_article_pairs(units, 3, 1)))) == 3
    assert pairs(P.transition_pairs(units, 9, 1)) == [(0, 1), (1, 2), (3, 4), (5, 6)]
    counts = collections.Counter(p for seed in range(60) for p in P.sample_ranks(5, 2, seed))
    assert set(counts) == set(range(5)) and min(counts.values()) > 10


def test_exact_similarities_by_numpy(spark):
    rng = np.random.default_rng(5)
    groups = {f"g{k}": rng.normal(size=(int(rng.integers(1, 6)), 5)) for k in range(9)}
    got = P.exact_similarities(_vectors(spark, groups), block=4).collect()
    flat = [(a, x / np.linalg.norm(x)) for a, xs in groups.items() for x in xs]
    want = collections.Counter()
    for (a, x), (b, y) in itertools.combinations(flat, 2):
        want["positive" if a == b else "negative", min(a, b), max(a, b), round(float(x @ y), 9)] += 1
    for a, xs in groups.items():
        for x, y in itertools.pairwise(xs):
            want["transition", a, a, round(float(x @ y / np.linalg.norm(x) / np.linalg.norm(y)), 9)] += 1
    assert collections.Counter((r["distribution"], r["article_a"], r["article_b"], round(r["cosine"], 9)) for r in got) == want


def test_sums_over_all_pairs_are_those_of_the_pairs(spark, monkeypatch):
    monkeypatch.setattr(B, "GROUPS", 3)
    rng = np.random.default_rng(6)
    groups = {str(k): rng.normal(size=(int(rng.integers(1, 30)), 5)) for k in range(9)}
    v = _vectors(spark, groups)
    v = v.withColumn("article", F.col("article").cast("long"))
    rows = P.exact_similarities(v, block=4).persist()
    near = lambda a, b: [tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in sorted(map(tuple, a.collect()))] == [tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in sorted(map(tuple, b.collect()))]
    want = rows.groupBy("distribution").agg(F.count("*"), F.avg("cosine"), F.stddev_pop("cosine"))
    assert near(X.summary(v, block=4), want)
    assert near(X.histogram(v, 20, block=4), P.histogram(rows, ["distribution"], "cosine", 20))
    trains = lambda a, b: (a + b) % 4 < 2
    xy = rows.where("distribution != 'transition'").select(F.round("cosine", 9).alias("x"), (F.col("distribution") == "positive").cast("int").alias("y"), trains(F.col("article_a"), F.col("article_b")).alias("train"))
    train, test = xy.where("train"), xy.where("not train")
    assert near(X.gaussian_naive_bayes(v, trains, block=4), P.confusion(P.gaussian_predict(test, P.gaussian_model(train))))
    assert near(X.histogram_naive_bayes(v, trains, block=4), P.confusion(P.histogram_predict(test, P.histogram_model(train))))


def test_a_block_with_itself_is_read_once(spark):
    """Two readers of a block may see its rows in two orders, which lost some pairs and doubled others."""

    def shuffled(batches):
        for batch in batches:
            yield batch.take(pa.array(np.random.default_rng().permutation(batch.num_rows)))

    v = _vectors(spark, {"x": np.random.default_rng(7).normal(size=(40, 5))}).coalesce(1)
    restless = v.mapInArrow(shuffled, v.schema)
    pairs = [(r["cosine"]) for r in P.exact_similarities(restless).where("distribution = 'positive'").collect()]
    assert len({round(c, 9) for c in pairs}) == len(pairs) == 40 * 39 // 2 and max(pairs) < 0.999


def test_no_pairs_of_articles_without_a_name(spark):
    v = spark.createDataFrame([(1, 0, [1.0, 0.0]), (1, 1, [1.0, 1.0]), (None, 2, [0.0, 1.0]), (2, 3, [0.0, 2.0])], "article int, position long, embedding array<float>")
    counts = {r["distribution"]: r["n"] for r in X.summary(v).collect()}
    assert counts == {"negative": 2, "positive": 1, "transition": 1}
    assert not X.summary(v.where("false")).collect() and not X.histogram(v.where("false"), 5).collect()


def test_sampled_pairs_of_a_fixture(spark):
    v = _vectors(spark, {"x": [(1, 0), (1, 1), (0, 1)], "y": [(1, 0), (0, 1)]})
    assert P.sampled_pairs(v, ["article", "position"], 4).count() == 4
    assert P.sampled_pairs(v, ["article", "position"], 99).count() == 10


def test_split_is_disjoint(spark):
    sizes = {f"p{k}": 2 for k in range(10)} | {"s0": 1, "s1": 1}
    frame = lambda n: spark.createDataFrame([(a, k) for a, m in n.items() for k in range(m)], "article string, position int")
    split = {r["article"]: r["split"] for r in P.split_articles(frame(sizes), 0.2, 42).collect()}
    assert sorted(split) == sorted(sizes)
    tests = sorted((a for a in sizes if sizes[a] > 1), key=lambda a: hashlib.md5(f"52|{a}".encode()).hexdigest())[:2]
    assert sorted(a for a in sizes if sizes[a] > 1 and split[a] == "test") == sorted(tests)
    with pytest.raises(ValueError):
        P.split_articles(frame({"a": 2, "b": 2, "c": 2}), 0.2, 42)
    assert [P.test_count(n, 0.25, 2) for n in (4, 10, 14, 100)] == [2, 2, 4, 25] and P.test_count(2, 0.25, 0) == 0
    assert P.test_limit(10, 0.2) == 2 and P.test_limit(2, 0.9) == 1


def test_naive_bayes_on_separate_classes(spark):
    def rows(a, b, n):
        return [(float(x), y) for y, (lo, hi) in enumerate((a, b)) for x in np.linspace(lo, hi, n)]

    train = spark.createDataFrame(rows((0.05, 0.25), (0.70, 0.90), 80), "x double, y int")
    test = spark.createDataFrame(rows((0.08, 0.22), (0.72, 0.88), 20), "x double, y int")
    assert [r["accuracy"] for r in P.classify(train, test).collect()] == [1.0, 1.0]
    with pytest.raises(ValueError):
        P.histogram_model(train, smoothing=0)


def test_histograms(spark):
    df = spark.createDataFrame([("short", x) for x in (5, 8, 10)] + [("long", x) for x in (20, 25, 30)], "run string, x int")
    h = P.histogram(df, ["run"], "x", 5)
    rows = h.collect()
    assert len(rows) == 10 and sum(r["count"] for r in rows) == 6
    assert {(r["left"], r["right"]) for r in rows} == {(5.0 + 5 * k, 10.0 + 5 * k) for k in range(5)}
    area = P.area_normalised(h.withColumn("density", F.col("density") * 7), ["run"]).groupBy("run").agg(F.sum(F.expr("density * (right - left)")).alias("a"))
    assert [r["a"] for r in area.collect()] == pytest.approx([1.0, 1.0])
    with pytest.raises(ValueError):
        P.histogram(spark.createDataFrame([("r", 0)], "run string, x int"), ["run"], "x", 5, log_x=True)
    assert P.histogram(df.where("x < 0"), ["run"], "x", 5).count() == 0


def test_chunk_summary_fixture(spark):
    rows = [("r", "a", 0, "one two abc"), ("r", "a", 1, "abc fourth"), ("r", "a", 2, "unrelated"), ("r", "b", 0, "another article")]
    r = C.chunk_summary(spark.createDataFrame(rows, "chunking_run_id string, article_id string, chunk_index int, text string")).first()
    assert (r["num_articles"], r["num_chunks"], r["mean_chunks_per_article"], r["median_chunks_per_article"]) == (2, 4, 2.0, 2.0)
    assert (r["overlap_transition_percent"], r["mean_positive_overlap_percent"]) == (50.0, 30.0)
    rows = [("r", "a", 0, "x"), ("t", "a", 0, "The tokenization overlap"), ("t", "a", 1, "##ization overlap continues"), ("u", "a", 0, "ab"), ("u", "a", 1, "##b")]
    runs = C.chunk_summary(spark.createDataFrame(rows, "chunking_run_id string, article_id string, chunk_index int, text string"), token_chunks=F.col("chunking_run_id") == "t")
    got = {r["chunking_run_id"]: (r["num_transitions"], r["overlap_transition_percent"], r["mean_positive_overlap_percent"]) for r in runs.collect()}
    assert got["r"] == (0, None, None) and got["u"] == (1, 0.0, None) and got["t"][:2] == (1, 100.0)
    assert got["t"][2] == pytest.approx(100 * len("ization overlap") / len("ization overlap continues"))
    assert C.suffix_prefix_length("The tokenization overlap", "ization overlap continues") == len("ization overlap")
    assert C.suffix_prefix_length("", "a") == 0


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab", max_size=40), st.text(alphabet="ab", max_size=40))
def test_overlaps_by_brute_force(before, after):
    want = max((k for k in range(min(len(before), len(after)) + 1) if before.endswith(after[:k])))
    assert C.suffix_prefix_length(before, after) == want == C._by_prefix_function(before, after)
    long = before * 90
    want = max((k for k in range(min(len(long), len(after * 40)) + 1) if long.endswith((after * 40)[:k])))
    assert C.suffix_prefix_length(long, after * 40) == want


def test_chunks_lose_images_and_are_numbered(spark):
    text = "![](images/only.jpg)\n\nFirst ![](images/inline.jpg) chunk\n\nSecond chunk"
    df = spark.createDataFrame([("a", text), ("b", " "), ("c", None)], "article_id string, content string")
    assert [(r["chunk_index"], r["text"]) for r in C.chunk(df, "paragraph").collect()] == [(0, "First chunk"), (1, "Second chunk")]
    with pytest.raises(ValueError):
        C.chunk(df, "token", token_count=2, token_overlap=2)


def test_recursive_split():
    text = "Alpha beta gamma. " * 30 + "\n\n" + "delta " * 50
    for size, overlap in ((80, 20), (50, 0), (7, 3)):
        chunks = C.split_text(text, size, overlap)
        assert max(map(len, chunks)) <= size
        if not overlap:
            assert "".join(chunks) == text
    assert C.split_text("abcdefghij", 4, 0) == ["abcd", "efgh", "ij"]


def test_embedding_skips_failed_batches(spark):
    def model():
        def encode(texts):
            if "bad" in texts:
                raise RuntimeError("no")
            return [[len(t), 1.0] for t in texts]

        return encode

    chunks = spark.createDataFrame([(1, "ab"), (2, "bad"), (3, "c")], "chunk_id int, text string").coalesce(1)
    done = C.embed(chunks, model, 2, batch_size=1).withColumn("embedding_run_id", F.lit("r"))
    assert sorted(r["chunk_id"] for r in done.collect()) == [1, 3]
    assert [r["chunk_id"] for r in C.unembedded(chunks, done, "r").collect()] == [2]


def _runs(spark):
    rows = [("noop-run", "m", "noop", "noop", 3), ("p-run", "m", "paragraph", "paragraph", 4), ("t-run", "m", "token", "token", 5), ("x-run", "m", "sentence", "sentence", 0)]
    return spark.createDataFrame(rows, "embedding_run_id string, model_id string, chunking_run_id string, chunking_method string, embedding_count long").withColumn("created_at", F.lit(1))


def test_run_lookup(spark):
    runs = _runs(spark)
    assert [r["embedding_run_id"] for r in R.chunk_runs(runs, "m")] == ["p-run", "t-run"]
    assert R.article_run(runs, "m")["embedding_run_id"] == "noop-run"
    for call in (lambda: R.require_run(runs, "?"), lambda: R.chunk_runs(runs), lambda: R.article_run(runs, "m", "p-run"), lambda: R.chunk_runs(runs, "other")):
        with pytest.raises(ValueError):
            call()
    with pytest.raises(ValueError, match="Multiple embedding runs"):
        R.chunk_runs(runs.unionByName(runs.where("embedding_run_id = 'p-run'").withColumn("embedding_run_id", F.lit("p2"))), "m")


def test_resume():
    run = {"model_id": "m", "config_json": '{"chunking_run_id": "c", "transformer_kwargs": {"a": 1}}'}
    R.check_resume(run, "m", "c", {"a": 1})
    for args, name in ((("n", "c", {"a": 1}), "model-id"), (("m", "d", {"a": 1}), "chunking-run-id"), (("m", "c", {}), "transformer-kwargs")):
        with pytest.raises(ValueError, match=name):
            R.check_resume(run, *args)


def test_scope():
    assert R.select_scope(["a", "b", "c"], ["c", "a"], ["a"]) == ["c"]
    for args in ((["a"], ["b"], None), (["a"], None, ["a"]), (["a"], None, ["b"])):
        with pytest.raises(ValueError):
            R.select_scope(*args)


def test_benchmark_report(spark):
    r = R.benchmark_report(spark.createDataFrame([("a", None), ("b", "failed")], "task string, error string"), ["a", "b"]).first()
    assert (r["completed"], r["failed"], r["is_complete"]) == (["a"], ["b"], False)


def test_derived_metrics(spark):
    df = spark.createDataFrame([(0.08, 0.25, 0.65), (0.08, 0.65, 0.25), (0.08, 0.25, 0.25), (0.08, 1.0, None), (-0.1, 0.2, 0.5)], "d double, n double, p double")
    got = df.select(S.degradation_share(F.col("d"), F.col("n"), F.col("p")).alias("s"), S.retained_similarity(F.col("d"), F.col("n")).alias("r")).collect()
    assert got[0]["s"] == pytest.approx(1 / 6) and got[0]["r"] == pytest.approx(0.67 / 0.75)
    assert got[1]["s"] is None and got[2]["s"] == 1.0 and got[3]["r"] is None and got[4]["s"] is None


def test_merge_needs_equal_keys(spark):
    a = spark.createDataFrame([("m", "s", 1.0)], "model_id string, chunking_strategy string, x double")
    b = spark.createDataFrame([("m", "t", 1.0)], "model_id string, chunking_strategy string, x double")
    assert S.merge({"a": a, "c": a}).columns == ["model_id", "chunking_strategy", "a_x", "c_x"]
    with pytest.raises(ValueError):
        S.merge({"a": a, "b": b})
    with pytest.raises(ValueError):
        S.check_unique(a.unionByName(a))
    with pytest.raises(ValueError):
        S.column_order(["a", "b"], ["a"])


def test_rendering(spark):
    df = spark.createDataFrame([(0.72457,), (None,)], "x double")
    assert [r[0] for r in df.select(S.format_metric(F.col("x"))).collect()] == ["0.7246", "--"]
    assert df.select(S.format_metric(F.col("x"), "percent")).first()[0] == r"72.46\%"
    table = S.latex_table(spark.createDataFrame([("a_b", 0.5)], "m string, x double"), {"m": "Model", "x": "Value"}, "A & B", "tab:x", {"x": "decimal"})
    assert r"a\_b & 0.5000 \\" in table and r"\caption{A \& B}" in table
    assert S.latex_escape("a_b#", "_") == r"a\_b#"


def test_order_and_series(spark):
    df = spark.createDataFrame([("m", "token_256_64"), ("m", "zeta"), ("m", "paragraph"), ("n", "token_256_0"), ("m", "alpha")], "model_id string, chunking_strategy string")
    assert [r[1] for r in S.ordered(df, ["n", "m"], ["paragraph"]).collect()] == ["token_256_0", "paragraph", "alpha", "token_256_64", "zeta"]
    assert [r["overlap"] for r in S.overlap_series(df).collect()] == [64, 0]
    assert S.missing_cells(S.complete_grid(df.withColumn("x", F.lit(1)), ["m"], ["zeta", "none"]), "x").first()[0] == 1


def split_plainly(text, size, overlap, separators=("\n\n", "\n", ". ", " ")):
    """The rule in other words: cut at the coarsest separator that is there, pieces that are too long
    at the next ones; then fill chunks, each beginning with the last whole pieces that fit the overlap."""

    def cut(part, k):
        if len(part) <= size:
            return [part] if part else []
        while k < len(separators) and separators[k] not in part:
            k += 1
        if k == len(separators):
            return [part[:size], *cut(part[size:], k)]
        first, rest = part.split(separators[k], 1)
        first += separators[k]
        return [*cut(first, k + 1), *(cut_rest(rest, k))]

    def cut_rest(part, k):  # what is left of a part that was cut at separator k is cut there on
        if separators[k] not in part:
            return cut(part, k + 1)
        first, rest = part.split(separators[k], 1)
        return [*cut(first + separators[k], k + 1), *cut_rest(rest, k)]

    chunks, now = [], []
    for piece in cut(text, 0):
        if now and sum(map(len, now)) + len(piece) > size:
            chunks.append("".join(now))
            while now and (sum(map(len, now)) > overlap or sum(map(len, now)) + len(piece) > size):
                now = now[1:]
        now = [*now, piece]
    return [*chunks, "".join(now)] if now else chunks


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab. \n", max_size=120), st.integers(2, 25), st.integers(0, 20))
def test_recursive_chunks_by_the_rule(text, size, overlap):
    if overlap < size:
        assert C.split_text(text, size, overlap) == split_plainly(text, size, overlap)


def test_windows_of_a_tokenizer_file(spark):
    from public_tokenizers import path
    from tokenizers import Tokenizer

    file, texts = path("byte_bpe_50k.json"), ["Parliament discussed several important questions, yesterday evening. " * 3, "one", "é漢 two"]
    df = spark.createDataFrame(list(enumerate(texts)), "article_id int, content string")
    t = Tokenizer.from_file(file)
    for count, overlap in ((7, 0), (8, 3), (100, 10)):
        rows = C.chunk(df, "token", tokenizer=file, token_count=count, token_overlap=overlap).collect()
        for k, text in enumerate(texts):
            ids = t.encode(text, add_special_tokens=False).ids
            starts = [0]
            while starts[-1] + count < len(ids):
                starts.append(starts[-1] + count - overlap)
            want = [x for x in (t.decode(ids[s : s + count]).strip() for s in starts) if x]
            assert [r["text"] for r in sorted(rows, key=lambda r: r["chunk_index"]) if r["article_id"] == k] == want
    counted = df.select(F.size(C.library_token_count(file)(F.col("content")))).collect()
    assert [r[0] for r in counted] == [len(t.encode(x, add_special_tokens=False).ids) for x in texts]
