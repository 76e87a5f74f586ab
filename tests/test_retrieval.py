import collections
import itertools
import math

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillmap.operators import blocks as B
from quillmap.operators import joins, retrieval

DEPTHS = (1, 2, 5, 20)


def brute_nearest(queries, corpus, k, same):
    unit = lambda v: np.array(v) / max(np.sqrt((np.array(v) ** 2).sum()), 1e-12)
    out = []
    for q, v in queries:
        scored = [(-(round(float(unit(v) @ unit(w)), 9) + 0.0), d) for d, w in corpus if not (same and d == q)]
        out += [(q, d, n + 1, -s) for n, (s, d) in enumerate(sorted(scored)[:k])]
    return collections.Counter(out)


def brute_measures(ranked, relevant, depth):
    """ranked: query -> documents in order; relevant: query -> {document: gain}."""
    rows = []
    for q, gains in relevant.items():
        gains = {d: g for d, g in gains.items() if g and g > 0}
        if not gains:
            continue
        found = ranked.get(q, [])[:depth]
        dcg = lambda values: sum(g / math.log2(n + 2) for n, g in enumerate(values))
        hits = [n + 1 for n, d in enumerate(found) if d in gains]
        ideal = dcg(sorted(gains.values(), reverse=True)[:depth])
        rows.append((dcg([gains.get(d, 0) for d in found]) / ideal, sum((m + 1) / n for m, n in enumerate(hits)) / len(gains), len(hits) / len(gains), len(hits) / depth, 1 / hits[0] if hits else 0))
    return (len(rows), *(float(np.mean(c)) for c in zip(*rows)))


def frame(spark, rows, name, kind="long"):
    return spark.createDataFrame(rows, f"{name} {kind}, embedding array<float>").repartition(3)


def got(df):
    return collections.Counter(tuple(r) for r in df.collect())


@pytest.mark.parametrize("same", [True, False])
@pytest.mark.parametrize("block", [7, 256])
def test_nearest_with_ties(spark, same, block):
    rng = np.random.default_rng(1)
    vectors = rng.integers(-1, 2, (60, 4)).astype(float)  # few values: many ties, some zero vectors
    corpus = [(k, v.tolist()) for k, v in enumerate(vectors)]
    queries = corpus if same else corpus[:9]
    df = retrieval.nearest(frame(spark, queries, "query"), frame(spark, corpus, "doc"), 5, same=same, block=block)
    assert got(df) == brute_nearest(queries, corpus, 5, same)


def test_fewer_than_k_and_nothing(spark):
    corpus = [(k, [1.0, float(k)]) for k in range(4)]
    df = frame(spark, corpus, "id")
    assert got(retrieval.nearest(df, df, 10, "id", "id", same=True)) == brute_nearest(corpus, corpus, 10, True)
    assert not got(retrieval.nearest(df, df.where("false"), 3, "id", "id"))
    assert not got(retrieval.nearest(df.where("false"), df, 3, "id", "id"))
    odd = frame(spark, [*corpus, (None, [1.0, 1.0]), (9, None)], "id")
    assert got(retrieval.nearest(odd, odd, 10, "id", "id", same=True)) == brute_nearest(corpus, corpus, 10, True)
    with pytest.raises(ValueError):
        retrieval.nearest(df, df, 0, "id", "id")


def test_names_of_any_kind(spark):
    rng = np.random.default_rng(2)
    corpus = [(f"d{k:02d}", v.tolist()) for k, v in enumerate(rng.normal(size=(20, 3)).astype(np.float32).astype(float))]
    df = frame(spark, corpus, "name", "string")
    assert got(retrieval.nearest(df, df, 3, "name", "name", same=True, block=6)) == brute_nearest(corpus, corpus, 3, True)


def test_graded_judgements(spark):
    rng = np.random.default_rng(3)
    corpus = [(k, v.tolist()) for k, v in enumerate(rng.normal(size=(40, 3)).astype(np.float32).astype(float))]
    queries = corpus[:10]
    judged = [(q, int(d), float(g)) for q in range(10) for d, g in zip(rng.permutation(40)[:12], rng.integers(0, 4, 12))]
    judged = [j for j in judged if j[0] != 7] + [(7, 1, 0.0), (8, 500, 3.0), (8, 501, None)]
    found = retrieval.nearest(frame(spark, queries, "query"), frame(spark, corpus, "doc"), max(DEPTHS))
    rows = retrieval.measures(retrieval.judged_by(found, spark.createDataFrame(judged, "query long, doc long, gain double"), max(DEPTHS)), DEPTHS).collect()
    ranked = collections.defaultdict(list)
    for q, d, n, _ in sorted(brute_nearest(queries, corpus, max(DEPTHS), False), key=lambda r: (r[0], r[2])):
        ranked[q].append(d)
    relevant = collections.defaultdict(dict)
    for q, d, g in judged:
        relevant[q][d] = g
    assert sorted(r["depth"] for r in rows) == sorted(DEPTHS)
    for r in rows:
        assert list(r)[1:] == pytest.approx(brute_measures(ranked, relevant, r["depth"]))


def test_labels_with_one_large_label(spark, monkeypatch):
    monkeypatch.setattr(joins, "SHARE", 5)
    rng = np.random.default_rng(4)
    vectors = rng.normal(size=(50, 3)).astype(np.float32).astype(float)
    labels = [None if k == 3 else "alone" if k == 4 else "big" if k % 2 else f"l{k % 5}" for k in range(50)]
    corpus = [(k, v.tolist()) for k, v in enumerate(vectors)]
    df = spark.createDataFrame([(k, v, lab) for (k, v), lab in zip(corpus, labels)], "doc long, embedding array<float>, label string")
    found = retrieval.nearest(df, df, max(DEPTHS), "doc", "doc", same=True, block=16)
    rows = retrieval.measures(retrieval.judged_by_label(found, df, max(DEPTHS)), DEPTHS).collect()
    ranked = collections.defaultdict(list)
    for q, d, n, _ in sorted(brute_nearest(corpus, corpus, max(DEPTHS), True), key=lambda r: (r[0], r[2])):
        ranked[q].append(d)
    relevant = {q: {d: 1.0 for d in range(50) if d != q and labels[d] == labels[q]} for q in range(50) if labels[q]}
    for r in rows:
        assert list(r)[1:] == pytest.approx(brute_measures(ranked, relevant, r["depth"]))


def test_no_query_with_a_relevant_document(spark):
    df = spark.createDataFrame([(1, [1.0], "a"), (2, [2.0], "b")], "doc long, embedding array<float>, label string")
    found = retrieval.nearest(df, df, 3, "doc", "doc", same=True)
    assert retrieval.measures(retrieval.judged_by_label(found, df, 3), (1, 3)).collect() == []
    with pytest.raises(ValueError):
        retrieval.measures((df, df), ())


def test_the_plan_limits_before_the_shuffle(spark):
    df = frame(spark, [(k, [1.0, float(k)]) for k in range(30)], "id")
    plan = retrieval.nearest(df, df, 3, "id", "id")._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan


def test_salted_join_is_a_join(spark, monkeypatch):
    monkeypatch.setattr(joins, "SHARE", 10)
    rows = spark.createDataFrame([(1, k) for k in range(95)] + [(2, 1), (3, 2)], "k long, v long")
    table = spark.createDataFrame([(1, "a"), (2, "b"), (4, "c")], "k long, t string")
    want = got(rows.join(table, ["k"], "left"))
    assert got(joins.salted_join(rows, table, ["k"], "v", how="left")) == want
    skewed = joins.salted_join(rows.repartition(1), table, ["k"], "v").select("k", F.spark_partition_id().alias("p"))
    assert skewed.where("k = 1").agg(F.count_distinct("p")).first()[0] >= 1


def test_a_block_goes_to_as_many_tasks_whatever_the_corpus(spark):
    def seen(met):
        for _, cell in itertools.groupby(met, lambda m: m[0]):
            pairs = [(a["doc"][0], b["doc"][0]) for _, a, b in cell]
            yield {"left": [len({a for a, _ in pairs})], "right": [len({b for _, b in pairs})], "pairs": [len(set(pairs))]}

    schema = pa.schema([(c, pa.int64()) for c in ("left", "right", "pairs")])
    for n in (160, 320):
        blocks = spark.range(n).select(F.col("id").alias("b"), F.array("id").alias("doc"), F.array(F.lit(1.0)).alias("flat"))
        sums = B.meetings(blocks, blocks, seen, schema, "left long, right long, pairs long").groupBy().sum().first()
        assert list(sums) == [n * B.CORPUS_GROUPS, n * B.QUERY_GROUPS, n * n]
