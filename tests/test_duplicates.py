import collections
import random

import pytest
from pyspark.sql import functions as F

from quillmap.operators import articles as A
from quillmap.streaming import duplicates as D

SCHEMA = "article_id string, content string, is_valid boolean, cleaning_reason string"


def expected(rows):
    first = {}
    for i, content, *_ in rows:
        if content is not None:
            first[content] = min(i, first.get(content, i))
    again = lambda i, c: c is not None and i != first[c]
    return {i: (False, "duplicate") if again(i, c) else (v, r) for i, c, v, r in rows}


def found(df):
    return {r["article_id"]: (r["is_valid"], r["cleaning_reason"]) for r in df.collect()}


def sample(seed, n=300):
    rng = random.Random(seed)
    texts = ["common text", "Common text", "common text ", "", *(f"text {k}" for k in range(120))]
    rows = [(f"article_{rng.random():.12f}", None if rng.random() < 0.05 else "common text" if rng.random() < 0.33 else rng.choice(texts)) for _ in range(n)]
    return [(i, c, *rng.choice([(True, None), (None, None), (False, "too_short"), (False, "duplicate")])) for i, c in rows]


def test_marks_by_brute_force(spark):
    rows = sample(1)
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    assert found(A.mark_duplicates(df)) == expected(rows)
    want = {i for i, (v, r) in expected(rows).items() if r == "duplicate" and dict((x[0], x[3]) for x in rows)[i] != "duplicate"}
    assert {r["article_id"] for r in A.newly_duplicate(df).collect()} == want
    assert found(A.mark_duplicates(df.where("false"))) == {}


def test_many_duplicates_are_joined_instead_of_sent(spark, monkeypatch):
    monkeypatch.setattr(A, "BROADCAST_IDS", 3)
    rows = sample(2)
    assert found(A.mark_duplicates(spark.createDataFrame(rows, SCHEMA))) == expected(rows)


def test_no_exchange_has_the_content(spark):
    df = spark.createDataFrame(sample(3), SCHEMA)
    plan = A.mark_duplicates(df)._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" in plan and "hashpartitioning" not in plan


def test_a_third_of_a_million_rows_is_dealt_evenly(spark):
    n = 1_000_000
    content = F.when(F.col("id") % 3 == 0, F.lit("one text")).otherwise(F.concat(F.lit("text "), (F.col("id") % 600_000).cast("string")))
    df = spark.range(0, n, 1, 8).select(F.format_string("a%08d", "id").alias("article_id"), content.alias("content"))
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # the plan itself has to be even
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        groups = A.content_groups(df)
        several = A.cut(groups.where("n_rows > 1"))
        keyed = df.select(A._digest("content"), "article_id")
        joined = A.salted_join(keyed, several.select("_digest", "_first"), ["_digest"], "article_id", several)
        sizes = [r["count"] for r in joined.groupBy(F.spark_partition_id()).count().collect()]
        assert sum(sizes) > n // 3 and max(sizes) < 2 * sorted(sizes)[len(sizes) // 2]
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def files(spark, folder, rows, k):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(folder)


@pytest.mark.parametrize("stop", [False, True])
def test_a_stream_gives_the_result_of_one_batch(spark, tmp_path, monkeypatch, stop):
    table, target, checkpoint = (str(tmp_path / n) for n in ("articles", "groups", "checkpoint"))
    rows = sample(4, 240)
    parts = [rows[k : k + 40] for k in range(0, 240, 40)]
    for k, part in enumerate(parts):
        files(spark, table, part, k)
        if stop and k in (1, 3):  # the batch is written, but the query dies before it is committed
            kept = D.A.content_groups

            def put_and_die(batch, number):
                batch.withColumn("batch", F.lit(number)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(target)
                raise RuntimeError("stopped")

            stream = kept(D.article_stream(spark, table)).writeStream.outputMode("update").foreachBatch(put_and_die)
            with pytest.raises(Exception, match="stopped"):
                stream.option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
        D.start(D.article_stream(spark, table, 1), target, checkpoint).awaitTermination()
        so_far = [r for p in parts[: k + 1] for r in p]
        if k in (0, 3, 5):
            assert found(D.marked(spark.read.parquet(table), spark, target)) == expected(so_far)
    got = {bytes(r["_digest"]): (r["_first"], r["n_rows"]) for r in D.groups(spark, target).collect()}
    want = {bytes(r["_digest"]): (r["_first"], r["n_rows"]) for r in A.content_groups(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == want and collections.Counter(n for _, n in got.values())


def test_a_smaller_id_that_comes_late_corrects_the_first(spark, tmp_path):
    table, target, checkpoint = (str(tmp_path / n) for n in ("articles", "groups", "checkpoint"))
    for k, name in enumerate(("m", "z", "a")):
        files(spark, table, [(name, "same", True, None)], k)
        D.start(D.article_stream(spark, table), target, checkpoint).awaitTermination()
        marks = found(D.marked(spark.read.parquet(table), spark, target))
        assert [i for i, (v, _) in marks.items() if v] == [min("mza"[: k + 1])]
