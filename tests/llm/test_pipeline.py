import collections

from pyspark.sql import functions as F

import corpus_pipeline
from quillmap.llm import mixing, packing, pseudonyms, quality_lines
from tests.llm.test_operators import check_slots, linked, one_by_one


def test_stages_by_brute_force(spark, odd_docs, no_docs, sf_dir):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality_rules", "near_duplicate_join", "pii", "source_mixing", "best_fit_packing"]
    docs = odd_docs.select("doc_id", "text", "lang", "source", "n_chars")
    stages = dict(corpus_pipeline.STAGES)

    kept = stages["quality_rules"](spark, docs, sf_dir)
    assert kept.columns == docs.columns
    judged = quality_lines.judge(docs).where("kept")
    assert sorted((r["doc_id"] or -1) for r in kept.collect()) == sorted((r["doc_id"] or -1) for r in judged.collect())
    assert kept.where("n_chars != length(text)").count() == 0

    single = stages["near_duplicate_join"](spark, kept, sf_dir)
    assert single.columns == docs.columns
    rows = [r for r in kept.collect() if r["doc_id"] is not None]
    rows.sort(key=lambda r: r["doc_id"])
    roots = linked([r["text"] for r in rows])[1]
    want = collections.Counter(rows[k]["doc_id"] for k in set(roots))  # one row of each group, also of equal rows
    assert collections.Counter(r["doc_id"] for r in single.collect() if r["doc_id"] is not None) == want

    extra = [(900, "write to anna@mail.example.com or 10.0.0.1 " + "word " * 30, "en", "s1", 9)]
    single = single.unionByName(spark.createDataFrame(extra, docs.schema))
    hidden = stages["pii"](spark, single, sf_dir)
    names = pseudonyms.Pseudonyms(corpus_pipeline.KEY)
    want = collections.Counter((r["doc_id"], None if r["text"] is None else names(r["text"])[0], r["source"]) for r in single.collect())
    assert hidden.columns == docs.columns
    assert collections.Counter((r["doc_id"], r["text"], r["source"]) for r in hidden.collect()) == want
    assert hidden.where("n_chars != length(text)").count() == 0

    mixed = stages["source_mixing"](spark, hidden, sf_dir)
    assert mixed.columns == docs.columns
    sizes, longest, taken = collections.Counter(), collections.Counter(), collections.Counter()
    for r in hidden.collect():
        n = len((r["text"] or "").split())
        sizes[r["source"]] += n
        longest[r["source"]] = max(longest[r["source"]], n)
    for r in mixed.collect():
        taken[r["source"]] += len((r["text"] or "").split())
    order = sorted(sizes, key=lambda x: (x is None, (x or "").encode()))
    targets = mixing.water_fill([float(sizes[x]) for x in order], [(5.0, 2.0, 1.0)[k % 3] for k in range(len(order))], 1.5 * sum(sizes.values()), 2.0)
    assert all(abs(taken[x] - t) <= longest[x] for x, t in zip(order, targets))
    mixed_rows, kept_rows = (collections.Counter((r["doc_id"], r["text"], r["source"]) for r in df.collect()) for df in (mixed, hidden))
    assert all(n <= 2 * kept_rows[r] for r, n in mixed_rows.items())

    packed = stages["best_fit_packing"](spark, mixed, sf_dir).collect()
    encode = packing.encoder(packing.default_tokenizer()).many
    tokens = sum(n * (len(encode([(text or "").encode()])[0]) // 4 + 1) for (_, text, _), n in mixed_rows.items())
    assert sum(r["length"] for r in packed) == tokens
    lengths = [r["length"] for r in packed]
    assert check_slots(packed, packing.CAPACITY) == len(one_by_one(lengths, packing.CAPACITY))
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, no_docs.select(*docs.columns), sf_dir).count() == 0, name


def test_one_row_of_each_group_stays(spark, sf_dir):
    """Repeated rows, repeated ids with equal and other texts, many rows without an id."""
    stage = dict(corpus_pipeline.STAGES)["near_duplicate_join"]
    words = [[f"{name}{k}" for k in range(60)] for name in "abcdef"]
    a, b, c, d, e, f = (" ".join(w) for w in words)
    near = " ".join(words[0][:50] + ["other"] + words[0][51:])
    rows = [(5, a, "s"), (5, a, "s"), (5, a, "t"), (7, near, "s"), (None, a, "s"), (None, near, None), *[(None, b, "s")] * 9, (None, b, "t"), (9, c, "s"), (9, d, "s"), (8, d, "s"), (None, "", "s"), (1, e, None), (None, e, "s"), (2, None, "s"), (3, f, "s")]
    for parts in (1, 5):
        docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(parts)
        out = stage(spark, docs, sf_dir)
        assert out.columns == docs.columns
        got = collections.Counter((r["doc_id"], r["text"]) for r in out.collect())
        assert got == collections.Counter([(5, a), (None, b), (9, c), (8, d), (None, ""), (1, e), (2, None), (3, f)])


def test_rows_that_share_a_hash_are_told_apart(spark, sf_dir, monkeypatch):
    docs = spark.createDataFrame([(k, f"{k} " + " ".join(f"w{k}x{j}" for j in range(30))) for k in range(40)] * 2, "doc_id long, text string").repartition(3)
    whole = corpus_pipeline._row_hash
    monkeypatch.setattr(corpus_pipeline, "_row_hash", lambda docs, salt: F.pmod(whole(docs, salt), F.lit(7)) if salt == 0 else whole(docs, salt))
    assert docs.select(corpus_pipeline._row_number(docs).alias("n")).distinct().count() == 40
    out = dict(corpus_pipeline.STAGES)["near_duplicate_join"](spark, docs, sf_dir)
    assert sorted(r["doc_id"] for r in out.collect()) == list(range(40))


def test_run(spark, sf_dir):
    out = corpus_pipeline.run(spark, sf_dir)
    assert {"doc_id", "piece", "sequence_id", "offset"} <= set(out.columns) and out.count() > 100
