import json
import random

import pytest
from pyspark.sql import functions as F

from quillmap import __main__ as cli
from quillmap.plans import evaluations as E
from quillmap.plans import reports
from quillmap.sources import remote_batches as B
from quillmap.sources.tables import Store, read_csv, read_histogram, write_csv


@pytest.fixture(scope="module")
def store(spark, tmp_path_factory):
    """Eight articles, three chunkings of them and two models."""
    s = Store(spark, str(tmp_path_factory.mktemp("store")))
    rng = random.Random(1)
    chunks, embeddings, runs = [], [], []
    for c, n in (("noop", 1), ("paragraph", 6), ("token_256_64", 7)):
        for article in range(8):
            for k in range(n):
                chunks.append((f"{c}-{article}-{k}", c, f"a{article}", k, "some words of text " * (k + 1)))
    for model in ("m1", "m2"):
        for c in ("noop", "paragraph", "token_256_64"):
            runs.append((f"{model}-{c}", model, f'{{"chunking_run_id": "{c}"}}', len(runs)))
            for chunk_id, run, article, _, _ in chunks:
                if run == c:
                    base = [1.0 if k == int(article[1:]) else 0.0 for k in range(8)]
                    embeddings.append((chunk_id, f"{model}-{c}", [x + rng.gauss(0, 0.2) for x in base], True))
    s.write("chunks", spark.createDataFrame(chunks, "chunk_id string, chunking_run_id string, article_id string, chunk_index int, text string"))
    s.write("chunking_runs", spark.createDataFrame([("noop", "noop", "{}", 0), ("paragraph", "paragraph", "{}", 1), ("token_256_64", "token", '{"token_count": 256, "token_overlap": 64}', 2)], "chunking_run_id string, method string, config_json string, created_at int"))
    s.write("embedding_runs", spark.createDataFrame(runs, "embedding_run_id string, model_id string, config_json string, created_at int"))
    s.write("embeddings", spark.createDataFrame(embeddings, "chunk_id string, embedding_run_id string, embedding array<float>, is_valid boolean"))
    return s


def test_all_measures_and_the_merged_report(spark, store):
    runs = store.read("embedding_runs")
    results = {
        "anisotropy": E.anisotropy(store),
        "intra_consistency": E.intra_consistency(store),
        "representation_degradation": E.representation_degradation(store, "m1").unionByName(E.representation_degradation(store, "m2")),
    }
    grids = {k: reports.summarise(k, r, runs, ["m1", "m2"], ["paragraph", "token_256_64"]) for k, r in results.items()}
    assert all(g.count() == 4 for g in grids.values())
    merged = reports.merged(grids)
    assert merged.count() == 4 and merged.where("retained_similarity is null").count() == 0
    text = reports.latex("anisotropy", grids["anisotropy"], "All", "tab:a")
    assert text.count(r"\midrule") == 2 and "token\\_256\\_64" in text
    assert "Chunking & Model" in reports.latex("anisotropy", grids["anisotropy"], "All", "tab:a", swap_columns=True)
    assert [r["overlap"] for r in reports.overlap_series(grids["anisotropy"], "pc1").collect()] == [64, 64]
    sampled = E.anisotropy(store, ["m1-paragraph"], sample_size=10**6).first()["mean_pairwise_cosine"]
    assert sampled == pytest.approx(E.anisotropy(store, ["m1-paragraph"]).first()["mean_pairwise_cosine"])


def test_separability_and_classes(spark, store):
    runs = ["m1-paragraph", "m2-paragraph"]
    r = E.inter_separability(store, ["m1-paragraph"], ("davies_bouldin", "silhouette"), cohort_size=4, seeds=(1, 2), cohort_run_ids=runs).first()
    assert (r["num_articles"], r["num_chunks"], r["davies_bouldin_cohort_pool_size"]) == (8, 48, 8)
    scores = json.loads(r["davies_bouldin_scores_json"])
    assert r["silhouette_score"] > 0.5 and r["davies_bouldin_seeds_json"] == "[1, 2]" and len(scores) == 2
    assert r["davies_bouldin_index"] == pytest.approx(sum(scores) / 2) and r["davies_bouldin_full_trimmed_index"] <= r["davies_bouldin_full_index"]
    own = E.inter_separability(store, ["m1-paragraph"], cohort_size=8, seeds=(5,)).first()
    assert own["davies_bouldin_index"] == pytest.approx(own["davies_bouldin_full_index"]) and own["davies_bouldin_std"] == 0
    grid = reports.summarise("inter_separability", E.inter_separability(store, runs, cohort_size=4, cohort_run_ids=runs), store.read("embedding_runs"), ["m1", "m2"], ["paragraph"])
    assert "davies_bouldin_full_trimmed_index" in grid.columns and grid.where("davies_bouldin_index is null").count() == 0
    with pytest.raises(ValueError, match="must include"):
        E.inter_separability(store, ["m1-paragraph"], cohort_size=4, cohort_run_ids=["m2-paragraph"])
    with pytest.raises(ValueError, match="cohort of 9"):
        E.inter_separability(store, ["m1-paragraph"], cohort_size=9)
    nb = E.naive_bayes(store, ["m1-paragraph"], 200)
    assert nb.count() == 4
    grid = reports.summarise("naive_bayes", nb, store.read("embedding_runs"), ["m1"], ["noop", "paragraph"])
    assert grid.count() == 1 and grid.first()["gaussian_negative_positive"] > 0.8
    with pytest.raises(ValueError):
        E.inter_separability(store, None, ("other",))
    with pytest.raises(ValueError):
        E.anisotropy(store, ["unknown"])


def test_norms_histograms_and_summaries(spark, store, tmp_path):
    assert E.norms(store, "m1", "paragraph").first()["count"] == 48
    similar = E.similarity_histograms(store, ["m1-paragraph"], ["P"], bins=4, limit=50)
    assert similar.count() == 12 and {r["model_id"] for r in similar.collect()} == {"m1"}
    h = E.chunk_histograms(store, ["paragraph", "token_256_64"], ["P", "T"], "word", bins=5)
    assert {(r["chunking_run_name"], r["method"], r["chunk_count"]) for r in h.collect()} == {("P", "paragraph", 48), ("T", "token", 56)}
    assert h.where("abs(bin_center - (bin_left + bin_right) / 2) > 1e-9").count() == 0
    log = E.chunk_histograms(store, ["paragraph"], None, "char", bins=5, log_x=True)
    assert log.where("abs(bin_center - sqrt(bin_left * bin_right)) > 1e-9 or chunking_run_name != '' or log_x != 1").count() == 0
    for kind, rows in (("chunk", h), ("similarity", similar)):
        write_csv(rows, str(tmp_path / kind))
        back = read_histogram(spark, str(tmp_path / kind), kind)
        assert back.where("not log_x").count() == rows.count() and back.columns == rows.columns
    with pytest.raises(ValueError):
        E.chunk_histograms(store, ["paragraph"], ["a", "b"])
    s = E.chunk_summaries(store)
    table = reports.chunk_table(s, "Chunks", "tab:c")
    assert s.count() == 3 and table.index("No-op") < table.index("P &") < table.index("T256/64")
    assert E.chunk_summaries(store, ["noop"]).first()["overlap_transition_percent"] is None
    with pytest.raises(ValueError, match="unknown"):
        E.chunk_summaries(store, ["other"])


def test_command_line(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    prose = "Parliament discussed several important questions yesterday evening. " * 12
    (folder / "n.md").write_text(f"# One\n{prose}\n# Two\n{prose}\n# Three\nshort")
    (folder / "n_metadata.json").write_text("{}")
    store = str(tmp_path / "store")
    for argv in (["ingest", str(folder)], ["clean"], ["deduplicate"], ["chunk", "s", "--method", "sentence", "--sentence-count", "2"], ["structure", "--output", str(tmp_path / "structure")], ["summarize-chunks", "--output", str(tmp_path / "summary")]):
        cli.run(spark, [store, *argv])
    articles = Store(spark, store).read("articles")
    assert sorted((r["title"], r["cleaning_reason"] or "") for r in articles.collect())[0][0] == "One"
    assert articles.where("is_valid").count() == 1 and articles.where("cleaning_reason = 'duplicate'").count() == 1
    assert spark.read.csv(str(tmp_path / "summary"), header=True).first()["num_chunks"] == "6"


def letters():
    """An embedder: how often a text has each of three letters."""
    return lambda texts: [[1.0 + t.count(c) for c in "aet"] for t in texts]


SERVICE = None


def service():
    return SERVICE


def test_all_steps_of_the_command_line(spark, tmp_path, capsys):
    """From files to the merged table, with a tokenizer file, a broken-off run and a batch service."""
    from public_tokenizers import path

    global SERVICE
    folder, out = tmp_path / "in", lambda name: str(tmp_path / name)
    folder.mkdir()
    rng = random.Random(3)
    vocabulary = ["parliament", "discussed", "several", "important", "questions", "yesterday", "evening", "and", "agreed", "afterwards", "they", "remained", "seated"]
    prose = lambda: ". ".join(" ".join(rng.choices(vocabulary, k=9)) for _ in range(12)) + "."
    (folder / "n.md").write_text("\n".join(f"# {k}\n{prose()}" for k in range(6)) + "\n# odd\n" + "a1 b2 c3 %% " * 60)
    (folder / "n_metadata.json").write_text("{}")
    run = lambda *argv: cli.run(spark, [out("store"), *map(str, argv)])
    run("ingest", folder)
    run("clean")
    run("structure", "--output", out("structure"), "--summary", out("structure_summary"), "--all-articles", "--tokenizer", path("byte_bpe_50k.json"))
    assert read_csv(spark, [out("structure_summary")], ["metric", "robust_upper_fence"]).count() == 30
    run("clean-by-statistics", "--report", out("report"), "--apply", "--mad-multiplier", 50)
    assert read_csv(spark, [out("report")], ["was_valid", "would_invalidate", "reasons"]).count() == 7
    run("chunk", "noop", "--method", "noop")
    run("chunk", "sentence", "--method", "sentence", "--sentence-count", 2)
    run("chunk", "token_32", "--method", "token", "--token-count", 32, "--token-overlap", 8, "--tokenizer", path("byte_bpe_50k.json"))
    store = Store(spark, out("store"))
    assert '"tokenizer"' in store.read("chunking_runs").where("chunking_run_id = 'token_32'").first()["config_json"]
    base = ["--model-id", "m", "--embedder", "tests.test_evaluations:letters", "--dimension", 3]
    run("embed", "m-noop", "--chunking-run-id", "noop", *base)
    run("embed", "m-sentence", "--chunking-run-id", "sentence", *base, "--limit", 5)
    assert store.read("embeddings").where("embedding_run_id = 'm-sentence'").count() == 5
    run("embed", "m-sentence", "--chunking-run-id", "sentence", *base)
    run("embed", "m-sentence", "--chunking-run-id", "sentence", *base)
    assert store.read("embeddings").where("embedding_run_id = 'm-sentence'").count() == store.read("chunks").where("chunking_run_id = 'sentence'").count()
    with pytest.raises(ValueError, match="resume"):
        run("embed", "m-sentence", "--chunking-run-id", "noop", *base)
    SERVICE = Service()
    client = ["--client", "tests.test_evaluations:service"]
    run("submit", "m-token", "--model-id", "m", "--chunking-run-id", "token_32", *client, "--inputs", 20)
    with pytest.raises(ValueError, match="under way"):
        run("submit", "m-token", "--model-id", "m", "--chunking-run-id", "token_32", *client)
    for _ in range(3):
        run("status", "m-token", *client)
    run("collect", "m-token", *client)
    run("collect", "m-token", *client)
    assert store.read("embeddings").where("embedding_run_id = 'm-token'").count() == store.read("chunks").where("chunking_run_id = 'token_32'").count()
    ids = ["--run-ids", "m-sentence"]
    run("anisotropy", *ids, "--output", out("anisotropy"))
    run("intra-consistency", *ids, "--output", out("intra_consistency"))
    run("degradation", "--run-id", "m-sentence", "--article-run-id", "m-noop", "--output", out("representation_degradation"))
    for kind in ("anisotropy", "intra_consistency", "representation_degradation"):
        run("summarize", kind, out(kind), "--output", out(f"{kind}_summary"), "--models", "m", "--strategies", "sentence", "--latex", out(f"{kind}.tex"))
        assert "sentence" in (tmp_path / f"{kind}.tex").read_text()
    tables = [f"{k}={out(k + '_summary')}" for k in ("intra_consistency", "anisotropy", "representation_degradation")]
    run("merge", *tables, "--output", out("merged"), "--latex", out("merged.tex"))
    row = read_csv(spark, [out("merged")], ["retained_similarity"]).first()
    assert float(row["retained_similarity"]) <= 1 and "MNCS" in (tmp_path / "merged.tex").read_text()
    run("summarize-chunks", "--output", out("chunks"))
    run("chunk-table", out("chunks"), "--latex", out("chunks.tex"))
    assert "T32/0" in (tmp_path / "chunks.tex").read_text()


class Service:
    def __init__(self):
        self.sent, self.asked = {}, 0

    def submit(self, rows):
        self.sent[f"b{len(self.sent)}"] = list(rows)
        return f"b{len(self.sent) - 1}"

    def status(self, batch_id):
        self.asked += 1
        return ("completed", f"out-{batch_id}", None) if self.asked > 3 else ("in_progress", None, None)

    def results(self, file_id):
        return [(i, [float(len(t))] * 3) for i, t in self.sent[file_id.removeprefix("out-")]]


def test_remote_batches(spark):
    chunks = spark.createDataFrame([(f"c{k}", "x" * (k + 1)) for k in range(7)], "chunk_id string, text string")
    client = Service()
    batches = B.submit(B.plan(chunks, inputs=3, size=1000), "r", client)
    assert sorted(map(len, client.sent.values())) == [1, 3, 3]
    done = B.wait(spark, batches, "r", client, sleep=lambda s: None)
    vectors, marked = B.collect(spark, done, client)
    assert {r["chunk_id"]: r["embedding"] for r in vectors.collect()} == {f"c{k}": [k + 1.0] * 3 for k in range(7)}
    assert B.collect(spark, marked, client)[0].count() == 0


def test_retrieval_of_chunks_of_the_same_article(spark, store, tmp_path):
    rows = E.retrieval(store, ["m1-paragraph", "m2-paragraph"], (1, 5, 40)).collect()
    assert len(rows) == 6
    for r in rows:
        assert r["n_queries"] == 48 and 0.5 < r["ndcg"] <= 1 and r["mrr"] > 0.5
    deep = {r["embedding_run_id"]: r["recall"] for r in rows if r["depth"] == 40}
    assert min(deep.values()) > 0.95
    cli.run(spark, [store.folder, "retrieval", "--run-ids", "m1-paragraph", "--depths", "1", "5", "--output", str(tmp_path / "r")])
    assert read_csv(spark, [str(tmp_path / "r")], ["depth", "ndcg"]).count() == 2
