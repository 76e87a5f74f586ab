"""Command line: `python -m quillmap STORE STEP [options]`. Results are CSV folders; tables are LaTeX files."""

from __future__ import annotations

import argparse
import importlib
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import articles as A
from .operators import chunking as C
from .plans import embedding as M
from .plans import evaluations as E
from .plans import reports
from .sources import newspapers, remote_batches
from .sources.steps import ship
from .sources.tables import KEYS, Store, read_csv, read_summary, write_csv, write_text

WHOLE = {"type": int}
REAL = {"type": float}


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="quillmap", description=__doc__)
    p.add_argument("store")
    steps = p.add_subparsers(dest="step", required=True)

    def step(name: str, *options: tuple[str, dict]) -> None:
        own = steps.add_parser(name)
        for flag, how in options:
            own.add_argument(flag, **how)

    runs, out, seed = ("--run-ids", {"nargs": "*"}), ("--output", {"required": True}), ("--seed", {"type": int, "default": 42})
    tokenizer = ("--tokenizer", {"help": "a tokenizer file; without it, runs of non-space characters are tokens"})
    latex = [("--latex", {}), ("--caption", {"default": ""}), ("--label", {"default": "tab:results"})]
    step("ingest", ("folder", {}))
    step("clean")
    step("deduplicate", ("--batch-size", {"type": int, "default": 10_000}))
    step("structure", out, ("--summary", {}), ("--all-articles", {"action": "store_true"}), ("--sizes", {"type": int, "nargs": "*", "default": list(A.T.TOKEN_SIZES)}), tokenizer)
    limits = A.Cleaning()
    step(
        "clean-by-statistics",
        ("--report", {"required": True}),
        ("--max-numeric-or-special-ratio", REAL | {"default": limits.max_numeric_or_special}),
        ("--mad-multiplier", REAL | {"default": limits.multiplier}),
        ("--minimum-outlier-metrics", WHOLE | {"default": limits.min_outliers}),
        ("--apply", {"action": "store_true"}),
        tokenizer,
    )
    sizes = ("chunk_size", "chunk_overlap", "sentence_count", "sentence_overlap", "token_count", "token_overlap")
    step("chunk", ("chunking_run_id", {}), ("--method", {"choices": C.METHODS, "default": "split"}), tokenizer, *[(f"--{n.replace('_', '-')}", WHOLE) for n in sizes])
    run = [("embedding_run_id", {}), ("--model-id", {"required": True}), ("--chunking-run-id", {"required": True})]
    step(
        "embed",
        *run,
        ("--embedder", {"required": True, "help": "module:function, which makes a function from texts to vectors"}),
        ("--dimension", WHOLE | {"required": True}),
        ("--batch-size", WHOLE | {"default": 256}),
        ("--max-characters", WHOLE),
        ("--limit", WHOLE),
        ("--arguments", {"type": json.loads, "default": {}, "help": "JSON, kept with the run"}),
    )
    client = ("--client", {"required": True, "help": "module:function, which makes a client of the batch service"})
    step("submit", *run, client, ("--inputs", WHOLE | {"default": remote_batches.BATCH_INPUTS}), ("--bytes", WHOLE | {"default": remote_batches.BATCH_BYTES}))
    step("status", ("embedding_run_id", {}), client)
    step("collect", ("embedding_run_id", {}), client)
    step("propagate", ("--batch-size", {"type": int, "default": 10_000}))
    step("runs")
    step("anisotropy", runs, out, ("--sample-size", WHOLE), seed)
    step("intra-consistency", runs, out, ("--drop-threshold", REAL))
    step(
        "inter-separability",
        runs,
        out,
        ("--metrics", {"nargs": "*", "default": ["davies_bouldin"]}),
        ("--min-chunks", WHOLE | {"default": E.MIN_CHUNKS}),
        ("--cohort-size", WHOLE | {"default": E.COHORT_SIZE}),
        ("--seeds", WHOLE | {"nargs": "*", "default": list(E.COHORT_SEEDS)}),
        ("--trim", REAL | {"default": E.TRIM}),
        ("--block-size", WHOLE | {"default": E.BLOCK}),
        ("--cohort-run-ids", {"nargs": "*"}),
        ("--skip-full", {"action": "store_true"}),
    )
    step("degradation", out, ("--run-id", {}), ("--model-id", {}), ("--article-run-id", {}), ("--min-chunks", WHOLE | {"default": E.MIN_CHUNKS}))
    step("naive-bayes", runs, out, ("--limit", WHOLE | {"default": 100_000}), ("--test-share", REAL | {"default": 0.2}), seed)
    step("retrieval", runs, out, ("--depths", WHOLE | {"nargs": "+", "default": list(E.N.DEPTHS)}), ("--block-size", WHOLE | {"default": E.BLOCK}))
    step("norms", out, ("--model-id", {"required": True}), ("--chunking-run-id", {"required": True}), ("--tolerance", REAL | {"default": E.TOLERANCE}))
    step("summarize-chunks", out, ("--chunking-run-ids", {"nargs": "*"}))
    shape = [("--run-ids", {"nargs": "+"}), ("--names", {"nargs": "*"}), ("--log-x", {"action": "store_true"})]
    step("chunk-histogram", out, *shape, ("--metric", {"choices": ["char", "word"], "default": "char"}), ("--bins", WHOLE | {"default": E.CHUNK_BINS}))
    step("similarity-histogram", out, *shape, ("--bins", WHOLE | {"default": E.SIMILARITY_BINS}), ("--pair-limit", WHOLE | {"default": 100_000}), seed)
    lists = [("--models", {"nargs": "+", "required": True}), ("--strategies", {"nargs": "+", "required": True})]
    step("summarize", ("kind", {"choices": list(reports.METRICS)}), ("results", {"nargs": "+"}), out, *lists, ("--swap-columns", {"action": "store_true"}), *latex)
    step("merge", ("tables", {"nargs": "+", "help": "kind=path of a summary"}), out, ("--groups", {"nargs": "*"}), *latex)
    step("chunk-table", ("summary", {}), ("--latex", {"required": True}), ("--caption", {"default": ""}), ("--label", {"default": "tab:chunks"}))
    return p


def ingest(spark: SparkSession, store: Store, folder: str) -> None:
    found, skipped = newspapers.scan(spark, folder)
    for row in skipped.toLocalIterator():
        print(f"WARNING no metadata for {row['stem']}")
    store.write("newspapers", found.withColumn("metadata", F.to_json("metadata")))
    parts = A.split_articles(store.read("newspapers").select("newspaper_id", "content"))
    unknown = {"is_valid": F.lit(None).cast("boolean"), "cleaning_reason": F.lit(None).cast("string")}
    store.write("articles", parts.withColumn("article_id", A.article_id("article_index", "content", "newspaper_id", "title")).withColumns(unknown))


def _named(text: str):
    """What module:function makes, called without arguments on first use."""
    module, _, name = text.partition(":")
    return getattr(importlib.import_module(module), name)


def _tokens(path: str | None):
    return C.library_token_count(path) if path else A.T.whitespace_tokens


def _numbers(table: DataFrame) -> DataFrame:
    """Columns that hold numbers in every row, as numbers: files have only texts."""
    texts = [c for c in table.columns if c not in ("embedding_run_id", "chunking_run_id", "method", "config_json", "task", "classifier", *KEYS)]
    bad = table.agg(*[F.count_if(F.col(c).isNotNull() & F.col(c).try_cast("double").isNull()).alias(c) for c in texts]).first() if texts else {}
    return table.withColumns({c: F.col(c).cast("double") for c in texts if not bad[c]})


def _store_step(spark: SparkSession, store: Store, a: argparse.Namespace) -> bool:
    """Steps that change the store; False if it is none of them."""
    if a.step == "ingest":
        ingest(spark, store, a.folder)
    elif a.step == "clean":
        store.replace("articles", A.validate(store.read("articles").drop("is_valid", "cleaning_reason")))
        A.validation_counts(store.read("articles")).show()
    elif a.step == "deduplicate":
        print(A.newly_duplicate(store.read("articles"), batch_size=a.batch_size).count(), "duplicates")
        store.replace("articles", A.mark_duplicates(store.read("articles")))
    elif a.step == "clean-by-statistics":
        rows = A.text_structure(store.read("articles").where("is_valid is not null"), tokenizer=_tokens(a.tokenizer))
        judged = A.classify_outliers(rows.select("article_id", "is_valid", *A.JUDGED), A.Cleaning(a.max_numeric_or_special_ratio, a.mad_multiplier, a.minimum_outlier_metrics))
        write_csv(A.cleaning_report(judged), a.report)
        A.reason_counts(judged).show(100, False)
        if a.apply:
            store.replace("articles", A.apply_cleaning(store.read("articles"), judged))
    elif a.step == "chunk":
        params = {k: v for k, v in vars(a).items() if k.startswith(("chunk_s", "chunk_o", "sentence_", "token_")) and v is not None}
        made = C.chunk(store.read("articles").where("is_valid"), a.method, tokenizer=a.tokenizer or A.T.whitespace_tokens, **params)
        made = made.withColumn("chunking_run_id", F.lit(a.chunking_run_id))
        store.write("chunks", made.withColumn("chunk_id", A.chunk_id("article_id", "chunk_index", "chunking_run_id", "text")))
        config = C.run_config(a.method, **params, **({"tokenizer": a.tokenizer} if a.tokenizer else {})).alias("config_json")
        named = [F.lit(a.chunking_run_id).alias("chunking_run_id"), F.lit(a.method).alias("method")]
        store.append("chunking_runs", spark.range(1).select(*named, config, F.current_timestamp().alias("created_at")))
    elif a.step == "embed":
        run = a.embedding_run_id, a.model_id, a.chunking_run_id
        print(M.embed(store, *run, _named(a.embedder), a.dimension, a.batch_size, a.max_characters, a.limit, a.arguments), "embedded")
    elif a.step == "submit":
        M.submit(store, a.embedding_run_id, a.model_id, a.chunking_run_id, _named(a.client)(), a.inputs, a.bytes)
    elif a.step == "status":
        M.status(store, a.embedding_run_id, _named(a.client)()).show()
    elif a.step == "collect":
        print(M.collect(store, a.embedding_run_id, _named(a.client)()), "collected")
    elif a.step == "propagate":
        store.replace("embeddings", A.propagate_validation(store.read("embeddings"), store.read("chunks"), store.read("articles"), a.batch_size))
        A.propagation_counts(store.read("embeddings")).show()
    elif a.step == "runs":
        E.run_table(store).show(1000, False)
    else:
        return False
    return True


def _report_step(spark: SparkSession, store: Store, a: argparse.Namespace) -> bool:
    """Steps that make tables from results; False if it is none of them."""
    if a.step == "structure":
        rows = store.read("articles")
        made = A.text_structure(rows if a.all_articles else rows.where("is_valid"), tokenizer=_tokens(a.tokenizer), sizes=tuple(a.sizes))
        write_csv(made, a.output)
        if a.summary:
            write_csv(A.metric_summary(made, [c for c in made.columns if c not in ("article_id", *A.LABELS)]), a.summary)
    elif a.step == "summarize":
        results = _numbers(read_csv(spark, a.results, ["embedding_run_id"]))
        grid = reports.summarise(a.kind, results, store.read("embedding_runs"), a.models, a.strategies)
        write_csv(grid, a.output)
        if a.latex:
            write_text(a.latex, reports.latex(a.kind, grid, a.caption, a.label, a.swap_columns))
    elif a.step == "merge":
        tables = dict(x.split("=", 1) for x in a.tables)
        table = reports.merged({kind: _numbers(read_summary(spark, path)) for kind, path in tables.items()})
        write_csv(table, a.output)
        if a.latex:
            write_text(a.latex, reports.merged_latex(table, a.caption, a.label, a.groups))
    elif a.step == "chunk-table":
        needed = ["chunking_run_id", "num_chunks", "mean_characters"]
        write_text(a.latex, reports.chunk_table(_numbers(read_csv(spark, [a.summary], needed)), a.caption, a.label))
    else:
        return False
    return True


def run(spark: SparkSession, argv: list[str]) -> None:
    a = _parser().parse_args(argv)
    store = Store(spark, a.store)
    ship(spark)
    if not _store_step(spark, store, a) and not _report_step(spark, store, a):
        made = {
            "anisotropy": lambda: E.anisotropy(store, a.run_ids, a.sample_size, a.seed),
            "intra-consistency": lambda: E.intra_consistency(store, a.run_ids, a.drop_threshold),
            "inter-separability": lambda: E.inter_separability(store, a.run_ids, tuple(a.metrics), a.min_chunks, a.cohort_size, tuple(a.seeds), a.trim, a.block_size, a.cohort_run_ids, a.skip_full),
            "degradation": lambda: E.representation_degradation(store, a.model_id, a.run_id, a.article_run_id, a.min_chunks),
            "naive-bayes": lambda: E.naive_bayes(store, a.run_ids, a.limit, a.test_share, a.seed),
            "retrieval": lambda: E.retrieval(store, a.run_ids, tuple(a.depths), a.block_size),
            "norms": lambda: E.norms(store, a.model_id, a.chunking_run_id, a.tolerance),
            "summarize-chunks": lambda: E.chunk_summaries(store, a.chunking_run_ids),
            "chunk-histogram": lambda: E.chunk_histograms(store, a.run_ids, a.names, a.metric, a.bins, a.log_x),
            "similarity-histogram": lambda: E.similarity_histograms(store, a.run_ids, a.names, a.bins, a.log_x, a.pair_limit, a.seed),
        }[a.step]()
        write_csv(made, a.output)


if __name__ == "__main__":
    import sys

    run(SparkSession.builder.appName("quillmap").getOrCreate(), sys.argv[1:])
