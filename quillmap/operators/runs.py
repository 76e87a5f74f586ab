"""The run registry: looking runs up, checking that a run can go on, status of remote batches."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TERMINAL = ("completed", "failed", "expired", "cancelled")


def describe_runs(runs: DataFrame, chunking_runs: DataFrame, embeddings: DataFrame) -> DataFrame:
    """One row for each embedding run, newest first: model, chunking run, method, valid embeddings."""
    counts = embeddings.where("is_valid").groupBy("embedding_run_id").agg(F.count("*").alias("embedding_count"))
    chunking = F.get_json_object("config_json", "$.chunking_run_id")
    methods = F.broadcast(chunking_runs.select("chunking_run_id", F.col("method").alias("chunking_method")))  # a row a run
    named = runs.withColumn("chunking_run_id", chunking).join(methods, "chunking_run_id", "left")
    out = named.join(counts, "embedding_run_id", "left").fillna(0, ["embedding_count"])
    return out.select("embedding_run_id", "model_id", "chunking_run_id", "chunking_method", "embedding_count", "created_at").orderBy(F.desc("created_at"), "embedding_run_id")


def find_run(runs: DataFrame, run_id: str):
    return runs.where(F.col("embedding_run_id") == run_id).first()


def require_run(runs: DataFrame, run_id: str):
    row = find_run(runs, run_id)
    if row is None:
        raise ValueError(f"unknown embedding run: {run_id}")
    return row


def newest_run(runs: DataFrame):
    row = runs.where("embedding_count > 0").orderBy(F.desc("created_at")).first()
    if row is None:
        raise ValueError("no embedding run has embeddings")
    return row


def non_noop_runs(runs: DataFrame) -> DataFrame:
    return runs.where(F.coalesce("chunking_method", F.lit("")) != "noop")


def chunk_runs(runs: DataFrame, model_id: str | None = None, run_id: str | None = None) -> list:
    """One run, or all of a model that are chunked and not empty; two for one chunking are an error."""
    if (model_id is None) == (run_id is None):
        raise ValueError("give either a run or a model")
    if run_id is not None:
        return [require_run(runs, run_id)]
    rows = non_noop_runs(runs).where((F.col("model_id") == model_id) & (F.col("embedding_count") > 0)).orderBy("chunking_run_id", "embedding_run_id").collect()
    seen: dict = {}
    for r in rows:
        if r["chunking_run_id"] in seen:
            raise ValueError(f"Multiple embedding runs of {model_id} for {r['chunking_run_id']}")
        seen[r["chunking_run_id"]] = r
    if not rows:
        raise ValueError(f"no chunked embedding run of {model_id}")
    return rows


def article_run(runs: DataFrame, model_id: str, run_id: str | None = None):
    """The run over whole articles: the one asked for, or the only one of the model."""
    if run_id is not None:
        row = require_run(runs, run_id)
        if row["model_id"] != model_id or row["chunking_method"] != "noop":
            raise ValueError(f"{run_id} isn't a run over whole articles of {model_id}")
        return row
    rows = runs.where((F.col("model_id") == model_id) & (F.col("chunking_method") == "noop") & (F.col("embedding_count") > 0)).limit(2).collect()
    if len(rows) != 1:
        raise ValueError(f"{'several runs' if rows else 'no run'} over whole articles of {model_id}")
    return rows[0]


def check_resume(run, model_id: str, chunking_run_id: str, arguments: dict | None = None) -> None:
    """Raise before anything is written if a run was made in another way."""
    config = json.loads(run["config_json"] or "{}")
    made = {"model-id": run["model_id"], "chunking-run-id": config.get("chunking_run_id"), "transformer-kwargs": config.get("transformer_kwargs") or {}}
    for (name, was), now in zip(made.items(), (model_id, chunking_run_id, arguments or {})):
        if was != now:
            raise ValueError(f"can't resume with another {name}: {was!r} is not {now!r}")


def batch_status(batches: DataFrame, run_id: str) -> DataFrame:
    """One row: batches, batches that aren't at an end, and completed ones not imported yet."""
    own = batches.where(F.col("embedding_run_id") == run_id)
    running = F.col("status").isNull() | ~F.col("status").isin(*TERMINAL)
    waiting = (F.col("status") == "completed") & F.col("imported_at").isNull() & (F.col("output_file_id").isNotNull() | F.col("error_file_id").isNotNull())
    return own.agg(F.count("*").alias("n_batches"), F.count_if(running).alias("n_running"), F.count_if(waiting).alias("n_to_import"))


def select_scope(names: list[str], wanted: list[str] | None, excluded: list[str] | None) -> list[str]:
    """In the order asked for, without the excluded; unknown names and an empty rest are errors."""
    wanted = list(dict.fromkeys(wanted or names))
    if unknown := sorted({*wanted, *(excluded or [])} - set(names)):
        raise ValueError(f"unknown: {unknown}")
    rest = [n for n in wanted if n not in set(excluded or [])]
    if not rest:
        raise ValueError("nothing is left")
    return rest


def benchmark_report(results: DataFrame, wanted: list[str]) -> DataFrame:
    """completed, failed and is_complete of a list of tasks, from (task, error)."""
    some = lambda fine: F.array_sort(F.collect_set(F.when(fine, F.col("task"))))
    tasks = results.agg(some(F.col("error").isNull()).alias("completed"), some(F.col("error").isNotNull()).alias("failed"))
    return tasks.withColumn("is_complete", F.size(F.array_except(F.array(*map(F.lit, wanted)), "completed")) == 0)
