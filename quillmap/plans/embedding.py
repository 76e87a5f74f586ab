"""Embedding runs over a store: local models with resume, and a remote batch service."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import chunking as C
from ..operators import runs as R
from ..sources import remote_batches as B
from ..sources.steps import cut, ship
from ..sources.tables import Store

RUN = "embedding_run_id string, model_id string, config_json string, created_at timestamp"
EMBEDDING = "chunk_id string, embedding array<float>, is_valid boolean, embedding_run_id string"
BATCHES = "remote_batches"


def _or_empty(store: Store, name: str, ddl: str) -> DataFrame:
    return store.read(name) if store.has(name) else store.spark.createDataFrame([], ddl)


def open_run(store: Store, run_id: str, model_id: str, chunking_run_id: str, arguments: dict | None = None) -> None:
    """Start a run, or make sure that one that is there was made in the same way, before anything is
    written."""
    runs = _or_empty(store, "embedding_runs", RUN)
    row = R.find_run(runs, run_id)
    if row is not None:
        R.check_resume(row, model_id, chunking_run_id, arguments)
        return
    if not store.read("chunking_runs").where(F.col("chunking_run_id") == chunking_run_id).limit(1).count():
        raise ValueError(f"unknown chunking run: {chunking_run_id}")
    config = json.dumps({"chunking_run_id": chunking_run_id, "transformer_kwargs": arguments or {}}, sort_keys=True)
    named = {"embedding_run_id": run_id, "model_id": model_id, "config_json": config}
    row = store.spark.range(1).select(*[F.lit(v).alias(k) for k, v in named.items()], F.current_timestamp().alias("created_at"))
    store.append("embedding_runs", row)


def waiting(store: Store, run_id: str, max_characters: int | None = None, limit: int | None = None) -> DataFrame:
    """Chunks of the run's chunking that have no embedding in it yet."""
    run = R.require_run(store.read("embedding_runs"), run_id)
    chunking = json.loads(run["config_json"])["chunking_run_id"]
    chunks = store.read("chunks").where(F.col("chunking_run_id") == chunking)
    return C.unembedded(chunks, _or_empty(store, "embeddings", EMBEDDING), run_id, max_characters, limit)


def keep(store: Store, run_id: str, vectors: DataFrame) -> int:
    """Add vectors (chunk_id, embedding) to a run, valid where their article is; returns how many."""
    articles = store.read("chunks").select("chunk_id", "article_id").dropDuplicates(["chunk_id"])
    flags = articles.join(store.read("articles").select("article_id", F.col("is_valid").alias("flag")), "article_id", "left")
    valid = F.coalesce("flag", F.lit(False)).alias("is_valid")
    rows = vectors.join(flags, "chunk_id", "left").select("chunk_id", "embedding", valid, F.lit(run_id).alias("embedding_run_id"))
    held = cut(rows)  # the models run once
    store.append("embeddings", held)
    return held.count()


def embed(
    store: Store,
    run_id: str,
    model_id: str,
    chunking_run_id: str,
    model: Callable,
    dimension: int,
    batch_size: int = 256,
    max_characters: int | None = None,
    limit: int | None = None,
    arguments: dict | None = None,
) -> int:
    """Embed what has no embedding yet; a run that was broken off goes on. Returns how many were added."""
    open_run(store, run_id, model_id, chunking_run_id, arguments)
    ship(store.spark)
    return keep(store, run_id, C.embed(waiting(store, run_id, max_characters, limit), model, dimension, batch_size))


def submit(store: Store, run_id: str, model_id: str, chunking_run_id: str, client: B.Client, inputs: int = B.BATCH_INPUTS, size: int = B.BATCH_BYTES) -> None:
    """Send all that has no embedding yet to the service. A run with batches under way can't be sent again."""
    open_run(store, run_id, model_id, chunking_run_id)
    batches = _or_empty(store, BATCHES, B.SCHEMA)
    if R.batch_status(batches, run_id).first()["n_running"]:
        raise ValueError(f"{run_id} has batches under way")
    store.append(BATCHES, B.submit(B.plan(waiting(store, run_id), inputs, size), run_id, client))


def status(store: Store, run_id: str, client: B.Client) -> DataFrame:
    """Ask the service, keep what it says, and count."""
    store.replace(BATCHES, B.refresh(store.spark, store.read(BATCHES), client))
    return R.batch_status(store.read(BATCHES), run_id)


def collect(store: Store, run_id: str, client: B.Client) -> int:
    """Import the results of all completed batches that weren't imported. Vectors are kept before the
    batches are marked, and chunks that have a vector already are left out, so a broken import can be
    run again."""
    batches = cut(store.read(BATCHES))
    own = F.col("embedding_run_id") == run_id
    vectors, marked = B.collect(store.spark, batches.where(own), client)
    done = _or_empty(store, "embeddings", EMBEDDING).where(own).select("chunk_id")
    added = keep(store, run_id, vectors.join(done, "chunk_id", "left_anti"))
    store.replace(BATCHES, batches.where(~own).unionByName(marked))
    return added
