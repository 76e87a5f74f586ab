"""Embedding by a remote batch service: submit, follow, collect. The service itself is a client that
the caller gives; what is known about its batches is a table."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterable
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..operators import runs as R

SCHEMA = "embedding_run_id string, batch_no long, status string, provider_batch_id string, output_file_id string, error_file_id string, imported_at timestamp"
# Limits of a request and of a batch.
REQUEST_INPUTS, BATCH_INPUTS, BATCH_BYTES, POLL_SECONDS = 128, 50_000, 190_000_000, 60


class Client(Protocol):
    def submit(self, rows: Iterable[tuple[str, str]]) -> str: ...

    def status(self, batch_id: str) -> tuple[str, str | None, str | None]: ...

    def results(self, file_id: str) -> Iterable[tuple[str, list[float]]]: ...


def plan(chunks: DataFrame, inputs: int = BATCH_INPUTS, size: int = BATCH_BYTES) -> DataFrame:
    """chunk_id, text, batch_no: batches within both limits. Chunks are numbered inside hashed parts,
    so no task sorts them all; a part opens a batch of its own."""
    if inputs < 1 or size < 1:
        raise ValueError("limits must be positive")
    n = max(1, chunks.count() // (4 * inputs))
    parts = chunks.select("chunk_id", "text", F.pmod(F.xxhash64("chunk_id"), F.lit(n)).alias("part"))
    upto = W.partitionBy("part").orderBy("chunk_id").rowsBetween(W.unboundedPreceding, 0)
    by_count = F.floor((F.count("*").over(upto) - 1) / inputs)
    by_size = F.floor(F.sum(F.octet_length("text")).over(upto) / size)
    numbered = parts.select("chunk_id", "text", F.struct("part", (by_count + by_size).alias("k")).alias("key"))
    numbers = {tuple(r["key"]): i for i, r in enumerate(numbered.select("key").distinct().orderBy("key").collect())}
    pairs = chunks.sparkSession.createDataFrame([(*k, i) for k, i in numbers.items()], "part long, k long, batch_no long")  # a row a batch
    return numbered.select("chunk_id", "text", "key.*").join(F.broadcast(pairs), ["part", "k"]).select("chunk_id", "text", "batch_no")


def submit(planned: DataFrame, run_id: str, client: Client) -> DataFrame:
    """The status table of what was sent: one batch at a time passes through the driver."""
    rows = []
    for (number,) in planned.select("batch_no").distinct().orderBy("batch_no").collect():
        batch = planned.where(F.col("batch_no") == number).select("chunk_id", "text").toLocalIterator()
        rows.append((run_id, number, "submitted", client.submit((r["chunk_id"], r["text"]) for r in batch), None, None, None))
    return planned.sparkSession.createDataFrame(rows, SCHEMA)


def refresh(spark: SparkSession, batches: DataFrame, client: Client) -> DataFrame:
    """The table with the status that the service gives for batches that aren't at an end."""
    rows = []
    for r in batches.collect():
        status, output, error = (r["status"], r["output_file_id"], r["error_file_id"]) if r["status"] in R.TERMINAL else client.status(r["provider_batch_id"])
        rows.append((r["embedding_run_id"], r["batch_no"], status, r["provider_batch_id"], output, error, r["imported_at"]))
    return spark.createDataFrame(rows, SCHEMA)


def wait(spark: SparkSession, batches: DataFrame, run_id: str, client: Client, seconds: float = POLL_SECONDS, sleep: Callable[[float], None] = time.sleep) -> DataFrame:
    """Ask again and again until every batch is at an end."""
    while True:
        batches = refresh(spark, batches, client)
        if R.batch_status(batches, run_id).first()["n_running"] == 0:
            return batches
        sleep(seconds)


def collect(spark: SparkSession, batches: DataFrame, client: Client) -> tuple[DataFrame, DataFrame]:
    """(chunk_id, embedding of all completed batches that weren't imported; the table marked so)."""
    ready = batches.where("status = 'completed' and imported_at is null and output_file_id is not null").collect()
    vectors = None
    for r in ready:
        part = spark.createDataFrame(list(client.results(r["output_file_id"])), "chunk_id string, embedding array<float>")
        vectors = part if vectors is None else vectors.unionByName(part)
    done = F.col("output_file_id").isin([r["output_file_id"] for r in ready])
    marked = batches.withColumn("imported_at", F.when(done, F.current_timestamp()).otherwise(F.col("imported_at")))
    return vectors if vectors is not None else spark.createDataFrame([], "chunk_id string, embedding array<float>"), marked
