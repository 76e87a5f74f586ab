"""Result files: CSV with checked headers, histograms, LaTeX, JSON; and the Parquet store."""

from __future__ import annotations

import json
import os
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .steps import cut

KEYS = ("model_id", "chunking_strategy")
# Columns of the two kinds of histogram files.
BIN_COLUMNS = [("bin_index", "int"), ("bin_left", "double"), ("bin_right", "double"), ("bin_center", "double"), ("density", "double")]
CHUNK_COLUMNS = [("chunking_run_id", "string"), ("chunking_run_name", "string"), ("method", "string"), ("metric", "string"), *BIN_COLUMNS, ("chunk_count", "bigint"), ("log_x", "int")]
SIMILARITY_COLUMNS = [("embedding_run_id", "string"), ("embedding_run_name", "string"), ("model_id", "string"), ("distribution", "string"), *BIN_COLUMNS, ("pair_count", "bigint"), ("log_x", "int")]


def write_csv(rows: DataFrame, folder: str, single_file: bool = True) -> None:
    """With a header; a result without rows is an error. Null is an empty field. Result tables are
    small, so they are one file unless asked otherwise."""
    if rows.isEmpty():
        raise ValueError("no rows to write")
    (rows.coalesce(1) if single_file else rows).write.mode("overwrite").option("emptyValue", "").csv(folder, header=True)


def _read(spark: SparkSession, path: str) -> DataFrame:
    table = spark.read.option("nullValue", "").csv(path, header=True)
    return table.withColumnsRenamed({c: c.lstrip("﻿") for c in table.columns})  # files may begin with a byte order mark


def read_csv(spark: SparkSession, paths: list[str], required: list[str]) -> DataFrame:
    """The rows of all files; each must have the required columns, as strings."""
    out = None
    for path in paths:
        table = _read(spark, path)
        if missing := sorted(set(required) - set(table.columns)):
            raise ValueError(f"{path} lacks the columns {', '.join(missing)}")
        out = table if out is None else out.unionByName(table, allowMissingColumns=True)
    if out is None:
        raise ValueError("no files to read")
    return out


def read_summary(spark: SparkSession, path: str) -> DataFrame:
    """A summary table; its keys are required and unique."""
    table = read_csv(spark, [path], list(KEYS))
    again = table.groupBy(*KEYS).count().where("count > 1").limit(5).collect()
    if again:
        raise ValueError(f"duplicate keys in {path}: {sorted((r[0], r[1]) for r in again)}")
    return table


def read_histogram(spark: SparkSession, path: str, kind: str = "chunk") -> DataFrame:
    """Typed histogram rows, log_x as a boolean; the header must be exact. Similarity files may lack
    the run's name, which is empty then."""
    columns = {"chunk": CHUNK_COLUMNS, "similarity": SIMILARITY_COLUMNS}[kind]
    table, names = _read(spark, path), [n for n, _ in columns]
    if kind == "similarity" and table.columns == [n for n in names if n != "embedding_run_name"]:
        table = table.withColumn("embedding_run_name", F.lit("")).select(*names)
    if table.columns != names:
        raise ValueError(f"{path} has the columns {table.columns}, not {names}")
    typed = [F.coalesce(F.col(n), F.lit("")).alias(n) if t == "string" else F.col(n).cast(t).alias(n) for n, t in columns]
    return table.select(*typed).withColumn("log_x", F.col("log_x") == 1)


def write_text(path: str, text: str) -> None:
    """A small result on the driver's side, put in place at once."""
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    held = f"{path}.tmp"
    Path(held).write_text(text, encoding="utf-8")
    os.replace(held, path)


def write_json(path: str, value) -> None:
    write_text(path, json.dumps(value, indent=2, ensure_ascii=False, sort_keys=True) + "\n")


class Store:
    """Tables as Parquet under one folder, partitioned by run where they have one. A run is written
    as a whole by dynamic overwrite, so a rerun replaces it and a failed one leaves nothing."""

    PARTITIONS = {"chunks": "chunking_run_id", "embeddings": "embedding_run_id"}

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder

    def path(self, name: str) -> str:
        return f"{self.folder}/{name}"

    def has(self, name: str) -> bool:
        where = self.spark._jvm.org.apache.hadoop.fs.Path(self.path(name))
        return where.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(where)

    def replace(self, name: str, rows: DataFrame) -> None:
        """For a table that is read while it is made: the rows are held before the old ones go."""
        self.write(name, cut(rows))

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(self.path(name))

    def write(self, name: str, rows: DataFrame) -> None:
        writer = rows.write.mode("overwrite")
        if name in self.PARTITIONS:
            writer = writer.option("partitionOverwriteMode", "dynamic").partitionBy(self.PARTITIONS[name])
        writer.parquet(self.path(name))

    def append(self, name: str, rows: DataFrame) -> None:
        writer = rows.write.mode("append")
        if name in self.PARTITIONS:
            writer = writer.partitionBy(self.PARTITIONS[name])
        writer.parquet(self.path(name))

    def valid_embeddings(self, run_ids: list[str]) -> DataFrame:
        return self.read("embeddings").where(F.col("embedding_run_id").isin(run_ids) & F.col("is_valid"))
