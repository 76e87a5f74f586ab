"""From raw documents to packed sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and works on all that the one before it kept; all but the
last return the columns of `documents`. `run` writes each result as Parquet into the shared folder
and reads it again.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmap.llm import mixing, near_duplicates, packing, pseudonyms, quality_lines
from quillmap.llm.common import shared_folder

#: Of this pipeline over the test tables; whoever runs it over others gives a key of their own.
KEY = b"key of the pipeline over the test tables"


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Failing lines go, then the documents that fail the base rule or lose too much text."""
    return _counted(quality_lines.clean(docs))


def near_duplicate_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked documents stays: the one with the smallest id, where rows
    without an id come last and a hash of the row decides among equal ids. Of equal rows one stays;
    a text without words is linked with nothing."""
    names = docs.columns
    key = next(k for n in range(len(names) + 1) if (k := f"row{n}") not in names)
    keyed = docs.withColumn(key, _row_number(docs))
    members = near_duplicates.JaccardJoin(keyed, id_col=key, first_col="doc_id").members()
    stay = members.where("component_id = doc_id").select(F.col("doc_id").alias(key))
    return keyed.dropDuplicates([key]).join(stay, key, "left_semi").select(*names)


def _row_hash(docs: DataFrame, salt: int) -> Column:
    """64 bits that follow from all of a row's values; nulls count with their place."""
    return F.xxhash64(F.lit(salt), *docs.columns, *[F.col(n).isNull() for n in docs.columns])


def _row_number(docs: DataFrame) -> Column:
    """A number that only equal rows share: 64 bits of hash, but where rows that another 64 bits tell
    apart share it, they get others. Of 10 billion rows about three pairs do."""
    number, other = _row_hash(docs, 0), _row_hash(docs, 1)
    for salt in range(2, 10):
        hashes = docs.select(number.alias("a"), other.alias("b")).groupBy("a").agg(F.min("b").alias("low"), F.max("b").alias("high"))
        shared = [r["a"] for r in hashes.where("low != high").select("a").limit(10_000).collect()]  # bounded; more take another turn
        if not shared:
            return number
        number = F.when(number.isin(shared), _row_hash(docs, salt)).otherwise(number)
    raise RuntimeError("rows can't be told apart")


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal numbers, dates and addresses become pseudonyms of the same format."""
    return _counted(pseudonyms.pseudonymise(docs, KEY))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are left out, kept or repeated so that sources come near their targets. A repeated
    document's rows are equal; documents without words have size 0 and are left out; rows with a
    null id or source are mixed like others."""
    return mixing.repeat(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their sequence and offset. A document that mixing repeats is packed as
    often as it comes, so (doc_id, piece) repeats in the result; a null text packs as the end id."""
    return packing.pack(docs)


def _counted(docs: DataFrame) -> DataFrame:
    """n_chars follows the text."""
    if "n_chars" not in docs.columns:
        return docs
    kind = docs.schema["n_chars"].dataType
    return docs.withColumn("n_chars", F.length("text").cast(kind))


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicate_join", near_duplicate_join),
    ("pii", pii),
    ("source_mixing", source_mixing),
    ("best_fit_packing", best_fit_packing),
]

#: Shingle hashes aside, tokenizer ids can't be had in SQL; the tests hold stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages. A stage's copy of the corpus is deleted once the next one has been written; the
    last copy stays, as the result reads it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    before = None
    for k, (name, stage) in enumerate(STAGES[:-1]):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}-{name}")
        docs = spark.read.parquet(f"{folder}/{k}-{name}")
        if before:
            _delete(spark, before)
        before = f"{folder}/{k}-{name}"
    return STAGES[-1][1](spark, docs, sf_dir)


def _delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
