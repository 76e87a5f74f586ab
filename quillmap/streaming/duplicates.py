"""Duplicates across the batches of a stream.

A stream over the article table keeps one row of state for each content: its smallest id and how
many articles have it. It is Spark's own streaming aggregate, combined before the shuffle, so a
content that most articles of a batch have is a row a task. Every batch writes the contents that it
changed; a later row of a content replaces an earlier one, since ids only get smaller and counts
larger. So a smaller id that comes late also corrects the article that was first until then.

A batch has its own partition, written by overwrite: one that is run again, after a stop between its
result and its commit, replaces what it had written.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import articles as A


def article_stream(spark: SparkSession, table: str, files_per_batch: int = 1_000) -> DataFrame:
    """article_id and content of what is added to an article table. The table's schema is that of the
    files that are there when the stream starts."""
    schema = spark.read.parquet(table).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(table).select("article_id", "content")


def start(articles: DataFrame, target: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Write, for each batch, the contents whose smallest id or count it changed."""

    def put(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(target)

    writer = A.content_groups(articles).writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def groups(spark: SparkSession, target: str) -> DataFrame:
    """What `content_groups` says of all articles up to the last batch."""
    return spark.read.parquet(target).groupBy("_digest").agg(F.min("_first").alias("_first"), F.max("n_rows").alias("n_rows"))


def marked(articles: DataFrame, spark: SparkSession, target: str) -> DataFrame:
    """The articles with duplicates marked, as one batch over all of them marks them."""
    return A.mark_duplicates(articles, groups=groups(spark, target))
