"""Ingest of newspapers as a stream: new files become articles as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import articles as A


def newspaper_stream(spark: SparkSession, folder: str, files_per_batch: int = 1000) -> DataFrame:
    """newspaper_id, content of each Markdown file that appears in the folder."""
    reader = spark.readStream.schema("value string").option("pathGlobFilter", "*.md").option("maxFilesPerTrigger", files_per_batch)
    texts = reader.text(folder, wholetext=True)
    stem = F.regexp_extract("_metadata.file_path", r"([^/]+)\.md$", 1)
    return texts.select(A.newspaper_id(stem).alias("newspaper_id"), F.col("value").alias("content"))


def start(newspapers: DataFrame, target: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Split, identify and validate each micro-batch and add it to the article table. A batch has its
    own partition, written by overwrite, so one that is run again replaces what it had written."""

    def put(batch: DataFrame, number: int) -> None:
        parts = A.split_articles(batch)
        named = parts.withColumn("article_id", A.article_id("article_index", "content", "newspaper_id", "title"))
        A.validate(named).withColumn("batch", F.lit(number)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(target)

    writer = newspapers.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
