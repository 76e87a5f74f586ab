"""Newspapers: Markdown files, each with a JSON file of metadata beside it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SIDECAR = "_metadata"


def _stem(path, ending: str):
    return F.regexp_extract(F.url_decode(F.replace(path, F.lit("+"), F.lit("%2B"))), rf"([^/]+){ending}$", 1)


def _files(spark: SparkSession, folder: str, pattern: str, ending: str) -> DataFrame:
    texts = spark.read.option("pathGlobFilter", pattern).text(folder, wholetext=True)
    return texts.select(_stem(F.col("_metadata.file_path"), ending).alias("stem"), F.col("value"))


def scan(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """(newspapers, skipped): newspaper_id, stem, content, metadata (VARIANT: sidecars mix strings
    and objects in one list); and the stems of files without a sidecar."""
    texts = _files(spark, folder, "*.md", r"\.md")
    sidecars = _files(spark, folder, f"*{SIDECAR}.json", rf"{SIDECAR}\.json")
    found = texts.join(sidecars.select("stem", F.parse_json("value").alias("metadata")), "stem")
    identity = F.concat(F.lit("newspaper_"), F.substring(F.sha2("stem", 256), 1, 24))
    skipped = texts.join(sidecars, "stem", "left_anti").select("stem")
    return found.select(identity.alias("newspaper_id"), "stem", F.col("value").alias("content"), "metadata"), skipped


def metadata_field(newspapers: DataFrame, path: str, kind: str = "string") -> DataFrame:
    """newspaper_id and one field of the metadata; null where it is missing or of another type."""
    return newspapers.select("newspaper_id", F.try_variant_get("metadata", path, kind).alias("value"))
