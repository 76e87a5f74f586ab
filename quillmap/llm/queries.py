"""The thin queries of the operators: production parameters, whole tables, digest columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import centroids, media_ts, minhash, mixing, near_duplicates, packing, pseudonyms, quality_lines, quality_model, repeats, resampling, sharding, url_filters
from .oracles import ORACLES  # noqa: F401


#: Of the queries over the test tables; whoever uses the operator gives a key of their own.
QUERY_KEY = b"key of the queries over the test tables"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_pii_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    out = pseudonyms.pseudonymise(docs, QUERY_KEY, counts_col="replaced")
    n = F.aggregate(F.map_values("replaced"), F.lit(0), lambda a, b: a + b)
    of_kind = [F.coalesce(F.try_element_at("replaced", F.lit(k)), F.lit(0)).alias(f"n_{k}") for k in pseudonyms.KINDS]
    return out.select("doc_id", "text", n.alias("n_replaced"), *of_kind)


def op2_media_transport_streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_ts.digest(_table(spark, sf_dir, "documents"))


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"))


def op4_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.plan(_table(spark, sf_dir, "documents"))


def op5_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filters.judge(_table(spark, sf_dir, "pages"))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.Repeats(_table(spark, sf_dir, "documents")).digest()


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign(_table(spark, sf_dir, "documents"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_lines.judge(_table(spark, sf_dir, "documents"))


def op9_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates.JaccardJoin(_table(spark, sf_dir, "documents")).members()


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return quality_model.score(docs, quality_model.train(docs, _table(spark, sf_dir, "labels")))


def op11_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = minhash.MinHash(_table(spark, sf_dir, "documents")).members()
    return found.select("doc_id", "n_shingles", "component_id", "kept")


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = resampling.Resampler().draw(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


def op13_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.Clusters().report(_table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_pii_pseudonyms,
        op2_media_transport_streams,
        op3_best_fit_packing,
        op4_source_mixing,
        op5_url_filters,
        op6_substring_dedup,
        op7_sharding,
        op8_quality_rules,
        op9_ngram_jaccard_join,
        op10_quality_classifier,
        op11_minhash_near_dedup,
        op12_importance_resampling,
        op13_centroid_clustering,
    )
}
