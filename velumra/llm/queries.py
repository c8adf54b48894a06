"""The registered queries of this package."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import embeddings, language_model, minhash, mixing, packing, quality, secrets, substrings, toxicity, webp

Query = Callable[[SparkSession, str], DataFrame]


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that the classifier keeps, with their scores."""
    return quality.passed(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op2_webp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No table holds images, so each embedding is first written as a WebP
    tile, in ten ways that use all tools of the format, and then decoded."""
    return webp.decoded(webp.tiles(spark.read.parquet(f"{sf_dir}/embeddings.parquet")))


def op3_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model.scores(documents(spark, sf_dir))


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All candidates, each with the forest's score and decision."""
    return secrets.findings(documents(spark, sf_dir))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir))


def op6_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that have near duplicates, with their group."""
    return minhash.near_duplicates(documents(spark, sf_dir))


def op7_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector with its class of near duplicates and its number of links."""
    return embeddings.near_classes(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op8_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages that stand in several documents."""
    return substrings.repeated_passages(documents(spark, sf_dir))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The toxic documents, with their scores."""
    return toxicity.toxic_documents(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir), mixing.WEIGHTS)


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        op1_quality, op2_webp, op3_language_model, op4_secrets, op5_packing, op6_minhash, op7_embeddings, op8_substrings, op9_toxicity, op10_mixing,
    )
}
ORACLES: dict[str, str] = {"op2_webp": webp.SQL, "op7_embeddings": embeddings.SQL, "op10_mixing": mixing.SQL}
