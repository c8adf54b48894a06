"""Graphs that the driver's tables hold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.graph import ASSOCIATIVE, STRUCTURAL, accumulate


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def named(letter: str, key: Column) -> Column:
    return F.concat(F.lit(letter), F.lpad(key.cast("string"), 7, "0"))


def _seconds(ts: Column) -> Column:
    return ts.cast("timestamp").cast("long")


def hierarchy_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Region to nation to customer and supplier, structural."""
    pairs = [("nation", "R", "n_regionkey", "N", "n_nationkey"), ("customer", "N", "c_nationkey", "C", "c_custkey"), ("supplier", "N", "s_nationkey", "S", "s_suppkey")]
    parts = [
        read(spark, sf_dir, t).select(named(a, F.col(x)).alias("from"), named(b, F.col(y)).alias("to"), F.lit(1.0).alias("delta"), F.lit(0).cast("long").alias("ts"), F.lit(STRUCTURAL).alias("type"))
        for t, a, x, b, y in pairs
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def supply_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Supplier and part of each line item, associative, by quantity."""
    return read(spark, sf_dir, "lineitem").select(
        named("S", F.col("l_suppkey")).alias("from"), named("P", F.col("l_partkey")).alias("to"), F.col("l_quantity").alias("delta"), _seconds(F.col("l_shipdate")).alias("ts"), F.lit(ASSOCIATIVE).alias("type")
    )


def event_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User and type of each event, associative, by value."""
    return read(spark, sf_dir, "events").select(
        named("U", F.col("user_id")).alias("from"), F.concat(F.lit("T"), F.col("event_type")).alias("to"), F.col("value").alias("delta"), _seconds(F.col("ts")).alias("ts"), F.lit(ASSOCIATIVE).alias("type")
    )


def ends(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct()


def hierarchy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return accumulate(hierarchy_log(spark, sf_dir))


def mixed_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hierarchy and all line items; no edge is in both."""
    return hierarchy_log(spark, sf_dir).unionByName(supply_log(spark, sf_dir))
