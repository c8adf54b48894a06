"""Loops over written tables: each round starts from files in the shared folder,
so plans stay short and a lost executor costs one round at most."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .lineage import drop, table


def least_values(start: DataFrame, step: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(node, value): the least value that reaches each node, from ``start``
    and then from ``step`` of the rows that fell in the round before. Only
    those rows meet the edges again; the loop ends when there are none. Of a
    ``start`` with a column ``fell``, one row for each node, only those begin
    for which it is true."""
    begun = start if "fell" in start.columns else start.groupBy("node").agg(F.min("value").alias("value")).withColumn("fell", F.lit(True))
    now = table(begun, "least")
    while not now.where("fell").isEmpty():
        offered = step(now.where("fell").select("node", "value")).select("node", "value", F.lit(True).alias("new"))
        both = now.select("node", "value", F.lit(False).alias("new")).unionByName(offered).groupBy("node")
        merged = both.agg(F.min("value").alias("value"), F.min(F.when(~F.col("new"), F.col("value"))).alias("_old"))
        then = table(merged.select("node", "value", (F.col("_old").isNull() | (F.col("value") < F.col("_old"))).alias("fell")), "least")
        drop(now)
        now = then
    return now.select("node", "value")
