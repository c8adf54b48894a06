"""Connected components by alternating large-star and small-star rounds
(Kiveris et al., "Connected Components in MapReduce and Beyond", 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.lineage import drop, table


def _least(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``edges`` with the least ``v`` of each ``u``, and its written table. An
    aggregate and a join, because a window would gather a hub's edges in one
    task: the aggregate combines before the shuffle, and the join's hot keys
    are split by adaptive execution, which needs the written side."""
    least = table(edges.groupBy("u").agg(F.min("v").alias("m")), "least")
    return edges.join(least, "u"), least


def _large_star(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    found, least = _least(both)
    return found.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct(), least


def _small_star(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``edges`` run from the greater end to the lesser."""
    found, least = _least(edges)
    others = found.where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return others.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), least


def weak_components(edges: DataFrame, u: str = "u", v: str = "v") -> DataFrame:
    """(node, component) for every node that has an edge to another; the
    component is its least node. Rows with a null end, self-loops and repeats
    count for nothing. Each round starts from a written table, so a lost
    executor costs one round at most; rounds grow with the logarithm of the
    longest path."""
    now = table(
        edges.select(F.col(u).alias("a"), F.col(v).alias("b"))
        .where("a != b")
        .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .distinct(),
        "edges",
    )
    mark = None
    while True:
        large, used = _large_star(now)
        middle = table(large, "edges")
        small, more = _small_star(middle)
        then = table(small, "edges")
        for old in (used, more, middle):
            drop(old)
        seen = then.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        drop(now)
        now = then
        if seen == mark or seen[0] == 0:
            break
        mark = seen
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
