"""Reachability, depth and rank over edges (src_idx, dst_idx, weight, type)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.iterate import least_values
from ..plans.lineage import drop, fresh, table
from .components import weak_components
from .graph import STRUCTURAL, Compiled, accumulate


class CycleError(ValueError):
    """Structural edges that must form no cycle form one."""


def components(compiled: Compiled, keep: Column | None = None) -> DataFrame:
    """(idx, component): weak components, named by their least index; a node
    without edges is one of its own. Edges for which ``keep`` isn't true are
    ignored."""
    edges = compiled.edges if keep is None else compiled.edges.where(keep)
    if compiled.two_way and keep is None:
        edges = edges.where("src_idx > dst_idx")
    tied = weak_components(edges.select("src_idx", "dst_idx"), "src_idx", "dst_idx")
    found = compiled.node_index.select("idx").join(tied, F.col("idx") == F.col("node"), "left")
    return found.select("idx", F.coalesce("component", "idx").alias("component"))


def directed_components(compiled: Compiled, keep: Column | None = None) -> DataFrame:
    """(idx, component): the least index from which a node can be reached
    along edges for which ``keep`` is true. On edges that run both ways these
    are the weak components. Rounds grow with the longest of the shortest paths."""
    edges = compiled.edges if keep is None else compiled.edges.where(keep)
    hops = table(edges.where("src_idx != dst_idx").select("src_idx", F.col("dst_idx").alias("to")), "hops")
    own = compiled.node_index.select(F.col("idx").alias("node"), F.col("idx").alias("value"))
    # Of the first round: every node's index has gone along its edges.
    met = hops.select(F.col("to").alias("node"), F.col("src_idx").alias("value"))
    start = own.unionByName(met).groupBy("node").agg(F.min("value").alias("value"))
    found = least_values(start.withColumn("fell", F.col("value") < F.col("node")), lambda fell: fell.join(hops, fell.node == hops.src_idx).select(F.col("to").alias("node"), "value"))
    drop(hops)
    return found.select(F.col("node").alias("idx"), F.col("value").alias("component"))


def dependency_depth(compiled: Compiled, roots: DataFrame, penalty: int = 3) -> DataFrame:
    """(idx, depth) of every node: the least cost of a path from any of
    ``roots.idx``, a structural edge costing 1 and an associative one
    ``penalty``; a negative penalty forbids those. -1 where there is no path.
    Roots that are no node count for nothing."""
    edges = compiled.edges if penalty >= 0 else compiled.edges.where(F.col("type") == STRUCTURAL)
    cost = F.when(F.col("type") == STRUCTURAL, F.lit(1)).otherwise(F.lit(max(penalty, 0))).cast("long")
    hops = table(edges.select("src_idx", F.col("dst_idx").alias("to"), cost.alias("cost")), "hops")
    start = compiled.node_index.join(roots.select("idx").distinct(), "idx", "left_semi").select(F.col("idx").alias("node"), F.lit(0).cast("long").alias("value"))
    found = least_values(start, lambda fell: fell.join(hops, fell.node == hops.src_idx).select(F.col("to").alias("node"), (F.col("value") + F.col("cost")).alias("value")))
    every = compiled.node_index.select("idx").join(found, F.col("idx") == F.col("node"), "left")
    return every.select("idx", F.coalesce("value", F.lit(-1).cast("long")).alias("depth"))


def flow_rank(compiled: Compiled, subset: DataFrame | None = None) -> DataFrame:
    """(idx, rank): the longest path of structural edges inside the subset that
    ends in the node. All edges of a level peel off together, so rounds are as
    many as ranks. CycleError if some never do; ValueError if ``subset`` names
    an index twice."""
    nodes = compiled.node_index.select("idx") if subset is None else subset.select("idx")
    if subset is not None and not nodes.groupBy("idx").count().where("count > 1").isEmpty():
        raise ValueError("the subset names an index twice")
    inside = compiled.edges.where(F.col("type") == STRUCTURAL).select("src_idx", "dst_idx")
    if subset is not None:
        a, b = (nodes.select(F.col("idx").alias(c)) for c in ("src_idx", "dst_idx"))
        inside = inside.join(a, "src_idx", "left_semi").join(b, "dst_idx", "left_semi")
    spark = compiled.node_index.sparkSession
    # Levels are appended to one table: the result scans it once, however many there are.
    path, level, left = fresh(spark, "ranks"), 0, table(inside, "left")
    nodes.withColumn("rank", F.lit(0)).write.parquet(path)
    levels = lambda: spark.read.schema("idx bigint, rank int").parquet(path)
    size = left.count()
    while size:
        level += 1
        left.select(F.col("dst_idx").alias("idx")).distinct().withColumn("rank", F.lit(level)).write.mode("append").parquet(path)
        ahead = levels().where(F.col("rank") == level)
        then = table(left.join(ahead.select(F.col("idx").alias("src_idx")), "src_idx", "left_semi"), "left")
        drop(left)
        left, before, size = then, size, then.count()
        if size == before:
            raise CycleError("structural edges form a cycle")
    return levels().groupBy("idx").agg(F.max("rank").alias("rank"))


def cyclic_edges(edges: DataFrame) -> DataFrame:
    """(src_idx, dst_idx) of the edges that lie on a cycle or between two: what
    remains when edges from sources and edges into sinks are peeled off again
    and again."""
    now = table(edges.select("src_idx", "dst_idx"), "cyclic")
    size = now.count()
    while size:
        entered, left = now.select(F.col("dst_idx").alias("src_idx")).distinct(), now.select(F.col("src_idx").alias("dst_idx")).distinct()
        then = table(now.join(entered, "src_idx", "left_semi").join(left, "dst_idx", "left_semi").select("src_idx", "dst_idx"), "cyclic")
        drop(now)
        before, now, size = size, then, then.count()
        if size == before:
            break
    return now


def check_acyclic(edges: DataFrame) -> None:
    """CycleError if structural edges (src, dst, type) by id form a cycle; a
    structural loop is one."""
    structural = edges.where(F.col("type") == STRUCTURAL).select(F.lower("src").alias("src_idx"), F.lower("dst").alias("dst_idx"))
    bad = cyclic_edges(structural).first()
    if bad:
        raise CycleError(f"structural edges form a cycle, which {bad.src_idx} -> {bad.dst_idx} is part of")


def accumulate_acyclic(log: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """``accumulate``, refused as a whole with CycleError if structural edges
    form a cycle."""
    edges = table(accumulate(log, nodes), "edges")
    check_acyclic(edges)
    return edges
