"""Damped eigenvector centrality, island by island."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.lineage import drop, table
from .blocks import huge_scores
from .graph import Compiled
from .paths import components, directed_components
from .scores import DAMPING, EPSILON, ROUNDS, SCORES

#: Islands with more edges are computed block by block, all others each in one task.
ISLAND_EDGES = 5_000_000


def island_scores(n: int, src: np.ndarray, dst: np.ndarray, weight: np.ndarray, rounds: int = ROUNDS, epsilon: float = EPSILON) -> np.ndarray:
    """Scores of the nodes 0 .. n - 1 of one island, a vector of unit length."""
    x = np.full(n, 1 / np.sqrt(n)) if n else np.empty(0)
    for _ in range(rounds if n else 0):
        y = DAMPING * np.bincount(dst, weight * x[src], n) + (1 - DAMPING) / n
        length = np.sqrt(y @ y)
        if length > 0:
            y /= length
        moved, x = np.abs(y - x).sum(), y
        if moved < epsilon:
            break
    return x


def _solved(rounds: int, epsilon: float) -> Callable[[pa.Table], pa.Table]:
    def run(found: pa.Table) -> pa.Table:
        src, dst, weight = (found.column(c).to_numpy() for c in ("src", "dst", "weight"))
        is_node = dst < 0
        idx = np.sort(src[is_node])
        a, b = np.searchsorted(idx, src[~is_node]), np.searchsorted(idx, dst[~is_node])
        order = np.lexsort((a, b))  # sums don't depend on how rows arrived
        return pa.table({"idx": idx, "centrality": island_scores(len(idx), a[order], b[order], weight[~is_node][order], rounds, epsilon)})

    return run


def centrality(compiled: Compiled, rounds: int = ROUNDS, epsilon: float = EPSILON, island_edges: int = ISLAND_EDGES) -> DataFrame:
    """(idx, centrality) of every node.

    In each island (as ``directed_components``) a score is 0.85 times the
    weighted scores that point to the node, plus 0.15 / n, scaled to unit
    length, from equal scores until they move by less than ``epsilon`` in all
    or ``rounds`` have passed. Edges between islands don't count. Weights
    aren't divided by the degree, so this is no PageRank; on two-sided graphs
    the scores may swing until the last round."""
    own = compiled.written()
    # Where all edges run both ways these are the same, in fewer rounds.
    found = components(own) if own.two_way else directed_components(own)
    islands = table(found.withColumnRenamed("component", "island"), "islands")
    edges = own.edges.select("src_idx", "dst_idx", F.col("weight").cast("double").alias("weight"))
    names = islands.select("island").distinct().limit(2).collect()
    if len(names) == 1:
        inner = edges.withColumn("island", F.lit(names[0].island))
    else:
        a, b = (islands.select(F.col("idx").alias(f"{s}_idx"), F.col("island").alias(n)) for s, n in (("src", "island"), ("dst", "_to")))
        inner = edges.join(a, "src_idx")
        inner = inner if own.two_way else inner.join(b, "dst_idx").where("island = _to")
        inner = table(inner.select("island", "src_idx", "dst_idx", "weight"), "inner")
    size = inner.groupBy("island").agg(F.count("*").alias("n_edges")).where(F.col("n_edges") > island_edges).select("island")
    huge = table(size, "huge")
    if len(names) != 1:
        drop(own.edges)
    rows = islands.select("island", F.col("idx").alias("src"), F.lit(-1).cast("long").alias("dst"), F.lit(0.0).alias("weight")).unionByName(
        inner.select("island", F.col("src_idx").alias("src"), F.col("dst_idx").alias("dst"), "weight")
    )
    if huge.isEmpty():
        return rows.groupBy("island").applyInArrow(_solved(rounds, epsilon), SCORES)
    small = rows.join(huge, "island", "left_anti").groupBy("island").applyInArrow(_solved(rounds, epsilon), SCORES)
    return small.unionByName(huge_scores(islands.join(huge, "island", "left_semi"), inner.join(huge, "island", "left_semi"), rounds, epsilon))
