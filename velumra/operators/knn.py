"""Exact k nearest neighbours."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import rounded

#: Vectors packed into one row of a block.
BLOCK = 1024


def _packed(vectors: DataFrame, id_: str, vector: str, name: str) -> DataFrame:
    """Rows of up to ``BLOCK`` vectors as packed bytes, made in each partition without a shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, BLOCK):
                part = batch.slice(k, BLOCK)
                lists = part.column("v")
                lengths = np.diff(lists.offsets.to_numpy())
                if len(set(lengths.tolist())) > 1:
                    raise ValueError("vectors differ in length")
                values = lists.flatten().to_numpy(zero_copy_only=False).astype("<f8")
                ids = part.column("id").to_numpy(zero_copy_only=False).astype("<i8")
                yield pa.RecordBatch.from_arrays([pa.array([ids.tobytes()], pa.binary()), pa.array([values.tobytes()], pa.binary())], names=[f"{name}_id", f"{name}_v"])

    plain = vectors.where(F.col(id_).isNotNull() & F.col(vector).isNotNull()).select(F.col(id_).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"))
    return plain.mapInArrow(run, f"{name}_id binary, {name}_v binary")


def _nearest(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for qi, qv, pi, pv in zip(*(batch.column(c).to_pylist() for c in ("query_id", "query_v", "point_id", "point_v"))):
                qi, pi = np.frombuffer(qi, "<i8"), np.frombuffer(pi, "<i8")
                q, p = np.frombuffer(qv).reshape(len(qi), -1), np.frombuffer(pv).reshape(len(pi), -1)
                if q.shape[1] != p.shape[1]:
                    raise ValueError("vectors differ in length")
                # Squares of distances by their expansion, and those that may be among the k again without it.
                square = (q * q).sum(1)[:, None] + (p * p).sum(1)[None] - 2 * (q @ p.T)
                slack = 1e-9 * (1 + np.abs(square).max(initial=0.0))
                out = []
                for row, d in enumerate(square):
                    near = np.flatnonzero(d <= np.partition(d, k - 1)[k - 1] + slack) if k < len(d) else np.arange(len(d))
                    far = np.sqrt(((p[near] - q[row]) ** 2).sum(1))
                    # All that tie with the k-th come along; the last window decides.
                    keep = far <= np.partition(far, k - 1)[k - 1] if k < len(far) else np.ones(len(far), bool)
                    out.append((np.full(int(keep.sum()), qi[row]), pi[near[keep]], far[keep]))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([o[j] for o in out])) for j in range(3)], names=["query_id", "point_id", "distance"])

    return run


def nearest(points: DataFrame, queries: DataFrame, k: int, id_: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, point_id, distance): for every query the ``k`` points of
    least Euclidean distance, ties by point id; none for ``k`` <= 0, all if
    there are fewer. A query that is itself a point finds itself first.

    Blocks of vectors meet pairwise, so each task multiplies dense matrices and
    passes on k rows of each block; nothing is broadcast by force."""
    schema = "query_id bigint, point_id bigint, distance double"
    if k <= 0:
        return points.sparkSession.createDataFrame([], "query_id bigint, rank int, point_id bigint, distance double")
    pairs = _packed(queries, id_, vector, "query").crossJoin(_packed(points, id_, vector, "point"))
    order = Window.partitionBy("query_id").orderBy("distance", "point_id")
    best = pairs.mapInArrow(_nearest(k), schema).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return best.select("query_id", "rank", "point_id", rounded("distance").alias("distance"))
