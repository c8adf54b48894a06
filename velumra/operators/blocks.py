"""Centrality of islands that fit no task.

Edges are sorted once by target into files of some ``BLOCK_EDGES`` edges in the
shared folder. A round is one job: each task reads all scores (8 bytes a node
and 4 for its island), sums what points to the nodes of its blocks, a slice of
edges at a time, and writes their new scores. The driver sees names of files
and a few sums for each block and island.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.lineage import discard, drop, fresh, located, table
from ..plans.memory import released
from ..plans.prefix import prefix_sum
from .scores import DAMPING, SCORES

BLOCK_EDGES = 1 << 21
SLICE_EDGES = 1 << 21


def _read(path: str, kind: str) -> np.ndarray:
    system, at = fs.FileSystem.from_uri(path)
    with system.open_input_file(at) as raw:
        return np.frombuffer(raw.read_buffer(), kind)


def _write(path: str, values: np.ndarray) -> None:
    system, at = fs.FileSystem.from_uri(path)
    with system.open_output_stream(at) as out:
        out.write(np.ascontiguousarray(values))


def _made(spark: SparkSession, name: str) -> str:
    folder = located(spark, fresh(spark, name))
    system, at = fs.FileSystem.from_uri(folder)
    system.create_dir(at, recursive=True)
    return folder


def _blocks_of(lows: np.ndarray):
    """The block of each edge, by its target."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dst = batch.column("dst").to_numpy(zero_copy_only=False)
            yield batch.append_column("block", pa.array(np.searchsorted(lows, dst, side="right") - 1, pa.int32()))

    return run


def _writing(folder: str, ranges: list[tuple[int, int]]):
    """Files of each block from rows sorted by block, target and source: sources
    and weights of its edges, and for each node of its range where they begin
    and its island. Rows with source -1 are nodes, their weight the island."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, name, outs = -1, "", []

        def close() -> list[pa.RecordBatch]:
            if now < 0:
                return []
            for out in outs:
                out.close()
            _write(f"{name}-ends", np.cumsum(degree))
            _write(f"{name}-island", island)
            return [pa.RecordBatch.from_pydict({"block": pa.array([now], pa.int32()), "name": [name]})]

        for batch in batches:
            block, src, dst, weight = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("block", "src", "dst", "weight"))
            edges = np.flatnonzero(np.diff(block)) + 1
            for a, b in zip([0, *edges], [*edges, len(block)]):
                if a == b:
                    continue
                if block[a] != now:
                    yield from close()
                    now = int(block[a])
                    name = f"{folder}/{now}-{TaskContext.get().taskAttemptId()}"
                    outs = [(s := fs.FileSystem.from_uri(f"{name}-{part}"))[0].open_output_stream(s[1]) for part in ("src", "weight")]
                    low, high = ranges[now]
                    degree, island = np.zeros(high - low + 1, np.int64), np.full(high - low + 1, -1, np.int32)
                is_node = src[a:b] < 0
                island[dst[a:b][is_node] - low] = weight[a:b][is_node]
                there = ~is_node
                degree += np.bincount(dst[a:b][there] - low, minlength=len(degree))
                outs[0].write(np.ascontiguousarray(src[a:b][there], np.int64))
                outs[1].write(np.ascontiguousarray(weight[a:b][there], np.float64))
        yield from close()

    return run


def _pull(name: str, x: np.ndarray) -> np.ndarray:
    """For each node of the block, the weighted scores that point to it."""
    ends = _read(f"{name}-ends", "i8")
    pull, full = np.zeros(len(ends)), np.flatnonzero(np.diff(ends, prepend=0))
    starts = np.concatenate([[0], ends])[full]
    paths = [fs.FileSystem.from_uri(f"{name}-{part}") for part in ("src", "weight")]
    with paths[0][0].open_input_file(paths[0][1]) as a, paths[1][0].open_input_file(paths[1][1]) as b:
        for at in range(0, int(ends[-1]) if len(ends) else 0, SLICE_EDGES):
            src, weight = (np.frombuffer(raw.read_buffer(8 * SLICE_EDGES), kind) for raw, kind in ((a, "i8"), (b, "f8")))
            i, j = np.searchsorted(starts, at, side="right") - 1, np.searchsorted(starts, at + len(src))
            pull[full[i:j]] += np.add.reduceat(weight * x[src], np.maximum(starts[i:j] - at, 0))
    return pull


STATS = "block int, name string, sums binary"


def _round(folder: str, ranges: list[tuple[int, int]], names: dict[int, str], before: list[tuple[dict[int, str], np.ndarray]], sizes: np.ndarray):
    """New scores, unscaled, of the blocks that come in. ``before`` holds the
    files of the last two rounds, latest first, and what scales each island.
    Sums by island: squares of the new scores; moves of the latest from the one
    before."""
    k, n = len(sizes), ranges[-1][1] + 1

    def scaled(b: int, round_: tuple[dict[int, str], np.ndarray], island: np.ndarray) -> np.ndarray:
        files, scale = round_
        scale = np.append(scale, 0.0)[island]  # -1, no node of these islands, takes the last
        return scale * _read(files[b], "f8") if files else scale

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = [int(b) for batch in batches for b in batch.column("block").to_numpy()]
        if not blocks:
            return
        x = np.zeros(n)
        for b, (low, high) in enumerate(ranges):
            x[low : high + 1] = scaled(b, before[0], _read(f"{names[b]}-island", "i4"))
        for b in blocks:
            low, high = ranges[b]
            island = _read(f"{names[b]}-island", "i4")
            own, here = island >= 0, x[low : high + 1]
            y = np.where(own, DAMPING * _pull(names[b], x) + ((1 - DAMPING) / np.append(sizes, 1.0))[island], 0.0)
            name = f"{folder}/{b}-{TaskContext.get().taskAttemptId()}"
            _write(name, y)
            moves = np.abs(here - scaled(b, before[1], island)) if len(before) > 1 else np.full(len(here), np.inf)
            sums = [np.bincount(island[own], v[own], k) for v in (y * y, moves)]
            yield pa.RecordBatch.from_pydict({"block": pa.array([b], pa.int32()), "name": [name], "sums": [np.concatenate(sums).tobytes()]})

    return run


def _emitting(ranges: list[tuple[int, int]], names: dict[int, str], files: dict[int, str], scale: np.ndarray, which: np.ndarray):
    """Rows of the islands ``which``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in [int(b) for batch in batches for b in batch.column("block").to_numpy()]:
            island = _read(f"{names[b]}-island", "i4")
            x = np.append(scale, 0.0)[island] * (_read(files[b], "f8") if files else 1.0)
            own = np.append(which, False)[island]
            for at in range(0, len(own), 1 << 16):
                kept = np.flatnonzero(own[at : at + (1 << 16)]) + at
                yield pa.RecordBatch.from_pydict({"idx": pa.array(kept + ranges[b][0], pa.int64()), "centrality": x[kept]})

    return run


def huge_scores(nodes: DataFrame, edges: DataFrame, rounds: int, epsilon: float, block_edges: int = BLOCK_EDGES) -> DataFrame:
    """(idx, centrality) for nodes (idx, island) and edges (island, src_idx,
    dst_idx, weight) of huge islands, as ``island_scores`` has them up to
    rounding. By how much a round moved is known one round later, from files."""
    spark = nodes.sparkSession
    sizes = {r.island: r.n for r in nodes.groupBy("island").agg(F.count("*").alias("n")).collect()}  # few: each has many edges
    islands, n = sorted(sizes), np.array([sizes[i] for i in sorted(sizes)], float)
    coded = nodes.join(F.broadcast(spark.createDataFrame(list(zip(islands, range(len(islands)))), "island bigint, code int")), "island")
    degree = edges.groupBy(F.col("dst_idx").alias("idx")).agg(F.count("*").alias("degree"))
    placed = prefix_sum(coded.join(degree, "idx", "left").fillna(0, ["degree"]).select("idx", "code", "degree"), [F.col("idx")], "degree")
    placed = table(placed.select("idx", "code", F.floor(F.col("start") / block_edges).alias("at")), "placed")
    found = placed.groupBy("at").agg(F.min("idx").alias("low"), F.max("idx").alias("high")).orderBy("low").collect()  # one row for each block
    ranges = [(r.low, r.high) for r in found]
    rows = placed.select(F.lit(-1).cast("long").alias("src"), F.col("idx").alias("dst"), F.col("code").cast("double").alias("weight")).unionByName(
        edges.select(F.col("src_idx").alias("src"), F.col("dst_idx").alias("dst"), "weight")
    )
    tasks = max(1, min(len(ranges), 2 * spark.sparkContext.defaultParallelism))
    folder = _made(spark, "blocks")
    in_blocks = rows.mapInArrow(_blocks_of(np.array([low for low, _ in ranges])), "src bigint, dst bigint, weight double, block int")
    sorted_ = in_blocks.repartition(len(ranges), "block").sortWithinPartitions("block", "dst", "src")
    names = {r.block: r.name for r in sorted_.mapInArrow(released(_writing(folder, ranges)), "block int, name string").collect()}
    drop(placed)
    work = spark.range(len(ranges), numPartitions=tasks).select(F.col("id").cast("int").alias("block"))
    out, open_ = fresh(spark, "scores"), np.ones(len(n), bool)
    # Round 0 has equal scores and no files; rounds are kept with their folder.
    before: list[tuple[dict[int, str], np.ndarray]] = [({}, 1 / np.sqrt(n))]
    folders: list[str] = []

    def emit(round_: tuple[dict[int, str], np.ndarray], which: np.ndarray) -> None:
        work.mapInArrow(_emitting(ranges, names, *round_, which), SCORES).write.mode("append").parquet(out)

    for done in range(rounds):
        here = _made(spark, "round")
        stats = work.mapInArrow(released(_round(here, ranges, names, before, n)), STATS).collect()
        squares, moved = np.sum([np.frombuffer(r.sums).reshape(2, -1) for r in sorted(stats, key=lambda r: r.block)], axis=0)
        folders.append(here)
        still = open_ & (moved < epsilon)
        if still.any():
            emit(before[0], still)
        open_ &= ~still
        if not open_.any():
            break
        length = np.sqrt(squares)
        before = [({r.block: r.name for r in stats}, 1 / np.where(length > 0, length, 1.0)), before[0]]
        if len(folders) > 2:
            discard(spark, folders.pop(0))
    if open_.any():
        emit(before[0], open_)
    for old in (*folders, folder):
        discard(spark, old)
    return spark.read.schema(SCORES).parquet(out)
