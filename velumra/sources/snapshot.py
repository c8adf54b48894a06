"""Graph snapshots: Parquet tables, and a binary file for exchange.

The binary layout is little-endian: magic, version, number of nodes N and of
edges E (four bytes each); N + 1 row starts and E targets as int32; E weights
as float32; E times as int64; E types as bytes; then N ids, each UTF-8 after
its length in groups of seven bits. What follows in the file is left alone.
"""

from __future__ import annotations

import io
import struct
from collections.abc import Iterator
from typing import BinaryIO

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..operators.graph import Compiled

MAGIC, VERSION = 0x46524745, 2
HEAD, HEAD_SIZE = "<Iiii", 16
#: Edges in a partition of a read.
SPLIT = 1 << 20
EDGES = "src_idx bigint, dst_idx bigint, weight double, last_modified bigint, type tinyint"


class SnapshotError(ValueError):
    """The bytes are no snapshot of the known version, or end too early."""


def save(compiled: Compiled, path: str) -> None:
    """As Parquet; ids keep their order, columns of nodes and edges stay."""
    compiled.node_index.write.parquet(f"{path}/nodes")
    compiled.edges.write.parquet(f"{path}/edges")


def load(spark: SparkSession, path: str) -> Compiled:
    return Compiled(spark.read.parquet(f"{path}/nodes"), spark.read.parquet(f"{path}/edges"))


def _string(text: str) -> bytes:
    raw, out = text.encode(), bytearray()
    n = len(raw)
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes(out) + bytes([n]) + raw


def _streamed(df: DataFrame, column: str, kind: str) -> Iterator[bytes]:
    held = []
    for row in df.toLocalIterator():
        held.append(row[column])
        if len(held) == 65536:
            yield np.array(held, kind).tobytes()
            held = []
    yield np.array(held, kind).tobytes()


def write_stream(compiled: Compiled, out: BinaryIO) -> None:
    """Sections stream through the driver a partition at a time: one file has
    one writer. ``out`` stays open."""
    order = ["src_idx", "dst_idx"]
    edges = compiled.edges.orderBy(*order)
    out.write(struct.pack(HEAD, MAGIC, VERSION, compiled.node_index.count(), compiled.edges.count()))
    out.write(np.zeros(1, "<i4").tobytes())
    sections = [(compiled.row_ptr().orderBy("idx"), "row_end", "<i4"), (edges, "dst_idx", "<i4"), (edges, "weight", "<f4"), (edges, "last_modified", "<i8"), (edges, "type", "u1")]
    for df, column, kind in sections:
        for part in _streamed(df.select(*dict.fromkeys([*(order if df is edges else ["idx"]), column])), column, kind):
            out.write(part)
    for row in compiled.node_index.orderBy("idx").toLocalIterator():
        out.write(_string(row.id))


def write_binary(compiled: Compiled, path: str) -> None:
    with open(path, "wb") as out:
        write_stream(compiled, out)


def _take(raw: BinaryIO, n: int) -> bytes:
    found = raw.read(n)
    if len(found) < n:
        raise SnapshotError(f"the snapshot ends {n - len(found)} bytes early")
    return found


def _head(raw: BinaryIO) -> tuple[int, int]:
    magic, version, n, e = struct.unpack(HEAD, _take(raw, HEAD_SIZE))
    if magic != MAGIC:
        raise SnapshotError(f"no snapshot: it begins with {magic:#x}")
    if version != VERSION:
        raise SnapshotError(f"snapshot version {version} is unknown")
    if n < 0 or e < 0:
        raise SnapshotError("the snapshot has a negative size")
    return n, e


def _ids(raw: BinaryIO, n: int) -> list[str]:
    out = []
    for _ in range(n):
        size = shift = 0
        while True:
            byte = _take(raw, 1)[0]
            size |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                break
        out.append(_take(raw, size).decode())
    return out


def _edges(raw: BinaryIO, n: int, e: int, first: int, last: int, begin: int = 0) -> pa.Table:
    """Edges ``first`` to ``last``; the snapshot begins at ``begin``."""

    def section(at: int, kind: str, a: int, b: int) -> np.ndarray:
        raw.seek(begin + HEAD_SIZE + at + a * np.dtype(kind).itemsize)
        return np.frombuffer(_take(raw, (b - a) * np.dtype(kind).itemsize), kind)

    starts = section(0, "<i4", 0, n + 1)
    if starts[-1] != e or (np.diff(starts) < 0).any():
        raise SnapshotError("row starts don't match the edges")
    at = 4 * (n + 1)
    columns = []
    for kind, size in (("<i4", 4), ("<f4", 4), ("<i8", 8), ("u1", 1)):
        columns.append(section(at, kind, first, last))
        at += size * e
    src = np.searchsorted(starts, np.arange(first, last), side="right") - 1
    return pa.table(
        {"src_idx": src.astype(np.int64), "dst_idx": columns[0].astype(np.int64), "weight": columns[1].astype(np.float64), "last_modified": columns[2], "type": columns[3].astype(np.int8)}
    )


def read_stream(spark: SparkSession, raw: BinaryIO) -> Compiled:
    """One snapshot from an open file, which is then at the byte after it."""
    begin = raw.tell()
    n, e = _head(raw)
    edges = _edges(raw, n, e, 0, e, begin)
    raw.seek(begin + HEAD_SIZE + 4 * (n + 1) + 17 * e)
    ids = _ids(raw, n)
    index = pa.table({"idx": pa.array(range(n), pa.int64()), "id": pa.array(ids, pa.string())})
    return Compiled(spark.createDataFrame(index, "idx bigint, id string"), spark.createDataFrame(edges, EDGES))


class _Part(InputPartition):
    def __init__(self, first: int, last: int):
        super().__init__((first, last))


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.what = options["path"], options.get("table", "edges")
        if self.what not in ("edges", "nodes"):
            raise ValueError("table is edges or nodes")

    def partitions(self):
        with open(self.path, "rb") as raw:
            n, e = _head(raw)
        return [_Part(0, n)] if self.what == "nodes" else [_Part(a, min(e, a + SPLIT)) for a in range(0, e, SPLIT)] or [_Part(0, 0)]

    def read(self, partition):
        first, last = partition.value
        with open(self.path, "rb") as raw:
            n, e = _head(raw)
            if self.what == "edges":
                yield from _edges(raw, n, e, first, last).to_batches()
            else:
                raw.seek(HEAD_SIZE + 4 * (n + 1) + 17 * e)
                ids = _ids(io.BufferedReader(raw, 1 << 20) if not isinstance(raw, io.BufferedReader) else raw, n)
                yield pa.RecordBatch.from_pydict({"idx": pa.array(range(n), pa.int64()), "id": pa.array(ids, pa.string())})


class SnapshotSource(DataSource):
    """``spark.read.format("graph_snapshot").option("table", "edges" or "nodes")``
    over a path that all executors see; edges are read in ranges, in parallel."""

    @classmethod
    def name(cls) -> str:
        return "graph_snapshot"

    def schema(self) -> str:
        return "idx bigint, id string" if self.options.get("table", "edges") == "nodes" else EDGES

    def reader(self, schema):
        return _Reader(dict(self.options))


def read_binary(spark: SparkSession, path: str) -> Compiled:
    spark.dataSource.register(SnapshotSource)
    read = lambda what: spark.read.format("graph_snapshot").option("table", what).load(path)
    return Compiled(read("nodes"), read("edges"))
