"""A weighted, time-stamped graph with structural (directed) and associative
(two-way) edges, as a pair of DataFrames.

nodes: id, any payload columns. edges: src, dst, weight, last_modified, type
(0 associative, 1 structural), one row for each ordered pair. Ids are the same
if they are equal in lower case.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.lineage import drop, table
from ..plans.memory import released
from ..plans.prefix import prefix_sum

ASSOCIATIVE, STRUCTURAL = 0, 1
DAY = 86400.0
#: Decay factors under this are zero.
GONE = 1e-7
#: Rows of a log that one task folds: more rows make more tasks, not larger ones.
FOLD_ROWS = 1 << 18


def key(id_: Column) -> Column:
    return F.lower(id_)


def upsert_nodes(log: DataFrame) -> DataFrame:
    """First write wins, by ``seq``, for the spelling of an id and for its
    payload. A null or blank id raises when it is read."""
    blank = F.col("id").isNull() | (F.trim("id") == "")
    checked = log.withColumn("id", F.when(blank, F.raise_error("a node needs an id").cast("string")).otherwise(F.col("id")))
    payload = [c for c in log.columns if c not in ("id", "seq")]
    first = checked.groupBy(key(F.col("id")).alias("_key")).agg(F.min_by(F.struct("id", *payload), "seq").alias("_row"))
    return first.select("_row.*")


def accumulate(log: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """Fold a log (from, to, delta, ts, type) into edges: weights add up, the
    latest time and the stronger type stay. Associative rows count both ways, a
    loop once. With ``nodes``, a missing source or target raises when it is read.

    The fold is a sum and two maxima, so Spark combines before the shuffle and
    order doesn't matter."""
    rows = _log_rows(log)
    if nodes is not None:
        known = nodes.select(key(F.col("id")).alias("_id")).distinct()
        for side, name in (("src", "source"), ("dst", "target")):
            rows = rows.join(known, F.col(side) == F.col("_id"), "left").withColumn(
                side, F.when(F.col("_id").isNull(), F.raise_error(F.concat(F.lit(f"{name} node is missing: "), F.col(side))).cast("string")).otherwise(F.col(side))
            )
            rows = rows.drop("_id")
    return _folded(_ways(rows, "src", "dst"), "src", "dst")


def _log_rows(log: DataFrame) -> DataFrame:
    return log.select(key(F.col("from")).alias("src"), key(F.col("to")).alias("dst"), F.col("delta").cast("double").alias("delta"), F.col("ts").cast("long").alias("ts"), F.col("type").cast("tinyint").alias("type"))


def _ways(rows: DataFrame, a: str, b: str) -> DataFrame:
    """Rows with ends ``a`` and ``b``; associative ones both ways, a loop once."""
    there, back = F.struct(F.col(a), F.col(b)), F.struct(F.col(b).alias(a), F.col(a).alias(b))
    both = F.when((F.col("type") == ASSOCIATIVE) & (F.col(a) != F.col(b)), F.array(there, back)).otherwise(F.array(there))
    return rows.withColumn("_way", F.explode(both)).withColumns({a: F.col(f"_way.{a}"), b: F.col(f"_way.{b}")}).drop("_way")


def _folded(directed: DataFrame, *keys: str) -> DataFrame:
    return directed.groupBy(*keys).agg(F.sum("delta").alias("weight"), F.max("ts").alias("last_modified"), F.max("type").alias("type"))


def add_edges(log: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """``accumulate`` of rows (from, to, weight, type) with time 0."""
    return accumulate(log.select("from", "to", F.col("weight").alias("delta"), F.lit(0).alias("ts"), "type"), nodes)


def merge(edges: DataFrame, more: DataFrame) -> DataFrame:
    """Add folded edges to folded edges."""
    both = edges.select("src", "dst", "weight", "last_modified", "type").unionByName(more.select("src", "dst", "weight", "last_modified", "type"))
    return both.groupBy("src", "dst").agg(F.sum("weight").alias("weight"), F.max("last_modified").alias("last_modified"), F.max("type").alias("type"))


def remove_nodes(nodes: DataFrame, edges: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Without the nodes whose ids ``ids`` lists and without all their edges,
    in and out."""
    gone = ids.select(key(F.col("id")).alias("_gone")).distinct()
    return (
        nodes.join(gone, key(F.col("id")) == F.col("_gone"), "left_anti"),
        edges.join(gone, key(F.col("src")) == F.col("_gone"), "left_anti").join(gone, key(F.col("dst")) == F.col("_gone"), "left_anti"),
    )


def has_node(nodes: DataFrame, id_: str | None) -> bool:
    return bool(id_) and not nodes.where(key(F.col("id")) == id_.lower()).isEmpty()


def get_node(nodes: DataFrame, id_: str):
    """The node's row; KeyError if there is none."""
    found = nodes.where(key(F.col("id")) == (id_ or "").lower()).first()
    if found is None:
        raise KeyError(f"node {id_!r} is not in the graph")
    return found


def lookup(nodes: DataFrame, ids: DataFrame) -> DataFrame:
    """(asked, id, found) for each row of ``ids.id``: the id that the node has
    in the graph, null if there is none. Null and empty ids are never found."""
    known = nodes.select("id", key(F.col("id")).alias("_key")).dropDuplicates(["_key"])
    asked = ids.select(F.col("id").alias("asked"))
    return asked.join(known, key(F.col("asked")) == F.col("_key"), "left").select("asked", "id", F.col("id").isNotNull().alias("found"))


def neighbours(edges: DataFrame, id_: str) -> DataFrame:
    return edges.where(key(F.col("src")) == id_.lower())


def project(nodes: DataFrame, *columns: Column) -> DataFrame:
    """One row for each node; for a scan that changes nodes, pass new columns."""
    return nodes.select(*columns)


def age_factor(rate: float, days: Column) -> Column:
    """exp(-rate x days), days not under 0, tiny factors zero."""
    m = F.exp(F.lit(-float(rate)) * F.greatest(days, F.lit(0.0)))
    return F.when(m < GONE, F.lit(0.0)).otherwise(m)


def decay_edges(edges: DataFrame, rate: float, now: int) -> DataFrame:
    """Weights by the age of their last change; times stay, so that decaying
    twice decays more. Works on edges by id and by index."""
    days = (F.lit(int(now)) - F.col("last_modified")).cast("double") / DAY
    return edges.withColumn("weight", F.col("weight") * age_factor(rate, days))


@dataclass
class Compiled:
    """node_index (idx, id) and edges (src_idx, dst_idx, weight, last_modified,
    type). ``two_way`` may only be true if every edge has one that runs back."""

    node_index: DataFrame
    edges: DataFrame
    two_way: bool = False

    def written(self) -> Compiled:
        """With its edges in a table, for whoever reads them more than once."""
        return Compiled(self.node_index, table(self.edges, "compiled"), self.two_way)

    def row_ptr(self) -> DataFrame:
        """(idx, row_start, row_end) of each node's edges in order."""
        degree = self.edges.groupBy(F.col("src_idx").alias("idx")).agg(F.count("*").alias("degree"))
        sized = self.node_index.select("idx").join(degree, "idx", "left").fillna(0, ["degree"])
        return prefix_sum(sized, [F.col("idx")], "degree", "row_start").select("idx", "row_start", (F.col("row_start") + F.col("degree")).alias("row_end"))

    def slice(self, keep: Column) -> Compiled:
        """The nodes that ``keep``, over idx and id, is true for, the edges
        between them, and new indices in the same order."""
        kept = _indexed(self.node_index.where(keep), [F.col("idx")], "_new")
        a, b = (kept.select(F.col("idx").alias(f"{s}_idx"), F.col("_new").alias(f"_{s}")) for s in ("src", "dst"))
        edges = self.edges.join(a, "src_idx").join(b, "dst_idx").select(F.col("_src").alias("src_idx"), F.col("_dst").alias("dst_idx"), "weight", "last_modified", "type")
        return Compiled(kept.select(F.col("_new").alias("idx"), "id"), edges)

    def boundary(self, group: DataFrame) -> DataFrame:
        """(source_index, target_index, weight) of edges that leave the group
        of indices in ``group.idx``."""
        inside = group.select("idx").distinct()
        out = self.edges.join(inside, F.col("src_idx") == F.col("idx"), "left_semi").join(inside, F.col("dst_idx") == F.col("idx"), "left_anti")
        return out.select(F.col("src_idx").alias("source_index"), F.col("dst_idx").alias("target_index"), "weight")

    def weights(self) -> DataFrame:
        """The weights as a 1 x E matrix (i, j, v), in order of edges."""
        numbered = prefix_sum(self.edges.select("src_idx", "dst_idx", "weight", F.lit(1).cast("long").alias("_one")), [F.col("src_idx"), F.col("dst_idx")], "_one", "j")
        return numbered.select(F.lit(0).cast("long").alias("i"), "j", F.col("weight").alias("v"))

    def with_weights(self, weights: DataFrame) -> Compiled:
        """A graph with the weights of a 1 x E matrix."""
        numbered = prefix_sum(self.edges.drop("weight").withColumn("_one", F.lit(1).cast("long")), [F.col("src_idx"), F.col("dst_idx")], "_one", "j").drop("_one")
        edges = numbered.join(weights.select("j", F.col("v").alias("weight")), "j").select("src_idx", "dst_idx", "weight", "last_modified", "type")
        return Compiled(self.node_index, edges)

    def topology_hash(self) -> bytes:
        """SHA-256 of row starts, targets and weights as little-endian int32,
        int32 and float32. Both tables are sorted once and packed by the
        executors; one task reads the packed files one after another, a batch
        at a time, and only the digest comes to the driver."""
        spark = self.edges.sparkSession
        own = self.written()
        ends = _packed(own.row_ptr().select("idx", "row_end"), ["idx"], {"row_end": "<i4"})
        edges = _packed(own.edges.select("src_idx", "dst_idx", "weight"), ["src_idx", "dst_idx"], {"dst_idx": "<i4", "weight": "<f4"})
        files = [(column, path) for packed, column in ((ends, "row_end"), (edges, "dst_idx"), (edges, "weight")) for path in _files(packed)]
        found = spark.createDataFrame([(0,)], "n int").coalesce(1).mapInArrow(_hashing(files), "digest binary").collect()
        for packed in (ends, edges, own.edges):
            drop(packed)
        (row,) = found
        return bytes(row.digest)


def _files(packed: DataFrame) -> list[str]:
    """The files of a packed table, in order of its parts; each part is one file."""
    rows = packed.select("part", F.input_file_name().alias("path")).distinct().collect()
    if len({r.part for r in rows}) < len(rows):
        raise ValueError("a part of the packed table has more than one file")
    return [r.path for r in sorted(rows, key=lambda r: r.part)]


def _hashing(files: list[tuple[str, str]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """One digest of an int32 zero and of the packed bytes of (column, file)
    after file, for each row that comes in."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _ in (row for batch in batches for row in range(batch.num_rows)):
            digest = hashlib.sha256(np.zeros(1, "<i4").tobytes())
            for column, file in files:
                system, path = fs.FileSystem.from_uri(file)
                with system.open_input_file(path) as raw:
                    at = 0
                    for part in pq.ParquetFile(raw).iter_batches(1, columns=["at", column]):
                        if part.column("at")[0].as_py() != at:
                            raise ValueError(f"the packed rows of {file} are out of order")
                        digest.update(part.column(column)[0].as_buffer())
                        at += 1
            yield pa.RecordBatch.from_arrays([pa.array([digest.digest()], pa.binary())], names=["digest"])

    return run


def _packed(df: DataFrame, order: list[str], kinds: dict[str, str]) -> DataFrame:
    """(part, at, columns as bytes) of the rows in order, many to a row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for at, batch in enumerate(batches):
            columns = [pa.array([batch.column(c).to_numpy(zero_copy_only=False).astype(k).tobytes()], pa.binary()) for c, k in kinds.items()]
            yield pa.RecordBatch.from_arrays([pa.array([at], pa.int64()), *columns], names=["at", *kinds])

    packed = df.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(run, ", ".join(["at bigint", *(f"{c} binary" for c in kinds)]))
    return table(packed.withColumn("part", F.spark_partition_id()), "packed")


def _indexed(df: DataFrame, order: list[Column], out: str) -> DataFrame:
    return prefix_sum(df.withColumn("_one", F.lit(1).cast("long")), order, "_one", out).drop("_one")


def compile_graph(nodes: DataFrame, edges: DataFrame) -> Compiled:
    """Index nodes by the rank of their id, without case, and edges by their
    ends' indices. The rank is a two-pass prefix sum."""
    index = _indexed(nodes.select("id", key(F.col("id")).alias("_key")).dropDuplicates(["_key"]), [F.col("_key")], "idx")
    a, b = (index.select(F.col("_key").alias(f"_k_{s}"), F.col("idx").alias(f"{s}_idx")) for s in ("src", "dst"))
    found = edges.join(a, key(F.col("src")) == F.col("_k_src")).join(b, key(F.col("dst")) == F.col("_k_dst"))
    return Compiled(index.select("idx", "id"), found.select("src_idx", "dst_idx", "weight", "last_modified", "type"))


def index_log(log: DataFrame) -> DataFrame:
    """(idx, id) of the graph that ``log`` folds into: its ends, without folding it."""
    rows = _log_rows(log)
    ids = rows.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
    return _indexed(ids, [F.col("id")], "idx").select("idx", "id")


def compile_log(log: DataFrame, fold_rows: int = FOLD_ROWS) -> Compiled:
    """``compile_graph`` of ``accumulate(log)`` and its ends.

    Ids are turned into indices before anything is folded, so a row of the log
    is shuffled three times: by either id and by its pair of indices. Both ways
    of a pair meet in one task, where they are told apart, and a task gets
    ``fold_rows`` rows on average, however many there are in all."""
    index = index_log(log)
    a, b = (index.select(F.col("id").alias(f"_k_{s}"), F.col("idx").alias(f"{s}_idx")) for s in ("src", "dst"))
    placed = _log_rows(log).join(a, F.col("src") == F.col("_k_src")).join(b, F.col("dst") == F.col("_k_dst"))
    pair = F.least("src_idx", "dst_idx").alias("_lo"), F.greatest("src_idx", "dst_idx").alias("_hi")
    parts = max(int(log.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-log.count() // fold_rows))
    together = placed.select(*pair, "src_idx", "dst_idx", "delta", "ts", "type").repartition(parts, "_lo", "_hi")
    edges = _folded(_ways(together, "src_idx", "dst_idx"), "_lo", "_hi", "src_idx", "dst_idx")
    two_way = log.where(~F.col("type").eqNullSafe(ASSOCIATIVE)).isEmpty()
    return Compiled(index, edges.select("src_idx", "dst_idx", "weight", "last_modified", "type"), two_way)


#: Neighbours that are held or sent on at once.
HELD = 1 << 20


def jaccard(edges: DataFrame, u: str = "src_idx", v: str = "dst_idx") -> DataFrame:
    """(u, v, similarity) of all pairs u < v that share an out-neighbour; all
    other pairs, and those without neighbours, have 0. Types and weights don't
    count. A hub that n nodes point to makes n (n - 1) / 2 pairs: they are the
    result.

    Pairs are not shuffled one by one: each node gets, for each of its
    out-neighbours, the list of the greater nodes that point there too, and the
    lists of a node are counted one node at a time. Ends must be whole numbers."""
    out = edges.select(F.col(u).cast("long").alias("u"), F.col(v).alias("to"))
    parts = max(int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-edges.count() // FOLD_ROWS))
    # Distinct and counted where a node's edges are.
    known = out.repartition(parts, "u").groupBy("u", "to").agg(F.lit(1).alias("_one"))
    known = known.withColumn("d", F.count("*").over(Window.partitionBy("u"))).select("u", "to", "d")
    lists = known.where("to IS NOT NULL AND u IS NOT NULL").repartition(parts, "to").sortWithinPartitions("to", "u").select("to", "u", "d").mapInArrow(released(_rest), "u bigint, d bigint, vs array<bigint>, ds array<bigint>")
    return lists.repartition(parts, "u").sortWithinPartitions("u").mapInArrow(released(_similarities), "u bigint, v bigint, similarity double")


def _groups(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[pa.Table]:
    """The rows again, never a part of a group: those with one value of ``column``."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        of = batch.column(column)
        new = pc.not_equal(of[1:], of[:-1]).to_numpy(zero_copy_only=False)
        last = int(np.flatnonzero(new)[-1]) + 1 if new.any() else 0
        if held and held[-1].column(column)[-1] != of[0]:
            yield pa.Table.from_batches(held)
            held = []
        if last:
            yield pa.Table.from_batches([*held, batch.slice(0, last)])
            held = []
        held.append(batch.slice(last))
    if held:
        yield pa.Table.from_batches(held)


def _rest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows by ``to`` and ``u``: each row with the rows of its group after
    it, in pieces of ``HELD`` at most."""
    for found in _groups(batches, "to"):
        u, d = (found.column(c).to_numpy() for c in ("u", "d"))
        new = pc.not_equal(found.column("to")[1:], found.column("to")[:-1]).to_numpy()
        ends = np.append(np.flatnonzero(new) + 1, len(u))
        end = np.repeat(ends, np.diff(ends, prepend=0))
        first, last = np.arange(len(u)) + 1, end
        pieces = -(-(last - first) // HELD)
        row = np.repeat(np.arange(len(u)), pieces)
        a = first[row] + HELD * (np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces))
        sizes = np.minimum(a + HELD, last[row]) - a
        part = np.cumsum(sizes) // HELD
        for p in np.unique(part):
            k = np.flatnonzero(part == p)
            at = np.arange(sizes[k].sum()) + np.repeat(a[k] - np.cumsum(sizes[k]) + sizes[k], sizes[k])
            offsets = pa.array(np.concatenate([[0], np.cumsum(sizes[k])]), pa.int32())
            lists = [pa.ListArray.from_arrays(offsets, pa.array(x[at], pa.int64())) for x in (u, d)]
            yield pa.RecordBatch.from_arrays([pa.array(u[row[k]]), pa.array(d[row[k]]), *lists], names=["u", "d", "vs", "ds"])


def _similarities(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows by ``u``: how often each v comes in the lists of one u. Lists
    are folded into counts whenever more than ``HELD`` neighbours are held."""
    now, own, held, size = None, 0, [], 0

    def folded() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        v, d, n = (np.concatenate(x) for x in zip(*held))
        v, first, where = np.unique(v, return_index=True, return_inverse=True)
        return v, d[first], np.bincount(where, n, len(v))

    def closed() -> Iterator[pa.RecordBatch]:
        if held:
            v, d, n = folded()
            for i in range(0, len(v), HELD):
                s = slice(i, i + HELD)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(v[s]), now)), pa.array(v[s]), pa.array(n[s] / (own + d[s] - n[s]))], names=["u", "v", "similarity"])

    for batch in batches:
        us, of = (batch.column(c).to_numpy() for c in ("u", "d"))
        vs, ds = (batch.column(c) for c in ("vs", "ds"))
        begin, v, d = vs.offsets.to_numpy(), vs.values.to_numpy(), ds.values.to_numpy()
        changes = np.flatnonzero(np.diff(us)) + 1
        for i, j in zip([0, *changes], [*changes, len(us)]):
            if i == j:
                continue
            if us[i] != now:
                yield from closed()
                now, own, held, size = us[i], of[i], [], 0
            s = slice(begin[i], begin[j])
            held.append((v[s], d[s], np.ones(begin[j] - begin[i])))
            size += begin[j] - begin[i]
            if size > HELD + (len(held[0][0]) if len(held) > 1 else 0):
                held, size = [folded()], 0
    yield from closed()


def neighbour_similarity(edges: DataFrame, a, b, u: str = "src_idx", v: str = "dst_idx") -> float:
    """The Jaccard index of two nodes' out-neighbours; 0 if there are none."""
    of = edges.where(F.col(u).isin([a, b])).groupBy(v).agg(F.count_distinct(u).alias("n"))
    row = of.agg(F.sum(F.when(F.col("n") == (1 if a == b else 2), 1).otherwise(0)).alias("both"), F.count("*").alias("any")).first()
    return float(row["both"] / row["any"]) if row["any"] else 0.0


