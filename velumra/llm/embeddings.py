"""Near-duplicate embeddings by E8 lattice hashing."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.components import weak_components
from ..plans.lineage import table
from ..plans.memory import released
from .words import mix

COSINE = 0.95
TABLES = 8
#: Lattice blocks of a key. Each more divides chance collisions by some 600;
#: two suit some 10**6 vectors, four some 10**12.
BLOCKS = 2
#: Cells probed in each block: the nearest and its nearest neighbours.
PROBES = 3
#: In a cell that isn't of one class, so many that live there meet so many that ask in one step.
PART = 2048
SCALE = 5.0


def _neighbours() -> np.ndarray:
    """The 240 shortest vectors of E8."""
    whole = []
    for i, j in combinations(range(8), 2):
        for a, b in product((1, -1), repeat=2):
            v = np.zeros(8)
            v[i], v[j] = a, b
            whole.append(v)
    half = [np.array(s) / 2 for s in product((1, -1), repeat=8) if np.prod(s) > 0]
    return np.array(whole + half)


NEIGHBOURS = _neighbours()


def _nearest_d8(x: np.ndarray) -> np.ndarray:
    """The nearest points with whole coordinates of even sum."""
    f = np.rint(x)
    off = x - f
    odd = np.flatnonzero(f.sum(1) % 2 != 0)
    worst = np.abs(off[odd]).argmax(1)
    f[odd, worst] += np.where(off[odd, worst] >= 0, 1.0, -1.0)
    return f


def decode(x: np.ndarray) -> np.ndarray:
    """The nearest points of E8, which is D8 and D8 moved by a half."""
    a, b = _nearest_d8(x), _nearest_d8(x - 0.5) + 0.5
    nearer = ((x - a) ** 2).sum(1) <= ((x - b) ** 2).sum(1)
    return np.where(nearer[:, None], a, b)


def cells(x: np.ndarray, probes: int) -> np.ndarray:
    """(rows, probes, 8): the nearest points and then its nearest neighbours,
    nearest to ``x`` first."""
    home = decode(x)
    out = home[:, None, :]
    if probes > 1:
        toward = (x - home) @ NEIGHBOURS.T
        best = np.argsort(-toward, 1, kind="stable")[:, : probes - 1]
        out = np.concatenate([out, home[:, None, :] + NEIGHBOURS[best]], 1)
    return out


def keys(x: np.ndarray, tables: int, blocks: int, probes: int, scale: float, seed: int = 29) -> np.ndarray:
    """(rows, tables x probes ** blocks) hashes of lattice cells of unit vectors;
    the first of each table is the vector's own cell."""
    n, dim = x.shape
    out = []
    for t in range(tables):
        rng = np.random.default_rng([seed, t, dim])
        turn = np.linalg.qr(rng.normal(size=(max(dim, 8 * blocks), max(dim, 8 * blocks))))[0][:dim, : 8 * blocks]
        y = x @ turn * (scale * np.sqrt(max(dim, 8 * blocks) / 64.0))
        total = np.full((n, 1), mix(np.array([t * 1000003 + dim], np.uint64))[0])
        for b in range(blocks):
            points = (2 * cells(y[:, 8 * b : 8 * b + 8], probes)).astype(np.int64).view(np.uint64)
            odd = rng.integers(0, 2**63, 8, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
            h = mix((points * odd).sum(2, dtype=np.uint64))
            total = mix((total * np.uint64(0x9E3779B97F4A7C15))[:, :, None] + h[:, None, :]).reshape(n, -1)
        out.append(total)
    return np.concatenate(out, 1)


def _matrix(column: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """(row numbers, unit vectors) of the usable vectors, by dimension."""
    groups: dict[int, tuple[list, list]] = {}
    for i, v in enumerate(column.to_pylist()):
        if v and None not in v:
            rows, vectors = groups.setdefault(len(v), ([], []))
            rows.append(i)
            vectors.append(v)
    out = []
    for rows, vectors in groups.values():
        x = np.array(vectors, np.float64)
        norm = np.sqrt((x * x).sum(1))
        good = np.isfinite(norm) & (norm > 0)
        out.append((np.array(rows)[good], x[good] / norm[good, None]))
    return out


def _units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Usable vectors with their unit vectors as packed floats."""
    for batch in batches:
        ids = batch.column("rep").to_numpy(zero_copy_only=False)
        for rows, x in _matrix(batch.column("embedding")):
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids[rows]), batch.column("pa").take(pa.array(rows)), batch.column("pb").take(pa.array(rows)), pa.array([v.tobytes() for v in x.astype("<f4")], pa.binary())],
                names=["rep", "pa", "pb", "unit"],
            )


def _unpacked(units: list[bytes]) -> list[tuple[np.ndarray, np.ndarray]]:
    """(row numbers, vectors), by dimension."""
    sizes = np.array([len(u) for u in units], np.int64)
    out = []
    for size in np.unique(sizes):
        rows = np.flatnonzero(sizes == size)
        out.append((rows, np.frombuffer(b"".join([units[k] for k in rows]), "<f4").reshape(len(rows), -1)))
    return out


def _hashed(tables: int, blocks: int, probes: int, scale: float):
    """(key, id, home): each vector in its own cell of each table and in those it asks."""
    each = probes**blocks

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(0, whole.num_rows, 1024):
                batch = whole.slice(k, 1024)
                ids = batch.column("rep").to_numpy(zero_copy_only=False)
                for rows, x in _unpacked(batch.column("unit").to_pylist()):
                    h = keys(x.astype(np.float64), tables, blocks, probes, scale)
                    home = np.tile(np.arange(h.shape[1]) % each == 0, len(rows))
                    yield pa.RecordBatch.from_arrays([pa.array(h.reshape(-1).view(np.int64)), pa.array(np.repeat(ids[rows], h.shape[1])), pa.array(home)], names=["key", "id", "home"])

    return run


def _alike(least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            alike = np.zeros(batch.num_rows, bool)
            x, y = (batch.column(c).to_pylist() for c in ("x", "y"))
            same = np.array([len(a) == len(b) for a, b in zip(x, y)], bool)
            for rows, left in _unpacked(x):
                keep = same[rows]
                right = b"".join([y[k] for k in rows[keep]])
                right = np.frombuffer(right, "<f4").reshape(int(keep.sum()), left.shape[1])
                alike[rows[keep]] = np.einsum("ij,ij->i", left[keep], right, dtype=np.float64) >= least
            yield batch.select(["id", "hub"]).append_column("alike", pa.array(alike))

    return run


def chained(homes: np.ndarray, asks: np.ndarray, x: np.ndarray, y: np.ndarray, held: tuple[np.ndarray, np.ndarray], least: float) -> tuple[list[int], list[int]]:
    """Pairs of vectors ``homes`` and ``asks`` (with unit vectors ``x``, ``y``)
    of cosine of at least ``least`` that connect all that such pairs connect,
    given that those ``held`` are connected already; fewer pairs than vectors."""
    own, back = np.unique(np.concatenate([homes, asks]), return_inverse=True)
    label = np.arange(len(own))
    left, right = back[: len(homes)], back[len(homes) :]
    joined = np.unique(np.concatenate([left[held[0]], right[held[1]]]))
    if len(joined):
        label[joined] = joined[0]
    out: tuple[list[int], list[int]] = ([], [])
    for k in range(0, len(homes), 512):
        near = x[k : k + 512] @ y.T >= least
        for i in np.flatnonzero(near.any(1)):
            h, others = left[k + i], right[near[i]]
            labels, first = np.unique(label[others], return_index=True)
            new = labels != label[h]
            if new.any():
                out[0].extend([int(own[h])] * int(new.sum()))
                out[1].extend(own[others[first[new]]].tolist())
                label[np.isin(label, labels[new])] = label[h]
    return out


def _rest(least: float):
    """Of rows in order of (key, i, j), the part of a cell in one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, held = None, []

        def pairs(rows: list) -> tuple[list[int], list[int]]:
            ids, home, alike, units = (list(c) for c in zip(*rows))
            ids, home, alike = np.array(ids, np.int64), np.array(home, bool), np.array(alike, bool)
            out: tuple[list[int], list[int]] = ([], [])
            for at, x in _unpacked(units):
                h, a = home[at], ~home[at]
                if h.any() and a.any():
                    own, same = ids[at], alike[at]
                    for full, some in zip(out, chained(own[h], own[a], x[h], x[a], (same[h], same[a]), least)):
                        full += some
            return out

        def edges(found: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([e for f in found for e in f[k]], pa.int64()) for k in (0, 1)], names=["id", "hub"])

        for batch in batches:
            found = []
            for key, i, j, *row in zip(*(batch.column(c).to_pylist() for c in ("key", "i", "j", "id", "home", "alike", "unit"))):
                if (key, i, j) != place:
                    if held:
                        found.append(pairs(held))
                    place, held = (key, i, j), []
                held.append(row)
            yield edges(found)
        if held:
            yield edges([pairs(held)])

    return run


def near_classes(
    vectors: DataFrame, cosine: float = COSINE, tables: int = TABLES, blocks: int = BLOCKS, probes: int = PROBES, scale: float = SCALE
) -> DataFrame:
    """(vec_id, class_id, links): each vector's class of near duplicates, by
    its least vec_id, and how many other vectors it is linked with by that,
    directly or through others. Two vectors are linked if their cosine is at
    least ``cosine``.

    Equal vectors collapse first. In each of ``tables`` random rotations,
    ``blocks`` times eight coordinates are decoded to their E8 points, and
    every vector asks in the cells of the ``probes`` nearest points of each
    block for those that live there. All that ask in a cell are verified with
    the least that lives there, its hub. Where one fails, those that live in
    the cell are compared with all that ask, in parts of ``PART`` by ``PART``,
    and each part passes on fewer links than it has vectors. So no group is
    written as pairs or gathered in one task, and no link that the lattice
    finds between different vectors is lost to its class.

    Defined results: vectors that are null or empty, hold a null, a NaN or an
    infinity, or have no length, have no link; rows with a null vec_id are left
    out; vectors of different dimensions are never linked; rows that repeat a
    vec_id are one vector, linked by all of its rows; an empty table gives
    none; other columns are ignored."""
    plain = vectors.where("vec_id IS NOT NULL").select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<float>").alias("embedding"))
    named = plain.withColumns({"pa": F.xxhash64("embedding"), "pb": F.xxhash64("embedding", F.lit(1))})
    firsts = named.where("embedding IS NOT NULL").groupBy("pa", "pb").agg(F.min("vec_id").alias("rep"), F.first("embedding").alias("embedding"))
    units = table(firsts.mapInArrow(released(_units), "rep bigint, pa bigint, pb bigint, unit binary"), "units")
    named = named.select("vec_id", "pa", "pb")
    asked = units.select("rep", "unit").mapInArrow(released(_hashed(tables, blocks, probes, scale)), "key bigint, id bigint, home boolean")
    # A vec_id with several vectors would be its own neighbour: ids are those of vectors, by rep, which may be equal.
    asked = table(asked.distinct(), "cells")
    hubs = asked.where("home").groupBy("key").agg(F.min("id").alias("hub"), F.countDistinct("id").alias("homes"))
    tied = table(asked.join(hubs, "key").where("id != hub"), "tied")
    unit = units.select(F.col("rep").alias("id"), "unit")
    tried = tied.select("id", "hub").distinct().join(unit.withColumnRenamed("unit", "x"), "id").join(unit.select(F.col("id").alias("hub"), F.col("unit").alias("y")), "hub")
    tried = tried.select("id", "hub", "x", "y").mapInArrow(released(_alike(cosine)), "id bigint, hub bigint, alike boolean")
    tried = table(tried.groupBy("id", "hub").agg(F.max("alike").alias("alike")), "tried")
    # Cells with another home than the hub, in which not all are like the hub.
    members = table(tied.where("homes > 1").join(tried, ["id", "hub"]).select("key", "id", "home", "alike"), "members")
    mixed = members.groupBy("key").agg(F.count(F.when(F.col("home"), 1)).alias("_homes"), F.count("*").alias("_all"), F.bool_and("alike").alias("_alike")).where("NOT _alike")
    mixed = mixed.select("key", F.ceil(F.col("_homes") / PART).cast("int").alias("_hs"), F.ceil(F.col("_all") / PART).cast("int").alias("_as"))
    rows = members.join(mixed, "key")
    part = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = rows.where("home").select("key", part("_hs").alias("i"), every("_as").alias("j"), "id", "home", "alike")
    right = rows.select("key", every("_hs").alias("i"), part("_as").alias("j"), "id", F.lit(False).alias("home"), "alike")
    parts = left.unionByName(right).join(unit, "id").repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "id", "home")
    edges = tried.where("alike").select("id", "hub").unionByName(parts.mapInArrow(released(_rest(cosine)), "id bigint, hub bigint"))
    copies = named.join(units.select("pa", "pb", "rep"), ["pa", "pb"]).where("vec_id != rep").select(F.col("vec_id").alias("id"), F.col("rep").alias("hub")).distinct()
    groups = weak_components(edges.where("id != hub").unionByName(copies), "id", "hub")
    classes = named.select("vec_id").distinct().join(groups.withColumnRenamed("node", "vec_id"), "vec_id", "left").select("vec_id", F.coalesce("component", "vec_id").alias("class_id"))
    classes = table(classes, "classes")
    sizes = classes.groupBy("class_id").agg((F.count("*") - 1).alias("links"))
    return classes.join(sizes, "class_id").select("vec_id", "class_id", "links")


SQL = """
WITH RECURSIVE near AS MATERIALIZED (
  SELECT a.vec_id AS i, b.vec_id AS j FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) >= 0.95
), reached(vec_id, other) AS (
  SELECT vec_id, vec_id FROM embeddings UNION SELECT r.vec_id, n.j FROM reached r JOIN near n ON n.i = r.other
)
SELECT vec_id, min(other) AS class_id, count(*) - 1 AS links FROM reached GROUP BY vec_id
"""
