import hashlib
import io
import re
import struct

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F
from pyspark.sql.classic.dataframe import DataFrame

from velumra.operators import blocks as B
from velumra.operators import centrality as C
from velumra.operators import graph as G
from velumra.operators import paths as P
from velumra.operators.components import weak_components
from velumra.sources import snapshot as S

A, ST = G.ASSOCIATIVE, G.STRUCTURAL


def log(spark, *rows):
    return spark.createDataFrame([(a, b, float(w), ts, t) for a, b, w, ts, t in rows], "`from` string, `to` string, delta double, ts bigint, type int")


def edges(spark, *rows):
    return G.accumulate(log(spark, *((a, b, w, 0, t) for a, b, w, t in rows)))


def nodes(spark, *ids):
    return spark.createDataFrame([(i, k) for k, i in enumerate(ids)], "id string, data int")


def compiled(spark, ids, *rows):
    return G.compile_graph(nodes(spark, *ids), edges(spark, *rows))


def as_dict(df):
    return {(r.src, r.dst): (r.weight, r.last_modified, r.type) for r in df.collect()}


def test_accumulate(spark):
    found = as_dict(G.accumulate(log(spark, ("A", "b", 1, 1000, A), ("a", "B", 1, 500, A), ("b", "a", 0.5, 7, A))))
    assert found == {("a", "b"): (2.5, 1000, A), ("b", "a"): (2.5, 1000, A)}


def test_types_and_loops(spark):
    found = as_dict(edges(spark, ("a", "b", 1, A), ("a", "b", 1, ST), ("c", "C", 2, A)))
    assert found == {("a", "b"): (2, 0, ST), ("b", "a"): (1, 0, A), ("c", "c"): (2, 0, A)}


def test_missing_ends_and_blank_ids(spark):
    with pytest.raises(PySparkException, match="source node is missing"):
        G.accumulate(log(spark, ("x", "b", 1, 0, A)), nodes(spark, "b")).collect()
    with pytest.raises(PySparkException, match="needs an id"):
        G.upsert_nodes(spark.createDataFrame([("  ", 1, 0)], "id string, data int, seq int")).collect()


def test_first_write_wins(spark):
    rows = G.upsert_nodes(spark.createDataFrame([("N", 2, 2), ("n", 1, 1), ("m", 5, 0)], "id string, data int, seq int")).collect()
    assert sorted(map(tuple, rows)) == [("m", 5), ("n", 1)]
    assert G.has_node(nodes(spark, "Ab"), "aB") and not G.has_node(nodes(spark, "Ab"), None)
    assert G.get_node(nodes(spark, "Ab"), "AB").data == 0
    with pytest.raises(KeyError):
        G.get_node(nodes(spark, "a"), "z")


def test_remove(spark):
    left, kept = G.remove_nodes(nodes(spark, "A", "B", "C"), edges(spark, ("A", "B", 1, A), ("B", "C", 1, ST)), nodes(spark, "b").select("id"))
    assert {r.id for r in left.collect()} == {"A", "C"} and kept.count() == 0


def test_compile(spark):
    g = compiled(spark, ["A", "B", "C"], ("A", "B", 1, A))
    assert [(r.row_start, r.row_end) for r in g.row_ptr().orderBy("idx").collect()] == [(0, 1), (1, 2), (2, 2)]
    assert g.edges.count() == 2 and P.components(g).select("component").distinct().count() == 2
    lone = compiled(spark, ["Loner"])
    assert lone.row_ptr().collect() == [(0, 0, 0)] and lone.edges.count() == 0


def test_slice_boundary_weights(spark):
    g = compiled(spark, "ABC", ("A", "B", 1, ST), ("B", "C", 1, ST))
    part = g.slice(F.col("idx") < 2)
    assert part.node_index.count() == 2 and part.edges.count() == 1
    assert g.slice(F.lit(False)).node_index.count() == 0
    g = compiled(spark, "ABCD", ("A", "B", 1, ST), ("C", "D", 1, ST), ("B", "C", 0.75, ST))
    assert g.boundary(g.node_index.where("idx < 2")).collect() == [(1, 2, 0.75)]
    again = g.with_weights(g.weights().withColumn("v", F.lit(42.0)))
    assert {r.weight for r in again.edges.collect()} == {42.0}


def test_decay(spark):
    e = G.accumulate(log(spark, ("A", "B", 10, 0, A)))
    now = int(138.629 * 86400)
    assert {round(r.weight, 3) for r in G.decay_edges(e, 0.005, now).collect()} == {5.0}
    assert {r.weight for r in G.decay_edges(e, 0.005, -now).collect()} == {10.0}
    assert {r.weight for r in G.decay_edges(e, 5.0, now).collect()} == {0.0}


def test_jaccard(spark):
    g = compiled(spark, ["a", "b", "s1", "s2", "ua", "ub", "z"], ("a", "s1", 1, ST), ("a", "s2", 1, ST), ("a", "ua", 1, ST), ("b", "s1", 1, ST), ("b", "s2", 1, ST), ("b", "ub", 1, ST))
    assert G.jaccard(g.edges).collect() == [(0, 1, 0.5)]
    assert G.neighbour_similarity(g.edges, 0, 1) == 0.5 and G.neighbour_similarity(g.edges, 0, 0) == 1 and G.neighbour_similarity(g.edges, 6, 6) == 0


@pytest.mark.parametrize("held", [3, 1 << 20])
def test_jaccard_without_shuffling_pairs(spark, monkeypatch, held):
    """Against sets, with repeats, a hub, nulls, and lists cut into small pieces."""
    monkeypatch.setattr(G, "HELD", held)
    rng = np.random.default_rng(1)
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 25, (120, 2))] + [(k, 99) for k in range(20)] + [(k, 99) for k in range(5)]
    e = spark.createDataFrame([*pairs, (3, None), (None, 4)], "src_idx bigint, dst_idx bigint")
    near = {k: {b for a, b in pairs if a == k} | ({None} if k == 3 else set()) for k in range(25)}
    want = {(a, b): len(near[a] & near[b]) / len(near[a] | near[b]) for a in near for b in near if a < b and near[a] & near[b]}
    got = G.jaccard(e)
    assert {(r.u, r.v): r.similarity for r in got.collect()} == pytest.approx(want) and got.count() == len(want)
    assert not re.search(r"hashpartitioning\(u#\d+L?, v#", got._jdf.queryExecution().toString())


def test_components(spark):
    g = compiled(spark, "ABCD", ("A", "B", 1, A), ("C", "D", 1, A), ("B", "C", 0.05, A))
    count = lambda df: df.select("component").distinct().count()
    for f in (P.components, P.directed_components):
        assert count(f(g)) == 1 and count(f(g, F.col("weight") > 0.1)) == 2


def test_long_chain(spark):
    pairs = spark.range(999).select(F.col("id").alias("u"), (F.col("id") + 1).alias("v"))
    assert weak_components(pairs).select("component").distinct().count() == 1


def test_directed_components_against_brute_force(spark):
    rng = np.random.default_rng(4)
    n, pairs = 30, [(int(a), int(b)) for a, b in rng.integers(0, 30, (28, 2))]
    ids = [f"n{k:03}" for k in range(n)]
    g = compiled(spark, ids, *((ids[a], ids[b], 1, ST) for a, b in pairs))
    label = list(range(n))
    for _ in range(n):
        for a, b in pairs:
            label[b] = min(label[b], label[a])
    assert {r.idx: r.component for r in P.directed_components(g).collect()} == dict(enumerate(label))


def test_depth(spark):
    g = compiled(spark, "ABC", ("A", "B", 1, ST), ("A", "C", 1, A))
    depth = lambda roots, p: [r.depth for r in P.dependency_depth(g, spark.createDataFrame([(x,) for x in roots], "idx bigint"), p).orderBy("idx").collect()]
    assert depth([0], 3) == [0, 1, 3] and depth([0], -1) == [0, 1, -1] and depth([0], 0) == [0, 1, 0]
    assert depth([], 3) == depth([77], 3) == [-1, -1, -1] and depth([0, 2], 3) == [0, 1, 0]


def test_flow_rank(spark):
    rank = lambda g, s=None: [r["rank"] for r in P.flow_rank(g, s).orderBy("idx").collect()]
    assert rank(compiled(spark, ["1ingest", "2intel", "3ui"], ("1ingest", "2intel", 1, ST), ("2intel", "3ui", 1, ST))) == [0, 1, 2]
    g = compiled(spark, ["a", "b", "c"], ("a", "b", 1, ST), ("b", "c", 1, A))
    assert rank(g) == [0, 1, 0]
    diamond = compiled(spark, "abcd", ("a", "b", 1, ST), ("b", "c", 1, ST), ("a", "c", 1, ST), ("c", "d", 1, ST))
    assert rank(diamond) == [0, 1, 2, 3]
    assert rank(diamond, spark.createDataFrame([(0,), (2,), (3,)], "idx bigint")) == [0, 1, 2]
    with pytest.raises(ValueError):
        P.flow_rank(diamond, spark.createDataFrame([(0,), (0,)], "idx bigint"))
    with pytest.raises(P.CycleError):
        P.flow_rank(compiled(spark, "ab", ("a", "b", 1, ST), ("b", "a", 1, ST)))


def test_cycles(spark):
    P.check_acyclic(edges(spark, ("a", "b", 1, ST), ("b", "c", 1, ST), ("c", "a", 1, A)).where("src != 'c'"))
    for rows in ([("a", "b", 1, ST), ("b", "c", 1, ST), ("c", "A", 1, ST)], [("a", "a", 1, ST)]):
        with pytest.raises(P.CycleError):
            P.check_acyclic(edges(spark, *rows))


def test_accumulation_refuses_cycles(spark):
    rows = [("ClassA", "ClassB", 0.5, 0, A), ("ClassB", "ClassA", 0.5, 0, A), ("a", "b", 1, 0, ST), ("b", "c", 1, 0, ST)]
    assert as_dict(P.accumulate_acyclic(log(spark, *rows)))["classa", "classb"] == (1, 0, A)
    with pytest.raises(P.CycleError):
        P.accumulate_acyclic(log(spark, *rows, ("c", "a", 1, 0, ST)))


def test_centrality(spark):
    g = compiled(spark, ["hub", *(f"leaf{k:02}" for k in range(99))], *(("hub", f"leaf{k:02}", 2, A) for k in range(99)))
    found = np.array([r.centrality for r in C.centrality(g).orderBy("idx").collect()])
    assert found[0] > found.mean() + 3 * found.std() and found @ found == pytest.approx(1)
    assert C.centrality(compiled(spark, [])).count() == 0


def test_centrality_by_joins_is_the_same(spark):
    rng = np.random.default_rng(3)
    ids = [f"n{k:02}" for k in range(24)]
    rows = [(ids[a], ids[b], round(float(w), 2), A) for (a, b), w in zip(rng.integers(0, 24, (30, 2)), rng.random(30))]
    g = compiled(spark, ids, *rows)
    one = {r.idx: r.centrality for r in C.centrality(g, rounds=6).collect()}
    two = {r.idx: r.centrality for r in C.centrality(g, rounds=6, island_edges=4).collect()}
    assert one == pytest.approx(two)


def test_huge_islands_against_numpy(spark, monkeypatch):
    """Blocks of a few edges, a hub over many slices, sources without a way in,
    two huge islands, a two-sided graph that swings until the last round, and
    one that stands still before it; a round is one job."""
    monkeypatch.setattr(B, "SLICE_EDGES", 7)
    rng = np.random.default_rng(8)
    pairs = {(int(a), 20 + int(b)) for a, b in rng.integers(0, 20, (150, 2))} | {(0, 20 + k) for k in range(20)}
    pairs = pairs | {(b, a) for a, b in pairs} | {(40, k) for k in (41, 42, 43)} | {(a, b) for a in range(41, 44) for b in range(41, 44)}
    weight = {p: 20 + float(w) for p, w in zip(sorted(pairs), rng.random(len(pairs)))}
    nodes_ = spark.createDataFrame([(k, 0 if k < 40 else 40) for k in range(44)], "idx bigint, island bigint")
    edges_ = spark.createDataFrame([(0 if a < 40 else 40, a, b, w) for (a, b), w in weight.items()], "island bigint, src_idx bigint, dst_idx bigint, weight double")
    made, whole = [], B._made
    monkeypatch.setattr(B, "_made", lambda *a: made.append(a) or whole(*a))
    for rounds in (0, 1, 2, 7, 30):
        want = {}
        for ids in (range(40), range(40, 44)):
            own = [(a - ids[0], b - ids[0], w) for (a, b), w in weight.items() if a in ids]
            a, b, w = map(np.array, zip(*own))
            want |= dict(zip(ids, C.island_scores(len(ids), a, b, w, rounds)))
        made.clear()
        got = {r.idx: r.centrality for r in B.huge_scores(nodes_, edges_, rounds, C.EPSILON, 16).collect()}
        assert got == pytest.approx(want, rel=1e-9) and len(got) == 44, rounds
    assert len(made) == 1 + rounds


def test_topology_hash(spark):
    g, h = (compiled(spark, "AB", ("A", "B", w, A)) for w in (1, 1.0001))
    want = hashlib.sha256(np.array([0, 1, 2, 1, 0], "<i4").tobytes() + np.ones(2, "<f4").tobytes()).digest()
    assert g.topology_hash() == want != h.topology_hash()


def test_topology_hash_of_many_parts_sends_little_to_the_driver(spark):
    """Nothing but the digest is collected, and parts are hashed in order."""
    pairs = spark.range(30_000).select((F.col("id") % 300).alias("src_idx"), (F.col("id") * 7 % 3001).alias("dst_idx")).distinct()
    edges = pairs.select("src_idx", "dst_idx", (F.col("src_idx") + F.col("dst_idx") / 8).alias("weight"), F.lit(0).cast("long").alias("last_modified"), F.lit(0).cast("tinyint").alias("type"))
    g = G.Compiled(spark.range(3001).select(F.col("id").alias("idx"), F.col("id").cast("string").alias("id")), edges)
    e = edges.orderBy("src_idx", "dst_idx").toPandas()
    ends = np.concatenate([[0], np.cumsum(np.bincount(e.src_idx, minlength=3001))]).astype("<i4")
    want = hashlib.sha256(ends.tobytes() + e.dst_idx.to_numpy().astype("<i4").tobytes() + e.weight.to_numpy().astype("<f4").tobytes()).digest()
    asked = []
    whole, DataFrame.toLocalIterator = DataFrame.toLocalIterator, lambda self, *a: asked.append(self) or whole(self, *a)
    try:
        assert g.topology_hash() == want and not asked
    finally:
        DataFrame.toLocalIterator = whole


def test_compiled_from_the_log_is_the_same(spark):
    """Both types on one pair, in both orders and cases, loops, nulls, many tasks."""
    rows = [("A", "b", 1, 5, A), ("B", "a", 2, 9, A), ("a", "B", 4, 7, ST), ("b", "A", 8, 1, ST), ("c", "C", 3, 2, A), ("d", "a", 5, 0, ST), ("z", "d", 1, 3, A), ("D", "Z", 6, 4, A)]
    given = log(spark, *rows).unionByName(spark.createDataFrame([("a", None, 1.0, 1, A), ("q", "a", None, None, A)], "`from` string, `to` string, delta double, ts bigint, type int"))
    folded = G.accumulate(given)
    want = G.compile_graph(folded.select(F.explode(F.array("src", "dst")).alias("id")).distinct(), folded)
    got = G.compile_log(given, 2)
    rows = lambda df: sorted(map(repr, df.collect()))
    assert rows(got.node_index) == rows(want.node_index) == rows(G.index_log(given)) and rows(got.edges) == rows(want.edges)
    assert G.compile_log(given.where("false")).edges.count() == 0
    # More rows make more tasks, each with no more of them.
    many = log(spark, *((f"s{k % 40}", f"p{k}", 1, 0, A) for k in range(400)))
    assert G.compile_log(many, 20).edges.select(F.spark_partition_id()).distinct().count() > 10


def test_snapshots(spark, tmp_path):
    g = compiled(spark, ["User_1", "User_2", "Ün" + "x" * 200], ("User_1", "User_2", 0.75, A), ("User_2", "Ün" + "x" * 200, 2, ST))
    S.save(g, str(tmp_path / "tables"))
    raw = io.BytesIO()
    S.write_stream(g, raw)
    raw.write(b"after")
    raw.seek(0)
    one = S.read_stream(spark, raw)
    assert raw.read() == b"after" and raw.getvalue()[:4] == bytes([0x45, 0x47, 0x52, 0x46])
    S.write_binary(g, str(tmp_path / "graph.bin"))
    rows = lambda x: sorted(map(tuple, x.edges.select("src_idx", "dst_idx", "weight", "last_modified", "type").collect()))
    for again in (one, S.read_binary(spark, str(tmp_path / "graph.bin")), S.load(spark, str(tmp_path / "tables"))):
        assert rows(again) == rows(g) and sorted(map(tuple, again.node_index.collect())) == sorted(map(tuple, g.node_index.collect()))
        assert again.topology_hash() == g.topology_hash()


@pytest.mark.parametrize("raw", [struct.pack(S.HEAD, 0xDEADBEEF, 2, 0, 0), struct.pack(S.HEAD, S.MAGIC, 999, 0, 0), struct.pack(S.HEAD, S.MAGIC, 2, 5, 5) + b"\0" * 8, b"EG"])
def test_broken_snapshots(spark, raw):
    with pytest.raises(S.SnapshotError):
        S.read_stream(spark, io.BytesIO(raw))
