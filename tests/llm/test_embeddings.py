import itertools

import brute
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from against import differences

from velumra.llm import embeddings, queries


def classes(df):
    return {r.vec_id: (r.class_id, r.links) for r in df.collect()}


def planted(seed: int, dim: int = 64):
    """Strangers; near copies of them that are near to one another or not,
    chains, groups of hundreds, and exact copies; in no order."""
    rng = np.random.default_rng(seed)
    unit = lambda x: x / np.linalg.norm(x, axis=-1, keepdims=True)
    base = unit(rng.normal(size=(900, dim)))
    near = lambda x, cosine: unit(cosine * x + np.sqrt(1 - cosine**2) * unit(rng.normal(size=x.shape)))
    parts = [base, near(base[:150], 0.97), near(base[:100], 0.955), near(base[200:300], 0.93), near(np.repeat(base[400:402], 300, 0), 0.99), base[500:560], base[500:560]]
    link = base[600:630]
    for _ in range(4):
        link = near(link, 0.965)
        parts.append(link)
    x = np.concatenate(parts).astype(np.float32)
    return rng.permutation(x)


def exact(x):
    x = x.astype(float)
    x /= np.linalg.norm(x, axis=1)[:, None]
    a, b = np.nonzero(np.triu(x @ x.T >= embeddings.COSINE, 1))
    return list(zip(a.tolist(), b.tolist()))


@pytest.mark.parametrize("seed, dim", [(0, 64), (3, 256)])
def test_recall_against_all_pairs(spark, seed, dim):
    x = planted(seed, dim)
    want = exact(x)
    top = brute.groups(want)
    found = classes(embeddings.near_classes(spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id bigint, embedding array<float>").repartition(7)))
    assert len(found) == len(x) and len(want) > 20_000
    # Of pairs; those inside groups of hundreds don't hide the others.
    small = [(a, b) for a, b in want if sum(t == top[a] for t in top.values()) < 100]
    for pairs in (want, small):
        assert len(pairs) > 300 and sum(found[a][0] == found[b][0] for a, b in pairs) >= 0.98 * len(pairs)
    # Nobody is in a class that links don't make, and counts agree.
    assert all(top.get(k, k) == top.get(c, c) for k, (c, _) in found.items())
    sizes = {}
    for c, _ in found.values():
        sizes[c] = sizes.get(c, 0) + 1
    assert all(n == sizes[c] - 1 and c <= k for k, (c, n) in found.items())


def test_equals_sql_where_there_are_classes(spark, tmp_path):
    """The registered SQL over vectors that have classes."""
    rng = np.random.default_rng(8)
    x = planted(5)[:700]
    x = np.concatenate([x, x[:80], x[100:180] + rng.normal(size=(80, 64)).astype(np.float32) * 0.01])
    ids = rng.permutation(5000)[: len(x)]
    pq.write_table(pa.table({"vec_id": pa.array(ids, pa.int64()), "embedding": pa.array(x.tolist(), pa.list_(pa.float32())), "label": pa.array(ids % 3, pa.int32())}), tmp_path / "embeddings.parquet")
    got = queries.op7_embeddings(spark, str(tmp_path))
    assert len({r.class_id for r in got.where("links > 0").collect()}) > 100
    assert differences(got, embeddings.SQL, str(tmp_path)) == ""


@pytest.mark.parametrize("sf", ["0.001", "0.01"])
def test_query_equals_sql(spark, sf):
    assert differences(queries.op7_embeddings(spark, f"/root/testdata/sf{sf}"), embeddings.SQL, f"/root/testdata/sf{sf}") == ""


def test_decoding_finds_the_nearest_point():
    """Against all points of the lattice around."""
    rng = np.random.default_rng(0)
    x = rng.normal(scale=3, size=(200, 8))
    home = embeddings.decode(x)
    assert np.allclose((2 * home) % 1, 0) and np.allclose(home.sum(1) % 2, 0)
    far = ((x - home) ** 2).sum(1)
    around = home[:, None, :] + embeddings.NEIGHBOURS
    assert (((x[:, None, :] - around) ** 2).sum(2) >= far[:, None] - 1e-9).all() and len(embeddings.NEIGHBOURS) == 240
    near = embeddings.cells(x, 3)
    assert np.allclose(near[:, 0], home) and np.allclose(((near[:, 1] - home) ** 2).sum(1), 2)


def test_recall_on_noise(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(400, 32))
    x = np.concatenate([x, x + rng.normal(size=x.shape) * 0.2])
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id bigint, embedding array<float>")
    x /= np.linalg.norm(x, axis=1)[:, None]
    want = {(i, j) for i, j in itertools.combinations(range(len(x)), 2) if x[i] @ x[j] >= 0.95}
    found = classes(embeddings.near_classes(df))
    assert len(want) > 350 and sum(found[i][0] == found[j][0] for i, j in want) >= 0.98 * len(want)


def test_chained_parts_connect_as_all_pairs_do():
    rng = np.random.default_rng(2)
    for _ in range(40):
        base = rng.normal(size=(6, 8))
        x = base[rng.integers(0, 6, 60)] + rng.normal(size=(60, 8)) * rng.choice([0.1, 0.4])
        x /= np.linalg.norm(x, axis=1)[:, None]
        homes, asks = np.arange(30), np.concatenate([np.arange(30, 60), np.arange(10)])
        y = x[asks]
        held = (x[homes] @ x[0] >= 0.9, y @ x[0] >= 0.9)
        a, b = embeddings.chained(homes, asks, x[homes], y, held, 0.9)
        assert len(a) < 60 and all(x[i] @ x[j] >= 0.9 for i, j in zip(a, b))
        known = [(0, int(i)) for i in homes[held[0]]] + [(0, int(i)) for i in asks[held[1]]]
        every = [(int(i), int(j)) for i in homes for j in asks if i != j and x[i] @ x[j] >= 0.9]
        assert brute.groups(known + list(zip(a, b))) == brute.groups(known + every)


def test_a_hot_cell_that_is_not_of_one_class(spark, monkeypatch):
    """Many vectors of two classes in one cell, cut into many parts."""
    monkeypatch.setattr(embeddings, "PART", 16)
    rng = np.random.default_rng(4)
    base = rng.normal(size=64)
    base /= np.linalg.norm(base)
    side = rng.normal(size=64)
    side -= (side @ base) * base
    side *= np.sqrt(1 / 0.94**2 - 1) / np.linalg.norm(side)
    x = np.concatenate([base + rng.normal(size=(150, 64)) * 0.003, base + side + rng.normal(size=(150, 64)) * 0.003])
    top = brute.groups(exact(x))
    found = classes(embeddings.near_classes(spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id bigint, embedding array<float>"), scale=0.5))
    assert len(set(top.values())) == 2 and {k: c for k, (c, _) in found.items()} == top


def test_odd_rows(spark):
    v = [0.1 * k for k in range(16)]
    rows = [(1, v), (2, v), (3, [2 * a for a in v]), (3, [2 * a for a in v]), (4, None), (5, []), (6, [0.0] * 16), (7, [float("nan")] * 16), (8, [None] + v[1:]), (9, v[:8]), (None, v), (10, [float("inf")] * 16), (11, [0.0] * 16), (12, [1.0]), (13, [5.0]), (14, v[::-1]), (14, v)]
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], "vec_id int, embedding array<double>, key string, rep string")
    got = classes(embeddings.near_classes(df))
    alone = {k: (k, 0) for k in (4, 5, 6, 7, 8, 9, 10, 11)}
    assert got == {1: (1, 3), 2: (1, 3), 3: (1, 3), 14: (1, 3), 12: (12, 1), 13: (12, 1)} | alone
    assert embeddings.near_classes(df.limit(0)).count() == 0
