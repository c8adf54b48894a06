import brute
import numpy as np
import pytest

from velumra.llm import minhash, queries
from velumra.llm.words import mix

SF = "/root/testdata/sf0.01"


def by_id(df):
    return {r.doc_id: (r.group_id, r.keep) for r in df.collect()}


def test_signatures_estimate_the_jaccard_index():
    rng = np.random.default_rng(0)
    for share in (0.2, 0.5, 0.8):
        pool = mix(rng.integers(0, 2**63, 3000, dtype=np.int64).astype(np.uint64))
        n = int(2000 * share)
        a, b = pool[:2000], pool[2000 - n : 3000]
        sig = minhash.one_permutation(np.concatenate([a, b]), np.repeat([0, 1], [len(a), len(b)]), 2)
        assert (sig[0] == sig[1]).mean() == pytest.approx(n / 3000 if share != 0.2 else 400 / 2600 * (2600 / 3000) , abs=0.1)


def test_densified_bins_of_small_sets():
    rng = np.random.default_rng(1)
    a = mix(rng.integers(0, 2**63, 12, dtype=np.int64).astype(np.uint64))
    sig = minhash.one_permutation(np.concatenate([a, a[::-1], a[:9]]), np.repeat([0, 1, 3], [12, 12, 9]), 5)
    assert (sig[0] == sig[1]).all() and (sig[2] == minhash.EMPTY).all() and (sig[4] == minhash.EMPTY).all()
    assert (sig[0] != minhash.EMPTY).all() and 0.6 < (sig[0] == sig[3]).mean() < 0.9


def test_query_against_exact_jaccard(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    found = by_id(queries.op6_minhash(spark, SF))
    pairs = brute.near_pairs(rows, 0.4)
    sure = [(a, b) for a, b, s in pairs if s >= 0.6]
    hits = sum(a in found and b in found and found[a][0] == found[b][0] for a, b in sure)
    assert sure and hits >= 0.98 * len(sure)
    # Nobody is in a group without a text that is nearly like theirs.
    loose = brute.groups([(a, b) for a, b, _ in pairs])
    assert all(d in loose and loose[d] == loose[g] for d, (g, _) in found.items())
    for g in {g for g, _ in found.values()}:
        members = sorted(d for d, (x, _) in found.items() if x == g)
        assert g == members[0] and len(members) > 1 and [found[d][1] for d in members] == [True] + [False] * (len(members) - 1)


def test_groups_of_many_copies(spark):
    base = [f"{' '.join(f'term{k}x{j}' for j in range(60))}" for k in range(3)]
    rows = [(k * 1000 + j, base[k] + f" tail{j % 4}") for k in range(3) for j in range(300)] + [(9000 + k, f"alone {' '.join(f'own{k}y{j}' for j in range(30))}") for k in range(50)]
    found = by_id(minhash.near_duplicates(brute.documents(spark, rows)))
    assert len(found) == 900 and {g for g, _ in found.values()} == {0, 1000, 2000}


def test_a_hot_bucket_that_is_not_of_one_group(spark, monkeypatch):
    """Half of all rows begin alike and are no duplicates of the rest of their
    buckets, but in pairs of one another; the parts are small."""
    monkeypatch.setattr(minhash, "PART", 8)
    start = " ".join(f"same{j}" for j in range(30))
    rows = [(2 * k + c, f"{start} " + " ".join(f"own{k}x{j}" for j in range(34)) + f" end{c}") for k in range(60) for c in range(2)]
    found = by_id(minhash.near_duplicates(brute.documents(spark, rows), rows=1))
    assert found == {d: (d - d % 2, d % 2 == 0) for d in range(120)}


def test_chained_rows_connect_as_all_pairs_do():
    rng = np.random.default_rng(3)
    for _ in range(40):
        base = rng.integers(0, 9, (5, 64)).astype("<u2")
        sig = np.where(rng.random((50, 64)) < 0.35, rng.integers(0, 9, (50, 64)), base[rng.integers(0, 5, 50)]).astype("<u2")
        share = (sig[:, None] == sig[None]).mean(2)
        alike = share[0, 1:] >= 0.5
        ids = np.concatenate([np.arange(1, 50)[~alike], np.arange(1, 50)])
        left = np.arange(len(ids)) < (~alike).sum()
        a, b = minhash.chained(ids, sig[ids], left, ~left, np.concatenate([np.zeros((~alike).sum(), bool), alike]), 0.5)
        hub = [(0, int(k)) for k in np.flatnonzero(alike) + 1]
        every = [(i, j) for i in range(50) for j in range(i) if share[i, j] >= 0.5]
        assert all(share[i, j] >= 0.5 for i, j in zip(a, b))
        assert brute.groups(hub + [(int(i), int(j)) for i, j in zip(a, b) if i != j]) == brute.groups(every)


def test_odd_rows(spark):
    docs = brute.clashing(brute.odd(spark).unionByName(brute.documents(spark, [(11, brute.LONG + " and a little more", "en", "src0"), (12, "One", None, None), (12, "two", None, None)])))
    found = by_id(minhash.near_duplicates(docs))
    assert found == {4: (4, True), 11: (4, False), 5: (5, True), 12: (5, False), 6: (6, True), 7: (6, False)}
    kept = minhash.kept_documents(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 2, 3, 4, 5, 5, 6, 8]
    assert minhash.near_duplicates(docs.limit(0)).count() == 0 and minhash.kept_documents(docs.limit(0)).count() == 0
