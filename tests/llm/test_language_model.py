import math
import tracemalloc
from collections import Counter, defaultdict

import brute
import numpy as np
import pytest
import zstandard

from velumra.llm import language_model as L

SF = "/root/testdata/sf0.001"


def plain(rows, held=L.HELD):
    """(n_words, bits per word) of each document, from dictionaries; weights by
    expectation maximisation over each held-out word pair itself."""
    texts = defaultdict(list)
    for d, t in rows:
        if w := brute.words(t):
            texts[d].append(w)
    number = lambda d: np.array([L.NULL if d is None else d])
    out = {d: bool(L.held_out(number(d), held)[0]) for d in texts}
    every = Counter(w for d in texts for ws in texts[d] for w in ws)
    p0 = 1 / (len(every) + 1)
    pairs = {d: [(a, b) for ws in texts[d] for a, b in zip([None, *ws], ws)] for d in texts}

    def counts(docs):
        two = Counter(p for d in docs for p in pairs[d])
        return two, Counter(a for d in docs for a, _ in pairs[d]), Counter(b for d in docs for _, b in pairs[d])

    two, one, word = counts([d for d in texts if not out[d]])
    total = sum(word.values())
    seen = defaultdict(list)
    for d in texts:
        if out[d]:
            for a, b in pairs[d]:
                seen[int(L.step(np.array([one[a]]))[0])].append((two[a, b] / one[a] if one[a] else 0, word[b] / max(1, total), p0))
    def learn(p):
        l, p = np.full(3, 1 / 3), np.array(p)
        for _ in range(L.ROUNDS):
            s = p * l
            l, before = (s / s.sum(1, keepdims=True)).mean(0), l
            if abs(l - before).max() < 1e-7:
                break
        l = np.maximum(l, L.LEAST)
        return l / l.sum()

    default = learn([x for p in seen.values() for x in p]) if seen else np.full(3, 1 / 3)
    weights = defaultdict(lambda: default, {k: learn(p) for k, p in seen.items()})
    two, one, word = counts(texts)
    total, found = sum(word.values()), {}
    for d in texts:
        t, o, w = counts([d])
        bits = 0.0
        for a, b in pairs[d]:
            context = one[a] - o[a]
            l = weights[int(L.step(np.array([context]))[0])]
            bits -= math.log2(l[0] * ((two[a, b] - t[a, b]) / context if context else 0) + l[1] * (word[b] - w[b]) / total + l[2] * p0)
        found[d] = (len(pairs[d]), bits / len(pairs[d]))
    return found


def check(df, rows, tolerance, **options):
    got = {r.doc_id: r for r in L.scores(df, **options).collect()}
    want = plain(rows, options.get("held", L.HELD))
    assert got.keys() == want.keys()
    for d, (n, bits) in want.items():
        assert got[d].n_words == n and got[d].bits_per_word == pytest.approx(bits, rel=tolerance)
        assert got[d].perplexity == pytest.approx(2 ** got[d].bits_per_word)


@pytest.mark.parametrize("options", [{}, {"frequent": 500, "held": 3}, {"frequent": 0}])
def test_against_dictionaries(spark, options):
    """The grid of the held-out sums rounds rates to quarters of a power of
    two. How many words are broadcast doesn't matter."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    check(docs, [(r.doc_id, r.text) for r in docs.collect()], 0.01, **options)


def test_odd_rows(spark):
    check(brute.clashing(brute.odd(spark)), [r[:2] for r in brute.ODD], 0.02, held=3)
    assert L.scores(brute.odd(spark).limit(0)).count() == 0
    assert L.scores(brute.documents(spark, [(1, None), (2, "")])).count() == 0


def test_a_pair_in_every_document(spark):
    rows = [(d, f"of the word{d % 7} " + " ".join(f"x{(d * 13 + k) % 50}" for k in range(d % 9))) for d in range(900)]
    check(brute.documents(spark, rows).coalesce(1), rows, 0.02, frequent=3)


def test_learned_weights():
    """Held-out pairs that only the pair rate explains pull the weight there."""
    l = L.learn(np.array([3, 3]), np.array([90.0, 10.0]), np.array([0.5, 0.0]), np.array([0.001, 0.01]), 1e-5)
    assert l.shape == (L.STEPS, 3) and l[3][0] > 0.8 and l.sum(1) == pytest.approx(1)
    assert L.learn(np.empty(0), np.empty(0), np.empty(0), np.empty(0), 0.1)[5] == pytest.approx(1 / 3)


def test_a_bucket_is_opened_in_parts():
    """A part holds all rows of its pairs, and memory follows the part, not the bucket."""
    rows, rng = 600_000, np.random.default_rng(1)
    pair = ((np.uint64(2) + rng.integers(0, 200, rows).astype(np.uint64)) << np.uint64(32)) | (np.uint64(2) + rng.integers(0, 500, rows).astype(np.uint64))
    pair[: rows // 10] = (np.uint64(2) << np.uint64(32)) | np.uint64(2)  # one pair in many documents
    ones = np.ones(rows, np.int64)
    blocks = L.Blocks(1, L.COLUMNS, 100_000, zstandard.ZstdCompressor().compress)
    packed = [b for k in range(0, rows, 100_000) for b in blocks.add(*(x[k : k + 100_000] for x in (pair * np.uint64(L.ODD), np.arange(rows), ones, ones, ones)))]
    packed = list(L._of_kind(L.PAIRS, [*packed, *blocks.flush()]))
    model = {"word": [np.full(600, 7)] * 2, "context": [np.full(600, 9)] * 2, "total": [10, 10]}

    def opened(chunk):
        tracemalloc.start()
        found = [(len(doc), len(first), int(doc.sum()), int(sizes.max())) for doc, _, _, _, first, sizes, *_ in L._opened(iter(packed), model, chunk=chunk)]
        most = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        return [sum(f[k] for f in found) for k in range(3)], max(f[3] for f in found), max(f[0] for f in found), most / 1e6

    (whole, hot, _, much), (parts, hottest, longest, little) = opened(rows), opened(30_000)
    assert whole == parts and whole[0] == rows and hot == hottest >= rows // 10
    assert longest < 60_000 + 60_000 and little < 0.6 * much
