import itertools

import brute
import numpy as np
import pytest

from velumra.llm import quality
from velumra.llm import queries

SF = "/root/testdata/sf0.01"


def labels(spark, *rows):
    return spark.createDataFrame(list(rows), "doc_id bigint, quality int, toxic int")


def test_linear_score_equals_all_pairs():
    rng = np.random.default_rng(0)
    m = quality.Machine(0.3, rng.normal(size=1 << quality.BITS), rng.normal(size=(1 << quality.BITS, quality.FACTORS)) * 0.1, 0.5)
    known = {}
    rows = [quality.features(t, "en", "s", known) for t in ("one two three two", "", "many words! 12 HERE\nand a line")]
    begin = np.concatenate([[0], np.cumsum([len(i) for i, _ in rows])])
    got = m.score(np.concatenate([i for i, _ in rows]), np.concatenate([v for _, v in rows]), begin)
    for (index, value), score in zip(rows, got):
        z = m.bias + sum(m.weight[i] * x for i, x in zip(index, value))
        z += sum(m.factor[i] @ m.factor[j] * x * y for (i, x), (j, y) in itertools.combinations(zip(index, value), 2))
        assert score == pytest.approx(1 / (1 + np.exp(-z)), rel=1e-5)


def test_held_out_accuracy(spark):
    """Fitted on documents of even number, judged on the others."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    known = spark.read.parquet(f"{SF}/labels.parquet")
    model = quality.train(docs, known.where("doc_id % 2 = 0"))
    judged = quality.scores(docs, model).join(known.where("doc_id % 2 = 1"), "doc_id").collect()
    kept = {q: [r.score >= model.threshold for r in judged if r.quality == q] for q in (0, 1)}
    assert np.mean(kept[1]) > 0.97 and np.mean(kept[0]) < 0.2


def test_query_equals_plain_scores(spark):
    docs, known = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    model = quality.train(docs, known)
    want = {}
    for r in docs.collect():
        index, value = quality.features(r.text, r.lang, r.source, {})
        want[r.doc_id] = model.score(index, value, np.array([0, len(index)]))[0]
    got = {r.doc_id: r.score for r in queries.op1_quality(spark, SF).collect()}
    assert got.keys() == {d for d, s in want.items() if s >= model.threshold}
    assert all(got[d] == pytest.approx(want[d]) for d in got)


def test_odd_rows(spark):
    docs, known = brute.odd(spark), labels(spark, (2, 0, 0), (6, 1, 0), (6, None, 0), (None, 1, 0), (99, 1, 1))
    model = quality.train(docs, known)
    scores = quality.scores(brute.clashing(docs), model).collect()
    assert len(scores) == len(brute.ODD) and all(0 <= r.score <= 1 for r in scores)
    by = {}
    for r in scores:
        by.setdefault(r.doc_id, set()).add(r.score)
    assert len(by[5]) == 1 and by[6] == by[7]
    wide = brute.clashing(docs)
    kept = quality.kept_documents(wide, known)
    assert kept.columns == wide.columns and kept.count() == quality.passed(docs, known).count()


def test_without_labels_or_rows(spark):
    docs = brute.odd(spark)
    for known in (spark.createDataFrame([], "doc_id bigint, quality int, toxic int"), labels(spark, (2, 1, 0), (6, 1, 0))):
        assert quality.kept_documents(docs, known).count() == len(brute.ODD)
    assert quality.passed(docs.limit(0), labels(spark, (1, 1, 0))).count() == 0


def test_sample_is_bounded(spark):
    docs, known = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    assert quality.train(docs, known, 30).threshold <= 0.5
