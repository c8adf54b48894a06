import re

import brute
import numpy as np
import pytest
import zstandard

from velumra.llm import queries, toxicity

SF = "/root/testdata/sf0.01"


def labels(spark, *rows):
    return spark.createDataFrame(list(rows) or [], "doc_id bigint, quality int, toxic int")


def test_held_out_accuracy(spark):
    """Trained on the few labels of even number, judged on the others; with
    them all words of the rarer languages aren't learned."""
    docs, known = spark.read.parquet("/root/testdata/sf0.1/documents.parquet"), spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    model = toxicity.fit(docs, known.where("doc_id % 2 = 0"))
    truth = {r.doc_id: r.toxic for r in known.where("doc_id % 2 = 1").collect()}
    judged = toxicity.scores(docs, model).where("doc_id % 2 = 1").collect()
    said = {y: [r.toxic for r in judged if truth.get(r.doc_id) == y] for y in (0, 1)}
    print("recall", np.mean(said[1]), "false alarms", np.mean(said[0]))
    assert np.mean(said[1]) > 0.72 and np.mean(said[0]) < 0.02


def plain_score(model, text):
    """Without the module's windows, compressor and sums."""
    words = re.findall(r"\w+", (text or "").lower())
    lengths = []
    for raw in (model.ordinary, model.toxic):
        c = zstandard.ZstdCompressor(level=12, dict_data=zstandard.ZstdCompressionDict(raw), write_content_size=False, write_dict_id=False)
        lengths.append([len(c.compress(f" {' '.join(words[k : k + 6])} ".encode())) for k in range(0, len(words), 6)])
    gains = [model.weight[min(8, max(-4, a - b)) + 4] for a, b in zip(*lengths)]
    starts = list(range(0, max(1, len(gains) - 128), 128))
    pieces = [gains[max(0, min(k + 256, len(gains)) - 256) : k + 256] for k in starts] if gains else []
    return max((sum(p) / len(p) ** 0.5 for p in pieces), default=0.0)


def test_query_equals_plain_scores(spark):
    docs, known = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    model = toxicity.fit(docs, known)
    want = {r.doc_id: plain_score(model, r.text) for r in docs.collect()}
    got = {r.doc_id: r.score for r in queries.op9_toxicity(spark, SF).collect()}
    assert got and got == {d: pytest.approx(s) for d, s in want.items() if s >= model.threshold}


def test_each_dictionary_is_trained_on_its_own_class(spark):
    docs, known = spark.read.parquet("/root/testdata/sf0.1/documents.parquet"), spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    model = toxicity.fit(docs, known)
    assert len(model.toxic) == len(model.ordinary)
    differ = [k for k, (a, b) in enumerate(zip(model.toxic, model.ordinary)) if a != b]
    assert differ[-1] - differ[0] < toxicity.OWN and len(differ) > toxicity.OWN // 2
    assert b"worthless" in model.toxic and b"worthless" not in model.ordinary


def test_clean_text_around_does_not_outvote_a_passage(spark):
    docs, known = spark.read.parquet("/root/testdata/sf0.1/documents.parquet"), spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    model = toxicity.fit(docs, known)
    steps = model.differences()
    clean = max((r.text for r in docs.join(known.where("toxic = 0"), "doc_id").where("lang = 'en'").collect()), key=len)
    words = clean.split()
    bad = list(words[:60])
    bad[3::7] = ["worthless", "pathetic", "idiot"] * (len(bad[3::7]) // 3) + ["trash"] * (len(bad[3::7]) % 3)
    clean = " ".join((words * 8)[:20_000])
    assert model.score(steps(clean)) < model.threshold < model.score(steps(clean + " " + " ".join(bad) + " " + clean))


def test_windows_are_the_whole_text():
    w = toxicity.windows(" ".join(f"w{k}" for k in range(20)))
    assert b"".join(w).split() == [f"w{k}".encode() for k in range(20)] and toxicity.windows(None) == toxicity.windows(" ") == []


def test_odd_rows(spark):
    docs, known = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    model = toxicity.fit(docs, known)
    found = toxicity.scores(brute.clashing(brute.odd(spark)), model).collect()
    assert len(found) == len(brute.ODD) and all(r.score == 0 and not r.toxic for r in found if r.doc_id in (1, 2, 3))
    assert toxicity.scores(docs.limit(0), model).count() == 0


def test_too_little_to_train_on(spark):
    docs = brute.odd(spark)
    for known in (labels(spark), labels(spark, (6, 1, 1), (7, None, None), (None, 1, 0))):
        assert toxicity.toxic_documents(docs, known).count() == 0
        assert toxicity.scores(docs, toxicity.fit(docs, known)).count() == len(brute.ODD)
