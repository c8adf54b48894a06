import math
import re

import numpy as np
import pytest
from against import differences
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from velumra.functions import vectors as V
from velumra.functions.numbers import rounded
from velumra.operators import knn, text
from velumra.plans import queries


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def arr(*xs):
    return F.array(*(F.lit(float(x)) for x in xs)) if xs else F.array().cast("array<double>")


def test_dot_and_distance(spark):
    assert value(spark, V.dot(arr(1, 2, 3, 4, 5, 6, 7), arr(7, 6, 5, 4, 3, 2, 1))) == 84
    assert value(spark, V.dot(arr(), arr())) == 0
    assert value(spark, V.l2_distance(arr(1, 0), arr(0, 1))) == pytest.approx(math.sqrt(2))
    assert value(spark, V.l2_distance(arr(1, 2, 3, 4, 5), arr(5, 4, 3, 2, 1))) == pytest.approx(math.sqrt(40))
    assert value(spark, V.dot(arr(1), F.lit(None).cast("array<double>"))) is None


@pytest.mark.parametrize("f", [V.dot, V.l2_distance, V.cosine])
def test_lengths_must_match(spark, f):
    with pytest.raises(PySparkException):
        value(spark, f(arr(1, 2), arr(1)))


def test_cosine_and_normalize(spark):
    assert value(spark, V.cosine(arr(0, 0), arr(1, 2))) == 0
    assert value(spark, V.cosine(arr(*[1] * 1024), arr(*[1] * 1024))) == pytest.approx(1)
    assert value(spark, V.normalize(arr(3, 4))) == [0.6, 0.8]
    assert value(spark, V.normalize(arr(0, 1e-9))) == [0, 1e-9]


def test_rounding_as_sql(spark, tmp_path):
    """Values that become zero keep their sign; halves and infinity."""
    rows = [(0, [1.0, -1e-8, 1e-8, 0.0, -0.0]), (1, [-3e-7, 0.5, 0.25, -5e-7, 0.1]), (2, [0.0, -0.0, -1e-9, 0.0, 0.0])]
    spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").coalesce(1).write.parquet(str(tmp_path / "raw"))
    next((tmp_path / "raw").glob("*.parquet")).rename(tmp_path / "embeddings.parquet")
    for name in ("vec_normalize", "vec_dot", "relu", "tanh", "tensor_decay"):
        assert differences(queries.QUERIES[name](spark, str(tmp_path)), queries.ORACLES[name], str(tmp_path)) == "", name
    xs = [0.1234565, -0.1234565, 1e305, float("inf"), -0.0, -4.9e-7, 5e-7, 2.5e-6, 123456.0000005]
    spark.createDataFrame([(k, x) for k, x in enumerate(xs)], "k int, x double").coalesce(1).write.parquet(str(tmp_path / "more"))
    next((tmp_path / "more").glob("*.parquet")).rename(tmp_path / "numbers.parquet")
    numbers = spark.read.parquet(str(tmp_path / "numbers.parquet")).select("k", rounded("x").alias("x"))
    assert differences(numbers, "SELECT k, round(x, 6) AS x FROM numbers", str(tmp_path)) == ""


def test_digest(spark):
    import hashlib

    assert value(spark, V.sha256_hex(F.lit("ab"), F.lit("c"))) == hashlib.sha256(b"abc").hexdigest().upper()


def docs(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")


def words(spark, t):
    return set(docs(spark, t).select(text.tokens(F.col("text")).alias("w")).first().w)


def test_tokens(spark):
    assert words(spark, "## Header with *** and (a + b) symbols!") == {"header", "symbols"}
    assert words(spark, "Tensor x i weights") == {"tensor", "weights"}
    assert words(spark, "1234 12e5 nan snake_case 50% café a—b—c") == {"snake_case", "café"}
    assert words(spark, None) == words(spark, "") == words(spark, " \n\t") == set()
    assert len(words(spark, " ".join(f"word{k}" for k in range(50_000)))) == 50_000


def test_idf(spark):
    found = {r.word: r.idf for r in text.idf(docs(spark, "common unique", "common", "common irrelevant")).collect()}
    assert found["common"] == 0 and found["unique"] == pytest.approx(math.log(3))
    found = {r.word: r.idf for r in text.idf(docs(spark, "apple banana", "apple")).collect()}
    assert found["banana"] == pytest.approx(math.log(2))


def test_top_words_and_vocabulary(spark):
    d = docs(spark, "pear pear plum", "plum fig_tree", None)
    found = [(r.doc_id, r.rank, r.word) for r in text.top_words(d, 10).orderBy("doc_id", "rank").collect()]
    assert found == [(0, 1, "pear"), (0, 2, "plum"), (1, 1, "fig_tree"), (1, 2, "plum")]
    assert text.top_words(d, 1).count() == 2
    assert [r.word for r in text.vocabulary(d).orderBy("word_idx").collect()] == ["pear", "plum", "fig_tree"]


def test_similar_documents(spark):
    d = docs(spark, "apple banana", "apple banana", "apple", "cherry", "")
    found = {(r.doc_a, r.doc_b): r.cosine for r in text.similar_documents(d, 0.5).collect()}
    assert found == {(0, 1): 1.0, (0, 2): pytest.approx(0.7071, abs=1e-4), (1, 2): pytest.approx(0.7071, abs=1e-4)}


def executed(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]


def test_similar_documents_shuffle_no_candidates(spark, monkeypatch):
    """Blocks meet in a grid, whatever their number: no join makes pairs."""
    d = docs(spark, *(f"apple banana cherry word{k} word{k % 7}" for k in range(90)), "", None)
    plan = executed(text.similar_documents(d, 0.7))
    assert "FlatMapCoGroupsInArrow" in plan and "Join" not in plan
    whole = sorted(map(tuple, text.similar_documents(d, 0.7).collect()))
    monkeypatch.setattr(text, "BLOCK_COUNTS", 60)
    monkeypatch.setattr(text, "ROWS", 3)
    assert sorted(map(tuple, text.similar_documents(d, 0.7).collect())) == whole and len(whole) > 100


def test_words_are_shuffled_once(spark):
    """By word alone, and neither written nor shuffled again for frequencies."""
    d = docs(spark, "pear pear plum", "plum fig_tree", None, "odd\u2028 pear")
    assert sorted((r.doc_id, r.word) for r in text.term_counts(d).collect()) == [(0, "pear"), (0, "plum"), (1, "fig_tree"), (1, "plum"), (3, "pear")]
    plan = executed(text.tfidf(d))
    assert plan.count("hashpartitioning") == 1 and "SortMergeJoin" not in plan
    plan = executed(text.encode_by_own(d))
    assert not re.search(r"hashpartitioning\(doc_id", plan)


def test_similar_documents_against_all_pairs(spark):
    """Words of very different frequency, near copies, and a search."""
    rng = np.random.default_rng(3)
    words = np.array([f"word{k}" for k in range(300)])
    share = 1 / np.arange(1, 301)
    rows = [rng.choice(words, rng.integers(1, 40), p=share / share.sum()).tolist() for _ in range(120)]
    rows += [r + [words[rng.integers(0, 300)]] for r in rows[::3]]
    counts = np.array([[r.count(w) for w in words] for r in rows], float)
    counts /= np.linalg.norm(counts, axis=1)[:, None]
    cosine = counts @ counts.T
    d = docs(spark, *(" ".join(r) for r in rows))
    for least in (0.3, 0.8, 0.95):
        got = {(r.doc_a, r.doc_b): r.cosine for r in text.similar_documents(d, least).collect()}
        want = {(i, j): cosine[i, j] for i in range(len(rows)) for j in range(i + 1, len(rows)) if cosine[i, j] >= least - 5e-7}
        assert len(want) > 20 and got == {k: pytest.approx(v, abs=1e-6) for k, v in want.items()}
    got = {(r.doc_a, r.doc_b) for r in text.similar_documents(d, 0.8, F.col("doc_id") % 7 == 0).collect()}
    assert got == {(i, j) for i in range(0, len(rows), 7) for j in range(len(rows)) if i != j and cosine[i, j] >= 0.8}


def test_encoding_by_own_words(spark):
    d = docs(spark, "pear pear plum", "plum fig_tree", None, "plum pear plum")
    want = sorted(map(tuple, text.encode(d, text.vocabulary(d)).collect()))
    assert sorted(map(tuple, text.encode_by_own(d).collect())) == want and len(want) == 6


def test_nearest_against_numpy(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(60, 5)).round(1)
    x[7] = x[8]
    d = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)] + [(99, None)], "vec_id bigint, embedding array<double>")
    got = {}
    for r in knn.nearest(d, d, 4).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.point_id)
    for q in range(60):
        far = np.sqrt(((x - x[q]) ** 2).sum(1))
        assert got[q] == sorted(range(60), key=lambda k: (far[k], k))[:4]
    assert knn.nearest(d, d, 0).count() == 0
    assert knn.nearest(d, d.limit(1), 1000).count() == 60
    assert knn.nearest(d.limit(0), d, 3).count() == 0
