import brute
import corpus_pipeline
import numpy as np
import pytest
import tiktoken

from velumra.llm import minhash, mixing, packing, quality, secrets
from velumra.llm.words import WordHashes, hashed, shingles

SF = "/root/testdata/sf0.001"


def plain_groups(texts):
    """Union of all pairs of which enough minima are equal."""
    h, begin = hashed(texts, WordHashes())
    s, of = shingles(h, begin, minhash.SHINGLE)
    sig = minhash.one_permutation(s, of, len(texts))
    return [(i, j) for j in range(len(texts)) for i in range(j) if begin[i + 1] > begin[i] and begin[j + 1] > begin[j] and (sig[i] == sig[j]).mean() >= minhash.THRESHOLD]


def plain(spark, rows):
    """Rows (doc_id, text, lang, source) through all stages, without Spark but
    for the fitting of the classifier."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = quality.train(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    found = [(r, quality.features(r[1], r[2], r[3], {})) for r in rows]
    rows = [r for r, (i, v) in found if model.score(i, v, np.array([0, len(i)]))[0] >= model.threshold]
    rows.sort()
    top = brute.groups(plain_groups([r[1] for r in rows]))
    rows = [r for k, r in enumerate(rows) if top.get(k, k) == k]
    forest, clean = secrets.train(), []
    for d, text, lang, source in rows:
        parts, at = [], 0
        for m in secrets.candidates(text):
            x = secrets.describe(m.group(), text[max(0, m.start() - secrets.CONTEXT) : m.start()], text[m.end() : m.end() + secrets.CONTEXT], source)
            if forest.score(np.array([x]))[0] >= secrets.THRESHOLD:
                parts += [text[at : m.start()], secrets.REDACTED]
                at = m.end()
        clean.append((d, "".join(parts) + text[at:], lang, source))
    served = {(s, d) for s, d, *_ in brute.queue(clean, mixing.WEIGHTS)}
    kept = [r for r in clean if (r[3], r[0]) in served]
    encode = tiktoken.Encoding("t", pat_str=packing.PATTERN, mergeable_ranks=packing.read_ranks(packing.RANKS), special_tokens={}).encode_ordinary
    return brute.windows(kept, packing.WINDOW, packing.EOS, encode)


def test_run_equals_plain_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    want = plain(spark, [(r.doc_id, r.text, r.lang, r.source) for r in docs.collect()])
    got = [(r.tokens, [(d.doc_id, d.doc_start, d.window_start, d.n) for d in r.docs]) for r in corpus_pipeline.run(spark, SF).orderBy("window_id").collect()]
    assert got == want and len(want) > 10


def test_stages_keep_columns_and_odd_rows(spark):
    docs = brute.odd(spark)
    assert 4 <= len(corpus_pipeline.STAGES) <= 5
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, SF).columns == docs.columns
        assert stage(spark, docs.limit(0), SF).count() == 0
    last = corpus_pipeline.STAGES[-1][1]
    assert last(spark, docs, SF).count() > 0 and last(spark, docs.limit(0), SF).count() == 0


def test_filters_keep_clean_documents(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    good = {r.doc_id for r in labels.where("quality = 1").collect()}
    kept = {r.doc_id for r in corpus_pipeline.quality_filter(spark, docs, "/root/testdata/sf0.01").collect()}
    assert len(good & kept) > 0.98 * len(good)


@pytest.mark.parametrize("name", ["op1_quality", "pipeline"])
def test_registered(name):
    import __spark_entry__

    assert name in __spark_entry__.queries() and len([q for q in __spark_entry__.queries() if q.startswith("op")]) == 10
