import brute
import pytest
from against import differences

from velumra.llm import mixing, queries

SF = "/root/testdata/sf0.001"


def queue(df):
    return sorted(((r.source, r.doc_id, r.tokens, r.virtual_finish, r.queue_start) for r in df.collect()), key=lambda r: (r[4], repr(r)))


def test_query_equals_sql(spark):
    assert differences(queries.op10_mixing(spark, SF), mixing.SQL, SF) == ""


@pytest.mark.parametrize("weights", [{}, {"src0": 4.0, "src1": 0.5}])
def test_odd_rows(spark, weights):
    rows = brute.ODD + [(k, "word " * (k % 7), "en", f"src{k % 3}") for k in range(100, 180)]
    docs = brute.clashing(brute.documents(spark, rows))
    want = sorted(brute.queue(rows, weights), key=lambda r: (r[4], repr(r)))
    assert queue(mixing.mix(docs, weights)) == want
    kept = mixing.kept_documents(docs, weights=weights)
    keys = {(s, d) for s, d, *_ in want}
    assert kept.columns == docs.columns and kept.count() == sum((s, d) in keys for d, _, _, s in rows)


def test_budgets_and_errors(spark):
    docs = brute.documents(spark, [(k, "a b c", "en", f"src{k % 2}") for k in range(20)])
    assert mixing.mix(docs, {}, budget_tokens=10).count() == 3
    assert mixing.mix(docs, {}, budget_tokens=0).count() == 0
    assert mixing.mix(docs.limit(0), {}).count() == 0
    shares = mixing.mix(docs, {"src0": 3.0}, budget_tokens=24).groupBy("source").count()
    assert dict(map(tuple, shares.collect())) == {"src0": 6, "src1": 2}
    with pytest.raises(ValueError):
        mixing.mix(docs, {"src0": 0})
