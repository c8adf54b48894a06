import brute
import numpy as np
import pytest
import tiktoken

from velumra.llm import packing, queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def encode():
    return tiktoken.Encoding("t", pat_str=packing.PATTERN, mergeable_ranks=packing.read_ranks(packing.RANKS), special_tokens={}).encode_ordinary


def packed(df):
    rows = df.orderBy("window_id").collect()
    assert [r.window_id for r in rows] == list(range(len(rows))) and all(r.n_tokens == len(r.tokens) for r in rows)
    return [(r.tokens, [(d.doc_id, d.doc_start, d.window_start, d.n) for d in r.docs]) for r in rows]


def test_query_equals_concatenation(spark, encode):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert packed(queries.op5_packing(spark, SF)) == brute.windows(rows, packing.WINDOW, packing.EOS, encode)


@pytest.mark.parametrize("window, eos", [(1, 50256), (7, None), (64, 50256), (10**6, 50256)])
def test_windows_of_any_size(spark, encode, window, eos):
    rows = [r for r in brute.ODD if r[1] is None or len(r[1]) < 1000] + [(k, f"document {k}  with two  spaces and a tail " * (k % 5)) for k in range(10, 30)]
    docs = brute.clashing(brute.documents(spark, rows))
    # Repeated rows can't be told apart, so neither can their order.
    assert packed(packing.pack(docs.repartition(5), window=window, eos=eos)) == brute.windows(rows, window, eos, encode)


def test_long_text_and_empty_table(spark, encode):
    assert packed(packing.pack(brute.odd(spark))) == brute.windows(brute.ODD, packing.WINDOW, packing.EOS, encode)
    assert packing.pack(brute.odd(spark).limit(0)).count() == 0


def test_pieces_encode_as_the_whole(encode):
    rng = np.random.default_rng(0)
    encoder = packing.Encoder(packing.read_ranks(packing.RANKS), "<u2")
    alphabet = list("ab1'sé中 \n\t ,.! 　\U0001f600")
    for _ in range(3000):
        text = "".join(rng.choice(alphabet, rng.integers(0, 14)))
        assert np.frombuffer(encoder.packed(text), "<u2").tolist() == encode(text), repr(text)
