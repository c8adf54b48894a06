"""Bag of words: tokens, vocabulary, TF-IDF, top words and document cosine."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import rounded
from ..plans.lineage import table
from ..plans.prefix import prefix_sum

SEPARATORS = r"""[ \-.,!?:;()\[\]{}"'`/\\\t\n\r*+=<>#@$^&|~]+"""
STOP_WORDS = sorted(
    "a all an and are as at be been but by can did does for from had has have how in is it not of on our that the their this to was were when where which who why will with your".split()
)
NUMBER = r"^([0-9]+(e[0-9]+)?|nan|infinity)$"
WORD = r"^[\p{L}\p{Nd}_]+\z"
#: Weights up to this are no top words.
FAINT = 1e-4
#: Characters of text whose words one task counts.
TASK_CHARS = 1 << 22


def _split(text: Column) -> Column:
    return F.split(F.lower(F.coalesce(text, F.lit(""))), SEPARATORS)


def _placed(docs: DataFrame) -> DataFrame:
    """(doc_id, pos, word): ``tokens`` as rows, in their order. Words are tested
    as rows because that is compiled, which functions over arrays are not; the
    outer form, as a text is never without pieces, keeps Spark from cutting each
    text once more to see whether there are any."""
    w = F.col("word")
    kept = (F.length(w) >= 3) & ~w.isin(STOP_WORDS) & w.rlike(WORD) & ~w.rlike(NUMBER)
    return docs.select("doc_id", F.posexplode_outer(_split(F.col("text"))).alias("pos", "word")).where(kept)


def tokens(text: Column) -> Column:
    """Lower-case words of three letters or more, without stop words, numbers
    and whatever holds a character that is no letter, digit or underscore. A
    null text has none."""
    stop = F.array(*(F.lit(w) for w in STOP_WORDS))
    keep = lambda w: (F.length(w) >= 3) & ~F.array_contains(stop, w) & w.rlike(WORD) & ~w.rlike(NUMBER)
    return F.filter(_split(text), keep)


def term_counts(docs: DataFrame) -> DataFrame:
    """(doc_id, word, tf)."""
    return _placed(docs).groupBy("doc_id", "word").agg(F.count("*").alias("tf"))


def _counts_by_word(docs: DataFrame) -> DataFrame:
    """``term_counts``, all rows of a word in one task: words are shuffled once,
    by word alone, and what goes by word next needs no further shuffle. More
    text makes more tasks, not larger ones."""
    size = docs.agg(F.sum(F.length("text"))).first()[0] or 0
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // TASK_CHARS))
    return _placed(docs).select("doc_id", "word").repartition(parts, "word").groupBy("word", "doc_id").agg(F.count("*").alias("tf"))


def document_frequencies(docs: DataFrame) -> DataFrame:
    """(word, df): the number of documents that hold the word. Words are made
    distinct in each row before the shuffle."""
    each = docs.select(F.explode(F.array_distinct(tokens(F.col("text")))).alias("word"))
    return each.groupBy("word").agg(F.count("*").alias("df"))


def idf(docs: DataFrame) -> DataFrame:
    """(word, df, idf) with the unsmoothed ln(N / df); N counts empty documents too."""
    total = docs.agg(F.count("*").alias("_docs"))  # one row
    return document_frequencies(docs).crossJoin(F.broadcast(total)).select("word", "df", F.ln(F.col("_docs") / F.col("df")).alias("idf"))


def vocabulary(docs: DataFrame) -> DataFrame:
    """(word, word_idx): words in order of first appearance, by doc_id and then
    place. The rank is a two-pass prefix sum, not a one-task window."""
    return _numbered(_placed(docs))


def _numbered(placed: DataFrame) -> DataFrame:
    first = placed.groupBy("word").agg(F.min(F.struct("doc_id", "pos")).alias("at"))
    ones = first.select("word", F.col("at.doc_id").alias("_doc"), F.col("at.pos").alias("_pos"), F.lit(1).cast("long").alias("_one"))
    return prefix_sum(ones, [F.col("_doc"), F.col("_pos")], "_one", "word_idx").select("word", "word_idx")


def tfidf(docs: DataFrame) -> DataFrame:
    """(doc_id, word, tf, weight), sparse. Words are shuffled once: a word's
    documents are counted where its counts are."""
    counts = _counts_by_word(docs).withColumn("df", F.count("*").over(Window.partitionBy("word")))
    total = docs.agg(F.count("*").alias("_docs"))  # one row
    return counts.crossJoin(F.broadcast(total)).select("doc_id", "word", "tf", (F.col("tf") * F.ln(F.col("_docs") / F.col("df"))).alias("weight"))


def top_words(docs: DataFrame, count: int) -> DataFrame:
    """(doc_id, rank, word, weight): the ``count`` heaviest words of each
    document over ``FAINT``. Weights are rounded to six places before they are
    compared; ties go by word."""
    heavy = tfidf(docs).select("doc_id", "word", rounded("weight").alias("weight")).where(F.col("weight") > FAINT)
    order = Window.partitionBy("doc_id").orderBy(F.desc("weight"), "word")
    return heavy.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= count).select("doc_id", "rank", "word", "weight")


def encode(docs: DataFrame, vocab: DataFrame) -> DataFrame:
    """(doc_id, word_idx, tf): counts of the words that ``vocab`` has."""
    return term_counts(docs).join(vocab, "word").select("doc_id", "word_idx", "tf")


def encode_by_own(docs: DataFrame) -> DataFrame:
    """``encode`` by the documents' own ``vocabulary``. Documents are cut into
    words twice, which costs less than to write and shuffle all counts again."""
    return _counts_by_word(docs).join(vocabulary(docs), "word").select("doc_id", "word_idx", "tf")


#: Words that have a column of their own in the bound, and columns that the rest share.
COMMON, SHARED = 1024, 1024
#: Counts in a block of documents; documents that are multiplied at a time.
BLOCK_COUNTS, ROWS = 1 << 20, 512


def similar_documents(docs: DataFrame, least: float, asked: Column | None = None) -> DataFrame:
    """(doc_a, doc_b, cosine) of pairs of documents whose term-count vectors
    have a cosine of at least ``least``, which must be positive: of all pairs
    doc_a < doc_b, or, as a search, of each document doc_a for which ``asked``
    is true with all others.

    Exact, and no candidates are written or shuffled: blocks of vectors meet in
    a grid, each pair of blocks in one task. There the ``COMMON`` most frequent
    words keep a column each and all others are added up in ``SHARED`` columns.
    Nothing is negative, so the product of two such short vectors bounds their
    cosine from above; only pairs whose bound reaches ``least`` are computed
    word by word. The work is quadratic (asked documents times all), what is
    held at once and what is shuffled is not."""
    if least <= 0:
        raise ValueError("least must be positive")
    counts = _counts_by_word(docs)
    vocab = table(counts.groupBy("word").agg(F.count("*").alias("df")).withColumn("id", F.monotonically_increasing_id()), "vocabulary")
    common = np.array(sorted(r.id for r in vocab.orderBy(F.desc("df"), "word").limit(COMMON).select("id").collect()), np.int64)
    coded = counts.join(vocab.select("word", "id"), "word").groupBy("doc_id").agg(F.collect_list("id").alias("ids"), F.collect_list("tf").alias("tfs"))
    vectors = table(coded, "vectors")
    # One row each: numbers of blocks, by their counts.
    blocks = lambda df: max(1, -(-(df.agg(F.sum(F.size("ids"))).first()[0] or 0) // BLOCK_COUNTS))
    left = vectors if asked is None else vectors.where(asked)
    n_a = blocks(left)
    n_b = max(blocks(vectors), min(docs.sparkSession.sparkContext.defaultParallelism, 64) // n_a)
    block = lambda n: F.pmod(F.xxhash64("doc_id"), F.lit(n)).cast("int")
    a = left.withColumn("i", block(n_a)).withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(n_b - 1))))
    b = vectors.withColumn("j", block(n_b)).withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(n_a - 1))))
    kind = docs.schema["doc_id"].dataType.simpleString()
    parts = n_a * n_b
    met = a.repartition(parts, "i", "j").groupBy("i", "j").cogroup(b.repartition(parts, "i", "j").groupBy("i", "j"))
    found = met.applyInArrow(_similar(least, common, asked is None), f"doc_a {kind}, doc_b {kind}, cosine double")
    return found.withColumn("cosine", rounded("cosine")).where(F.col("cosine") >= least)


class _Vectors:
    """Unit vectors of documents, sorted by word in each."""

    def __init__(self, found: pa.Table, common: np.ndarray):
        self.docs = found.column("doc_id").to_numpy()
        sizes = pc.list_value_length(found.column("ids")).to_numpy().astype(np.int64)
        ids, tfs = (pc.list_flatten(found.column(c)).to_numpy().astype(k) for c, k in (("ids", np.int64), ("tfs", float)))
        row = np.repeat(np.arange(len(sizes)), sizes)
        order = np.lexsort((ids, row))
        self.ids, tfs = ids[order], tfs[order]
        self.row, self.ends = row, np.cumsum(sizes)
        self.starts = self.ends - sizes
        self.w = tfs / np.sqrt(np.bincount(row, tfs * tfs, len(sizes)))[row] if len(sizes) else tfs
        at = np.minimum(np.searchsorted(common, self.ids), max(len(common) - 1, 0))
        own = common[at] == self.ids if len(common) else np.zeros(len(self.ids), bool)
        # Ids come in runs from one task each; the product spreads them over the shared columns.
        spread = ((self.ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)).astype(np.int64)
        self.column = np.where(own, at, COMMON + spread % SHARED)

    def short(self, a: int, b: int) -> np.ndarray:
        i, j = self.starts[a], self.ends[b - 1]
        cells = (self.row[i:j] - a) * (COMMON + SHARED) + self.column[i:j]
        return np.bincount(cells, self.w[i:j], (b - a) * (COMMON + SHARED)).reshape(b - a, -1).astype(np.float32)


def _similar(least: float, common: np.ndarray, each_once: bool):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        a, b = _Vectors(left, common), _Vectors(right, common)
        out = [(a.docs[:0], b.docs[:0], np.zeros(0))]
        for i in range(0, len(a.docs), ROWS):
            rows = a.short(i, min(i + ROWS, len(a.docs)))
            for j in range(0, len(b.docs), ROWS):
                near = rows @ b.short(j, min(j + ROWS, len(b.docs))).T >= least - 1e-4
                for p in np.flatnonzero(near.any(1)):
                    one, others = i + p, np.flatnonzero(near[p]) + j
                    others = others[b.docs[others] > a.docs[one]] if each_once else others[b.docs[others] != a.docs[one]]
                    if len(others):
                        cosine = _cosines(a, one, b, others)
                        kept = cosine >= least - 1e-6
                        out.append((np.repeat(a.docs[one : one + 1], kept.sum()), b.docs[others[kept]], cosine[kept]))
        return pa.table(dict(zip(("doc_a", "doc_b", "cosine"), map(np.concatenate, zip(*out)))))

    return run


def _cosines(a: _Vectors, one: int, b: _Vectors, others: np.ndarray) -> np.ndarray:
    """Of one document with each of the others."""
    ids, w = a.ids[a.starts[one] : a.ends[one]], a.w[a.starts[one] : a.ends[one]]
    sizes = b.ends[others] - b.starts[others]
    row = np.repeat(np.arange(len(others)), sizes)
    at = np.arange(len(row)) + np.repeat(b.starts[others] - np.cumsum(sizes) + sizes, sizes)
    found = np.minimum(np.searchsorted(ids, b.ids[at]), len(ids) - 1)
    return np.bincount(row, np.where(ids[found] == b.ids[at], w[found] * b.w[at], 0.0), len(others))
