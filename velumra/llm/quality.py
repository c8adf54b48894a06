"""Quality classification by a factorisation machine."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.memory import released
from .words import unused

#: The bound on labelled rows that the model is fitted on, taken in order of a hash of doc_id.
SAMPLE = 8192
#: Share of the sample's good held-out documents that the threshold may reject.
REJECTED = 0.001
BITS = 16
FACTORS = 8
STEPS = 12

_UPPER, _DIGIT, _LETTER, _SPACE = (np.zeros(256, bool) for _ in range(4))
_UPPER[65:91] = _DIGIT[48:58] = _SPACE[[9, 10, 11, 12, 13, 32]] = True
_LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True


def _steps(share: float) -> int:
    return min(STEPS - 1, int(share * STEPS))


def statistics(text: str, words: list[str], distinct: int) -> list[int]:
    """Structure of a text, each figure as a step of its scale."""
    raw = np.bincount(np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8), minlength=256)
    n, count = max(1, int(raw.sum())), max(1, len(words))
    letters = max(1, int(raw[_LETTER].sum()))
    other = n - int(raw[_LETTER].sum()) - int(raw[_DIGIT].sum()) - int(raw[_SPACE].sum())
    lines = text.split("\n")
    return [
        min(STEPS - 1, int(np.log2(n))),
        min(STEPS - 1, int(n / count / 1.5)),
        _steps(raw[_UPPER].sum() / letters),
        _steps(raw[_DIGIT].sum() / n),
        _steps(other / count / 4),
        _steps(distinct / count),
        _steps(sum(map(str.__eq__, words, words[1:])) / count),
        _steps(1 - len(set(lines)) / len(lines)),
        _steps(raw[33] / count / 2),
        _steps((raw[35] + raw[36] + raw[37] + raw[38] + raw[42] + raw[124]) / count / 4),
        min(STEPS - 1, int(np.log2(1 + count / len(lines)))),
    ]


def features(text: str | None, lang: str | None, source: str | None, known: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """Indices and values: the set of hashed words, of unit length together,
    and one index of value 1 for each statistic and each piece of metadata."""
    text = text or ""
    words = text.lower().split()
    own = set(words)
    if len(known) > 400_000:
        known.clear()
    where = []
    for w in own:
        k = known.get(w)
        if k is None:
            k = known[w] = zlib.crc32(w.encode("utf-8", "surrogatepass"))
        where.append(k)
    mask = (1 << BITS) - 1
    index, times = np.unique(np.array(where, np.int64) & mask, return_counts=True)
    value = times / max(1e-9, np.sqrt((times * times).sum()))
    named = [f"stat{i}={s}" for i, s in enumerate(statistics(text, words, len(own)))] + [f"lang={lang}", f"source={source}"]
    more = np.array([zlib.crc32(x.encode()) & mask for x in named], np.int64)
    return np.concatenate([index, more]).astype(np.int32), np.concatenate([value, np.ones(len(more))]).astype(np.float32)


@dataclass
class Machine:
    bias: float
    weight: np.ndarray
    factor: np.ndarray
    threshold: float

    def score(self, index: np.ndarray, value: np.ndarray, begin: np.ndarray) -> np.ndarray:
        """Probabilities of good quality; linear in the features, because the
        pairs' sum is half of (sum of v x) squared less the sum of squares."""
        if not len(begin) - 1:
            return np.empty(0)
        vx = self.factor[index] * value[:, None]
        sums = np.add.reduceat(vx, begin[:-1])
        squares = np.add.reduceat(vx * vx, begin[:-1])
        z = self.bias + np.add.reduceat(self.weight[index] * value, begin[:-1]) + 0.5 * (sums * sums - squares).sum(1)
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit(rows: list[tuple[np.ndarray, np.ndarray]], good: np.ndarray, epochs: int = 8, rate: float = 0.1, seed: int = 5) -> Machine:
    """AdaGrad on log loss, classes weighted alike, a fifth of the rows held
    out for the threshold. Without both classes there is nothing to learn:
    every document then scores 1."""
    size = 1 << BITS
    if not len(good) or good.min() == good.max():
        return Machine(30.0, np.zeros(size, np.float32), np.zeros((size, FACTORS), np.float32), 0.5)
    rng = np.random.default_rng(seed)
    m = Machine(0.0, np.zeros(size), rng.normal(0, 0.02, (size, FACTORS)), 0.5)
    gw, gv, gb = np.full(size, 1e-2), np.full((size, FACTORS), 1e-2), 1e-2
    held = np.arange(len(good)) % 5 == 4 if len(good) >= 50 else np.zeros(len(good), bool)
    train = np.flatnonzero(~held)
    share = good[train].mean()
    balance = np.where(good == 1, 0.5 / max(share, 1e-6), 0.5 / max(1 - share, 1e-6))
    for _ in range(epochs):
        rng.shuffle(train)
        for k in range(0, len(train), 64):
            some = train[k : k + 64]
            index, value = (np.concatenate([rows[i][j] for i in some]) for j in range(2))
            counts = np.array([len(rows[i][0]) for i in some])
            begin = np.concatenate([[0], np.cumsum(counts)])
            vx = m.factor[index] * value[:, None]
            sums = np.add.reduceat(vx, begin[:-1])
            error = (m.score(index, value, begin) - good[some]) * balance[some] / len(some)
            each = np.repeat(error, counts) * value
            dv = each[:, None] * (np.repeat(sums, counts, 0) - vx)
            # Rows of one batch that share an index are summed first.
            own, back = np.unique(index, return_inverse=True)
            w = np.bincount(back, each, len(own)) + 1e-6 * m.weight[own]
            v = np.stack([np.bincount(back, dv[:, f], len(own)) for f in range(FACTORS)], 1) + 1e-6 * m.factor[own]
            gw[own] += w * w
            gv[own] += v * v
            gb += error.sum() ** 2
            m.weight[own] -= rate * w / np.sqrt(gw[own])
            m.factor[own] -= rate * v / np.sqrt(gv[own])
            m.bias -= rate * error.sum() / np.sqrt(gb)
    m.weight, m.factor = m.weight.astype(np.float32), m.factor.astype(np.float32)
    judged = np.flatnonzero(held) if held.any() and (good[held] == 1).any() else np.arange(len(good))
    scores = np.array([m.score(*rows[i], np.array([0, len(rows[i][0])]))[0] for i in judged])
    m.threshold = float(min(0.5, np.quantile(scores[good[judged] == 1], REJECTED)))
    return m


def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known: dict[str, int] = {}
    for batch in batches:
        found = [features(*x, known) for x in zip(*(batch.column(c).to_pylist() for c in ("text", "lang", "source")))]
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("good"), pa.array([i.tobytes() for i, _ in found], pa.binary()), pa.array([v.tobytes() for _, v in found], pa.binary())],
            names=["doc_id", "good", "index", "value"],
        )


def _plain(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), *(F.col(c).cast("string").alias(c) for c in ("text", "lang", "source")))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Machine:
    """Fit on at most ``sample`` labelled documents. A document that is
    labelled several times has its least label; null labels count for nothing."""
    chosen = (
        labels.where("doc_id IS NOT NULL AND quality IS NOT NULL")
        .select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("good"))
        .groupBy("doc_id")
        .agg(F.min("good").alias("good"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(sample)
    )
    # At most ``sample`` pairs of numbers.
    rows = _plain(docs).join(F.broadcast(chosen), "doc_id").mapInArrow(released(_featured), "doc_id long, good int, index binary, value binary").collect()
    rows = sorted((d, g, bytes(i), bytes(v)) for d, g, i, v in map(tuple, rows))
    return fit([(np.frombuffer(i, np.int32), np.frombuffer(v, np.float32)) for _, _, i, v in rows], np.array([g > 0 for _, g, _, _ in rows], int))


def _scored(model, column: str, read: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, known = model.value, {}
        for whole in batches:
            for k in range(0, whole.num_rows, 256):
                batch = whole.slice(k, 256)
                found = [features(*x, known) for x in zip(*(batch.column(c).to_pylist() for c in read))]
                begin = np.concatenate([[0], np.cumsum([len(i) for i, _ in found])]).astype(np.int64)
                scores = m.score(np.concatenate([i for i, _ in found]), np.concatenate([v for _, v in found]), begin)
                rest = batch.select([c for c in batch.schema.names if c not in read])
                yield rest.append_column(column, pa.array(scores.astype(np.float64)))

    return run


def _broadcast(docs: DataFrame, model: Machine):
    return docs.sparkSession.sparkContext.broadcast(model)


def scores(docs: DataFrame, model: Machine) -> DataFrame:
    """(doc_id, score) for every row of ``docs``, from its whole text.

    Defined results: a null text counts as empty, null metadata as the value
    "None", a null doc_id stays null; very long texts saturate the steps of
    length; repeated rows and ties score alike; an empty table gives none;
    other columns are ignored."""
    return _plain(docs).mapInArrow(released(_scored(_broadcast(docs, model), "score", ["text", "lang", "source"])), "doc_id bigint, score double")


def passed(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, score) of the documents that the classifier keeps: those of at
    least its threshold, which is the score that all but ``REJECTED`` of the
    good held-out documents reach, and 0.5 at most. Defined results as
    ``scores``; rows that tie with the threshold are kept, and without labels
    of both classes all are."""
    model = train(docs, labels, sample)
    return scores(docs, model).where(F.col("score") >= model.threshold)


def kept_documents(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """The rows of ``docs``, all columns, that the classifier keeps. Defined
    results as ``passed``: null and empty texts are judged like others, rows
    that repeat stay or go together, an empty table stays empty, and columns
    may have any other name."""
    model = train(docs, labels, sample)
    score, *read = unused(docs.columns, "__score", "__text", "__lang", "__source")
    named = docs.select("*", *(F.col(c).cast("string").alias(n) for c, n in zip(("text", "lang", "source"), read)))
    schema = docs.withColumn(score, F.lit(0.0)).schema
    judged = named.mapInArrow(released(_scored(_broadcast(docs, model), score, read)), schema)
    return judged.where(F.col(score) >= model.threshold).drop(score)
