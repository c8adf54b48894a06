"""Toxicity by compression distance under two zstandard dictionaries."""

from __future__ import annotations

import random
import warnings
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.memory import released
from .words import WORDS

#: Bounds on the labelled documents that are trained on, in order of a hash of doc_id.
TOXIC, ORDINARY = 1024, 3072
WINDOW = 6
#: Bytes of the dictionaries that are trained on toxic and on ordinary words, and of the ordinary text that follows in both.
OWN, SHARED = 2048, 100_000
LEVEL = 12
#: Length of the segments that the trainer picks, and of what it counts.
SEGMENT, COUNTED = 16, 8
#: Steps of the difference of two lengths: LOW bytes or less, to HIGH or more.
LOW, HIGH = -4, 8
#: Words of toxic documents that the toxic dictionary is trained on are seen beside so many different words, and their log rate is so much higher than in ordinary ones.
SIDES, LIFT = 6, 3.0
#: A document is judged by its worst stretch of so many windows.
STRETCH = 256
#: A false alarm weighs as much as so many misses.
ALARM = 4.0


def windows(text: str | None) -> list[bytes]:
    """The whole text, ``WINDOW`` lower-case words at a time."""
    words = WORDS.findall((text or "").lower())
    return [(" " + " ".join(words[i : i + WINDOW]) + " ").encode("utf-8", "surrogatepass") for i in range(0, len(words), WINDOW)]


def _segments(word: str) -> set[str]:
    return {word[:k] for k in range(4, min(len(word), 9))} | {word + " "}


def toxic_words(toxic: list[str], ordinary: list[str]) -> list[str]:
    """The words of toxic documents, as often as they stand there, that tell
    these from ordinary ones: which begin, or end, as ordinary words don't.
    Counting different neighbours, not occurrences, keeps the words of one
    much-copied document out."""
    words = [[WORDS.findall(t.lower()) for t in texts] for texts in (toxic, ordinary)]
    totals = [max(1, sum(map(len, w))) for w in words]
    counts = []
    for texts in words:
        of: Counter[str] = Counter()
        for word, n in Counter(w for t in texts for w in t).items():
            for s in _segments(word):
                of[s] += n
        counts.append(of)
    lift = lambda n, s: np.log((n + 0.5) / totals[0]) - np.log((counts[1][s] + 0.5) / totals[1])
    likely = {s for s, n in counts[0].items() if n >= SIDES and lift(n, s) > LIFT}
    sides: dict[str, set[tuple[str, str]]] = defaultdict(set)
    for text in words[0]:
        for a, b in zip(["", *text], text):
            for s in likely.intersection(_segments(b)):
                sides[s].add((a, b))
    found = {s for s in likely if len(sides[s]) >= SIDES and lift(len(sides[s]), s) > LIFT}
    return [w for text in words[0] for w in text if not found.isdisjoint(_segments(w))]


def trained(samples: list[bytes], size: int, seed: int, **options: int) -> tuple[bytes, bytes]:
    """Head (entropy tables) and content of a dictionary that zstandard trains
    on ``samples``, which are repeated where they are fewer than it asks for."""
    import zstandard

    samples = samples * (1 + 12 * size // max(1, sum(map(len, samples))))
    random.Random(seed).shuffle(samples)
    raw = zstandard.train_dictionary(size, samples, level=LEVEL, **options).as_bytes()
    ends = raw.index(b"".join(k.to_bytes(4, "little") for k in (1, 4, 8))) + 12
    return raw[:ends], raw[ends:]


@dataclass
class Model:
    """A dictionary trained on toxic words and one on ordinary words, each
    followed by the same ordinary text, so that the lengths of ordinary windows
    agree; the weight of each difference of lengths, and the threshold."""

    toxic: bytes
    ordinary: bytes
    weight: np.ndarray
    threshold: float

    def differences(self):
        import zstandard

        def compressor(raw: bytes):
            kept = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_FULLDICT)
            kept.precompute_compress(level=LEVEL)
            return zstandard.ZstdCompressor(dict_data=kept, level=LEVEL, write_content_size=False, write_checksum=False, write_dict_id=False).compress

        a, b = compressor(self.ordinary), compressor(self.toxic)
        return lambda text: np.clip(np.array([len(a(w)) - len(b(w)) for w in windows(text)], np.int64), LOW, HIGH) - LOW

    def score(self, steps: np.ndarray) -> float:
        """The most, over stretches of ``STRETCH`` windows that overlap by half,
        of the sum of weights over the root of their number; 0 without a window."""
        if not len(steps):
            return 0.0
        upto = np.concatenate([[0.0], np.cumsum(self.weight[steps])])
        begin = np.arange(0, max(1, len(steps) - STRETCH // 2), STRETCH // 2)
        end = np.minimum(begin + STRETCH, len(steps))
        begin = np.maximum(0, end - STRETCH)
        return float(((upto[end] - upto[begin]) / np.sqrt(end - begin)).max())


def train(rows: list[tuple[int, str, int]], seed: int = 3) -> Model | None:
    """Of (doc_id, text, toxic), in order of doc_id: of five, three train the
    dictionaries, the fourth the weights, the fifth the threshold. None, with a
    warning, where a part lacks a class or toxic documents have no word that
    ordinary ones lack; nothing can be learned then."""
    rows = sorted(rows)
    part = lambda k, c: [t for i, (_, t, y) in enumerate(rows) if (0, 0, 0, 1, 2)[i % 5] == k and y == c]
    toxic, ordinary = (part(0, c) for c in (1, 0))
    shared = [w for t in ordinary for w in windows(t)]
    words = toxic_words(toxic, ordinary) if shared else []
    if not words or not all(part(k, c) for k in (1, 2) for c in (0, 1)):
        warnings.warn("too few labelled documents to learn what is toxic: nothing will be called toxic", stacklevel=2)
        return None
    padded = lambda ws: [f" {w} ".encode("utf-8", "surrogatepass") for w in ws]
    plain = [w for t in ordinary for w in WORDS.findall(t.lower())]
    plain = random.Random(seed).sample(plain, min(len(plain), max(len(words), 2000)))
    head, text = trained(shared, SHARED, seed, k=64, d=COUNTED)
    owns = [trained(padded(ws), OWN, seed, k=SEGMENT, d=COUNTED)[1] for ws in (words, plain)]
    a, b = (head + own.rjust(OWN, b"\n") + text for own in owns)
    model = Model(a, b, np.zeros(HIGH - LOW + 1), 0.0)
    steps = model.differences()
    tally = [np.bincount(np.concatenate([steps(t) for t in part(1, c)]), minlength=HIGH - LOW + 1) + 0.5 for c in (0, 1)]
    model.weight = np.log(tally[1] / tally[1].sum()) - np.log(tally[0] / tally[0].sum())
    scores = [np.sort([model.score(steps(t)) for t in part(2, c)]) for c in (0, 1)]
    cuts = np.unique(np.concatenate([*scores, [0.0]]))
    cuts = np.append((cuts[1:] + cuts[:-1]) / 2, cuts[-1] + 1e-6)
    alarms = 1 - np.searchsorted(scores[0], cuts) / len(scores[0])
    misses = np.searchsorted(scores[1], cuts) / len(scores[1])
    cost = ALARM * alarms + misses
    best = np.flatnonzero(cost <= cost.min() + 1e-12)
    model.threshold = float(max(cuts[best].mean(), 1e-6))
    return model


def fit(docs: DataFrame, labels: DataFrame, toxic: int = TOXIC, ordinary: int = ORDINARY) -> Model | None:
    """Train on at most ``toxic`` and ``ordinary`` labelled documents. A
    document that is labelled several times is toxic if it ever is; null
    labels count for nothing."""
    known = (
        labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL")
        .select(F.col("doc_id").cast("long").alias("doc_id"), (F.col("toxic") > 0).cast("int").alias("toxic"))
        .groupBy("doc_id")
        .agg(F.max("toxic").alias("toxic"))
    )
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    chosen = known.where("toxic = 1").orderBy(*order).limit(toxic).unionByName(known.where("toxic = 0").orderBy(*order).limit(ordinary))
    # At most toxic + ordinary pairs of numbers.
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "doc_id")
    return train([(r.doc_id, r.text or "", r.toxic) for r in texts.collect()])


def _scored(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        steps = m.differences() if m else None
        for batch in batches:
            found = [m.score(steps(t)) if m else 0.0 for t in batch.column("text").to_pylist()]
            toxic = [bool(m) and s >= m.threshold for s in found]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, pa.float64()), pa.array(toxic, pa.bool_())], names=["doc_id", "score", "toxic"])

    return run


def scores(docs: DataFrame, model: Model | None) -> DataFrame:
    """(doc_id, score, toxic) for every row of ``docs``.

    Each window of the whole text is compressed under both dictionaries; the
    lengths' difference has the weight of its log likelihood ratio between
    toxic and ordinary documents, and the worst stretch decides, so that clean
    text around it can't outvote it. Defined results: null, empty and wordless
    texts score 0 and are not toxic; repeated rows and ties score alike; a null doc_id
    stays null; an empty table gives none; without a model nothing is toxic;
    other columns are ignored."""
    kept = docs.sparkSession.sparkContext.broadcast(model)
    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return named.mapInArrow(released(_scored(kept)), "doc_id bigint, score double, toxic boolean")


def toxic_documents(docs: DataFrame, labels: DataFrame, **bounds: int) -> DataFrame:
    """The rows of ``scores`` that are toxic, by a model fitted on the labelled
    ones among ``docs``. Defined results as ``scores``: null and empty texts
    are never in it, repeated rows are as often as they occur, and without
    labels of both classes, or without documents, there is none."""
    return scores(docs, fit(docs, labels, **bounds)).where("toxic")
