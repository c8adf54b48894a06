"""Language-model scores by deleted interpolation (Jelinek and Mercer, 1980)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.lineage import table
from ..plans.memory import released
from .words import Blocks, WordHashes, hashed, mix, opened, planes, unplanes

#: Counts of the most frequent words, as many as this at most, are broadcast; those of all others travel to the
#: buckets of their word. Every word has its own counts, so this moves work and changes no result.
FREQUENT = 1 << 17
#: One document in so many is held out to learn the mixture weights.
HELD = 10
RARE, START = 0, 1
#: Mixture weights differ by steps of log2(1 + context count).
STEPS = 48
#: Rates are kept in quarters of a power of two while weights are learned.
FINE = 4.0
LEAST = 1e-4
ROUNDS = 200
NULL = -(2**63)
ODD = 0x9E3779B97F4A7C15
BACK = pow(ODD, -1, 2**64)
#: Of a block: pair (or its rare word), document, count, the document's counts of the context and of the word;
COLUMNS = ["<u8", "<i8", "<u4", "<u4", "<u4"]
#: the frequent word and its side; the second word, if both are rare, with its counts.
ONE_RARE, BOTH_RARE = [*COLUMNS, "<u4"], [*COLUMNS, "<u8", "<i8", "<i8"]
COUNTS = ["<u8", "<i8", "<i8", "<i8", "<i8"]
#: What a block holds.
PAIRS, MIXED, RARES, WORD_COUNTS = range(4)
KINDS = {PAIRS: COLUMNS, MIXED: ONE_RARE, RARES: BOTH_RARE, WORD_COUNTS: COUNTS}
BLOCKS = "kind int, bucket int, n int, payload binary"
ENCODED = "docs binary, sizes binary, words binary, n int, codes binary"
#: So many words, or documents, and those of one more document make up a row of encoded texts.
WORDS_AT_ONCE, DOCS_AT_ONCE = 400_000, 1024
#: Rows of a bucket that are opened at once, but all of one pair or rare word are.
CHUNK = 200_000


def held_out(doc_id: np.ndarray, held: int) -> np.ndarray:
    return mix(doc_id.astype(np.int64).view(np.uint64) + np.uint64(101)) % np.uint64(held) == 0


def _ids(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("doc_id").fill_null(NULL).to_numpy(zero_copy_only=False)


def _encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts with words, some in a row: documents, numbers of words, hashes of
    the distinct words, the frequent ones first, and each word's place among these."""
    known, press = WordHashes(150_000), zstandard.ZstdCompressor(level=1).compress
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def row() -> pa.RecordBatch:
        docs, sizes, h = (np.concatenate(x) for x in zip(*held))
        held.clear()
        word, code, count = np.unique(h, return_inverse=True, return_counts=True)
        order = np.argsort(-count, kind="stable")
        place = np.empty(len(word), "<u2" if len(word) <= 1 << 16 else "<u4")
        place[order] = np.arange(len(word))
        packed = [docs.astype("<i8").tobytes(), sizes.astype("<u4").tobytes(), word[order].tobytes(), press(planes(place[code]))]
        docs, sizes, word, code = (pa.array([x], pa.binary()) for x in packed)
        return pa.RecordBatch.from_arrays([docs, sizes, word, pa.array([len(h)], pa.int32()), code], names=["docs", "sizes", "words", "n", "codes"])

    for whole in batches:
        for k in range(0, whole.num_rows, 32):
            batch = whole.slice(k, 32)
            h, begin = hashed(batch.column("text").to_pylist(), known)
            sizes = np.diff(begin)
            if len(h):
                held.append((_ids(batch)[sizes > 0], sizes[sizes > 0], h))
            if sum(len(x[2]) for x in held) >= WORDS_AT_ONCE or sum(len(x[0]) for x in held) >= DOCS_AT_ONCE:
                yield row()
    if held:
        yield row()


def _decoded(batches: Iterator[pa.RecordBatch]):
    """What ``_encoded`` packed: documents, where the words of each begin,
    distinct hashes, and each word's place among these."""
    press = zstandard.ZstdDecompressor()
    for batch in batches:
        for k in range(batch.num_rows):
            docs, sizes, word, codes = (batch.column(c)[k].as_buffer() for c in ("docs", "sizes", "words", "codes"))
            word, kind = np.frombuffer(word, "<u8"), "<u2" if len(word) <= 8 << 16 else "<u4"
            begin = np.concatenate([[0], np.cumsum(np.frombuffer(sizes, "<u4"), dtype=np.int64)])
            yield np.frombuffer(docs, "<i8"), begin, word, unplanes(press.decompress(codes), kind, batch.column("n")[k].as_py()).astype(np.int64)


def _counted(held: int):
    """(hash of a word, n, n held out, last words, last words held out) of some texts at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[tuple[np.ndarray, ...]] = []

        def rows() -> pa.RecordBatch:
            word, *counts = (np.concatenate(x) for x in zip(*found))
            found.clear()
            word, back = np.unique(word, return_inverse=True)
            counts = [np.bincount(back, c, len(word)).astype(np.int64) for c in counts]
            return pa.RecordBatch.from_arrays([pa.array(x) for x in (word.view(np.int64), *counts)], names=["word", "n", "h", "e", "eh"])

        for docs, begin, word, code in _decoded(batches):
            out = held_out(docs, held)
            each, last = np.repeat(out, np.diff(begin)), code[begin[1:] - 1]
            found.append((word, *(np.bincount(x, minlength=len(word)) for x in (code[~each], code[each], last[~out], last[out]))))
            if sum(len(x[0]) for x in found) > 300_000:
                yield rows()
        if found:
            yield rows()

    return run


def _document_pairs(batches: Iterator[pa.RecordBatch], top: np.ndarray, rare: bool):
    """For some documents at a time, their distinct pairs of two rare words, or
    all others: hash and number of context and of word (``RARE``, ``START`` or
    2 and the place in ``top``), document, and how often the pair, the context
    and the word stand in it."""
    for docs, begin, word, v in _decoded(batches):
        at = np.searchsorted(top, word)
        at[at == len(top)] = 0
        number = np.where(top[at] == word, at + 2, RARE) if len(top) else np.full(len(word), RARE)
        word, number = np.append(word, np.uint64(0)), np.append(number, START).astype(np.uint64)
        u = np.concatenate([[len(word) - 1], v[:-1]])
        u[begin[:-1]] = len(word) - 1
        both = (number[u] == RARE) & (number[v] == RARE)
        keep = np.flatnonzero(both if rare else ~both)
        if not len(keep):
            continue
        owner = np.repeat(np.arange(len(docs)), np.diff(begin))
        asked = np.flatnonzero(number[v] == RARE) if rare else np.arange(len(v))
        _, back, count = np.unique((owner[asked] << 32) | v[asked], return_inverse=True, return_counts=True)
        nv = np.zeros(len(v), np.int64)
        nv[asked] = count[back]
        # A word is a context as often as it stands in the document, but for the last one.
        nu = np.concatenate([[1], nv[:-1]]) - (u == np.repeat(v[begin[1:] - 1], np.diff(begin)))
        nu[begin[:-1]] = 1
        own, pair = owner[keep].astype(np.uint64), (u[keep].astype(np.uint64) << np.uint64(32)) | v[keep].astype(np.uint64)
        bits = len(word).bit_length()
        if 2 * bits + len(docs).bit_length() <= 64:
            order = np.argsort((own << np.uint64(2 * bits)) | (u[keep].astype(np.uint64) << np.uint64(bits)) | v[keep].astype(np.uint64))
        else:
            order = np.lexsort((pair, own))
        own, pair, i = own[order], pair[order], keep[order]
        new = np.flatnonzero((np.diff(own, prepend=~own[:1]) != 0) | (np.diff(pair, prepend=~pair[:1]) != 0))
        n, i = np.diff(np.append(new, len(pair))), i[new]
        yield word[u[i]], number[u[i]], word[v[i]], number[v[i]], docs[owner[i]], n, nu[i], nv[i]


def _of_kind(kind: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield pa.RecordBatch.from_arrays([pa.array(np.full(b.num_rows, kind, np.int32)), *b.columns], names=["kind", *b.schema.names])


def _pairs(top, buckets: int):
    """Blocks of the pairs that hold a frequent word: by pair if both words
    are, else by the rare one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=1).compress
        both, one = Blocks(buckets, COLUMNS, 500_000, press), Blocks(buckets, ONE_RARE, 200_000, press)
        for uh, u, vh, v, *rest in _document_pairs(batches, top.value, rare=False):
            frequent = (u != RARE) & (v != RARE)
            yield from _of_kind(PAIRS, both.add(((u << np.uint64(32)) | v)[frequent] * np.uint64(ODD), *(x[frequent] for x in rest)))
            mixed = (u == RARE) != (v == RARE)
            first = u[mixed] == RARE
            other = np.where(first, v[mixed] << np.uint64(1), (u[mixed] << np.uint64(1)) | np.uint64(1))
            yield from _of_kind(MIXED, one.add(np.where(first, uh[mixed], vh[mixed]), *(x[mixed] for x in rest), other))
        yield from _of_kind(PAIRS, both.flush())
        yield from _of_kind(MIXED, one.flush())

    return run


def _rare_pairs(top):
    """The pairs of two rare words, one row each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for uh, _, vh, _, *rest in _document_pairs(batches, top.value, rare=True):
            columns = [uh.view(np.int64), vh.view(np.int64), *(x.astype(np.int64) for x in rest)]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=["u", "word", "doc", "c", "nu", "nv"])

    return run


def _packed(kind: int, names: list[str], buckets: int):
    """Blocks of plain rows, by their first column."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = Blocks(buckets, KINDS[kind], 200_000, zstandard.ZstdCompressor(level=1).compress)
        for batch in batches:
            columns = [batch.column(c).to_numpy(zero_copy_only=False) for c in names]
            yield from _of_kind(kind, blocks.add(columns[0].view(np.uint64), *columns[1:]))
        yield from _of_kind(kind, blocks.flush())

    return run


def _added(*by: np.ndarray, sums: tuple[np.ndarray, ...]):
    """Rows in order of ``by``, those that agree in all of it added up; where
    each run of rows that agree in all but the first of ``by`` begins, and its length."""
    order = np.lexsort(by)
    by = tuple(x[order] for x in by)
    change = [np.diff(x, prepend=~x[:1]) != 0 for x in by]
    new = np.flatnonzero(np.logical_or.reduce(change))
    first = np.flatnonzero(np.logical_or.reduce(change[1:])[new])
    return order[new], tuple(np.add.reduceat(x[order].astype(np.int64), new) for x in sums), first, np.diff(np.append(first, len(new)))


def _spans(found: list[tuple[int, pa.Buffer]], kinds: list[str], chunk: int):
    """The columns of the blocks of a bucket, split by ranges of the first one
    into parts of about ``chunk`` rows."""
    press = zstandard.ZstdDecompressor()
    blocks = [opened(n, press.decompress(raw), kinds) for n, raw in found]
    parts = -(-sum(n for n, _ in found) // chunk)
    edges = np.array([k * 2**64 // parts for k in range(1, parts)], np.uint64)
    cuts = [[0, *np.searchsorted(b[0], edges).tolist(), len(b[0])] for b in blocks]
    for k in range(parts):
        columns = [np.concatenate([b[j][c[k] : c[k + 1]] for b, c in zip(blocks, cuts)]) for j in range(len(kinds))]
        if len(columns[0]):
            yield columns


def _opened(batches: Iterator[pa.RecordBatch], model: dict, more: str | None = None, chunk: int = CHUNK):
    """The pairs of the buckets, one bucket after another, in order of bucket,
    and of a bucket in parts: documents, their counts, where each pair's rows
    begin and how many they are, and for each pair the counts of context and
    word, without held-out text and with it. The rows of a document that is in
    several rows are added up. With the value of column ``more``."""
    extra = None

    def whole(found: dict[int, list[tuple[int, pa.Buffer]]]):
        parts = lambda kind: _spans(found.pop(kind, []), KINDS[kind], chunk)
        known, counts = np.empty(0, np.uint64), np.empty((0, 4), np.int64)
        if WORD_COUNTS in found:
            known, *some = (np.concatenate(c) for c in zip(*parts(WORD_COUNTS)))
            order = np.argsort(known)
            known, counts = known[order], np.stack(some, 1)[order]
        of = lambda h: counts[np.searchsorted(known, h)].T
        for key, doc, *some in parts(PAIRS):
            at, some, first, sizes = _added(doc, key, sums=some)
            pair = key[at][first] * np.uint64(BACK)
            u, v = (pair >> np.uint64(32)).astype(np.int64), (pair & np.uint64(2**32 - 1)).astype(np.int64)
            yield doc[at], *some, first, sizes, [m[u] for m in model["context"]], [m[v] for m in model["word"]], extra
        for rare, doc, *some, other in parts(MIXED):
            at, some, first, sizes = _added(doc, other, rare, sums=some)
            n, h, e, eh = of(rare[at][first])
            other = other[at][first].astype(np.int64)
            second, other = other & 1 == 1, other >> 1
            context = [np.where(second, m[other], r) for m, r in zip(model["context"], (n - e, n + h - e - eh))]
            word = [np.where(second, r, m[other]) for m, r in zip(model["word"], (n, n + h))]
            yield doc[at], *some, first, sizes, context, word, extra
        for u, doc, *some, v, vn, vall in parts(RARES):
            at, some, first, sizes = _added(doc, v, u, sums=some)
            n, h, e, eh = of(u[at][first])
            yield doc[at], *some, first, sizes, [n - e, n + h - e - eh], [vn[at][first], vall[at][first]], extra

    bucket, found = None, {}
    for batch in batches:
        if more and batch.num_rows and extra is None:
            extra = batch.column(more)[0].as_py()
        payload = batch.column("payload")
        for k, (kind, b, n) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("kind", "bucket", "n")))):
            if b != bucket:
                yield from whole(found)
                bucket, found = b, {}
            found.setdefault(kind, []).append((n, payload[k].as_buffer()))
    yield from whole(found)


def step(context: np.ndarray) -> np.ndarray:
    return np.minimum(STEPS - 1, np.log2(1.0 + context).astype(np.int64))


def _rates(c2, cu, cv, total):
    return np.divide(c2, cu, out=np.zeros(len(c2)), where=cu > 0), cv / max(1, total)


HISTOGRAM = "s int, a int, b int, w double, p2 double, p1 double"


def _held(model, held: int):
    """The held-out pairs as sums over a grid of (context step, log of the pair's
    rate, log of the word's rate), of bounded size at any amount of text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for doc, n, _, _, first, sizes, context, word, _ in _opened(batches, m):
            out = np.where(held_out(doc, held), n, 0)
            h, c = np.add.reduceat(out, first), np.add.reduceat(n - out, first)
            hit = h > 0
            if not hit.any():
                continue
            h, c, cu, cv = h[hit], c[hit], context[0][hit], word[0][hit]
            p2, p1 = _rates(c, cu, cv, m["total"][0])
            fine = lambda p: np.where(p > 0, np.round(FINE * np.log2(np.maximum(p, 1e-300))), 1).astype(np.int64)
            # The logs of rates are between -252 and 1.
            cell, back = np.unique((step(cu) << 24) | ((fine(p2) + 1024) << 12) | (fine(p1) + 1024), return_inverse=True)
            w, cell = np.bincount(back, h), (cell >> 24, (cell >> 12 & 4095) - 1024, (cell & 4095) - 1024)
            yield pa.RecordBatch.from_arrays(
                [*(pa.array(x.astype(np.int32)) for x in cell), pa.array(w), pa.array(np.bincount(back, h * p2, len(w))), pa.array(np.bincount(back, h * p1, len(w)))],
                names=["s", "a", "b", "w", "p2", "p1"],
            )

    return run


def learn(s: np.ndarray, w: np.ndarray, p2: np.ndarray, p1: np.ndarray, p0: float) -> np.ndarray:
    """(STEPS, 3) mixture weights of pair, word and uniform rate by expectation
    maximisation; a step without held-out text has the weights of all text."""

    def weights(rows: np.ndarray) -> np.ndarray:
        l = np.full(3, 1 / 3)
        p = np.stack([p2[rows], p1[rows], np.full(int(rows.sum()), p0)], 1)
        for _ in range(ROUNDS):
            share = p * l
            share /= share.sum(1, keepdims=True)
            now = (share * w[rows, None]).sum(0) / w[rows].sum()
            if np.abs(now - l).max() < 1e-7:
                l = now
                break
            l = now
        l = np.maximum(l, LEAST)
        return l / l.sum()

    every = weights(np.ones(len(w), bool)) if len(w) else np.full(3, 1 / 3)
    out = np.tile(every, (STEPS, 1))
    for k in np.unique(s):
        out[k] = weights(s == k)
    return out


def _learned(p0: float):
    def run(found: pa.Table) -> pa.Table:
        order = np.lexsort([found.column(c).to_numpy() for c in ("b", "a", "s")])
        s, w, p2, p1 = (found.column(c).to_numpy()[order] for c in ("s", "w", "p2", "p1"))
        return pa.table({"lambdas": pa.array([learn(s, w, p2 / w, p1 / w, p0).tobytes()], pa.binary())})

    return run


def _scored(model, p0: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, found = model.value, []

        def merged() -> None:
            docs, *sums = (np.concatenate(x) for x in zip(*found))
            own, back = np.unique(docs, return_inverse=True)
            found[:] = [(own, *(np.bincount(back, x, len(own)) for x in sums))]

        rows, most = 0, 2 * CHUNK
        for doc, n, nu, nv, first, sizes, context, word, raw in _opened(batches, m, "lambdas"):
            lambdas = np.frombuffer(raw).reshape(STEPS, 3)
            c2 = np.repeat(np.add.reduceat(n, first), sizes) - n
            cu, cv = np.repeat(context[1], sizes) - nu, np.repeat(word[1], sizes) - nv
            p2, p1 = _rates(c2, cu, cv, m["total"][1])
            at = step(cu)
            bits = -n * np.log2(lambdas[at, 0] * p2 + lambdas[at, 1] * p1 + lambdas[at, 2] * p0)
            own, back = np.unique(doc, return_inverse=True)
            found.append((own, np.bincount(back, bits), np.bincount(back, n)))
            rows += len(own)
            if rows > most:
                merged()
                rows = len(found[0][0])
                most = 2 * rows + 2 * CHUNK
        if found:
            merged()
            own, total, count = found[0]
            yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(total), pa.array(count.astype(np.int64))], names=["doc_id", "bits", "words"])

    return run


def scores(docs: DataFrame, frequent: int = FREQUENT, held: int = HELD) -> DataFrame:
    """(doc_id, n_words, bits_per_word, perplexity) of every document with a word.

    The model is a mixture of the maximum-likelihood rates of a word after the
    word before it, of the word alone, and of any of the words that occur (and
    one more). The mixture weights depend on how often the context was seen,
    and are learned by expectation maximisation: one document in ``held`` is
    held out, all others are counted, and the weights maximise the likelihood
    of the held-out counts. Scores then use the counts of all documents but the
    one that is scored: its own counts of pair, context and word are taken off
    (the number of all words is left as it is). Every word and pair has counts
    of its own, by a 64-bit hash.

    Each text is cut into words once and written as numbers; what follows reads
    these. Pairs move once, as packed blocks; learning and scoring read the same
    shuffle. The counts of the ``frequent`` most frequent words are broadcast.
    A pair with a rare word goes to the bucket of that word, and so do its
    counts; of two rare words, the second one's counts are joined first. A task
    opens one bucket at a time, about one part in four times the shuffle
    partitions, and of it about ``CHUNK`` rows at once. Rows are of (pair, document), so a pair that stands in every
    document makes up no more than one part in the mean number of a document's
    different pairs. Only that broadcast and a grid of held-out sums, both of
    bounded size, reach driver and executors.

    Defined results: null, empty and wordless texts have no row; rows that
    repeat a doc_id are one document, as are those with a null one; an empty
    table gives none; other columns are ignored."""
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    texts = table(texts.mapInArrow(released(_encoded), ENCODED), "encoded")
    counts = texts.mapInArrow(released(_counted(held)), "word long, n long, h long, e long, eh long").groupBy("word")
    counts = table(counts.agg(*(F.sum(c).alias(c) for c in ("n", "h", "e", "eh"))).withColumn("all", F.col("n") + F.col("h")), "words")
    # The number of words of each frequency; frequencies above a million count as one.
    sizes = counts.groupBy(F.least("all", F.lit(1_000_000)).alias("f")).count().orderBy(F.desc("f")).collect()
    room, least = frequent, 1_000_001
    for row in sizes:
        room -= row["count"]
        if room < 0:
            break
        least = row["f"]
    top = counts.where(F.col("all") >= least).select("word", "n", "h", "e", "eh").collect()
    sums = counts.agg(F.count("*").alias("words"), *(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n", "h", "e", "eh"))).first()
    word, n, h, e, eh = np.array(top, np.int64).reshape(-1, 5).T
    order = np.argsort(word.view(np.uint64))
    word, n, h, e, eh = (x[order] for x in (word, n, h, e, eh))
    full = lambda x, start: np.concatenate([[0, start], x]).astype(np.int64)
    model = {"word": [full(n, 0), full(n + h, 0)], "context": [full(n - e, sums.e), full(n + h - e - eh, sums.e + sums.eh)], "total": [int(sums.n), int(sums.n + sums.h)]}
    model = spark.sparkContext.broadcast(model)
    known = spark.sparkContext.broadcast(word.view(np.uint64))
    p0 = 1.0 / (sums.words + 1)
    buckets = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    pack = lambda df, kind, *names: df.mapInArrow(released(_packed(kind, names, buckets)), BLOCKS)
    rare = counts.where(F.col("all") < least)
    alone = texts.mapInArrow(released(_rare_pairs(known)), "u bigint, word bigint, doc bigint, c bigint, nu bigint, nv bigint").join(rare.select("word", "n", "all"), "word")
    parts = texts.mapInArrow(released(_pairs(known, buckets)), BLOCKS)
    parts = parts.unionByName(pack(alone, RARES, "u", "doc", "c", "nu", "nv", "word", "n", "all")).unionByName(pack(rare, WORD_COUNTS, "word", "n", "h", "e", "eh"))
    blocks = parts.repartition("bucket")
    grid = blocks.sortWithinPartitions("bucket").mapInArrow(released(_held(model, held)), HISTOGRAM).groupBy("s", "a", "b").agg(*(F.sum(c).alias(c) for c in ("w", "p2", "p1")))
    start = spark.createDataFrame([(-1, 0, 0, 1.0, 0.0, 0.0)], HISTOGRAM)  # so that there is a row even without held-out text
    lambdas = grid.unionByName(start).withColumn("_all", F.lit(0)).groupBy("_all").applyInArrow(_learned_all(p0), "lambdas binary")
    # Spark drops a sort below a join.
    scored = blocks.crossJoin(F.broadcast(lambdas)).sortWithinPartitions("bucket").mapInArrow(released(_scored(model, p0)), "doc_id bigint, bits double, words bigint")
    per_word = F.col("bits") / F.col("n_words")
    return (
        scored.groupBy("doc_id")
        .agg(F.sum("bits").alias("bits"), F.sum("words").alias("n_words"))
        .select(F.when(F.col("doc_id") != NULL, F.col("doc_id")).alias("doc_id"), "n_words", per_word.alias("bits_per_word"), F.pow(F.lit(2.0), per_word).alias("perplexity"))
    )


def _learned_all(p0: float):
    learned = _learned(p0)

    def run(found: pa.Table) -> pa.Table:
        return learned(found.filter(pa.array(found.column("s").to_numpy() >= 0)))

    return run
