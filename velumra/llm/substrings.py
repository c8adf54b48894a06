"""Passages that repeat across documents, by MinHash banding of paragraphs."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import reduce
from itertools import combinations, pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.components import weak_components
from ..plans.lineage import table, tidy
from ..plans.memory import released
from .words import WORDS, Blocks, WordHashes, mix, shingles, unblock

#: A paragraph ends at the first end of a sentence or line after so many words;
LEAST = 8
#: a stretch with more words and no such end is cut after words of certain hashes, but not so near its end.
LONGEST = 24
#: Bands of so many minima: a pair of Jaccard 0.7 shares one with probability 0.994.
SHINGLE, BANDS, ROWS = 2, 12, 3
#: Bands are shuffled in so many rounds, each of which takes its share of the room.
ROUNDS = 2
SIMILAR = 0.7
#: Repeated paragraphs side by side are one passage; shorter ones don't count.
PASSAGE = 25
#: In a bucket where a tie fails, so many that failed meet so many of the bucket in one step.
PART = 4096
#: In a part of so few members all pairs are compared.
FEW = 6
#: Prints that a task remembers, so as not to send their word pairs again.
SEEN = 1_000_000
#: Begins with one set of characters, so that the scan skips all others.
STOP = re.compile(r"[.!?…。！？\n](?:(?<=\n)\n*|(?<!\n)[.!?…。！？]*[\"'»”)\]]*\s+)")
MARKED = re.compile(r"\w+|\0")
CUT = np.uint64(3)


def paragraphs(text: str, known: WordHashes) -> tuple[list[int], list[int], np.ndarray]:
    """The stretches that ``text`` is cut into, as their ends (where one ends
    the next begins), their numbers of words, and the hashes of all words in a
    row. Where they end depends on nearby words only, so a passage is cut alike
    wherever it stands, but for its first and last stretch."""
    stops = [m.end() for m in STOP.finditer(text)]
    stops.append(len(text))
    # A word of its own stands for each stop, so the text is read once.
    h = known.many(MARKED.findall(STOP.sub(" \0 ", text.lower().replace("\0", "\1"))))
    marks = np.flatnonzero(h == known.many(["\0"]))
    upto = (marks - np.arange(len(marks))).tolist()
    h = np.delete(h, marks) if len(marks) else h
    upto.append(len(h))
    ends, counts, first, seen, at = [], [], 0, 0, 0
    for stop, n in zip(stops, upto):
        if n - seen > LONGEST:
            piece = text[at:stop]
            places = [m.end() for m in WORDS.finditer(piece)]
            if len(places) != n - seen:  # lower case changed the words' number
                places = [round(len(piece) * (k + 1) / (n - seen)) for k in range(n - seen)]
            for k in np.flatnonzero((mix(h[seen:n]) & CUT) == 0).tolist():
                if seen + k + 1 - first >= LEAST and n - (seen + k + 1) >= LEAST:
                    ends.append(at + places[k])
                    counts.append(seen + k + 1 - first)
                    first = seen + k + 1
        if n - first >= LEAST:
            ends.append(stop)
            counts.append(n - first)
            first = n
        seen, at = n, stop
    if len(h) > first:
        ends.append(len(text))
        counts.append(len(h) - first)
    return ends, counts, h


def _cut(batch: pa.RecordBatch, known: WordHashes):
    """All paragraphs of a batch: (owner row, number, begin, end), numbers of
    words, hashes in a row, where each one's begin, and prints of the word sequences."""
    found = [paragraphs(t, known) if t else ([], [], np.empty(0, np.uint64)) for t in batch.column("text").to_pylist()]
    each = np.array([len(f[0]) for f in found], np.int64)
    begin = np.concatenate([[0], np.cumsum(each)]).astype(np.int64)
    owner = np.repeat(np.arange(len(found)), each)
    end = np.array([e for f in found for e in f[0]], np.int64)
    start = np.concatenate([[0], end[:-1]]).astype(np.int64)[: len(end)]
    start[begin[:-1][each > 0]] = 0
    lengths = np.array([n for f in found for n in f[1]], np.int64)
    first = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)
    h = np.concatenate([f[2] for f in found]) if found else np.empty(0, np.uint64)
    place = (np.arange(len(h)) - np.repeat(first[:-1], lengths)).astype(np.uint64)
    prints = mix(np.add.reduceat(mix(mix(h) + place * np.uint64(0x9E3779B97F4A7C15)), first[:-1])) if len(lengths) else np.empty(0, np.uint64)
    return (owner, np.arange(len(owner)) - begin[owner], start, end), lengths, h, first, prints


def pair_sets(s: np.ndarray, of: np.ndarray, keep: np.ndarray) -> pa.Array:
    """The distinct low 32 bits of hashes ``s`` of each paragraph to ``keep``, in order, as packed bytes; others are null."""
    here = keep[of]
    both = np.sort((of[here].astype(np.uint64) << np.uint64(32)) | (s[here] & np.uint64(2**32 - 1)))
    both = both[np.diff(both, prepend=~both[:1]) != 0]  # np.unique by hashing takes several times as long
    sizes = np.bincount((both >> np.uint64(32)).astype(np.int64), minlength=len(keep))
    ends = np.concatenate([[0], 4 * np.cumsum(sizes)]).astype(np.int32)
    valid = np.packbits(keep, bitorder="little").tobytes()
    return pa.Array.from_buffers(pa.binary(), len(keep), [pa.py_buffer(valid), pa.py_buffer(ends.tobytes()), pa.py_buffer(both.astype("<u4").tobytes())])


def _listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All paragraphs; those that can be near others have their word pairs where the task meets them first."""
    known, seen = WordHashes(), set()
    for whole in batches:
        for k in range(0, whole.num_rows, 512):
            batch = whole.slice(k, 512)
            found, lengths, h, first, prints = _cut(batch, known)
            own, at = np.unique(prints, return_index=True)
            new = np.zeros(len(prints), bool)
            new[[i for p, i in zip(own.tolist(), at.tolist()) if p not in seen]] = True
            new &= lengths >= LEAST
            if len(seen) > SEEN:
                seen.clear()
            seen.update(prints[new].tolist())
            ids = batch.column("doc_id").take(pa.array(found[0]))
            columns = [pa.array(prints.view(np.int64)), ids, *(pa.array(x.astype(np.int32)) for x in (*found[1:], lengths)), pair_sets(*shingles(h, first, SHINGLE), new)]
            yield pa.RecordBatch.from_arrays(columns, names=["print", "doc_id", "unit", "begin", "end", "words", "grams"])


def band_keys(grams: list[bytes], bands: int = BANDS, rows: int = ROWS, seed: int = 41, first: int = 0) -> np.ndarray:
    """(sets, bands) hashes of ``rows`` minima, each of its own hash function; of the bands from ``first`` on."""
    sizes = np.array([len(g) // 4 for g in grams])
    begin = np.concatenate([[0], np.cumsum(sizes[:-1])]).astype(np.int64)
    g = mix(np.frombuffer(b"".join(grams), "<u4").astype(np.uint64))
    rng = np.random.default_rng(seed)
    seeds = rng.integers(0, 2**63, (bands, rows, 2)).astype(np.uint64)
    out = np.zeros((len(grams), bands - first), np.uint64)
    for b in range(first, bands):
        key = np.full(len(grams), b + 1, np.uint64)
        for odd, more in seeds[b]:
            least = np.minimum.reduceat((g * (odd * np.uint64(2) + np.uint64(1)) + more) >> np.uint64(24), begin)
            key = key * np.uint64(0x9E3779B97F4A7C15) + mix(least)
        # 48 bits are enough to tell buckets apart, and take less room in a block.
        out[:, b - first] = mix(key) & ~np.uint64(0xFFFF)
    return out


def _banded(buckets: int, first: int, end: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = Blocks(buckets, ["<u8", "<u8"], 800_000)
        for whole in batches:
            if whole.num_rows:
                key = band_keys(whole.column("grams").to_pylist(), end, first=first)
                prints = whole.column("print").to_numpy(zero_copy_only=False).view(np.uint64)
                yield from blocks.add(key.reshape(-1), np.repeat(prints, key.shape[1]))
        yield from blocks.flush()

    return run


def _stars(found: pa.Table) -> pa.Table:
    """Ties of each print in a bucket of equal band keys to the least one, with the key."""
    key, print_ = unblock(found, ["<u8", "<u8"])
    order = np.lexsort((print_, key))
    key, print_ = key[order], print_[order]
    new = np.diff(key, prepend=~key[:1]) != 0
    hub = print_[new][np.cumsum(new) - 1] if len(key) else print_
    apart = (print_ != hub) & (np.diff(print_, prepend=~print_[:1]) != 0)
    return pa.table({n: pa.array(x[apart].view(np.int64)) for n, x in (("key", key), ("a", print_), ("b", hub))})


def alike(x: list[bytes], y: list[bytes], least: float) -> np.ndarray:
    """Whether the Jaccard index of each pair of sets reaches ``least``."""
    sizes = [np.array([len(g) // 4 for g in side], np.int64) for side in (x, y)]
    if not len(x):
        return np.empty(0, bool)
    keyed = [
        (np.repeat(np.arange(len(n), dtype=np.uint64), n) << np.uint64(32)) | np.frombuffer(b"".join(side), "<u4") for n, side in zip(sizes, (x, y))
    ]
    shared = np.intersect1d(*keyed, assume_unique=True)
    both = np.bincount((shared >> np.uint64(32)).astype(np.int64), minlength=len(x))
    return both >= least * (sizes[0] + sizes[1] - both)


def _similar(least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yes = alike(batch.column("x").to_pylist(), batch.column("y").to_pylist(), least)
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(yes, pa.bool_())], names=["a", "b", "alike"])

    return run


def links(prints: list[int], alike: list[bool], sets: list[np.ndarray], least: float) -> list[tuple[int, int]]:
    """Pairs that connect all of a bucket that pairs of at least ``least``
    connect, where those ``alike`` are connected by the hub already. Exact:
    two such sets share one of each one's rarest members, as many as may miss."""
    sizes = np.array([len(x) for x in sets])
    first = np.concatenate([[0], np.cumsum(sizes)])
    _, gram, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    gram = gram[np.lexsort((gram, count[gram], np.repeat(np.arange(len(sets)), sizes)))]
    top, out, where = list(range(len(sets))), [], {}
    hub = next((i for i, yes in enumerate(alike) if yes), None)
    own: list[set[int]] = []

    def find(i: int) -> int:
        while top[i] != i:
            top[i] = i = top[top[i]]
        return i

    for i, yes in enumerate(alike):
        if yes:
            top[i] = hub
    for i, n in enumerate(sizes.tolist()):
        mine = gram[first[i] : first[i + 1]]
        own.append(set(mine.tolist()))
        head = mine[: n - math.ceil(least * n - 1e-9) + 1]
        head = head[count[head] > 1].tolist()
        for j in {j for g in head for j in where.get(g, ())}:
            if find(i) != find(j):
                both = len(own[i] & own[j])
                if both >= least * (len(own[i]) + len(own[j]) - both):
                    top[find(i)] = find(j)
                    out.append((prints[i], prints[j]))
        for g in head:
            where.setdefault(g, []).append(i)
    return out


def _linked(least: float):
    """Of rows in order of (key, i, j), the part of a bucket in one task. The
    pairs of small parts are compared together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, rows = None, {}
        edges: list[tuple[int, int]] = []
        waiting: tuple[list, list, list] = ([], [], [])

        def close() -> None:
            if len(rows) > FEW:
                same, raw = zip(*rows.values())
                edges.extend(links(list(rows), list(same), [np.frombuffer(x, "<u4") for x in raw], least))
                return
            for (a, (one, x)), (b, (other, y)) in combinations(rows.items(), 2):
                if not (one and other):
                    for held, value in zip(waiting, ((a, b), x, y)):
                        held.append(value)

        def found() -> pa.RecordBatch:
            pairs, x, y = waiting
            edges.extend(p for p, yes in zip(pairs, alike(x, y, least)) if yes)
            out = pa.RecordBatch.from_arrays([pa.array([e[k] for e in edges], pa.int64()) for k in (0, 1)], names=["a", "b"])
            for held in (edges, *waiting):
                held.clear()
            return out

        for batch in batches:
            for key, i, j, a, *row in zip(*(batch.column(c).to_pylist() for c in ("key", "i", "j", "a", "alike", "grams"))):
                if (key, i, j) != place:
                    close()
                    place, rows = (key, i, j), {}
                rows[a] = row
            yield found()
        close()
        yield found()

    return run


def repeated_passages(docs: DataFrame, similar: float = SIMILAR, passage: int = PASSAGE) -> DataFrame:
    """Passages that stand in two documents or more:
    (doc_id, begin, end, words, first_doc_id, remove).

    Texts are cut into paragraphs at ends of sentences and lines, and where
    these are far apart after words of certain hashes. Paragraphs of one word
    sequence have one 64-bit print; from there on only different prints count,
    however often they occur. Prints that share a MinHash band are tied to the
    least of the bucket, and a tie holds when the exact Jaccard index of their
    word pairs reaches ``similar``. In a bucket where a tie fails, those that
    failed meet all others, but for those that are connected already, in parts
    of ``PART`` by ``PART``, so it is connected as by all its pairs. Clusters
    are the connected components; one that stays inside a single document is
    none.

    Neighbouring paragraphs of clusters make a passage if they have ``passage``
    words together. A passage is one row for each stretch of it that is first,
    or is not first, of its clusters: ``remove`` is true where every paragraph
    stands earlier too, in (doc_id, place), so one copy of each paragraph
    stays. ``first_doc_id`` is the least document in which any of it stands.

    Each text is cut once. Bands move as packed blocks, in ``ROUNDS`` rounds, of
    which a bucket holds about one part in four times the shuffle partitions. Defined results: null,
    empty and wordless texts have no passage; rows with a null doc_id are left
    out; rows that repeat a doc_id are one document; an empty table gives none;
    other columns are ignored. Places count characters of the whole text."""
    spark = docs.sparkSession
    texts = docs.where("doc_id IS NOT NULL AND text IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    listed = table(texts.mapInArrow(released(_listed), "print bigint, doc_id bigint, unit int, begin int, end int, words int, grams binary"), "paragraphs")
    units = listed.drop("grams")
    # Each print at least once, and seldom more often than there are tasks.
    grams = listed.where("grams IS NOT NULL").select("print", "grams")
    buckets = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    rounds, edges = [], [BANDS * k // ROUNDS for k in range(ROUNDS + 1)]
    for first, end in pairwise(edges):
        banded = grams.mapInArrow(released(_banded(buckets, first, end)), Blocks.SCHEMA).groupBy("bucket")
        rounds.append(table(banded.applyInArrow(_stars, "key bigint, a bigint, b bigint"), "ties"))
        del banded
        tidy(spark)
    tied = reduce(DataFrame.unionByName, rounds)
    asked = tied.select(F.col("a").alias("print")).unionByName(tied.select(F.col("b").alias("print"))).distinct()
    crowd = table(grams.join(asked, "print", "left_semi").groupBy("print").agg(F.first("grams").alias("grams")), "asked")
    tried = table(
        tied.select("a", "b")
        .distinct()
        .join(crowd.select(F.col("print").alias("a"), F.col("grams").alias("x")), "a")
        .join(crowd.select(F.col("print").alias("b"), F.col("grams").alias("y")), "b")
        .select("a", "b", "x", "y")
        .mapInArrow(released(_similar(similar)), "a bigint, b bigint, alike boolean"),
        "tried",
    )
    members = table(tied.join(tried, ["a", "b"]).select("key", "a", "alike"), "members")
    mixed = members.groupBy("key").agg(F.count(F.when(~F.col("alike"), 1)).alias("_failed"), F.count("*").alias("_all")).where("_failed > 0 AND _all > 1")
    mixed = mixed.select("key", F.ceil(F.col("_failed") / PART).cast("int").alias("_is"), F.ceil(F.col("_all") / PART).cast("int").alias("_js"))
    split = members.join(mixed, "key")
    part = lambda n: F.pmod(F.xxhash64("a"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = split.where("NOT alike").select("key", part("_is").alias("i"), every("_js").alias("j"), "a", "alike")
    right = split.select("key", every("_is").alias("i"), part("_js").alias("j"), "a", "alike")
    parts = left.unionByName(right).distinct().join(crowd.withColumnRenamed("print", "a"), "a").repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "a")
    linked = table(parts.mapInArrow(released(_linked(similar)), "a bigint, b bigint").distinct(), "linked")
    near = tried.where("alike").select("a", "b").unionByName(linked)
    groups = weak_components(near, "a", "b").select(F.col("node").alias("print"), "component")
    prints = units.groupBy("print").agg(F.min(F.struct("doc_id", "unit")).alias("first"), F.max("doc_id").alias("last"))
    prints = prints.join(groups, "print", "left").where("component IS NOT NULL OR first.doc_id < last").withColumn("cluster", F.coalesce("component", "print"))
    prints = table(prints.select("print", "cluster", "first", "last"), "prints")
    clusters = prints.groupBy("cluster").agg(F.min("first").alias("_first"), F.max("last").alias("_last")).where("_first.doc_id < _last")
    repeated = units.join(prints.select("print", "cluster").join(clusters, "cluster"), "print")
    repeated = repeated.select(
        "doc_id", "unit", "begin", "end", "words", F.col("_first.doc_id").alias("_doc"), (F.struct("doc_id", "unit") != F.col("_first")).alias("_later")
    ).distinct()
    order = Window.partitionBy("doc_id").orderBy("unit", "begin", "end")
    runs = repeated.withColumn("_run", F.col("unit") - F.row_number().over(order))
    # Among the rows of a run, each stretch of equal _later has its own number.
    alike_order = Window.partitionBy("doc_id", "_later").orderBy("unit", "begin", "end")
    runs = runs.withColumn("_all", F.sum("words").over(Window.partitionBy("doc_id", "_run"))).withColumn("_piece", F.col("unit") - F.row_number().over(alike_order))
    return (
        runs.where(F.col("_all") >= passage)
        .groupBy("doc_id", "_run", "_later", "_piece")
        .agg(F.min("begin").alias("begin"), F.max("end").alias("end"), F.sum("words").cast("int").alias("words"), F.min("_doc").alias("first_doc_id"))
        .select("doc_id", "begin", "end", "words", "first_doc_id", F.col("_later").alias("remove"))
    )
