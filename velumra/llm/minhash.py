"""Near-duplicate documents by one-permutation MinHash."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.components import weak_components
from ..plans.lineage import table
from ..plans.memory import released
from .words import WordHashes, hashed, mix, shingles, unused

BINS = 256
ROWS = 4
SHINGLE = 2
THRESHOLD = 0.5
#: In a bucket where a tie fails, so many that failed meet so many of the bucket in one step.
PART = 4096
EMPTY = np.uint64(2**64 - 1)


def one_permutation(h: np.ndarray, of: np.ndarray, n: int, bins: int = BINS) -> np.ndarray:
    """(n, bins) minima of hashes ``h`` of texts ``of``: one hash function, the
    range cut into bins. An empty bin borrows from a full one found by its own
    sequence of hashes (optimal densification, Shrivastava 2017), so that two
    sets borrow alike where they are alike. Rows of texts without a hash are
    all EMPTY."""
    sig = np.full(n * bins, EMPTY)
    width = np.uint64(2**64 // bins)
    np.minimum.at(sig, of * bins + (h // width).astype(np.int64), h % width)
    sig = sig.reshape(n, bins)
    full = sig != EMPTY
    row, at = np.nonzero(~full & full.any(1)[:, None])
    if len(row):
        source, attempt = sig.copy(), 0
        while len(row):
            attempt += 1
            j = (mix(at.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(attempt)) % np.uint64(bins)).astype(np.int64)
            hit = full[row, j]
            sig[row[hit], at[hit]] = source[row[hit], j[hit]]
            row, at = row[~hit], at[~hit]
    return sig


def _signatures(shingle: int, bins: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for whole in batches:
            for k in range(0, whole.num_rows, 512):
                batch = whole.slice(k, 512)
                h, begin = hashed(batch.column("text").to_pylist(), known)
                s, of = shingles(h, begin, shingle)
                short = mix(one_permutation(s, of, batch.num_rows, bins)).astype("<u2")
                has = np.diff(begin) > 0
                print_ = np.zeros((2, batch.num_rows), np.uint64)
                order = np.arange(len(h), dtype=np.uint64) - np.repeat(begin[:-1], np.diff(begin)).astype(np.uint64)
                for seed in range(2):
                    each = mix(mix(h + np.uint64(seed)) + order * np.uint64(0x9E3779B97F4A7C15))
                    print_[seed, has] = np.add.reduceat(each, begin[:-1][has]) if has.any() else 0
                out = pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), *(pa.array(p.view(np.int64)) for p in print_), pa.array([x.tobytes() for x in short], pa.binary())],
                    names=["doc_id", "print_a", "print_b", "sig"],
                )
                yield out.filter(pa.array(has))

    return run


def _bands(rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = batch.column("sig").to_pylist()
            if not raw:
                continue
            sig = np.frombuffer(b"".join(raw), "<u2").reshape(len(raw), -1, rows).astype(np.uint64)
            key = np.zeros(sig.shape[:2], np.uint64)
            for r in range(rows):
                key = key * np.uint64(0x9E3779B97F4A7C15) + mix(sig[:, :, r] + np.uint64(r + 1))
            key = mix(key + np.arange(key.shape[1], dtype=np.uint64)[None, :] * np.uint64(0xD6E8FEB86659FD93))
            ids = np.repeat(batch.column("doc_id").to_numpy(zero_copy_only=False), key.shape[1])
            yield pa.RecordBatch.from_arrays([pa.array(key.reshape(-1).view(np.int64)), pa.array(ids, pa.int64())], names=["key", "doc_id"])

    return run


def _alike(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (batch.column(c).to_pylist() for c in ("sig_a", "sig_b"))
            if not a:
                continue
            x, y = (np.frombuffer(b"".join(s), "<u2").reshape(len(s), -1) for s in (a, b))
            share = (x == y).mean(1)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("hub"), pa.array(share >= threshold)], names=["doc_id", "hub", "alike"]
            )

    return run


def chained(ids: np.ndarray, sig: np.ndarray, left: np.ndarray, right: np.ndarray, held: np.ndarray, threshold: float) -> tuple[list, list]:
    """Pairs of a row ``left`` and a row ``right`` whose share of equal minima
    reaches ``threshold``, which connect all that such pairs connect, given
    that the rows ``held`` are connected already; fewer pairs than rows."""
    label = np.arange(len(ids))
    if held.any():
        label[held] = np.flatnonzero(held)[0]
    right = np.flatnonzero(right)
    docs, hubs = [], []
    for i in np.flatnonzero(left):
        others = right[label[right] != label[i]]
        if not len(others):
            continue
        others = others[(sig[others] == sig[i]).mean(1) >= threshold]
        if len(others):
            labels, first = np.unique(label[others], return_index=True)
            docs += [ids[i]] * len(labels)
            hubs += ids[others[first]].tolist()
            label[np.isin(label, labels)] = label[i]
    return docs, hubs


def _rest(threshold: float):
    """Of rows in order of (key, i, j), the part of a bucket in one task: those
    that failed with the hub meet all of the bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, held = None, []

        def edges(found: list) -> pa.RecordBatch:
            docs, hubs = [], []
            for rows in found:
                ids, side, alike, raw = zip(*rows)
                sig, side = np.frombuffer(b"".join(raw), "<u2").reshape(len(raw), -1), np.array(side)
                some = chained(np.array(ids), sig, side == 0, side == 1, np.array(alike, bool), threshold)
                docs += some[0]
                hubs += some[1]
            return pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(hubs, pa.int64())], names=["doc_id", "hub"])

        for batch in batches:
            found = []
            for key, i, j, *row in zip(*(batch.column(c).to_pylist() for c in ("key", "i", "j", "doc_id", "side", "alike", "sig"))):
                if (key, i, j) != place:
                    if held:
                        found.append(held)
                    place, held = (key, i, j), []
                held.append(row)
            yield edges(found)
        if held:
            yield edges([held])

    return run


def near_duplicates(
    docs: DataFrame, threshold: float = THRESHOLD, shingle: int = SHINGLE, bins: int = BINS, rows: int = ROWS
) -> DataFrame:
    """Documents that have a near duplicate: (doc_id, group_id, keep).

    A document is the set of its runs of ``shingle`` lower-case words. Copies
    of equal word sequence (by two 64-bit prints) collapse first. One
    representative of each is cut into bands of ``rows`` of its ``bins``
    minima; in each bucket all members are tied to the one of least id only,
    so a bucket of n gives n - 1 candidate edges. An edge holds when the share
    of equal minima reaches ``threshold``. Members that fail with their hub
    are compared with all of the bucket that they aren't connected with yet, in
    parts of ``PART`` by ``PART`` that pass on fewer edges than they have
    members. Groups are the connected components of edges that hold; the least
    doc_id is kept. With 64 bands of 4, a pair of Jaccard 0.5 collides with
    probability 0.98.

    Skew: hubs are aggregated before the shuffle, joins on hot keys are split
    by adaptive execution, and no task holds more than two parts of a bucket.

    Defined results: a null, empty or wordless text is never a duplicate, nor
    is a document with a null id; rows that repeat a doc_id are one document;
    an empty table gives no group; other columns are ignored.
    """
    texts = docs.where("doc_id IS NOT NULL AND text IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    signed = table(texts.mapInArrow(released(_signatures(shingle, bins)), "doc_id bigint, print_a bigint, print_b bigint, sig binary"), "signed")
    firsts = signed.groupBy("print_a", "print_b").agg(F.min("doc_id").alias("hub"), F.first("sig").alias("sig"))
    firsts = table(firsts, "firsts")
    copies = signed.select("doc_id", "print_a", "print_b").join(firsts.drop("sig"), ["print_a", "print_b"]).where("doc_id != hub").select("doc_id", "hub").distinct()
    # A doc_id that is repeated with other texts has several signatures.
    sigs = firsts.select(F.col("hub").alias("doc_id"), "sig")
    banded = sigs.mapInArrow(released(_bands(rows)), "key bigint, doc_id bigint")
    hubs = table(banded.groupBy("key").agg(F.min("doc_id").alias("hub"), F.max("doc_id").alias("_last")).where("hub < _last").select("key", "hub"), "hubs")
    buckets = table(banded.join(hubs, "key").where("doc_id != hub"), "buckets")
    pairs = buckets.select("doc_id", "hub").distinct()
    tried = table(
        pairs.join(sigs.withColumnRenamed("sig", "sig_a"), "doc_id")
        .join(sigs.select(F.col("doc_id").alias("hub"), F.col("sig").alias("sig_b")), "hub")
        .mapInArrow(released(_alike(threshold)), "doc_id bigint, hub bigint, alike boolean")
        .groupBy("doc_id", "hub")
        .agg(F.max("alike").alias("alike")),
        "tried",
    )
    # Buckets of which some fail with the hub. (An id with several signatures has all of them.)
    members = table(buckets.join(tried, ["doc_id", "hub"]).select("key", "doc_id", "alike").distinct(), "members")
    mixed = members.groupBy("key").agg(F.count(F.when(~F.col("alike"), 1)).alias("_failed"), F.count("*").alias("_all")).where("_failed > 0 AND _all > 1")
    mixed = mixed.select("key", F.ceil(F.col("_failed") / PART).cast("int").alias("_is"), F.ceil(F.col("_all") / PART).cast("int").alias("_js"))
    split = members.join(mixed, "key")
    part = lambda n: F.pmod(F.xxhash64("doc_id"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = split.where("NOT alike").select("key", part("_is").alias("i"), every("_js").alias("j"), "doc_id", F.lit(0).alias("side"), "alike")
    right = split.select("key", every("_is").alias("i"), part("_js").alias("j"), "doc_id", F.lit(1).alias("side"), "alike")
    parts = left.unionByName(right).join(sigs, "doc_id").repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "doc_id", "side")
    led = parts.mapInArrow(released(_rest(threshold)), "doc_id bigint, hub bigint")
    edges = copies.unionByName(tried.where("alike").select("doc_id", "hub")).unionByName(led)
    groups = weak_components(edges, "doc_id", "hub")
    return groups.select(
        F.col("node").alias("doc_id"), F.col("component").alias("group_id"), (F.col("node") == F.col("component")).alias("keep")
    )


def kept_documents(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs``, all columns, without those that a kept near
    duplicate stands for. Defined results: rows with a null doc_id and null,
    empty and wordless texts stay; rows that repeat a doc_id stay or go
    together; an empty table stays empty; columns may have any other name."""
    (name,) = unused(docs.columns, "__gone_id")
    gone = near_duplicates(docs, **options).where("NOT keep").select(F.col("doc_id").alias(name))
    return docs.join(gone, F.col("doc_id").cast("long") == F.col(name), "left_anti")
