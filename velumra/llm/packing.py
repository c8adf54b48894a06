"""Packing by concatenate and cut."""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.memory import released
from ..plans.prefix import range_sorted, starts

RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
EOS = 50256
SPACED = re.compile(r"\s\s|\s\Z")
WINDOW = 2048

DOC = "struct<doc_id:bigint,doc_start:bigint,window_start:int,n:int>"
CUT = f"window_id bigint, offset int, n int, tokens array<int>, docs array<{DOC}>"


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


class Encoder(dict):
    """The public byte-level BPE, as packed ids of texts; the ids of
    space-separated pieces are kept.

    The split pattern never joins what is before a single space to what is
    after it, so pieces can be encoded alone; a text with two white-space
    characters running, or one at its end, is encoded whole.
    """

    def __init__(self, ranks: dict[bytes, int], kind: str, keep: int = 400_000):
        import tiktoken

        super().__init__()
        self.encode = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.kind, self.keep = kind, keep

    def __missing__(self, piece: str) -> bytes:
        if len(self) >= self.keep:
            self.clear()
        found = self[piece] = self.whole(" " + piece)
        return found

    def whole(self, text: str) -> bytes:
        return np.array(self.encode(text), self.kind).tobytes()

    def packed(self, text: str) -> bytes:
        if SPACED.search(text):
            return self.whole(text)
        first, *rest = text.split(" ")
        return self.whole(first) + b"".join(map(self.__getitem__, rest))


def _tokenise(ranks, eos: int | None, kind: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(ranks.value, kind)
        end = b"" if eos is None else np.array([eos], kind).tobytes()
        width = np.dtype(kind).itemsize
        for whole in batches:
            for k in range(0, whole.num_rows, 1024):
                batch = whole.slice(k, 1024)
                ids = [encoder.packed(text or "") + end for text in batch.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), pa.array([len(x) // width for x in ids], pa.int64()), pa.array(ids, pa.binary())], names=["doc_id", "n", "ids"]
                )

    return run


def _cut(window: int, whole: bool, kind: str):
    """Windows that are whole within a task, or (``whole`` false) the pieces of
    those that continue in another."""

    def rows(found: list[tuple[int, list]]) -> pa.RecordBatch:
        for _, pieces in found:
            pieces.sort(key=lambda p: p[0])
        every = [p for _, pieces in found for p in pieces]
        n = [sum(len(p[1]) for p in pieces) for _, pieces in found]
        ints = pa.array(np.concatenate([p[1] for p in every]).astype(np.int32))
        records = pa.StructArray.from_arrays(
            [pa.array([p[2] for p in every], pa.int64()), pa.array([p[3] for p in every], pa.int64()), pa.array([p[0] for p in every], pa.int32()), pa.array([len(p[1]) for p in every], pa.int32())],
            names=["doc_id", "doc_start", "window_start", "n"],
        )
        upto = lambda counts: pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32())
        return pa.RecordBatch.from_arrays(
            [
                pa.array([w for w, _ in found], pa.int64()), pa.array([p[0][0] for _, p in found], pa.int32()), pa.array(n, pa.int32()),
                pa.ListArray.from_arrays(upto(n), ints), pa.ListArray.from_arrays(upto([len(p) for _, p in found]), records),
            ],
            names=["window_id", "offset", "n", "tokens", "docs"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_: dict[int, list] = {}  # window -> pieces (offset, ids, doc_id, doc_start)
        held: dict[int, int] = {}
        for batch in batches:
            done = []
            for doc_id, start, raw in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "start", "ids"))):
                ids, at = np.frombuffer(raw, kind), 0
                while at < len(ids):
                    w, offset = divmod(start + at, window)
                    part = ids[at : at + window - offset]
                    open_.setdefault(w, []).append((offset, part, doc_id, at))
                    held[w] = held.get(w, 0) + len(part)
                    if held[w] == window:
                        done.append((w, open_.pop(w)))
                        del held[w]
                    at += len(part)
                if whole and len(done) >= 512:
                    yield rows(done)
                    done = []
            if whole and done:
                yield rows(done)
        if not whole and open_:
            # A task may hold pieces of one window that do not touch.
            apart = []
            for w, pieces in sorted(open_.items()):
                pieces.sort(key=lambda p: p[0])
                run_ = [pieces[0]]
                for p in pieces[1:]:
                    if p[0] == run_[-1][0] + len(run_[-1][1]):
                        run_.append(p)
                    else:
                        apart.append((w, run_))
                        run_ = [p]
                apart.append((w, run_))
            yield rows(apart)

    return run


def pack(docs: DataFrame, ranks_path: str = RANKS, window: int = WINDOW, eos: int | None = EOS) -> DataFrame:
    """Cut the concatenation of all documents' tokens into windows.

    Documents follow one another in order of (doc_id, xxhash64 of the text,
    text); each ends with ``eos`` unless that is None. First pass: range-sort,
    tokenise, and sum in each partition. Ranges are cut by doc_id and hash, so
    the sample that the driver gets holds no text. (Texts are sorted, not their
    tokens: finding the ranges runs what comes before the sort a second time.) Second pass: the partitions' totals give each document
    its global offset, and offsets give windows. Windows that lie in one task
    are cut there; only the pieces of those that cross a task's edge are
    shuffled and joined.

    ``docs`` of a window are its boundary records: the document, the position
    in its tokens and in the window, and the count. The last window holds what
    remains and may be short; all others have exactly ``window`` tokens.

    Defined results: null and empty texts are documents of no token but
    ``eos``; a null doc_id comes first and stays null; repeated rows are packed
    as often as they occur; an empty table gives no window; other columns are
    ignored; special tokens' strings are ordinary text.
    """
    spark = docs.sparkSession
    known = read_ranks(ranks_path)
    kind = "<u2" if max([eos or 0, *known.values()]) < 65536 else "<u4"
    ranks = spark.sparkContext.broadcast(known)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    order = [F.col("doc_id"), F.xxhash64("text")]
    ranged = range_sorted(texts, order, "n", _tokenise(ranks, eos, kind), "doc_id bigint, n bigint, ids binary", (F.col("text"),))
    placed = starts(ranged, "n").select("doc_id", "start", "ids")
    whole = placed.mapInArrow(released(_cut(window, True, kind)), CUT)
    pieces = placed.mapInArrow(released(_cut(window, False, kind)), CUT)
    ordered = F.array_sort(F.collect_list(F.struct("offset", "n", "tokens", "docs")))
    joined = pieces.groupBy("window_id").agg(ordered.alias("p")).select(
        "window_id",
        F.aggregate("p", F.lit(0), lambda a, x: a + x["n"]).alias("n"),
        F.flatten(F.transform("p", lambda x: x["tokens"])).alias("tokens"),
        F.flatten(F.transform("p", lambda x: x["docs"])).alias("docs"),
    )
    return whole.select("window_id", "n", "tokens", "docs").unionByName(joined).withColumnRenamed("n", "n_tokens")
