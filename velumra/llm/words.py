"""Words, hashes and packed arrays for the kernels that run on executors."""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np
import xxhash

WORDS = re.compile(r"\w+")
ONE = np.uint64(1)


def unused(columns: list[str], *names: str) -> list[str]:
    """``names``, lengthened where one of ``columns`` has the name."""
    taken = {c.lower() for c in columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser over unsigned 64-bit integers."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class WordHashes(dict):
    """Word -> 64-bit hash, as bytes, which join faster than numbers; forgets
    all when full, so memory is bounded."""

    def __init__(self, keep: int = 400_000):
        super().__init__()
        self.keep = keep

    def __missing__(self, word: str) -> bytes:
        if len(self) >= self.keep:
            self.clear()
        found = self[word] = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass")).to_bytes(8, "little")
        return found

    def many(self, words: list[str]) -> np.ndarray:
        return np.frombuffer(b"".join(map(self.__getitem__, words)), "<u8")


def hashed(texts: list[str | None], known: WordHashes) -> tuple[np.ndarray, np.ndarray]:
    """The word hashes of all texts in a row, and where each text's begin."""
    parts = [known.many(WORDS.findall(t.lower())) if t else np.empty(0, np.uint64) for t in texts]
    begin = np.zeros(len(parts) + 1, np.int64)
    np.cumsum([len(p) for p in parts], out=begin[1:])
    return (np.concatenate(parts) if parts else np.empty(0, np.uint64)), begin


def shingles(h: np.ndarray, begin: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``n`` words inside each text, and each one's text;
    a text with fewer words has one run of all its words."""
    owner = np.repeat(np.arange(len(begin) - 1), np.diff(begin))
    lengths = np.diff(begin)
    total = h.copy() if n == 1 else None
    if n > 1:
        if len(h) >= n:
            total = np.zeros(len(h) - n + 1, np.uint64)
            for k in range(n):
                total = total * np.uint64(0x9E3779B97F4A7C15) + mix(h[k : len(h) - n + 1 + k])
            same = owner[: len(total)] == owner[n - 1 :]
            total, of = total[same], owner[: len(total)][same]
        else:
            total, of = np.empty(0, np.uint64), np.empty(0, np.int64)
        short = np.flatnonzero((lengths > 0) & (lengths < n))
        if len(short):
            some = []
            for t in short:
                x = np.zeros(1, np.uint64)
                for w in h[begin[t] : begin[t + 1]]:
                    x = x * np.uint64(0x9E3779B97F4A7C15) + mix(np.array([w], np.uint64))
                some.append(x + np.uint64(lengths[t]))
            total, of = np.concatenate([total, *some]), np.concatenate([of, short])
        return mix(total), of
    return mix(total), owner


def planes(x: np.ndarray) -> bytes:
    """Bytes of equal weight side by side, which compress far better."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T).tobytes()


def unplanes(raw: bytes, kind: type, n: int) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(size, n).T).reshape(-1).view(kind)


class Blocks:
    """Rows of equally long integer columns, the first of them a hash, kept
    until there are many and then written as one packed row for each bucket of
    the hash: a shuffle moves few rows, sorted and compressible."""

    SCHEMA = "bucket int, n int, payload binary"

    def __init__(self, buckets: int, kinds: list[str], rows: int = 2_000_000, press: Callable[[bytes], bytes] = bytes):
        """``press`` compresses payloads."""
        self.buckets, self.kinds, self.rows, self.press = buckets, kinds, rows, press
        self.held: list[tuple[np.ndarray, ...]] = []
        self.count = 0

    def add(self, *columns: np.ndarray):
        if len(columns[0]):
            self.held.append(columns)
            self.count += len(columns[0])
        if self.count >= self.rows:
            yield from self.flush()

    def flush(self):
        import pyarrow as pa

        if not self.count:
            return
        columns = [np.concatenate(c).astype(k, copy=False) for c, k in zip(zip(*self.held), self.kinds)]
        self.held, self.count = [], 0
        bucket = ((columns[0] >> np.uint64(32)) % np.uint64(self.buckets)).astype(np.int32)
        order = np.lexsort((columns[0], bucket))
        columns, bucket = [c[order] for c in columns], bucket[order]
        edges = np.flatnonzero(np.diff(bucket, prepend=-1))
        ends = np.append(edges[1:], len(bucket))
        payload = []
        for a, b in zip(edges, ends):
            key = columns[0][a:b]
            gaps = np.diff(key, prepend=key.dtype.type(0))
            payload.append(self.press(b"".join([planes(gaps), *(planes(np.ascontiguousarray(c[a:b])) for c in columns[1:])])))
        yield pa.RecordBatch.from_arrays(
            [pa.array(bucket[edges]), pa.array((ends - edges).astype(np.int32)), pa.array(payload, pa.binary())], names=["bucket", "n", "payload"]
        )


def opened(n: int, raw: bytes, kinds: list[str]) -> list[np.ndarray]:
    """The columns of one block, in order of the first."""
    at, out = 0, []
    for j, kind in enumerate(kinds):
        size = n * np.dtype(kind).itemsize
        column = unplanes(raw[at : at + size], kind, n)
        out.append(np.cumsum(column, dtype=kind) if j == 0 else column)
        at += size
    return out


def unblock(table, kinds: list[str]) -> list[np.ndarray]:
    """The columns of all blocks of a bucket, in no order."""
    parts = [opened(n, raw, kinds) for n, raw in zip(table.column("n").to_pylist(), table.column("payload").to_pylist())]
    return [np.concatenate(c) for c in zip(*parts)] if parts else [np.empty(0, k) for k in kinds]
