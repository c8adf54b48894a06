"""Lossless WebP as a media column: a decoder for executors, and an encoder
that makes streams with every tool of the format to test it on."""

from __future__ import annotations

import heapq
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

LENGTH_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
LENGTHS, DISTANCES = 24, 40
HASH = 0x1E35A7BD
BLACK = 0xFF000000
#: An image that says that it is larger is refused before any pixel is read: a few bytes can stand for 2**28.
MAX_PIXELS = 1 << 24
PREDICTOR, CROSS, GREEN, PALETTE = range(4)


def _plane() -> list[tuple[int, int]]:
    """The 120 nearest places above and left, as the format lists them."""
    rows = (
        "0,1 1,0 1,1 -1,1 0,2 2,0 1,2 -1,2 2,1 -2,1 2,2 -2,2 0,3 3,0 1,3 -1,3 3,1 -3,1 2,3 -2,3 3,2 -3,2 0,4 4,0 1,4 -1,4 4,1 -4,1 3,3 -3,3 "
        "2,4 -2,4 4,2 -4,2 0,5 3,4 -3,4 4,3 -4,3 5,0 1,5 -1,5 5,1 -5,1 2,5 -2,5 5,2 -5,2 4,4 -4,4 3,5 -3,5 5,3 -5,3 0,6 6,0 1,6 -1,6 6,1 -6,1 "
        "2,6 -2,6 6,2 -6,2 4,5 -4,5 5,4 -5,4 3,6 -3,6 6,3 -6,3 0,7 7,0 1,7 -1,7 5,5 -5,5 7,1 -7,1 4,6 -4,6 6,4 -6,4 2,7 -2,7 7,2 -7,2 3,7 -3,7 "
        "7,3 -7,3 5,6 -5,6 6,5 -6,5 8,0 4,7 -4,7 7,4 -7,4 8,1 8,2 6,6 -6,6 8,3 5,7 -5,7 7,5 -7,5 8,4 6,7 -6,7 7,6 -7,6 8,5 7,7 -7,7 8,6 8,7"
    )
    return [tuple(map(int, p.split(","))) for p in rows.split()]


PLANE = _plane()


class Broken(ValueError):
    """The bytes are no lossless WebP image."""


# ---------------------------------------------------------------- reading


class Bits:
    """Reads a stream least bit first."""

    def __init__(self, raw: bytes):
        self.raw, self.at, self.held, self.n = raw, 0, 0, 0

    def fill(self) -> None:
        more = self.raw[self.at : self.at + 8]
        self.held |= int.from_bytes(more, "little") << self.n
        self.at += len(more)
        self.n += 8 * len(more)

    def read(self, n: int) -> int:
        if self.n < n:
            self.fill()
            if self.n < n:
                raise Broken("the stream ends early")
        found = self.held & ((1 << n) - 1)
        self.held >>= n
        self.n -= n
        return found

    def symbol(self, code: tuple[list[int], int]) -> int:
        """``code``: symbol * 16 + length for each run of its longest length's bits."""
        found, bits = code
        if self.n < bits:
            self.fill()
        s = found[self.held & ((1 << bits) - 1)]
        n = s & 15
        if n > self.n:
            raise Broken("the stream ends early")
        self.held >>= n
        self.n -= n
        return s >> 4


def _codes(lengths: list[int]) -> list[tuple[int, int, int]]:
    """(symbol, length, code with its first bit lowest) of a canonical code."""
    out, code, last = [], 0, 0
    for n, s in sorted((n, s) for s, n in enumerate(lengths) if n):
        code <<= n - last
        out.append((s, n, int(f"{code:0{n}b}"[::-1], 2)))
        code, last = code + 1, n
    return out


def _table(lengths: list[int]) -> tuple[list[int], int]:
    used = [s for s, n in enumerate(lengths) if n]
    if len(used) == 1:  # takes no bits
        return [used[0] * 16], 0
    if not used or sum(2 ** (15 - n) for n in lengths if n) != 2**15:
        raise Broken("a prefix code is not complete")
    bits = max(lengths)
    out = [0] * (1 << bits)
    for s, n, code in _codes(lengths):
        out[code :: 1 << n] = [s * 16 + n] * (1 << (bits - n))
    return out, bits


def _read_code(bits: Bits, size: int) -> tuple[list[int], int]:
    lengths = [0] * size
    if bits.read(1):
        two, wide = bits.read(1), bits.read(1)
        some = [bits.read(8 if wide else 1)] + ([bits.read(8)] if two else [])
        for s in some:
            if s >= size:
                raise Broken("a symbol is outside its alphabet")
            lengths[s] = 1
        return _table(lengths)
    first = [0] * 19
    for k in range(4 + bits.read(4)):
        first[LENGTH_ORDER[k]] = bits.read(3)
    code, most = _table(first), size
    if bits.read(1):
        most = 2 + bits.read(2 + 2 * bits.read(3))
        if most > size:
            raise Broken("more code lengths than symbols")
    at, last = 0, 8
    while at < size and most > 0:
        most -= 1
        s = bits.symbol(code)
        if s < 16:
            lengths[at] = s
            at += 1
            last = s or last
        else:
            times = 3 + bits.read(2) if s == 16 else 3 + bits.read(3) if s == 17 else 11 + bits.read(7)
            if at + times > size:
                raise Broken("code lengths run over")
            if s == 16:
                lengths[at : at + times] = [last] * times
            at += times
    return _table(lengths)


def _value(bits: Bits, code: int) -> int:
    if code < 4:
        return code + 1
    extra = (code - 2) >> 1
    return ((2 + (code & 1)) << extra) + bits.read(extra) + 1


def _ceil(n: int, bits: int) -> int:
    return (n + (1 << bits) - 1) >> bits


def _read_pixels(bits: Bits, width: int, height: int, main: bool) -> array:
    """Prefix codes, back-references and colour cache."""
    cache_bits = bits.read(4) if bits.read(1) else 0
    if cache_bits > 11:
        raise Broken("the colour cache is too large")
    cache, shift = [0] * (1 << cache_bits), 32 - cache_bits
    group, tile, groups = None, 0, 1
    if main and bits.read(1):
        tile = bits.read(3) + 2
        across = _ceil(width, tile)
        group = [(p >> 8) & 0xFFFF for p in _read_pixels(bits, across, _ceil(height, tile), False)]
        groups = max(group) + 1
    green = 256 + LENGTHS + (len(cache) if cache_bits else 0)
    codes = [[_read_code(bits, n) for n in (green, 256, 256, 256, DISTANCES)] for _ in range(groups)]
    total, own, symbol, at = width * height, codes[0], bits.symbol, 0
    out = array("I", bytes(4 * total))
    while at < total:
        if group:
            own = codes[group[(at // width >> tile) * across + (at % width >> tile)]]
        s = symbol(own[0])
        if s < 256:
            red = symbol(own[1])
            blue = symbol(own[2])
            out[at] = (symbol(own[3]) << 24) | (red << 16) | (s << 8) | blue
            n = 1
        elif s < 256 + LENGTHS:
            n = _value(bits, s - 256)
            d = _value(bits, symbol(own[4]))
            if d > 120:
                d -= 120
            else:
                x, y = PLANE[d - 1]
                d = max(1, x + y * width)
            if d > at or at + n > total:
                raise Broken("a back-reference leaves the image")
            out[at : at + n] = (out[at - d : at] * (n // d + 1))[:n] if d < n else out[at - d : at - d + n]
        else:
            out[at] = cache[s - 256 - LENGTHS]
            n = 1
        if cache_bits:
            if n == 1:
                cache[(HASH * out[at] & 0xFFFFFFFF) >> shift] = out[at]
            else:
                for p in out[at : at + n]:
                    cache[(HASH * p & 0xFFFFFFFF) >> shift] = p
        at += n
    return out


def _halves(a: int, b: int) -> int:
    """Channel by channel mean, rounded down."""
    return (((a ^ b) & 0xFEFEFEFE) >> 1) + (a & b)


def _sum(a: int, b: int) -> int:
    """Channel by channel sum, each modulo 256."""
    return ((a & 0xFF00FF00) + (b & 0xFF00FF00) & 0xFF00FF00) | ((a & 0x00FF00FF) + (b & 0x00FF00FF) & 0x00FF00FF)


def _split(p: int) -> tuple[int, int, int, int]:
    return p >> 24, (p >> 16) & 255, (p >> 8) & 255, p & 255


def _join(channels) -> int:
    a, r, g, b = (min(255, max(0, c)) for c in channels)
    return (a << 24) | (r << 16) | (g << 8) | b


def predicted(mode: int, l: int, t: int, tr: int, tl: int) -> int:
    if mode == 1:
        return l
    if mode == 2:
        return t
    if mode == 3:
        return tr
    if mode == 4:
        return tl
    if mode == 5:
        return _halves(_halves(l, tr), t)
    if mode == 6:
        return _halves(l, tl)
    if mode == 7:
        return _halves(l, t)
    if mode == 8:
        return _halves(tl, t)
    if mode == 9:
        return _halves(t, tr)
    if mode == 10:
        return _halves(_halves(l, tl), _halves(t, tr))
    if mode == 11:
        far = [(abs(c - e), abs(b - e)) for b, c, e in zip(_split(l), _split(t), _split(tl))]
        return l if sum(f[0] for f in far) < sum(f[1] for f in far) else t
    if mode == 12:
        return _join(b + c - e for b, c, e in zip(_split(l), _split(t), _split(tl)))
    if mode == 13:
        return _join(b + int((b - e) / 2) for b, e in zip(_split(_halves(l, t)), _split(tl)))
    return BLACK


def _unpredict(p: array, width: int, size: int, modes: array) -> array:
    across = _ceil(width, size)
    for at in range(len(p)):
        y, x = divmod(at, width)
        if y == 0:
            guess = p[at - 1] if x else BLACK
        elif x == 0:
            guess = p[at - width]
        else:
            mode = (modes[(y >> size) * across + (x >> size)] >> 8) & 15
            guess = predicted(mode, p[at - 1], p[at - width], p[at - width + 1], p[at - width - 1])
        p[at] = _sum(p[at], guess)
    return p


def _signed(x: np.ndarray) -> np.ndarray:
    return (x.astype(np.int64) & 255 ^ 128) - 128


def _packed(x: np.ndarray) -> array:
    return array("I", x.astype(np.uint32).tobytes())


def _uncross(p: array, width: int, size: int, elements: array) -> array:
    x = np.array(p, np.int64)
    at, across = np.arange(len(x)), _ceil(width, size)
    e = np.array(elements, np.int64)[(at // width >> size) * across + (at % width >> size)]
    green = _signed(x >> 8)
    red = ((x >> 16) + (_signed(e) * green >> 5)) & 255
    blue = (x + (_signed(e >> 8) * green >> 5) + (_signed(e >> 16) * _signed(red) >> 5)) & 255
    return _packed((x & 0xFF00FF00) | (red << 16) | blue)


def _ungreen(p: array) -> array:
    x = np.array(p, np.int64)
    green = (x >> 8) & 255
    return _packed((x & 0xFF00FF00) | (((x >> 16) + green & 255) << 16) | (x + green & 255))


def _unindex(p: array, width: int, height: int, pack: int, table: array) -> array:
    x = np.array(p, np.int64).reshape(height, -1)
    each = 8 >> pack
    column = np.arange(width)
    index = (x[:, column >> pack] >> 8 & 255) >> (each * (column & ((1 << pack) - 1))) & ((1 << each) - 1)
    full = np.zeros(256, np.int64)
    full[: len(table)] = table
    return _packed(full[index].reshape(-1))


def decode(raw: bytes, max_pixels: int = MAX_PIXELS) -> tuple[int, int, array]:
    """Width, height and pixels, row by row, each 0xAARRGGBB. An image of over
    ``max_pixels`` is ``Broken``."""
    if len(raw) < 12 or raw[:4] != b"RIFF" or raw[8:12] != b"WEBP":
        raise Broken("no WebP container")
    at, found = 12, None
    while at + 8 <= len(raw) and found is None:
        size = int.from_bytes(raw[at + 4 : at + 8], "little")
        if raw[at : at + 4] == b"VP8L":
            found = raw[at + 8 : at + 8 + size]
        at += 8 + size + (size & 1)
    if found is None or found[:1] != b"\x2f":
        raise Broken("no lossless image")
    bits = Bits(found[1:])
    width, height = bits.read(14) + 1, bits.read(14) + 1
    if width * height > max_pixels:
        raise Broken(f"{width} x {height} pixels are over the limit of {max_pixels}")
    bits.read(1)
    if bits.read(3):
        raise Broken("an unknown version")
    across, undo = width, []
    while bits.read(1):
        kind = bits.read(2)
        if any(k == kind for k, *_ in undo):
            raise Broken("a transform comes twice")
        if kind in (PREDICTOR, CROSS):
            size = bits.read(3) + 2
            undo.append((kind, across, size, _read_pixels(bits, _ceil(across, size), _ceil(height, size), False)))
        elif kind == PALETTE:
            count = bits.read(8) + 1
            table = _read_pixels(bits, count, 1, False)
            for k in range(1, count):
                table[k] = _sum(table[k], table[k - 1])
            pack = 3 if count <= 2 else 2 if count <= 4 else 1 if count <= 16 else 0
            undo.append((kind, across, pack, table))
            across = _ceil(across, pack)
        else:
            undo.append((kind, across, 0, []))
    p = _read_pixels(bits, across, height, True)
    for kind, wide, size, more in reversed(undo):
        if kind == PREDICTOR:
            p = _unpredict(p, wide, size, more)
        elif kind == CROSS:
            p = _uncross(p, wide, size, more)
        elif kind == GREEN:
            p = _ungreen(p)
        else:
            p = _unindex(p, wide, height, size, more)
    return width, height, p


# ---------------------------------------------------------------- writing


class Sink:
    def __init__(self):
        self.held, self.n, self.out = 0, 0, bytearray()

    def write(self, value: int, n: int) -> None:
        self.held |= value << self.n
        self.n += n
        while self.n >= 8:
            self.out.append(self.held & 255)
            self.held >>= 8
            self.n -= 8

    def bytes(self) -> bytes:
        return bytes(self.out) + (bytes([self.held & 255]) if self.n else b"")


def _lengths(counts: list[int], most: int) -> list[int]:
    """Lengths of a prefix code by Huffman's method, none over ``most``."""
    counts = list(counts)
    while True:
        heap = [(c, s, (s,)) for s, c in enumerate(counts) if c]
        lengths = [0] * len(counts)
        if len(heap) == 1:
            lengths[heap[0][1]] = 1
            return lengths
        heapq.heapify(heap)
        while len(heap) > 1:
            a, b = heapq.heappop(heap), heapq.heappop(heap)
            for s in a[2] + b[2]:
                lengths[s] += 1
            heapq.heappush(heap, (a[0] + b[0], min(a[1], b[1]), a[2] + b[2]))
        if max(lengths, default=0) <= most:
            return lengths
        counts = [(c + 1) // 2 for c in counts]


def _write_code(sink: Sink, counts: list[int]) -> dict[int, tuple[int, int]]:
    """Write a code and return symbol -> (bits, their number)."""
    used = [s for s, c in enumerate(counts) if c] or [0]
    if len(used) <= 2 and max(used) < 256:
        sink.write(1, 1)
        sink.write(len(used) - 1, 1)
        sink.write(int(used[0] > 1), 1)
        sink.write(used[0], 8 if used[0] > 1 else 1)
        if len(used) == 2:
            sink.write(used[1], 8)
        return {used[0]: (0, 0)} if len(used) == 1 else {used[0]: (0, 1), used[1]: (1, 1)}
    if len(used) == 1:
        counts = list(counts)
        counts[0 if used[0] else 1] += 1
    lengths = _lengths(counts, 15)
    runs, at = [], 0
    while at < len(lengths):
        n, end = lengths[at], at
        while end < len(lengths) and lengths[end] == n:
            end += 1
        if n == 0:
            while end - at >= 3:
                k = min(138, end - at)
                runs.append((17, k - 3, 3) if k <= 10 else (18, k - 11, 7))
                at += k
        else:
            runs.append((n, 0, 0))
            at += 1
            while end - at >= 3:
                k = min(6, end - at)
                runs.append((16, k - 3, 2))
                at += k
        runs += [(n, 0, 0)] * (end - at)
        at = end
    tally = [0] * 19
    for s, _, _ in runs:
        tally[s] += 1
    if sum(map(bool, tally)) == 1:
        tally[0 if not tally[0] else 1] += 1
    first = _lengths(tally, 7)
    keep = max(k for k in range(19) if first[LENGTH_ORDER[k]]) + 1
    sink.write(0, 1)
    sink.write(max(4, keep) - 4, 4)
    for k in range(max(4, keep)):
        sink.write(first[LENGTH_ORDER[k]], 3)
    sink.write(0, 1)
    code = {s: (c, n) for s, n, c in _codes(first)}
    for s, extra, n in runs:
        sink.write(*code[s])
        sink.write(extra, n)
    return {s: (c, n) for s, n, c in _codes(lengths)}


def _prefix(value: int) -> tuple[int, int, int]:
    """Code, extra value and extra bits of a length or distance."""
    if value <= 4:
        return value - 1, 0, 0
    v = value - 1
    high = v.bit_length() - 1
    second = v >> (high - 1) & 1
    return 2 * high + second, v - ((2 + second) << (high - 1)), high - 1


def _tokens(p: list[int], width: int, references: bool, cache_bits: int) -> list[tuple]:
    """("pixel", p), ("cache", k) and ("copy", length, distance), with places."""
    out, at, seen, cache = [], 0, {}, [None] * (1 << cache_bits)
    slot = lambda q: (HASH * q & 0xFFFFFFFF) >> (32 - cache_bits)
    while at < len(p):
        best, n = seen.get(tuple(p[at : at + 3])) if references else None, 0
        if best is not None:
            while at + n < len(p) and p[best + n] == p[at + n] and n < 4096:
                n += 1
        if n >= 3:
            out.append((at, "copy", n, at - best))
        else:
            n = 1
            if cache_bits and cache[slot(p[at])] == p[at]:
                out.append((at, "cache", slot(p[at]), 0))
            else:
                out.append((at, "pixel", p[at], 0))
        for k in range(at, at + n):
            if cache_bits:
                cache[slot(p[k])] = p[k]
            seen[tuple(p[k : k + 3])] = k
        at += n
    return out


def _write_pixels(sink: Sink, p: list[int], width: int, main: bool, references: bool = False, cache_bits: int = 0, tile: int = 0) -> None:
    sink.write(1, 1) if cache_bits else sink.write(0, 1)
    if cache_bits:
        sink.write(cache_bits, 4)
    group, groups, across = [0], 1, 1
    if main:
        sink.write(int(tile > 0), 1)
    if tile:
        across, height = _ceil(width, tile), _ceil(len(p) // width, tile)
        group = [k % 3 for k in range(across * height)]
        groups = max(group) + 1
        sink.write(tile - 2, 3)
        _write_pixels(sink, [g << 8 for g in group], across, False)
    green = 256 + LENGTHS + ((1 << cache_bits) if cache_bits else 0)
    counts = [[[0] * n for n in (green, 256, 256, 256, DISTANCES)] for _ in range(groups)]
    near = {max(1, x + y * width): k + 1 for k, (x, y) in reversed(list(enumerate(PLANE)))}
    todo = []
    for at, kind, a, b in _tokens(p, width, references, cache_bits):
        g = group[(at // width >> tile) * across + (at % width >> tile)] if tile else 0
        if kind == "pixel":
            parts = [(0, a >> 8 & 255, 0, 0), (1, a >> 16 & 255, 0, 0), (2, a & 255, 0, 0), (3, a >> 24, 0, 0)]
        elif kind == "cache":
            parts = [(0, 256 + LENGTHS + a, 0, 0)]
        else:
            (s, e, n), (ds, de, dn) = _prefix(a), _prefix(near.get(b, b + 120))
            parts = [(0, 256 + s, e, n), (4, ds, de, dn)]
        for c, s, _, _ in parts:
            counts[g][c][s] += 1
        todo.append((g, parts))
    codes = [[_write_code(sink, c) for c in five] for five in counts]
    for g, parts in todo:
        for c, s, e, n in parts:
            sink.write(*codes[g][c][s])
            sink.write(e, n)


def _less(a: int, b: int) -> int:
    return _join(((x - y) & 255) for x, y in zip(_split(a), _split(b)))


def encode(width: int, height: int, p: list[int], transforms: tuple[int, ...] = (), references: bool = False, cache_bits: int = 0, tile: int = 0, size: int = 2) -> bytes:
    """A stream that uses the named tools; the pixels come back exactly."""
    sink, p, across = Sink(), list(p), width
    sink.write(width - 1, 14)
    sink.write(height - 1, 14)
    sink.write(int(any(q >> 24 != 255 for q in p)), 1)
    sink.write(0, 3)
    for kind in transforms:
        wide, tall = _ceil(across, size), _ceil(height, size)
        if kind == PALETTE:
            table = sorted(set(p))
            if len(table) > 256:
                continue
        sink.write(1, 1)
        sink.write(kind, 2)
        if kind == GREEN:
            p = [(q & 0xFF00FF00) | (((q >> 16) - (q >> 8) & 255) << 16) | (q - (q >> 8) & 255) for q in p]
        elif kind == PALETTE:
            sink.write(len(table) - 1, 8)
            _write_pixels(sink, [table[0]] + [_less(b, a) for a, b in zip(table, table[1:])], len(table), False)
            pack = 3 if len(table) <= 2 else 2 if len(table) <= 4 else 1 if len(table) <= 16 else 0
            place, each, new = {q: k for k, q in enumerate(table)}, 8 >> pack, _ceil(across, pack)
            packed = [0xFF000000] * (new * height)
            for at, q in enumerate(p):
                y, x = divmod(at, across)
                packed[y * new + (x >> pack)] |= place[q] << (8 + each * (x & ((1 << pack) - 1)))
            p, across = packed, new
        elif kind == PREDICTOR:
            modes = [BLACK | ((k % 14) << 8) for k in range(wide * tall)]
            sink.write(size - 2, 3)
            _write_pixels(sink, modes, wide, False)
            rest = []
            for at, q in enumerate(p):
                y, x = divmod(at, across)
                if y == 0:
                    guess = p[at - 1] if x else BLACK
                elif x == 0:
                    guess = p[at - across]
                else:
                    guess = predicted((modes[(y >> size) * wide + (x >> size)] >> 8) & 15, p[at - 1], p[at - across], p[at - across + 1], p[at - across - 1])
                rest.append(_less(q, guess))
            p = rest
        else:
            elements = [BLACK | ((37 * k + 11 & 255) << 16) | ((91 * k + 200 & 255) << 8) | (53 * k + 7 & 255) for k in range(wide * tall)]
            sink.write(size - 2, 3)
            _write_pixels(sink, elements, wide, False)
            x, at = np.array(p, np.int64), np.arange(len(p))
            e = np.array(elements, np.int64)[(at // across >> size) * wide + (at % across >> size)]
            green, red = _signed(x >> 8), _signed(x >> 16)
            new_red = ((x >> 16) - (_signed(e) * green >> 5)) & 255
            blue = (x - (_signed(e >> 8) * green >> 5) - (_signed(e >> 16) * red >> 5)) & 255
            p = ((x & 0xFF00FF00) | (new_red << 16) | blue).tolist()
    sink.write(0, 1)
    _write_pixels(sink, p, across, True, references, cache_bits, tile)
    raw = b"\x2f" + sink.bytes()
    chunk = b"VP8L" + len(raw).to_bytes(4, "little") + raw + b"\0" * (len(raw) & 1)
    return b"RIFF" + (4 + len(chunk)).to_bytes(4, "little") + b"WEBP" + chunk


# ---------------------------------------------------------------- columns

#: The ways in which ``tiles`` writes, in turn by vec_id.
WAYS: list[dict] = [
    {}, {"transforms": (GREEN,)}, {"transforms": (PREDICTOR,), "cache_bits": 4}, {"transforms": (CROSS, GREEN)}, {"transforms": (PALETTE,)},
    {"references": True}, {"references": True, "cache_bits": 6, "tile": 2}, {"transforms": (PREDICTOR, CROSS, GREEN), "references": True, "cache_bits": 3},
    {"transforms": (PALETTE, PREDICTOR), "references": True}, {"transforms": (GREEN, PREDICTOR), "tile": 2},
]


def tile_pixels(embedding: Column) -> Column:
    """An embedding as pixels: each value is a level, of which each channel shows something else."""
    level = lambda v: F.least(F.greatest(F.floor((v.cast("double") + 1.0) * 127.5 + 0.5), F.lit(0)), F.lit(255))
    pixel = lambda v: F.lit(255 * 2**24) + (level(v) * 7 % 256) * 2**16 + level(v) * 256 + (255 - level(v))
    return F.transform(embedding, lambda v: F.when(v.isNotNull(), pixel(v)))


def _written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        images = []
        for vec_id, p in zip(batch.column("vec_id").to_pylist(), batch.column("pixels").to_pylist()):
            wide = next((w for w in (8, 4, 2, 1) if len(p) % w == 0), 1) if p else 0
            images.append(encode(wide, len(p) // wide, p, **WAYS[(vec_id or 0) % len(WAYS)]) if p and None not in p else None)
        yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(images, pa.binary())], names=["vec_id", "image"])


def tiles(embeddings: DataFrame) -> DataFrame:
    """(vec_id, image): each embedding as a WebP image, 8 pixels wide where
    that goes. Defined results: a null or empty vector, or one that holds a
    null, has a null image; a null vec_id stays null; repeated rows repeat
    their image; an empty table gives none; other columns are ignored."""
    named = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), tile_pixels(F.col("embedding")).alias("pixels"))
    return named.mapInArrow(_written, "vec_id bigint, image binary")


def _read(column: str, max_pixels: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(0, whole.num_rows, 256):
                batch = whole.slice(k, 256)
                wide, high, pixels, errors = [], [], [], []
                for raw in batch.column(column).to_pylist():
                    found, why = (None, None, None), None
                    if raw is not None:
                        try:
                            found = decode(raw, max_pixels)
                        except Broken as e:
                            why = str(e)
                    for values, value in zip((wide, high, pixels, errors), (*found, why)):
                        values.append(value)
                some = [p for p in pixels if p is not None]
                flat = np.concatenate([np.frombuffer(p, np.uint32) for p in some]).astype(np.int64) if some else np.empty(0, np.int64)
                ends = np.concatenate([[0], np.cumsum([len(p or ()) for p in pixels])]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(flat), mask=pa.array([p is None for p in pixels]))
                rest = batch.select([c for c in batch.schema.names if c != column])
                for name, values in (("width", pa.array(wide, pa.int32())), ("height", pa.array(high, pa.int32())), ("pixels", lists), ("error", pa.array(errors, pa.string()))):
                    rest = rest.append_column(name, values)
                yield rest

    return run


def decoded(images: DataFrame, column: str = "image", max_pixels: int = MAX_PIXELS) -> DataFrame:
    """``images`` with ``column`` replaced by width, height, pixels (row by
    row, each 0xAARRGGBB) and error.

    Defined results: a null image gives nulls; bytes that are no lossless WebP,
    a stream that is broken or cut, or an image of over ``max_pixels`` give a
    null image and the reason in ``error``; repeated rows stay; an empty table stays empty. A column of
    ``images`` that is named like a new one is replaced by it."""
    new = ("width", "height", "pixels", "error")
    kept = images.select(*[c for c in images.columns if c not in new or c == column])
    kinds = [T.IntegerType(), T.IntegerType(), T.ArrayType(T.LongType()), T.StringType()]
    schema = T.StructType([f for f in kept.schema.fields if f.name != column] + [T.StructField(n, k) for n, k in zip(new, kinds)])
    return kept.mapInArrow(_read(column, max_pixels), schema)


SQL = """
SELECT vec_id, 8::INTEGER AS width, (len(embedding) // 8)::INTEGER AS height, CAST(NULL AS VARCHAR) AS error,
  list_transform(embedding, lambda v: (255 * 16777216::BIGINT
    + (least(greatest(floor((v::DOUBLE + 1.0) * 127.5 + 0.5), 0), 255)::BIGINT * 7 % 256) * 65536
    + least(greatest(floor((v::DOUBLE + 1.0) * 127.5 + 0.5), 0), 255)::BIGINT * 256
    + (255 - least(greatest(floor((v::DOUBLE + 1.0) * 127.5 + 0.5), 0), 255)::BIGINT))) AS pixels
FROM embeddings
"""
