"""Lossless WebP: a media column of encoded images becomes arrays of ARGB pixels.

The decoder reads prefix codes, back-references and the colour cache, with as many groups
of codes as the image has, and inverts the predictor, cross-colour, subtract-green and
palette transforms. ``encode`` writes the same format, every feature of it, for tables that
hold no media and for tests.
"""

from __future__ import annotations

import heapq
import struct
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh, map_arrow, name

OPAQUE = 0xFF000000
#: Images of more pixels than this aren't decoded unless the caller allows it: a file of a few
#: bytes can claim the format's 2**28.
MOST_PIXELS = 1 << 24
#: So many pixels at most go back to Spark in one batch, unless one image has more.
BATCH_PIXELS = 1 << 20
_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
_HASH = 0x1E35A7BD
#: Offsets (left, up) of the first 120 distance codes.
_NEAR = [tuple(map(int, p.split(","))) for p in (
    "0,1 1,0 1,1 -1,1 0,2 2,0 1,2 -1,2 2,1 -2,1 2,2 -2,2 0,3 3,0 1,3 -1,3 3,1 -3,1 2,3 -2,3 3,2 -3,2 0,4 4,0 1,4 -1,4 4,1 -4,1 3,3 -3,3 "
    "2,4 -2,4 4,2 -4,2 0,5 3,4 -3,4 4,3 -4,3 5,0 1,5 -1,5 5,1 -5,1 2,5 -2,5 5,2 -5,2 4,4 -4,4 3,5 -3,5 5,3 -5,3 0,6 6,0 1,6 -1,6 6,1 -6,1 "
    "2,6 -2,6 6,2 -6,2 4,5 -4,5 5,4 -5,4 3,6 -3,6 6,3 -6,3 0,7 7,0 1,7 -1,7 5,5 -5,5 7,1 -7,1 4,6 -4,6 6,4 -6,4 2,7 -2,7 7,2 -7,2 3,7 -3,7 "
    "7,3 -7,3 5,6 -5,6 6,5 -6,5 8,0 4,7 -4,7 7,4 -7,4 8,1 8,2 6,6 -6,6 8,3 5,7 -5,7 7,5 -7,5 8,4 6,7 -6,7 7,6 -7,6 8,5 7,7 -7,7 8,6 8,7"
).split()]


class BadImage(ValueError):
    """The bytes are no lossless WebP image that can be decoded."""


class _Bits:
    """Bits of a byte string, least significant first."""

    def __init__(self, data: bytes):
        self.data, self.at, self.end = data + bytes(8), 0, len(data) * 8

    def read(self, n: int) -> int:
        at = self.at
        self.at = at + n
        if self.at > self.end:
            raise BadImage("the data end early")
        return (int.from_bytes(self.data[at >> 3 : (at >> 3) + 5], "little") >> (at & 7)) & ((1 << n) - 1)


class _Code:
    """A prefix code as one table, indexed by as many bits as its longest word has."""

    __slots__ = ("bits", "table")

    def __init__(self, lengths: list[int]):
        used = [(n, s) for s, n in enumerate(lengths) if n]
        if not used:
            self.bits, self.table = 0, [(0, 0)]
            return
        if len(used) == 1:
            self.bits, self.table = 0, [(0, used[0][1])]
            return
        used.sort()
        self.bits = most = used[-1][0]
        self.table = table = [None] * (1 << most)
        code, last = 0, used[0][0]
        for n, s in used:
            code <<= n - last
            last = n
            if code >> n:
                raise BadImage("a prefix code is oversubscribed")
            word = int(f"{code:0{n}b}"[::-1], 2)
            table[word :: 1 << n] = [(n, s)] * (1 << (most - n))
            code += 1
        if code != 1 << last:
            raise BadImage("a prefix code is incomplete")

    def read(self, b: _Bits) -> int:
        if not self.bits:
            return self.table[0][1]
        at = b.at
        n, s = self.table[(int.from_bytes(b.data[at >> 3 : (at >> 3) + 3], "little") >> (at & 7)) & ((1 << self.bits) - 1)]
        b.at = at + n
        return s


def _read_code(b: _Bits, size: int) -> _Code:
    lengths = [0] * size
    if b.read(1):
        two = b.read(1)
        first = b.read(8 if b.read(1) else 1)
        symbols = [first, b.read(8)] if two else [first]
        for s in symbols:
            if s >= size:
                raise BadImage("a symbol is outside its alphabet")
            lengths[s] = 1
        return _Code(lengths)
    of = [0] * 19
    for k in _ORDER[: 4 + b.read(4)]:
        of[k] = b.read(3)
    code = _Code(of)
    most = 2 + b.read(2 + 2 * b.read(3)) if b.read(1) else size
    at, before = 0, 8
    while at < size and most:
        most -= 1
        n = code.read(b)
        if b.at > b.end:
            raise BadImage("the data end early")
        if n < 16:
            lengths[at] = n
            at += 1
            before = n or before
            continue
        value, again = (before, 3 + b.read(2)) if n == 16 else (0, 3 + b.read(3)) if n == 17 else (0, 11 + b.read(7))
        if at + again > size:
            raise BadImage("code lengths run past the alphabet")
        lengths[at : at + again] = [value] * again
        at += again
    return _Code(lengths)


def _span(b: _Bits, code: int) -> int:
    if code < 4:
        return code + 1
    extra = (code - 2) >> 1
    return ((2 + (code & 1)) << extra) + b.read(extra) + 1


def _read_image(b: _Bits, width: int, height: int, main: bool) -> list[int]:
    """Pixels of an entropy-coded image; the main one may have several groups of codes."""
    cache_bits = b.read(4) if b.read(1) else 0
    if cache_bits > 11:
        raise BadImage("the colour cache is too large")
    group_of, block, across, groups = None, 0, 0, 1
    if main and b.read(1):
        block = b.read(3) + 2
        across = (width + (1 << block) - 1) >> block
        group_of = [(p >> 8) & 0xFFFF for p in _read_image(b, across, (height + (1 << block) - 1) >> block, False)]
        groups = max(group_of) + 1
    cache = [0] * (1 << cache_bits) if cache_bits else []
    sizes = (280 + len(cache), 256, 256, 256, 40)
    codes = [[_read_code(b, n) for n in sizes] for _ in range(groups)]
    green, red, blue, alpha, far = codes[0]
    out: list[int] = []
    total, shift, cached = width * height, 32 - cache_bits, 0
    while len(out) < total:
        if b.at > b.end:
            raise BadImage("the data end early")
        n = len(out)
        if group_of:
            green, red, blue, alpha, far = codes[group_of[(n // width >> block) * across + (n % width >> block)]]
        s = green.read(b)
        if s < 256:
            r = red.read(b)
            u = blue.read(b)
            out.append(alpha.read(b) << 24 | r << 16 | s << 8 | u)
        elif s < 280:
            length = _span(b, s - 256)
            d = _span(b, far.read(b))
            if d > 120:
                d -= 120
            else:
                x, y = _NEAR[d - 1]
                d = max(1, x + y * width)
            if d > n or n + length > total:
                raise BadImage("a back-reference leaves the image")
            if d >= length:
                out += out[n - d : n - d + length]
            else:
                part = out[n - d :]
                out += (part * (length // d + 1))[:length]
        else:
            if not cache or s - 280 >= len(cache):
                raise BadImage("a symbol is outside its alphabet")
            for p in out[cached:]:
                cache[(_HASH * p & 0xFFFFFFFF) >> shift] = p
            cached = len(out)
            out.append(cache[s - 280])
    return out


def _half(a: int, b: int) -> int:
    return (((a ^ b) & 0xFEFEFEFE) >> 1) + (a & b)


def _parts(p: int) -> tuple[int, int, int, int]:
    return p >> 24, (p >> 16) & 255, (p >> 8) & 255, p & 255


def _clamp(x: int) -> int:
    return 0 if x < 0 else 255 if x > 255 else x


def _whole(a: int, r: int, g: int, b: int) -> int:
    return a << 24 | r << 16 | g << 8 | b


def _select(left: int, top: int, corner: int) -> int:
    a, b = 0, 0
    for x, y, z in zip(_parts(left), _parts(top), _parts(corner)):
        a += abs(y - z)
        b += abs(x - z)
    return left if a < b else top


def _full(left: int, top: int, corner: int) -> int:
    return _whole(*[_clamp(x + y - z) for x, y, z in zip(_parts(left), _parts(top), _parts(corner))])


def _halved(left: int, top: int, corner: int) -> int:
    return _whole(*[_clamp(x + int((x - z) / 2)) for x, z in zip(_parts(_half(left, top)), _parts(corner))])


#: What each mode predicts from left, top, top right and top left.
_MODES = (
    lambda l, t, r, c: OPAQUE,
    lambda l, t, r, c: l,
    lambda l, t, r, c: t,
    lambda l, t, r, c: r,
    lambda l, t, r, c: c,
    lambda l, t, r, c: _half(_half(l, r), t),
    lambda l, t, r, c: _half(l, c),
    lambda l, t, r, c: _half(l, t),
    lambda l, t, r, c: _half(c, t),
    lambda l, t, r, c: _half(t, r),
    lambda l, t, r, c: _half(_half(l, c), _half(t, r)),
    lambda l, t, r, c: _select(l, t, c),
    lambda l, t, r, c: _full(l, t, c),
    lambda l, t, r, c: _halved(l, t, c),
    lambda l, t, r, c: OPAQUE,
    lambda l, t, r, c: OPAQUE,
)


def _add(a: int, b: int) -> int:
    return ((a & 0xFF00FF00) + (b & 0xFF00FF00) & 0xFF00FF00) | ((a & 0x00FF00FF) + (b & 0x00FF00FF) & 0x00FF00FF)


def _less(a: int, b: int) -> int:
    return ((a | 0x00FF00FF) - (b & 0xFF00FF00) & 0xFF00FF00) | ((a | 0xFF00FF00) - (b & 0x00FF00FF) & 0x00FF00FF)


def _predict(p: list[int], i: int, x: int, width: int, modes: list[int], row: int, bits: int) -> int:
    """The prediction of pixel ``i`` from the pixels before it."""
    if i < width:
        return p[i - 1] if i else OPAQUE
    if not x:
        return p[i - width]
    return _MODES[(modes[row + (x >> bits)] >> 8) & 15](p[i - 1], p[i - width], p[i - width + 1], p[i - width - 1])


def _undo_predictor(p: list[int], width: int, height: int, bits: int, modes: list[int]) -> list[int]:
    across, i = (width + (1 << bits) - 1) >> bits, 0
    for y in range(height):
        row = (y >> bits) * across
        for x in range(width):
            p[i] = _add(p[i], _predict(p, i, x, width, modes, row, bits))
            i += 1
    return p


def _signed(x):
    return x - ((x & 128) << 1)


def _cross(p: list[int], width: int, height: int, bits: int, factors: list[int], sign: int) -> list[int]:
    """Add (1) or take away (-1) what green and red predict of red and blue."""
    a = np.array(p, np.int64).reshape(height, width)
    f = np.array(factors, np.int64).reshape(-1, (width + (1 << bits) - 1) >> bits)
    f = f.repeat(1 << bits, 0)[:height].repeat(1 << bits, 1)[:, :width]
    red, green, blue = (a >> 16) & 255, (a >> 8) & 255, a & 255
    g = _signed(green)
    new = (red + sign * (_signed(f & 255) * g >> 5)) & 255
    whole = _signed(new if sign > 0 else red)
    blue = (blue + sign * ((_signed((f >> 8) & 255) * g >> 5) + (_signed((f >> 16) & 255) * whole >> 5))) & 255
    return ((a & 0xFF00FF00) | new << 16 | blue).ravel().tolist()


def _green(p: list[int], sign: int) -> list[int]:
    a = np.array(p, np.int64)
    g = (a >> 8) & 255
    return ((a & 0xFF00FF00) | (((a >> 16) + sign * g) & 255) << 16 | ((a + sign * g) & 255)).tolist()


def _undo_palette(p: list[int], width: int, height: int, bits: int, palette: list[int]) -> list[int]:
    packed = np.array(p, np.int64).reshape(height, -1)
    x = np.arange(width)
    depth = 8 >> bits
    at = (packed[:, x >> bits] >> 8 & 255) >> ((x & ((1 << bits) - 1)) * depth) & ((1 << depth) - 1)
    return np.array(palette + [0] * (256 - len(palette)), np.int64)[at].ravel().tolist()


def payload(data: bytes) -> bytes:
    """The VP8L chunk of a RIFF file."""
    if data[:4] != b"RIFF" or data[8:12] != b"WEBP":
        raise BadImage("not a WebP file")
    at = 12
    while at + 8 <= len(data):
        kind, size = data[at : at + 4], struct.unpack_from("<I", data, at + 4)[0]
        if kind == b"VP8L":
            if at + 8 + size > len(data):
                raise BadImage("the data end early")
            return data[at + 8 : at + 8 + size]
        if kind in (b"VP8 ", b"ANIM"):
            raise BadImage("a lossy image" if kind == b"VP8 " else "an animation")
        at += 8 + size + (size & 1)
    raise BadImage("no image")


def decode(data: bytes, most_pixels: int = MOST_PIXELS) -> tuple[int, int, list[int]]:
    """(width, height, ARGB pixels by row) of a lossless WebP file; BadImage if it is none, or larger than ``most_pixels``."""
    b = _Bits(payload(data))
    if b.read(8) != 0x2F:
        raise BadImage("bad signature")
    width, height = b.read(14) + 1, b.read(14) + 1
    if width * height > most_pixels:
        raise BadImage(f"more than {most_pixels} pixels")
    opaque = not b.read(1)
    if b.read(3):
        raise BadImage("unknown version")
    now, steps, seen = width, [], set()
    while b.read(1):
        kind = b.read(2)
        if kind in seen:
            raise BadImage("a transform is repeated")
        seen.add(kind)
        if kind < 2:
            bits = b.read(3) + 2
            steps.append((kind, now, bits, _read_image(b, (now + (1 << bits) - 1) >> bits, (height + (1 << bits) - 1) >> bits, False)))
        elif kind == 2:
            steps.append((kind, now, 0, []))
        else:
            n = b.read(8) + 1
            palette = _read_image(b, n, 1, False)
            for i in range(1, n):
                palette[i] = _add(palette[i], palette[i - 1])
            bits = 3 if n <= 2 else 2 if n <= 4 else 1 if n <= 16 else 0
            steps.append((kind, now, bits, palette))
            now = (now + (1 << bits) - 1) >> bits
    p = _read_image(b, now, height, True)
    for kind, w, bits, extra in reversed(steps):
        if kind == 0:
            p = _undo_predictor(p, w, height, bits, extra)
        elif kind == 1:
            p = _cross(p, w, height, bits, extra, 1)
        elif kind == 2:
            p = _green(p, 1)
        else:
            p = _undo_palette(p, w, height, bits, extra)
    return width, height, [x | OPAQUE for x in p] if opaque else p


class _Writer:
    def __init__(self):
        self.value, self.n, self.done = 0, 0, bytearray()

    def write(self, value: int, n: int) -> None:
        self.value |= value << self.n
        self.n += n
        if self.n >= 512:
            whole = self.n >> 3
            self.done += (self.value & ((1 << (whole * 8)) - 1)).to_bytes(whole, "little")
            self.value >>= whole * 8
            self.n &= 7

    def bytes(self) -> bytes:
        return bytes(self.done) + self.value.to_bytes((self.n + 7) >> 3, "little")


def _lengths(counts: Counter, size: int, most: int) -> list[int]:
    """Code lengths for symbols that occur, none above ``most``."""
    out = [0] * size
    if len(counts) < 2:
        for s in counts:
            out[s] = 1
        return out
    floor = 0
    while True:
        heap = [(max(c, floor), s, (s,)) for s, c in counts.items()]
        heapq.heapify(heap)
        out = [0] * size
        while len(heap) > 1:
            a, b = heapq.heappop(heap), heapq.heappop(heap)
            for s in a[2] + b[2]:
                out[s] += 1
            heapq.heappush(heap, (a[0] + b[0], a[1], a[2] + b[2]))
        if max(out) <= most:
            return out
        floor = floor * 2 or 2


def _words(lengths: list[int]) -> dict[int, tuple[int, int]]:
    used = sorted((n, s) for s, n in enumerate(lengths) if n)
    if len(used) == 1:
        return {used[0][1]: (0, 0)}
    out, code, last = {}, 0, used[0][0] if used else 0
    for n, s in used:
        code <<= n - last
        last = n
        out[s] = (int(f"{code:0{n}b}"[::-1], 2), n)
        code += 1
    return out


def _write_code(w: _Writer, counts: Counter, size: int) -> dict[int, tuple[int, int]]:
    symbols = sorted(counts) or [0]
    if len(symbols) <= 2 and symbols[-1] < 256:
        w.write(1, 1)
        w.write(len(symbols) - 1, 1)
        wide = symbols[0] > 1
        w.write(wide, 1)
        w.write(symbols[0], 8 if wide else 1)
        if len(symbols) == 2:
            w.write(symbols[1], 8)
        lengths = [0] * size
        for s in symbols:
            lengths[s] = 1
        return _words(lengths)
    lengths = _lengths(counts, size, 15)
    runs, i, before = [], 0, 8
    last = max(s for s, n in enumerate(lengths) if n) + 1
    while i < last:
        n = 1
        while i + n < last and lengths[i + n] == lengths[i]:
            n += 1
        if not lengths[i] and n >= 3:
            n = min(n, 138)
            runs.append((17, n - 3, 3) if n <= 10 else (18, n - 11, 7))
        elif lengths[i] == before and n >= 3:
            n = min(n, 6)
            runs.append((16, n - 3, 2))
        else:
            n = 1
            runs.append((lengths[i], 0, 0))
            before = lengths[i] or before
        i += n
    of = _lengths(Counter(r[0] for r in runs), 19, 7)
    words = _words(of)
    count = max(4, 1 + max(k for k, s in enumerate(_ORDER) if of[s]))
    w.write(0, 1)
    w.write(count - 4, 4)
    for s in _ORDER[:count]:
        w.write(of[s], 3)
    if len(runs) >= 2:
        bits = max(2, (len(runs) - 2).bit_length() + 1 & ~1)
        w.write(1, 1)
        w.write((bits - 2) // 2, 3)
        w.write(len(runs) - 2, bits)
    else:
        w.write(1, 1)
        w.write(0, 3)
        w.write(0, 2)
    for s, extra, n in runs:
        w.write(*words[s])
        w.write(extra, n)
    if len(runs) < 2:
        raise ValueError("a code of one length run")
    return _words(lengths)


def _prefix(value: int) -> tuple[int, int, int]:
    """(code, extra bits' value, their number) of a length or distance."""
    v = value - 1
    if v < 4:
        return v, 0, 0
    top = v.bit_length() - 1
    second = v >> (top - 1) & 1
    return 2 * top + second, v & ((1 << (top - 1)) - 1), top - 1


def _tokens(p: list[int], width: int, cache_bits: int, copies: bool) -> list[tuple]:
    """Literals (argb,), cache hits (index, None) and copies (length, distance code, at)."""
    out, cache, known, i = [], [None] * (1 << cache_bits) if cache_bits else [], {}, 0
    codes = {}
    for k, (x, y) in enumerate(_NEAR):
        codes.setdefault(max(1, x + y * width), k + 1)

    def put(v: int) -> None:
        if cache_bits:
            cache[(_HASH * v & 0xFFFFFFFF) >> (32 - cache_bits)] = v

    while i < len(p):
        length, d = 0, 0
        if copies:
            j = known.get(tuple(p[i : i + 3]), -1)
            if j >= 0:
                d = i - j
                while i + length < len(p) and length < 4096 and p[i + length] == p[j + length]:
                    length += 1
        step = length if length >= 3 else 1
        if step > 1:
            out.append((length, codes.get(d, d + 120), i))
        elif cache_bits and cache[(_HASH * p[i] & 0xFFFFFFFF) >> (32 - cache_bits)] == p[i]:
            out.append((cache[(_HASH * p[i] & 0xFFFFFFFF) >> (32 - cache_bits)], None, i))
        else:
            out.append((p[i], -1, i))
        for k in range(i, i + step):
            put(p[k])
            known[tuple(p[k : k + 3])] = k
        i += step
    return out


def _write_image(w: _Writer, p: list[int], width: int, cache_bits: int = 0, copies: bool = False, main: bool = False, blocks: int = 0) -> None:
    w.write(bool(cache_bits), 1)
    if cache_bits:
        w.write(cache_bits, 4)
    group = lambda i: 0
    groups = 1
    if main:
        w.write(bool(blocks), 1)
        if blocks:
            across = (width + (1 << blocks) - 1) >> blocks
            down = (len(p) // width + (1 << blocks) - 1) >> blocks
            groups = min(3, across * down)
            w.write(blocks - 2, 3)
            _write_image(w, [OPAQUE | (k % groups) << 8 for k in range(across * down)], across)
            group = lambda i: ((i // width >> blocks) * across + (i % width >> blocks)) % groups
    tokens = _tokens(p, width, cache_bits, copies)
    counts = [[Counter() for _ in range(5)] for _ in range(groups)]
    steps = []
    for v, d, i in tokens:
        c = counts[group(i)]
        if d is None:
            s = [(0, 280 + ((_HASH * v & 0xFFFFFFFF) >> (32 - cache_bits)), 0, 0)]
        elif d < 0:
            s = [(0, v >> 8 & 255, 0, 0), (1, v >> 16 & 255, 0, 0), (2, v & 255, 0, 0), (3, v >> 24, 0, 0)]
        else:
            (a, x, n), (b, y, m) = _prefix(v), _prefix(d)
            s = [(0, 256 + a, x, n), (4, b, y, m)]
        for k, symbol, *_ in s:
            c[k][symbol] += 1
        steps.append((group(i), s))
    sizes = (280 + (1 << cache_bits if cache_bits else 0), 256, 256, 256, 40)
    words = [[_write_code(w, c, n) for c, n in zip(cs, sizes)] for cs in counts]
    for g, s in steps:
        for k, symbol, extra, n in s:
            w.write(*words[g][k][symbol])
            w.write(extra, n)


def encode(width: int, height: int, pixels: list[int], predictor: list[int] | None = None, cross: list[int] | None = None, green: bool = False, palette: bool = False, cache_bits: int = 0, copies: bool = True, blocks: int = 0, bits: int = 2) -> bytes:
    """A lossless WebP file of ARGB pixels.

    ``predictor`` and ``cross`` are modes and factors that blocks of ``1 << bits`` pixels
    take in turn; ``blocks`` (2 to 9) gives blocks of that size groups of codes of their own.
    """
    w = _Writer()
    w.write(0x2F, 8)
    w.write(width - 1, 14)
    w.write(height - 1, 14)
    w.write(any(x >> 24 != 255 for x in pixels), 1)
    w.write(0, 3)
    p, now = list(pixels), width
    if palette:
        colours = sorted(set(p))
        if len(colours) > 256:
            raise ValueError("too many colours for a palette")
        n = len(colours)
        b = 3 if n <= 2 else 2 if n <= 4 else 1 if n <= 16 else 0
        w.write(1, 1)
        w.write(3, 2)
        w.write(n - 1, 8)
        _write_image(w, [colours[0]] + [_less(y, x) for x, y in zip(colours, colours[1:])], n)
        at = {c: i for i, c in enumerate(colours)}
        rows, p = [p[i : i + width] for i in range(0, len(p), width)], []
        for row in rows:
            for x in range(0, width, 1 << b):
                p.append(OPAQUE | sum(at[c] << (k * (8 >> b)) for k, c in enumerate(row[x : x + (1 << b)])) << 8)
        now = (width + (1 << b) - 1) >> b
    across, down = (now + (1 << bits) - 1) >> bits, (height + (1 << bits) - 1) >> bits
    if predictor:
        modes = [OPAQUE | predictor[k % len(predictor)] << 8 for k in range(across * down)]
        w.write(1, 1)
        w.write(0, 2)
        w.write(bits - 2, 3)
        _write_image(w, modes, across)
        p = [_less(v, _predict(p, i, i % now, now, modes, (i // now >> bits) * across, bits)) for i, v in enumerate(p)]
    if cross:
        factors = [OPAQUE | cross[k % len(cross)] for k in range(across * down)]
        w.write(1, 1)
        w.write(1, 2)
        w.write(bits - 2, 3)
        _write_image(w, factors, across)
        p = _cross(p, now, height, bits, factors, -1)
    if green:
        w.write(1, 1)
        w.write(2, 2)
        p = _green(p, -1)
    w.write(0, 1)
    _write_image(w, p, now, cache_bits, copies, True, blocks)
    data = w.bytes()
    chunk = b"VP8L" + struct.pack("<I", len(data)) + data + b"\0" * (len(data) & 1)
    return b"RIFF" + struct.pack("<I", 4 + len(chunk)) + b"WEBP" + chunk


def decode_media(df: DataFrame, media: str = "image", width: str = "width", height: str = "height", pixels: str = "pixels", error: str = "media_error", most_pixels: int = MOST_PIXELS) -> DataFrame:
    """``df`` with width, height, ARGB pixels by row and what was wrong, in place of the bytes.

    Null bytes give nulls; bytes that are no lossless WebP image, empty ones too, and images
    of more than ``most_pixels`` give null pixels and the reason. Every row stays and the same bytes give the same pixels. A new
    column whose name is taken gets a leading underscore.
    """
    rest = [c for c in df.columns if c != media]
    added = fresh(rest, width, height, pixels, error)
    kinds = (T.IntegerType(), T.IntegerType(), T.ArrayType(T.LongType(), False), T.StringType())
    out = T.StructType([df.schema[c] for c in rest] + [T.StructField(n, k) for n, k in zip(added, kinds)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, first, held = [], 0, 0

            def flush(stop: int) -> pa.RecordBatch:
                cols = list(zip(*rows)) if rows else [(), (), (), ()]
                made = [pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.string()))]
                return pa.RecordBatch.from_arrays([*[c.slice(first, stop - first) for c in b.columns[: len(rest)]], *made], names=[*rest, *added])

            for i, x in enumerate(b.column(len(rest))):
                x = x.as_py()
                try:
                    got = (None,) * 4 if x is None else (*decode(x, most_pixels), None)
                except BadImage as e:
                    got = (None, None, None, str(e))
                size = len(got[2] or ())
                if held and held + size > BATCH_PIXELS:
                    yield flush(i)
                    rows, first, held = [], i, 0
                rows.append(got if got[2] is None else (*got[:2], np.array(got[2], np.int64), None))
                held += size
            yield flush(b.num_rows)

    return map_arrow(df.select(*map(name, rest), name(media)), run, out)


#: How the registered query encodes its images, in turn.
STYLES = (
    {"copies": False},
    {"green": True, "cache_bits": 4},
    {"predictor": [1, 2, 5, 11, 12, 13]},
    {"predictor": [3, 4, 6, 7, 8, 9, 10], "cross": [0x203040, 0xE01020], "green": True},
    {"palette": True},
    {"blocks": 2, "cache_bits": 6, "predictor": [0, 7]},
)


def thumbnails(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", image: str = "image") -> DataFrame:
    """A media table: each vector as an image about square, a component and its two next ones to a pixel.

    A component's level is floor((x + 1) * 127.5) between 0 and 255. A null vector, or one
    without components, gives a null image; a null component has the level 0.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            images = []
            for k, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if not v:
                    images.append(None)
                    continue
                x = np.clip(np.floor((np.array([-1 if c is None else c for c in v], np.float32).astype(float) + 1) * 127.5), 0, 255).astype(np.int64)
                width = int(np.ceil(np.sqrt(len(x))))
                height = -(-len(x) // width)
                x = np.append(x, np.zeros(width * height - len(x), np.int64))
                argb = OPAQUE | x << 16 | np.roll(x, -1) << 8 | np.roll(x, -2)
                images.append(encode(width, height, argb.tolist(), **STYLES[(k or 0) % len(STYLES)]))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(images, pa.binary())], names=[key, image])

    schema = T.StructType([vectors.schema[key], T.StructField(image, T.BinaryType())])
    return map_arrow(vectors.select(name(key), name(vector)), run, schema)


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decode_media(thumbnails(spark.read.parquet(f"{sf_dir}/embeddings.parquet")))


def op9_sql() -> str:
    return """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: greatest(0, least(255, floor((x::DOUBLE + 1) * 127.5)))::BIGINT) AS l FROM embeddings)
SELECT vec_id, 8::INTEGER AS width, 8::INTEGER AS height,
       list_transform(range(64), lambda i: 4278190080 + l[i + 1] * 65536 + l[(i + 1) % 64 + 1] * 256 + l[(i + 2) % 64 + 1])::BIGINT[] AS pixels, NULL::VARCHAR AS media_error
FROM v"""
