"""Lossless WebP: bytes to pixel arrays, by prefix codes, back-references, colour cache and the four inverse transforms.

Decoding is a map over rows without any shuffle: one image is decoded by one task, its pixels leave as RGBA bytes. The
encoder is there for tests and for the query (the tables at hand hold no images); it writes all features the decoder
reads. Pixels are ARGB integers inside, as in the format."""

from __future__ import annotations

import heapq
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table


class WebPError(ValueError):
    """The bytes aren't a whole lossless WebP image."""


_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
_MULTIPLIER = 0x1E35A7BD
_BLACK = 0xFF000000


#: The short distance codes, as pairs (dx, dy) of the specification.
_NEAR = (
    (0, 1), (1, 0), (1, 1), (-1, 1), (0, 2), (2, 0), (1, 2), (-1, 2), (2, 1), (-2, 1), (2, 2), (-2, 2), (0, 3), (3, 0), (1, 3), (-1, 3), (3, 1), (-3, 1), (2, 3), (-2, 3),
    (3, 2), (-3, 2), (0, 4), (4, 0), (1, 4), (-1, 4), (4, 1), (-4, 1), (3, 3), (-3, 3), (2, 4), (-2, 4), (4, 2), (-4, 2), (0, 5), (3, 4), (-3, 4), (4, 3), (-4, 3), (5, 0),
    (1, 5), (-1, 5), (5, 1), (-5, 1), (2, 5), (-2, 5), (5, 2), (-5, 2), (4, 4), (-4, 4), (3, 5), (-3, 5), (5, 3), (-5, 3), (0, 6), (6, 0), (1, 6), (-1, 6), (6, 1), (-6, 1),
    (2, 6), (-2, 6), (6, 2), (-6, 2), (4, 5), (-4, 5), (5, 4), (-5, 4), (3, 6), (-3, 6), (6, 3), (-6, 3), (0, 7), (7, 0), (1, 7), (-1, 7), (5, 5), (-5, 5), (7, 1), (-7, 1),
    (4, 6), (-4, 6), (6, 4), (-6, 4), (2, 7), (-2, 7), (7, 2), (-7, 2), (3, 7), (-3, 7), (7, 3), (-7, 3), (5, 6), (-5, 6), (6, 5), (-6, 5), (8, 0), (4, 7), (-4, 7), (7, 4),
    (-7, 4), (8, 1), (8, 2), (6, 6), (-6, 6), (8, 3), (5, 7), (-5, 7), (7, 5), (-7, 5), (8, 4), (6, 7), (-6, 7), (7, 6), (-7, 6), (8, 5), (7, 7), (-7, 7), (8, 6), (8, 7),
)


# ---------------------------------------------------------------- bits and prefix codes


class _Bits:
    """Bits of data, least significant first; beyond the end there are zeros, and over() tells that they were read."""

    __slots__ = ("data", "at", "buf", "n")

    def __init__(self, data: bytes):
        self.data, self.at, self.buf, self.n = data, 0, 0, 0

    def fill(self) -> None:
        self.buf |= int.from_bytes(self.data[self.at : self.at + 16], "little") << self.n
        self.at += 16
        self.n += 128

    def read(self, count: int) -> int:
        if self.n < count:
            self.fill()
        value = self.buf & ((1 << count) - 1)
        self.buf >>= count
        self.n -= count
        return value

    def over(self) -> bool:
        return self.at * 8 - self.n > len(self.data) * 8


class _Code:
    """A lookup of the next bits: entries are symbol << 4 | length."""

    __slots__ = ("table", "mask")

    def __init__(self, lengths: dict[int, int]):
        """lengths: of the symbols that have a code. A single symbol takes no bits."""
        if len(lengths) == 1:
            self.table, self.mask = [next(iter(lengths)) << 4], 0
            return
        most = max(lengths.values(), default=0)
        if sum(1 << (most - n) for n in lengths.values()) != 1 << most or not lengths:
            raise WebPError("a prefix code isn't complete")
        table = [0] * (1 << most)
        for symbol, (code, n) in canonical(lengths).items():
            table[code :: 1 << n] = [symbol << 4 | n] * (1 << (most - n))
        self.table, self.mask = table, (1 << most) - 1


def canonical(lengths: dict[int, int]) -> dict[int, tuple[int, int]]:
    """(bit-reversed code, length) of each symbol: shorter codes first, then smaller symbols."""
    out, code, last = {}, 0, 0
    for n, symbol in sorted((n, s) for s, n in lengths.items()):
        code <<= n - last
        last = n
        out[symbol] = (int(f"{code:0{n}b}"[::-1], 2) if n else 0, n)
        code += 1
    return out


def _symbol(bits: _Bits, code: _Code) -> int:
    if bits.n < 15:
        bits.fill()
    entry = code.table[bits.buf & code.mask]
    bits.buf >>= entry & 15
    bits.n -= entry & 15
    return entry >> 4


def _read_code(bits: _Bits, size: int) -> _Code:
    if bits.read(1):
        two = bits.read(1)
        first = bits.read(8 if bits.read(1) else 1)
        symbols = {first: 1} | ({bits.read(8): 1} if two else {})
        if max(symbols) >= size:
            raise WebPError("a symbol outside its alphabet")
        return _Code(symbols)
    many = bits.read(4) + 4
    outer = _Code({s: n for s in _ORDER[:many] if (n := bits.read(3))})
    left = 2 + bits.read(2 + 2 * bits.read(3)) if bits.read(1) else size
    lengths: dict[int, int] = {}
    at, last = 0, 8
    while at < size and left:
        left -= 1
        s = _symbol(bits, outer)
        if s < 16:
            if s:
                lengths[at] = last = s
            at += 1
            continue
        run = 3 + bits.read(2) if s == 16 else 3 + bits.read(3) if s == 17 else 11 + bits.read(7)
        if at + run > size:
            raise WebPError("code lengths beyond the alphabet")
        if s == 16:
            lengths.update(dict.fromkeys(range(at, at + run), last))
        at += run
    return _Code(lengths)


def _extra(bits: _Bits, prefix: int) -> int:
    if prefix < 4:
        return prefix + 1
    extra = (prefix - 2) >> 1
    return ((2 + (prefix & 1)) << extra) + bits.read(extra) + 1


# ---------------------------------------------------------------- decoding


def _entropy_image(bits: _Bits, width: int, height: int, top: bool) -> list[int]:
    """The ARGB pixels of an image coded with prefix codes, back-references and a colour cache."""
    cache_bits = bits.read(4) if bits.read(1) else 0
    if cache_bits > 11:
        raise WebPError("colour cache too large")
    cache = [0] * (1 << cache_bits) if cache_bits else []
    groups_of: list[int] | None = None
    block, many = 0, 1
    if top and bits.read(1):
        block = bits.read(3) + 2
        groups_of = [p >> 8 & 0xFFFF for p in _entropy_image(bits, _down(width, block), _down(height, block), False)]
        many = max(groups_of) + 1
    groups = [[_read_code(bits, n) for n in (280 + len(cache), 256, 256, 256, 40)] for _ in range(many)]
    across = _down(width, block)
    green, red, blue, alpha, far = groups[0]
    total, shift = width * height, 32 - cache_bits
    out: list[int] = []
    put = out.append
    seen = 0  # pixels that the cache has
    g_table, g_mask, r_table, r_mask, b_table, b_mask, a_table, a_mask = green.table, green.mask, red.table, red.mask, blue.table, blue.mask, alpha.table, alpha.mask
    n, copied = 0, False
    while n < total:
        if groups_of is not None and (copied or (n % width) & ((1 << block) - 1) == 0):
            green, red, blue, alpha, far = groups[groups_of[(n // width >> block) * across + (n % width >> block)]]
            g_table, g_mask, r_table, r_mask, b_table, b_mask, a_table, a_mask = green.table, green.mask, red.table, red.mask, blue.table, blue.mask, alpha.table, alpha.mask
        copied = False
        if bits.n < 60:
            bits.fill()
            if bits.at > len(bits.data) + 32:
                raise WebPError("the data end early")
        buf = bits.buf
        e = g_table[buf & g_mask]
        used = e & 15
        s = e >> 4
        buf >>= used
        if s < 256:
            e = r_table[buf & r_mask]
            k = e & 15
            p = s << 8 | (e >> 4) << 16
            buf >>= k
            used += k
            e = b_table[buf & b_mask]
            k = e & 15
            p |= e >> 4
            buf >>= k
            used += k
            e = a_table[buf & a_mask]
            k = e & 15
            bits.buf = buf >> k
            bits.n -= used + k
            put(p | (e >> 4) << 24)
            n += 1
            continue
        bits.buf = buf
        bits.n -= used
        if s < 280:
            length = _extra(bits, s - 256)
            code = _extra(bits, _symbol(bits, far))
            if code > 120:
                back = code - 120
            else:
                dx, dy = _NEAR[code - 1]
                back = max(1, dx + dy * width)
            if back > n or n + length > total:
                raise WebPError("a back-reference outside the image")
            if back >= length:
                out += out[n - back : n - back + length]
            else:
                run = out[n - back :]
                out += (run * (length // back + 1))[:length]
            n += length
            copied = True
            continue
        while seen < n:  # the cache takes all pixels so far before it is asked
            cache[(_MULTIPLIER * out[seen] & 0xFFFFFFFF) >> shift] = out[seen]
            seen += 1
        put(cache[s - 280])
        n += 1
    if bits.over():
        raise WebPError("the data end early")
    return out


def _down(size: int, bits: int) -> int:
    return (size + (1 << bits) - 1) >> bits


def _average(a: int, b: int) -> int:
    return (((a ^ b) & 0xFEFEFEFE) >> 1) + (a & b)


def _select(left: int, top: int, corner: int) -> int:
    by_left = by_top = 0
    for s in (0, 8, 16, 24):
        c = corner >> s & 255
        by_left += abs((top >> s & 255) - c)
        by_top += abs((left >> s & 255) - c)
    return left if by_left < by_top else top


def _clamp(v: int) -> int:
    return 0 if v < 0 else 255 if v > 255 else v


def _full(left: int, top: int, corner: int) -> int:
    return sum(_clamp((left >> s & 255) + (top >> s & 255) - (corner >> s & 255)) << s for s in (0, 8, 16, 24))


def _half(a: int, corner: int) -> int:
    out = 0
    for s in (0, 8, 16, 24):
        x = a >> s & 255
        d = x - (corner >> s & 255)
        out |= _clamp(x + (d // 2 if d >= 0 else -(-d // 2))) << s
    return out


def predict(mode: int, left: int, top: int, corner: int, right: int) -> int:
    """right is the pixel above and to the right."""
    if mode == 1:
        return left
    if mode == 2:
        return top
    if mode == 3:
        return right
    if mode == 4:
        return corner
    if mode == 5:
        return _average(_average(left, right), top)
    if mode == 6:
        return _average(left, corner)
    if mode == 7:
        return _average(left, top)
    if mode == 8:
        return _average(corner, top)
    if mode == 9:
        return _average(top, right)
    if mode == 10:
        return _average(_average(left, corner), _average(top, right))
    if mode == 11:
        return _select(left, top, corner)
    if mode == 12:
        return _full(left, top, corner)
    if mode == 13:
        return _half(_average(left, top), corner)
    return _BLACK


#: Rows from which on predictions are made front by front, which smaller images don't repay.
FRONTS = 400


def _undo_predictor(pixels: list[int], width: int, height: int, bits: int, modes: list[int]) -> list[int]:
    """The pixel above and to the right of a row's last one is the row's own first."""
    if height >= FRONTS and width >= FRONTS:
        return _undo_by_fronts(pixels, width, height, bits, modes)
    across = _down(width, bits)
    out: list[int] = []
    put = out.append
    p = _BLACK
    for x in range(width):
        v = pixels[x]
        p = ((p & 0xFF00FF) + (v & 0xFF00FF)) & 0xFF00FF | ((p & 0xFF00FF00) + (v & 0xFF00FF00)) & 0xFF00FF00
        put(p)
    for y in range(1, height):
        at = y * width
        row = [m >> 8 & 15 for m in modes[(y >> bits) * across : (y >> bits) * across + across]]
        for x in range(width):
            i = at + x
            if x == 0:
                p = out[i - width]
            else:
                p = predict(row[x >> bits], out[i - 1], out[i - width], out[i - width - 1], out[i - width + 1])
            v = pixels[i]
            put(((p & 0xFF00FF) + (v & 0xFF00FF)) & 0xFF00FF | ((p & 0xFF00FF00) + (v & 0xFF00FF00)) & 0xFF00FF00)
    return out


def _undo_by_fronts(pixels: list[int], width: int, height: int, bits: int, modes: list[int]) -> list[int]:
    """The same for larger images: pixels of equal x + 2 y don't need each other, so each such front is predicted at once."""
    across = _down(width, bits)
    v = np.array(pixels, np.uint32).view(np.uint8).reshape(-1, 4).astype(np.int16)
    y, x = np.divmod(np.arange(width * height), width)
    mode = (np.array(modes, np.uint32) >> 8 & 15)[(y >> bits) * across + (x >> bits)]
    mode[::width] = 2
    out = np.zeros_like(v)
    black = np.array([0, 0, 0, 255], np.int16)
    first = np.cumsum(v[:width].astype(np.int64), axis=0)
    out[:width] = (first + black) & 255
    for t in range(2, width + 2 * height - 2):
        rows = np.arange(max(1, -(-(t - width + 1) // 2)), min(height - 1, t // 2) + 1)
        if not len(rows):
            continue
        i = rows * width + t - 2 * rows
        m, left, top, corner, right = mode[i], out[i - 1], out[i - width], out[np.maximum(i - width - 1, 0)], out[i - width + 1]
        p = np.empty_like(left)
        for k in np.flatnonzero(np.bincount(m)):
            on = m == k
            a, b, c, d = left[on], top[on], corner[on], right[on]
            if k == 1:
                q = a
            elif k == 2:
                q = b
            elif k == 3:
                q = d
            elif k == 4:
                q = c
            elif k == 5:
                q = (((a + d) >> 1) + b) >> 1
            elif k == 6:
                q = (a + c) >> 1
            elif k == 7:
                q = (a + b) >> 1
            elif k == 8:
                q = (c + b) >> 1
            elif k == 9:
                q = (b + d) >> 1
            elif k == 10:
                q = (((a + c) >> 1) + ((b + d) >> 1)) >> 1
            elif k == 11:
                q = np.where((np.abs(b - c).sum(1) < np.abs(a - c).sum(1))[:, None], a, b)
            elif k == 12:
                q = np.clip(a + b - c, 0, 255)
            elif k == 13:
                mean = (a + b) >> 1
                away = mean - c
                q = np.clip(mean + ((away + (away < 0)) >> 1), 0, 255)
            else:
                q = black
            p[on] = q
        out[i] = (p + v[i]) & 255
    return out.astype(np.uint8).reshape(-1).view(np.uint32).tolist()


def _cross(pixels: np.ndarray, width: int, height: int, bits: int, blocks: Sequence[int], back: bool) -> np.ndarray:
    """Add (or, for the encoder, take away) what green and red tell of the other colours, block by block."""
    across = _down(width, bits)
    y, x = np.divmod(np.arange(width * height), width)
    m = np.asarray(blocks, np.uint32)[(y >> bits) * across + (x >> bits)]
    signed = lambda v: (v & 255).astype(np.uint8).astype(np.int8).astype(np.int32)
    delta = lambda t, c: (signed(t) * signed(c)) >> 5
    red, green, blue = pixels >> 16 & 255, pixels >> 8 & 255, pixels & 255
    sign = 1 if back else -1
    new_red = (red.astype(np.int32) + sign * delta(m, green)) & 255
    true_red = new_red if back else red
    new_blue = (blue.astype(np.int32) + sign * (delta(m >> 8, green) + delta(m >> 16, true_red.astype(np.uint32)))) & 255
    return pixels & np.uint32(0xFF00FF00) | new_red.astype(np.uint32) << 16 | new_blue.astype(np.uint32)


def _green(pixels: np.ndarray, sign: int) -> np.ndarray:
    g = (pixels >> 8 & 255).astype(np.int32)
    red, blue = ((pixels >> 16 & 255).astype(np.int32) + sign * g) & 255, ((pixels & 255).astype(np.int32) + sign * g) & 255
    return pixels & np.uint32(0xFF00FF00) | red.astype(np.uint32) << 16 | blue.astype(np.uint32)


def _payload(data: bytes) -> bytes:
    if len(data) < 20 or data[:4] != b"RIFF" or data[8:12] != b"WEBP":
        raise WebPError("no RIFF header of a WebP image")
    at = 12
    while at + 8 <= len(data):
        size = int.from_bytes(data[at + 4 : at + 8], "little")
        if data[at : at + 4] == b"VP8L":
            if at + 8 + size > len(data):
                raise WebPError("the data end early")
            return data[at + 8 : at + 8 + size]
        at += 8 + size + (size & 1)
    raise WebPError("no lossless image")


def decode(data: bytes, most_pixels: int = 1 << 28) -> tuple[int, int, np.ndarray]:
    """(width, height, ARGB pixels as uint32) of a lossless WebP file; WebPError for anything else. most_pixels guards
    a task's memory against headers that lie; 2**28 is all the format allows."""
    bits = _Bits(_payload(data))
    if bits.read(8) != 0x2F:
        raise WebPError("no signature of a lossless image")
    width, height = bits.read(14) + 1, bits.read(14) + 1
    bits.read(1)
    if bits.read(3):
        raise WebPError("unknown version")
    if width * height > most_pixels:
        raise WebPError("more pixels than allowed")
    steps: list[tuple] = []
    coded = width
    while bits.read(1):
        kind = bits.read(2)
        if any(s[0] == kind for s in steps):
            raise WebPError("a transform comes twice")
        if kind in (0, 1):
            size = bits.read(3) + 2
            steps.append((kind, coded, size, _entropy_image(bits, _down(coded, size), _down(height, size), False)))
        elif kind == 2:
            steps.append((kind,))
        else:
            many = bits.read(8) + 1
            delta = np.array(_entropy_image(bits, many, 1, False), np.uint32).view(np.uint8).reshape(-1, 4)
            palette = np.cumsum(delta, axis=0, dtype=np.uint8).view(np.uint32).ravel()
            size = 0 if many > 16 else 1 if many > 4 else 2 if many > 2 else 3
            steps.append((kind, coded, size, palette))
            coded = _down(coded, size)
    pixels: list[int] | np.ndarray = _entropy_image(bits, coded, height, True)
    for step in reversed(steps):
        if step[0] == 0:
            pixels = _undo_predictor(pixels if isinstance(pixels, list) else pixels.tolist(), step[1], height, step[2], step[3])
            continue
        now = np.asarray(pixels, np.uint32)
        if step[0] == 1:
            pixels = _cross(now, step[1], height, step[2], step[3], True)
        elif step[0] == 2:
            pixels = _green(now, 1)
        else:
            full, size, palette = step[1:]
            per = 8 >> size
            x = np.arange(full)
            packed = now.reshape(height, -1)[:, x >> size] >> np.uint32(8)
            index = packed >> ((x & ((1 << size) - 1)) * per).astype(np.uint32) & np.uint32((1 << per) - 1)
            padded = np.zeros(max(256, len(palette)), np.uint32)  # an index beyond the palette is transparent black
            padded[: len(palette)] = palette
            pixels = padded[index.ravel()]
    return width, height, np.asarray(pixels, np.uint32)


def rgba(pixels: np.ndarray) -> bytes:
    return pixels.astype("<u4").view(np.uint8).reshape(-1, 4)[:, [2, 1, 0, 3]].tobytes()


# ---------------------------------------------------------------- encoding (for tests and the query)


@dataclass(frozen=True)
class Features:
    #: Mode of each block, in turn; empty: no predictor.
    predictor: tuple[int, ...] = ()
    predictor_bits: int = 2
    #: (green to red, green to blue, red to blue) of each block, in turn.
    cross: tuple[tuple[int, int, int], ...] = ()
    cross_bits: int = 2
    green: bool = False
    palette: bool = False
    cache_bits: int = 0
    back_references: bool = True
    #: Block size of two alternating groups of prefix codes; 0: one group.
    group_bits: int = 0


class _Out:
    def __init__(self) -> None:
        self.value, self.n, self.parts = 0, 0, bytearray()

    def write(self, value: int, count: int) -> None:
        self.value |= value << self.n
        self.n += count
        if self.n > 512:
            whole = self.n // 8
            self.parts += (self.value & ((1 << 8 * whole) - 1)).to_bytes(whole, "little")
            self.value >>= 8 * whole
            self.n -= 8 * whole

    def bytes(self) -> bytes:
        return bytes(self.parts) + self.value.to_bytes((self.n + 7) // 8, "little")


def code_lengths(counts: dict[int, int], most: int) -> dict[int, int]:
    """Huffman lengths, counts being flattened until none is over most."""
    if len(counts) < 2:
        return dict.fromkeys(counts, 1)
    floor = 1
    while True:
        heap = [(max(n, floor), s, (s,)) for s, n in counts.items()]
        heapq.heapify(heap)
        depth = dict.fromkeys(counts, 0)
        while len(heap) > 1:
            a, b = heapq.heappop(heap), heapq.heappop(heap)
            for s in a[2] + b[2]:
                depth[s] += 1
            heapq.heappush(heap, (a[0] + b[0], min(a[1], b[1]), a[2] + b[2]))
        if max(depth.values()) <= most:
            return depth
        floor *= 4


def _write_code(out: _Out, counts: dict[int, int]) -> dict[int, tuple[int, int]]:
    if len(counts) <= 2 and max(counts, default=0) < 256:
        symbols = sorted(counts) or [0]
        out.write(1, 1)
        out.write(len(symbols) - 1, 1)
        wide = symbols[0] > 1
        out.write(wide, 1)
        out.write(symbols[0], 8 if wide else 1)
        if len(symbols) == 2:
            out.write(symbols[1], 8)
            return {symbols[0]: (0, 1), symbols[1]: (1, 1)}
        return {symbols[0]: (0, 0)}
    lengths = code_lengths(counts, 15)
    tokens: list[tuple[int, int, int]] = []
    at = 0
    for s in sorted(lengths):
        gap = s - at
        while gap:
            run = min(gap, 138)
            tokens += [(18, run - 11, 7)] if run > 10 else [(17, run - 3, 3)] if run > 2 else [(0, 0, 0)] * run
            gap -= run
        tokens.append((lengths[s], 0, 0))
        at = s + 1
    inner = code_lengths(Counter(t[0] for t in tokens), 7)
    out.write(0, 1)
    out.write(15, 4)
    for s in _ORDER:
        out.write(inner.get(s, 0), 3)
    codes = canonical(inner) if len(inner) > 1 else {s: (0, 0) for s in inner}
    left = len(tokens)  # what follows the last token has no code
    need = max(2, (left - 2).bit_length()) if left >= 2 else 0
    if need:
        need += need & 1
        out.write(1, 1)
        out.write((need - 2) // 2, 3)
        out.write(left - 2, need)
    else:
        out.write(0, 1)
    for s, extra, n in tokens:
        out.write(*codes[s])
        if n:
            out.write(extra, n)
    return canonical(lengths) if len(lengths) > 1 else {s: (0, 0) for s in lengths}


def _prefix(value: int) -> tuple[int, int, int]:
    """(prefix, extra bits' value, their number) of a length or distance from 1."""
    v = value - 1
    if v < 4:
        return v, 0, 0
    high = v.bit_length() - 1
    second = v >> (high - 1) & 1
    return 2 * high + second, v & ((1 << (high - 1)) - 1), high - 1


def _write_entropy(out: _Out, pixels: list[int], width: int, top: bool, features: Features) -> None:
    cache_bits = features.cache_bits if top else 0
    out.write(1, 1) if cache_bits else out.write(0, 1)
    if cache_bits:
        out.write(cache_bits, 4)
    height = len(pixels) // width
    block = features.group_bits if top else 0
    if top:
        out.write(1 if block else 0, 1)
    groups = 1
    if block:
        out.write(block - 2, 3)
        across = _down(width, block)
        of = [(i % across + i // across) % 2 for i in range(across * _down(height, block))]
        groups = max(of) + 1
        _write_entropy(out, [g << 8 for g in of], across, False, features)
    tokens: list[tuple] = []  # (position, pixel) or (position, None, length, distance) or (position, None, cache index)
    cache: dict[int, int] = {}
    shift, last = 32 - cache_bits, {}
    i = 0
    while i < len(pixels):
        p = pixels[i]
        length = 0
        if features.back_references and top and i + 3 <= len(pixels):
            key = (p, pixels[i + 1], pixels[i + 2])
            at = last.get(key, -1)
            last[key] = i
            if at >= 0:
                while i + length < len(pixels) and length < 4096 and pixels[at + length] == pixels[i + length]:
                    length += 1
        if length >= 3:
            tokens.append((i, None, length, i - at))
            if cache_bits:
                for q in pixels[i : i + length]:
                    cache[(_MULTIPLIER * q & 0xFFFFFFFF) >> shift] = q
            i += length
            continue
        if cache_bits:
            slot = (_MULTIPLIER * p & 0xFFFFFFFF) >> shift
            if cache.get(slot, 0) == p:
                tokens.append((i, None, slot))
            else:
                tokens.append((i, p))
            cache[slot] = p
        else:
            tokens.append((i, p))
        i += 1
    near = {max(1, dx + dy * width): k + 1 for k, (dx, dy) in reversed(list(enumerate(_NEAR)))}
    counts: list[list[Counter]] = [[Counter() for _ in range(5)] for _ in range(groups)]
    planned = []
    for t in tokens:
        g = of[(t[0] // width >> block) * across + (t[0] % width >> block)] if block else 0
        c = counts[g]
        if t[1] is not None:
            parts = (t[1] >> 8 & 255, t[1] >> 16 & 255, t[1] & 255, t[1] >> 24)
            for k, v in enumerate(parts):
                c[k][v] += 1
            planned.append((g, parts))
        elif len(t) == 4:
            length, dist = _prefix(t[2]), _prefix(near.get(t[3], t[3] + 120))
            c[0][256 + length[0]] += 1
            c[4][dist[0]] += 1
            planned.append((g, length, dist))
        else:
            c[0][280 + t[2]] += 1
            planned.append((g, 280 + t[2], None, None))
    codes = [[_write_code(out, c) for c in group] for group in counts]
    write = out.write
    for entry in planned:
        five = codes[entry[0]]
        if len(entry) == 2:
            for k, v in enumerate(entry[1]):
                write(*five[k][v])
        elif len(entry) == 3:
            (a, av, an), (b, bv, bn) = entry[1], entry[2]
            write(*five[0][256 + a])
            write(av, an)
            write(*five[4][b])
            write(bv, bn)
        else:
            write(*five[0][entry[1]])


def encode(width: int, height: int, pixels: Sequence[int], features: Features = Features()) -> bytes:
    """A lossless WebP file of ARGB pixels. A palette needs at most 256 colours, and comes alone."""
    out = _Out()
    out.write(0x2F, 8)
    out.write(width - 1, 14)
    out.write(height - 1, 14)
    out.write(1, 1)
    out.write(0, 3)
    now: list[int] = list(pixels)
    plain = Features(back_references=False)
    coded = width
    if features.palette:
        colours = sorted(set(now))
        if len(colours) > 256:
            raise ValueError("too many colours for a palette")
        size = 0 if len(colours) > 16 else 1 if len(colours) > 4 else 2 if len(colours) > 2 else 3
        out.write(1, 1)
        out.write(3, 2)
        out.write(len(colours) - 1, 8)
        channels = np.array(colours, np.uint32).view(np.uint8).reshape(-1, 4)
        _write_entropy(out, np.diff(channels, axis=0, prepend=np.zeros((1, 4), np.uint8)).astype(np.uint8).copy().view(np.uint32).ravel().tolist(), len(colours), False, plain)
        index = {c: i for i, c in enumerate(colours)}
        coded, per = _down(width, size), 8 >> size
        packed = [0] * (coded * height)
        for i, c in enumerate(now):
            y, x = divmod(i, width)
            packed[y * coded + (x >> size)] |= index[c] << (8 + per * (x & ((1 << size) - 1)))
        now = [p | _BLACK for p in packed]
    else:
        if features.green:
            out.write(1, 1)
            out.write(2, 2)
            now = _green(np.array(now, np.uint32), -1).tolist()
        if features.predictor:
            bits, across = features.predictor_bits, _down(width, features.predictor_bits)
            modes = [features.predictor[k % len(features.predictor)] for k in range(across * _down(height, bits))]
            out.write(1, 1)
            out.write(0, 2)
            out.write(bits - 2, 3)
            _write_entropy(out, [m << 8 | _BLACK for m in modes], across, False, plain)
            rest = []
            for i, v in enumerate(now):
                y, x = divmod(i, width)
                if y == 0:
                    p = now[i - 1] if x else _BLACK
                else:
                    p = now[i - width] if x == 0 else predict(modes[(y >> bits) * across + (x >> bits)], now[i - 1], now[i - width], now[i - width - 1], now[i - width + 1])
                rest.append(((v & 0xFF00FF) + 0x1000100 - (p & 0xFF00FF)) & 0xFF00FF | ((v & 0xFF00FF00) + 0x100010000 - (p & 0xFF00FF00)) & 0xFF00FF00)
            now = rest
        if features.cross:
            bits, across = features.cross_bits, _down(width, features.cross_bits)
            blocks = [(g & 255) | (b & 255) << 8 | (r & 255) << 16 | _BLACK for g, b, r in (features.cross[k % len(features.cross)] for k in range(across * _down(height, bits)))]
            out.write(1, 1)
            out.write(1, 2)
            out.write(bits - 2, 3)
            _write_entropy(out, blocks, across, False, plain)
            now = _cross(np.array(now, np.uint32), width, height, bits, blocks, False).tolist()
    out.write(0, 1)
    _write_entropy(out, now, coded, True, features)
    body = out.bytes()
    body = b"VP8L" + len(body).to_bytes(4, "little") + body + b"\0" * (len(body) & 1)
    return b"RIFF" + (len(body) + 4).to_bytes(4, "little") + b"WEBP" + body


# ---------------------------------------------------------------- over tables


def decode_images(images: DataFrame) -> DataFrame:
    """images (any columns, media binary) with width, height, pixels (RGBA bytes, row by row) and error in place of media.

    A null media has nulls in all four; bytes that aren't a whole lossless WebP image, empty ones too, have the reason in
    error and null otherwise. Input columns of those four names are replaced. Rows stay where they are: no shuffle."""

    @F.pandas_udf("width int, height int, pixels binary, error string")
    def decoded(media: pd.Series) -> pd.DataFrame:
        rows: list[tuple] = []
        for data in media:
            try:
                if data is None:
                    rows.append((None, None, None, None))
                else:
                    width, height, pixels = decode(bytes(data))
                    rows.append((width, height, rgba(pixels), None))
            except WebPError as wrong:
                rows.append((None, None, None, str(wrong)))
        out = pd.DataFrame(rows, columns=["width", "height", "pixels", "error"])
        return out.astype({"width": "Int32", "height": "Int32"})

    kept = [c for c in images.columns if c not in ("media", "width", "height", "pixels", "error")]
    return images.select(*[F.col(f"`{c}`") for c in kept], decoded("media").alias("_decoded")).select(*[F.col(f"`{c}`") for c in kept], "_decoded.*")


SIDE = 8
_X, _Y = (a.ravel() for a in np.meshgrid(np.arange(SIDE), np.arange(SIDE)))
#: How the icon of a page is coded goes by the first digit of its hash.
_CODED = (
    Features(palette=True),
    Features(predictor=(11, 12, 13, 5), green=True),
    Features(predictor=(1, 2, 7, 10), cross=((3, 5, 2), (-2, 4, 1)), cache_bits=3),
    Features(green=True, cache_bits=4, back_references=True, group_bits=2),
)


def icon(h: str) -> list[int]:
    """The pixels of an icon from 32 hexadecimal digits: two colours in the pattern of its digits, or a gradient."""
    b = bytes.fromhex(h)
    if b[0] % 2 == 0:
        on, off = (0xFF000000 | int.from_bytes(b[k : k + 3], "big") for k in (1, 4))
        return [on if b[8 + y] >> x & 1 else off for y in range(SIDE) for x in range(SIDE)]
    c = [(b[k] + _X * (b[k + 1] % 8) + _Y * (b[k + 2] % 8)) % 256 for k in (1, 4, 7)]
    return (0xFF000000 | c[0] << 16 | c[1] << 8 | c[2]).tolist()


def page_icons(pages: DataFrame) -> DataFrame:
    """(page_id, media): an icon of each page, drawn from its URL and coded as lossless WebP; null where the URL is."""

    @F.pandas_udf("binary")
    def coded(hashes: pd.Series) -> pd.Series:
        # two-colour icons are coded with palette or with cache and groups, gradients with the predictors
        return pd.Series([None if h is None else encode(SIDE, SIDE, icon(h), _CODED[(0, 3)[int(h[2], 16) % 2] if int(h[1], 16) % 2 == 0 else (1, 2)[int(h[2], 16) % 2]]) for h in hashes], dtype="object")

    return pages.select("page_id", coded(F.md5("url")).alias("media"))


def op2_webp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(page_id, width, height, pixels, error) of the icon of every page, pixels as hexadecimal RGBA."""
    decoded = decode_images(page_icons(table(spark, sf_dir, "pages")))
    return decoded.select("page_id", "width", "height", F.lower(F.hex("pixels")).alias("pixels"), "error")


QUERIES = {"op2_webp": op2_webp}
_RAMP = "lpad(lower(to_hex((b[{k}] + x * (b[{k} + 1] % 8) + y * (b[{k} + 2] % 8)) % 256)), 2, '0')"
ORACLE = {
    "op2_webp": f"""
WITH hashed AS (SELECT page_id, md5(url) AS h FROM pages),
bytes AS (SELECT page_id, h, list_transform(range(0, 16), lambda i: CAST(('0x' || substr(h, CAST(2 * i + 1 AS INTEGER), 2)) AS INTEGER)) AS b FROM hashed),
cells AS (SELECT page_id, h, b, i // 8 AS y, i % 8 AS x, i FROM bytes, range(0, 64) AS r(i) WHERE h IS NOT NULL),
drawn AS (
  SELECT page_id, h, string_agg(CASE WHEN b[1] % 2 = 0
           THEN substr(h, CASE WHEN (b[CAST(9 + y AS INTEGER)] >> CAST(x AS INTEGER)) & 1 = 1 THEN 3 ELSE 9 END, 6)
           ELSE {_RAMP.format(k=2)} || {_RAMP.format(k=5)} || {_RAMP.format(k=8)} END || 'ff', '' ORDER BY i) AS pixels
  FROM cells GROUP BY page_id, h)
SELECT page_id, CAST(CASE WHEN hashed.h IS NOT NULL THEN 8 END AS INTEGER) AS width, CAST(CASE WHEN hashed.h IS NOT NULL THEN 8 END AS INTEGER) AS height,
       pixels, CAST(NULL AS VARCHAR) AS error
FROM hashed LEFT JOIN drawn USING (page_id, h)"""
}
