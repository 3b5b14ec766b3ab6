"""Lossless WebP (VP8L): decoding to pixel arrays, and storing byte payloads as pixels.

`decode` reads the whole format: prefix codes (simple and normal), meta prefix codes, back-references
with the distance map, the colour cache, and the inverse predictor, cross-colour, subtract-green and
palette transforms with pixel bundling. Two walks give the same pixels. The general one goes symbol by
symbol. Images of one prefix-code group and no colour cache, which is what `encode_payload` writes, are
read in bulk: for every bit position the four symbols of a pixel that would start there are looked up
at once, then one chain of positions is followed, stopping at back-references.

Pixels are rows of (alpha, red, green, blue) bytes.

Defined results: a null text is an empty payload, which is padding alone; equal texts give equal bytes;
a payload above one image's height goes on in further images; a damaged file raises ValueError.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import Scratch, table

UNIT = 576
WIDTH, MAX_SIDE = UNIT // 4, 1 << 14
MAX_CODE = 15
PREDICTOR, CROSS_COLOUR, SUBTRACT_GREEN, PALETTE = range(4)

# Fixed values of the format: the order in which code lengths of code lengths are stored.
LENGTH_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)


def _near_offsets() -> list[tuple[int, int]]:
    """The 120 (dx, dy) that the first distance codes stand for: by distance, then by |dx| ascending
    pairs of the two signs; the format's map follows this rule."""
    near = [(dx, dy) for dy in range(8) for dx in range(-7, 9) if dy > 0 or dx > 0]
    return sorted(near, key=lambda p: (p[0] ** 2 + p[1] ** 2, abs(p[0]), -p[0]))


NEAR = _near_offsets()


class Bits:
    """A reader of little-endian bits."""

    def __init__(self, data: bytes):
        self.at, self.end = 0, 8 * len(data)
        self.raw = bytes(data) + bytes(16)

    def peek(self, n: int) -> int:
        at = self.at >> 3
        return int.from_bytes(self.raw[at : at + 8], "little") >> (self.at & 7) & (1 << n) - 1

    def long(self, n: int) -> int:
        """Any number of the next bits (clear beyond the end)."""
        at = self.at >> 3
        return int.from_bytes(self.raw[at : at + (n + 15 >> 3)], "little") >> (self.at & 7) & (1 << n) - 1

    def take(self, n: int) -> int:
        value = self.peek(n) if n < 50 else 0
        self.at += n
        if self.at > self.end:
            raise ValueError("the bits end early")
        return value


# ---------------------------------------------------------------- prefix codes


#: The 16 bits of each number the other way round.
REVERSED = sum(((np.arange(1 << 16) >> k & 1) << 15 - k) for k in range(16))


def canonical(lengths: np.ndarray) -> np.ndarray:
    """The canonical code of each symbol, bits reversed so that it is read from the low end."""
    used = np.flatnonzero(lengths)
    order = used[np.argsort(lengths[used], kind="stable")]
    sizes = lengths[order]
    # counted in units of the longest code, each code starts where those before it end
    room = 1 << MAX_CODE - sizes
    codes = np.zeros(len(lengths), np.int64)
    codes[order] = REVERSED[(np.cumsum(room) - room) << 1] if len(used) else 0
    return codes


class Prefix:
    """A prefix code as a table over the next `depth` bits: symbol and length of each entry."""

    def __init__(self, lengths: np.ndarray):
        lengths = np.asarray(lengths, np.int64)
        used = np.flatnonzero(lengths)
        if len(used) == 0:
            raise ValueError("a prefix code without symbols")
        if len(used) == 1:  # one symbol takes no bits
            self.depth, self.symbols, self.sizes = 0, np.array([used[0]], np.int32), np.zeros(1, np.uint8)
            return
        if (1 << MAX_CODE - lengths[used]).sum() != 1 << MAX_CODE:
            raise ValueError("a prefix code that isn't complete")
        self.depth = int(lengths.max())
        # in order of their codes, symbols own runs of the table; it is then read from the low end
        order = used[np.argsort(lengths[used], kind="stable")]
        runs = 1 << self.depth - lengths[order]
        low_first = REVERSED[: 1 << 16 : 1 << 16 - self.depth]
        self.symbols = np.repeat(order.astype(np.int32), runs)[low_first]
        self.sizes = np.repeat(lengths[order].astype(np.uint8), runs)[low_first]

    def read(self, bits: Bits) -> int:
        at = bits.peek(self.depth)
        bits.take(int(self.sizes[at]))
        return int(self.symbols[at])


def read_prefix(bits: Bits, alphabet: int, before: list | None = None) -> Prefix:
    """The next prefix code. `before` remembers the last one read and its bits: a code of the same
    alphabet that is stored in the same bits again is the same code."""
    if before and before[0] == alphabet and bits.long(before[2]) == before[1]:
        bits.take(before[2])
        return before[3]
    start = bits.at
    code = Prefix(_read_lengths(bits, alphabet))
    if before is not None:
        used, bits.at = bits.at - start, start
        before[:] = alphabet, bits.long(used), used, code
        bits.take(used)
    return code


def _read_lengths(bits: Bits, alphabet: int) -> np.ndarray:
    lengths = np.zeros(alphabet, np.int64)
    if bits.take(1):  # simple: one or two symbols
        two, wide = bits.take(1), bits.take(1)
        symbols = [bits.take(8 if wide else 1)] + ([bits.take(8)] if two else [])
        if max(symbols) >= alphabet:
            raise ValueError("a symbol outside its alphabet")
        lengths[symbols] = 1
        return lengths
    of_lengths = np.zeros(19, np.int64)
    for k in range(4 + bits.take(4)):
        of_lengths[LENGTH_ORDER[k]] = bits.take(3)
    most = alphabet
    if bits.take(1):
        most = 2 + bits.take(2 + 2 * bits.take(3))
        if most > alphabet:
            raise ValueError("too many code lengths")
    code, out, last = Prefix(of_lengths), [], 8
    symbols, sizes, mask = code.symbols.tolist(), code.sizes.tolist(), (1 << code.depth) - 1
    ahead = bits.long(14 * most)  # a length takes 7 bits at most, and 7 more if it repeats
    spent = 0
    while len(out) < alphabet and most:
        most -= 1
        s, n = symbols[ahead & mask], sizes[ahead & mask]
        ahead >>= n
        if s < 16:
            out.append(s)
            last = s or last
        else:
            value, least, extra = ((last, 3, 2), (0, 3, 3), (0, 11, 7))[s - 16]
            out += [value] * (least + (ahead & (1 << extra) - 1))
            ahead >>= extra
            n += extra
        spent += n
    bits.at += spent
    if len(out) > alphabet or bits.at > bits.end:
        raise ValueError("code lengths run over")
    lengths[: len(out)] = out
    return lengths


# ---------------------------------------------------------------- entropy-coded images


def _extended(symbol: int, bits: Bits) -> int:
    """The value of a length or distance symbol with its extra bits."""
    if symbol < 4:
        return symbol + 1
    extra = symbol - 2 >> 1
    return (2 + (symbol & 1) << extra) + bits.take(extra) + 1


def _distance(code: int, width: int) -> int:
    if code > 120:
        return code - 120
    dx, dy = NEAR[code - 1]
    return max(1, dx + dy * width)


def read_image(bits: Bits, width: int, height: int, top: bool = False) -> np.ndarray:
    """An entropy-coded image: width * height pixels as 0xAARRGGBB."""
    cache_bits = bits.take(4) if bits.take(1) else 0
    if cache_bits > 11:
        raise ValueError("colour cache too large")
    groups, block, which = 1, 0, None
    if top and bits.take(1):
        block = 2 + bits.take(3)
        which = read_image(bits, width + (1 << block) - 1 >> block, height + (1 << block) - 1 >> block) >> 8 & 0xFFFF
        groups = int(which.max()) + 1
    alphabets = (256 + 24 + (1 << cache_bits if cache_bits else 0), 256, 256, 256, 40)
    before: list = []
    codes = [[read_prefix(bits, n, before) for n in alphabets] for _ in range(groups)]
    if groups == 1 and not cache_bits:
        return _bulk(bits, codes[0], width, width * height)
    return _walk(bits, codes, width, width * height, cache_bits, which, block)


def _copy(out: np.ndarray, at: int, distance: int, length: int) -> int:
    if distance > at or at + length > len(out):
        raise ValueError("a back-reference outside the image")
    if distance >= length:
        out[at : at + length] = out[at - distance : at - distance + length]
    else:
        out[at : at + length] = np.resize(out[at - distance : at], length)
    return at + length


def _walk(bits: Bits, codes: list, width: int, total: int, cache_bits: int, which: np.ndarray | None, block: int) -> np.ndarray:
    """Symbol by symbol: any number of groups, and the colour cache."""
    out, at, cached = np.zeros(total, np.uint32), 0, 0
    cache = np.zeros(1 << cache_bits, np.uint32)
    across = width + (1 << block) - 1 >> block

    def remember(upto: int) -> None:
        nonlocal cached
        if cache_bits:
            for pixel in out[cached:upto].tolist():
                cache[(0x1E35A7BD * pixel & 0xFFFFFFFF) >> 32 - cache_bits] = pixel
        cached = upto

    while at < total:
        group = codes[int(which[(at // width >> block) * across + (at % width >> block)])] if which is not None else codes[0]
        s = group[0].read(bits)
        if s < 256:
            red, blue, alpha = (group[k].read(bits) for k in (1, 2, 3))
            out[at] = alpha << 24 | red << 16 | s << 8 | blue
            at += 1
        elif s < 280:
            length = _extended(s - 256, bits)
            at = _copy(out, at, _distance(_extended(group[4].read(bits), bits), width), length)
        else:
            remember(at)
            out[at] = cache[s - 280]
            at += 1
    return out


def _windows(raw: np.ndarray, first: int, last: int, n: int) -> np.ndarray:
    """The n bits (at most 17) that start at each bit position first..last (first a multiple of 8)."""
    b = raw[first >> 3 : (last >> 3) + 4].astype(np.uint32)
    wide = b[:-3] | b[1:-2] << 8 | b[2:-1] << 16
    return (wide[:, None] >> np.arange(8, dtype=np.uint32) & np.uint32((1 << n) - 1)).ravel()


#: Bytes of compressed data looked at together.
STRETCH = 1 << 16


def _bulk(bits: Bits, group: list, width: int, total: int) -> np.ndarray:
    """One group, no cache. For each bit position of a stretch: the four symbols of a pixel that starts
    there and where the next one starts; then the chain of true positions."""
    out, at = np.zeros(total, np.uint32), 0
    if all(group[k].depth == 0 for k in range(4)) and int(group[0].symbols[0]) < 256:
        out[:] = int(group[3].symbols[0]) << 24 | int(group[1].symbols[0]) << 16 | int(group[0].symbols[0]) << 8 | int(group[2].symbols[0])
        return out
    raw = np.frombuffer(bits.raw, np.uint8)
    green = group[0]
    depth = max(p.depth for p in group[:4])
    reach = sum(p.depth for p in group[:4])
    while at < total:
        first = bits.at & ~7
        last = min(first + 8 * STRETCH, bits.end) - 1
        if bits.at > last:
            raise ValueError("the bits end early")
        window = _windows(raw, first, last + reach + 8, depth)
        n = last - first + 1
        sized: list[tuple[Prefix, np.ndarray]] = []

        def sizes(code: Prefix) -> np.ndarray:
            for other, known in sized:
                if other.depth == code.depth and np.array_equal(other.sizes, code.sizes):
                    return known
            sized.append((code, code.sizes[window & np.uint32((1 << code.depth) - 1)]))
            return sized[-1][1]

        here = np.arange(n, dtype=np.int32)
        step = np.zeros(n, np.int32)
        starts = []
        for code in group[:4]:
            starts.append(here + step)
            if code.depth:
                step = step + sizes(code)[starts[-1]]
        if (reference := green.symbols >= 256).any():  # a back-reference is handled on its own
            step[reference[window[:n] & np.uint32((1 << green.depth) - 1)]] = 0
        hops, p, path, room = step.astype(np.uint8).tobytes(), bits.at - first, [], total - at
        add = path.append
        while p < n:
            hop = hops[p]
            if not hop:
                break
            add(p)
            p += hop
        if len(path) > room:  # what follows the image isn't pixels
            p = path[room]
            del path[room:]
        if path:
            rows = np.array(path, np.int32)
            pixel = np.zeros(len(rows), np.uint32)
            for code, start, shift in zip(group[:4], starts, (8, 16, 0, 24)):
                pixel |= code.symbols[window[start[rows]] & np.uint32((1 << code.depth) - 1)].astype(np.uint32) << shift
            out[at : at + len(rows)] = pixel
            at += len(rows)
        bits.at = first + p
        if bits.at > bits.end:
            raise ValueError("the bits end early")
        if at < total and p < n:
            s = green.read(bits)
            length = _extended(s - 256, bits)
            at = _copy(out, at, _distance(_extended(group[4].read(bits), bits), width), length)
    return out


# ---------------------------------------------------------------- transforms


def _bytes(pixels: np.ndarray) -> np.ndarray:
    """0xAARRGGBB pixels as bytes in the order blue, green, red, alpha."""
    return np.ascontiguousarray(pixels, "<u4").view(np.uint8).reshape(*pixels.shape, 4)


def _average(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return ((a.astype(np.int16) + b) >> 1).astype(np.uint8)


def _predict(mode: int, left, up, up_right, up_left):
    """The predictor `mode` of one pixel, from its neighbours' four bytes each."""
    if mode == 0 or mode > 13:
        return np.array([0, 0, 0, 255], np.uint8)
    if mode <= 4:
        return (left, up, up_right, up_left)[mode - 1]
    if mode == 5:
        return _average(_average(left, up_right), up)
    if mode <= 10:
        a, b = {6: (left, up_left), 7: (left, up), 8: (up_left, up), 9: (up, up_right), 10: (_average(left, up_left), _average(up, up_right))}[mode]
        return _average(a, b)
    l, u, c = (x.astype(np.int16) for x in (left, up, up_left))
    if mode == 11:
        return left if np.abs(u - c).sum() < np.abs(l - c).sum() else up
    if mode == 12:
        return np.clip(l + u - c, 0, 255).astype(np.uint8)
    mean = _average(left, up).astype(np.int16)
    half = mean - c
    return np.clip(mean + np.where(half < 0, -(-half >> 1), half >> 1), 0, 255).astype(np.uint8)


def _undo_predictor(pixels: np.ndarray, modes: np.ndarray, block: int) -> np.ndarray:
    height, width = pixels.shape
    p = _bytes(pixels).copy()
    p[0, 0] += np.array([0, 0, 0, 255], np.uint8)
    if width > 1:
        p[0] = np.cumsum(p[0], axis=0, dtype=np.uint8)  # the first row is predicted from the left
    for y in range(1, height):
        p[y, 0] += p[y - 1, 0]
        row = modes[y >> block] >> 8 & 15
        for x in range(1, width):
            right = p[y - 1, x + 1] if x + 1 < width else p[y, 0]
            p[y, x] += _predict(int(row[x >> block]), p[y, x - 1], p[y - 1, x], right, p[y - 1, x - 1])
    return p.view("<u4")[..., 0]


def _undo_cross_colour(pixels: np.ndarray, factors: np.ndarray, block: int) -> np.ndarray:
    height, width = pixels.shape
    p = _bytes(pixels).copy()
    f = _bytes(factors).view(np.int8)[np.arange(height)[:, None] >> block, np.arange(width) >> block].astype(np.int32)
    to_red, to_blue, red_to_blue = f[..., 0], f[..., 1], f[..., 2]
    green = p[..., 1].view(np.int8).astype(np.int32)
    red = (p[..., 2] + (to_red * green >> 5)).astype(np.uint8)
    p[..., 2] = red
    p[..., 0] = (p[..., 0] + (to_blue * green >> 5) + (red_to_blue * red.view(np.int8) >> 5)).astype(np.uint8)
    return p.view("<u4")[..., 0]


def _undo_green(pixels: np.ndarray) -> np.ndarray:
    p = _bytes(pixels).copy()
    p[..., 0] += p[..., 1]
    p[..., 2] += p[..., 1]
    return p.view("<u4")[..., 0]


def _undo_palette(pixels: np.ndarray, colours: np.ndarray, packed: int, width: int) -> np.ndarray:
    green = pixels >> 8 & 255
    if packed:
        each = 8 >> packed
        parts = green[..., None] >> np.arange(0, 8, each, dtype=np.uint32) & np.uint32((1 << each) - 1)
        green = parts.reshape(len(pixels), -1)[:, :width]
    known = np.concatenate([colours, np.zeros(256, np.uint32)])  # an index beyond the palette is clear black
    return known[green]


def decode_vp8l(data: bytes) -> np.ndarray:
    """height x width pixels as 0xAARRGGBB, from the payload of a VP8L chunk."""
    bits = Bits(data)
    if bits.take(8) != 0x2F:
        raise ValueError("no VP8L signature")
    width, height, _, version = bits.take(14) + 1, bits.take(14) + 1, bits.take(1), bits.take(3)
    if version:
        raise ValueError("unknown version")
    undo, inner, seen = [], width, set()
    while bits.take(1):
        kind = bits.take(2)
        if kind in seen:
            raise ValueError("a transform twice")
        seen.add(kind)
        if kind in (PREDICTOR, CROSS_COLOUR):
            block = bits.take(3) + 2
            w, h = inner + (1 << block) - 1 >> block, height + (1 << block) - 1 >> block
            side = read_image(bits, w, h).reshape(h, w)
            undo.append(lambda p, f=_undo_predictor if kind == PREDICTOR else _undo_cross_colour, side=side, block=block: f(p, side, block))
        elif kind == SUBTRACT_GREEN:
            undo.append(_undo_green)
        else:
            n = bits.take(8) + 1
            colours = np.cumsum(_bytes(read_image(bits, n, 1)), axis=0, dtype=np.uint8).view("<u4")[:, 0]
            packed = 3 if n <= 2 else 2 if n <= 4 else 1 if n <= 16 else 0
            undo.append(lambda p, colours=colours, packed=packed, w=inner: _undo_palette(p, colours, packed, w))
            inner = inner + (1 << packed) - 1 >> packed
    pixels = read_image(bits, inner, height, top=True).reshape(height, inner)
    for step in reversed(undo):
        pixels = step(pixels)
    return pixels


def decode(data: bytes) -> np.ndarray:
    """A lossless WebP file as a height x width x 4 array of (alpha, red, green, blue)."""
    if len(data) < 20 or data[:4] != b"RIFF" or data[8:12] != b"WEBP":
        raise ValueError("no WebP file")
    if struct.unpack_from("<I", data, 4)[0] + 8 > len(data):
        raise ValueError("the file ends early")
    at = 12
    while at + 8 <= len(data):
        kind, size = data[at : at + 4], struct.unpack_from("<I", data, at + 4)[0]
        if at + 8 + size > len(data):
            raise ValueError("a chunk ends early")
        if kind == b"VP8L":
            return _bytes(decode_vp8l(data[at + 8 : at + 8 + size]))[..., ::-1]
        at += 8 + size + (size & 1)
    raise ValueError("no lossless image in the file")


# ---------------------------------------------------------------- storing payloads


class _Writer:
    def __init__(self) -> None:
        self.value, self.n = 0, 0

    def put(self, value: int, n: int) -> None:
        self.value |= value << self.n
        self.n += n


def code_lengths(counts: np.ndarray, most: int) -> np.ndarray:
    """Lengths of a complete prefix code for the counted symbols, at most `most` bits each."""
    used = np.flatnonzero(counts).tolist()
    lengths = np.zeros(len(counts), np.int64)
    if len(used) < 2:
        lengths[used] = 1
        return lengths
    weights = np.asarray(counts)[used].astype(np.int64)
    while True:
        order = np.argsort(weights, kind="stable")
        depths = _depths(weights[order].tolist())
        if depths[0] <= most:
            lengths[np.array(used)[order]] = depths
            return lengths
        weights = (weights >> 1) + 1  # flatter


def _depths(weights: list[int]) -> list[int]:
    """Huffman depths of two or more ascending weights: leaves and joined nodes are two queues."""
    n = len(weights)
    parent, joined = [0] * (2 * n - 1), []
    leaf = node = 0
    for k in range(n - 1):
        total = 0
        for _ in range(2):
            if node >= len(joined) or leaf < n and weights[leaf] <= joined[node]:
                total += weights[leaf]
                parent[leaf] = n + k
                leaf += 1
            else:
                total += joined[node]
                parent[n + node] = n + k
                node += 1
        joined.append(total)
    depth = [0] * (2 * n - 1)
    for k in range(2 * n - 3, -1, -1):
        depth[k] = depth[parent[k]] + 1
    return depth[:n]


def _put_prefix(w: _Writer, lengths: np.ndarray) -> None:
    used = np.flatnonzero(lengths).tolist()
    if len(used) <= 2 and all(s < 256 for s in used):
        used = used or [0]
        w.put(1, 1)
        w.put(len(used) - 1, 1)
        w.put(1, 1)
        for s in used:
            w.put(s, 8)
        return
    w.put(0, 1)
    starts = np.flatnonzero(np.diff(lengths, prepend=-1))
    tokens = []
    for value, run in zip(lengths[starts].tolist(), np.diff(starts, append=len(lengths)).tolist()):
        while value == 0 and run >= 3:
            some = min(run, 138)
            tokens.append((18, some - 11, 7) if some > 10 else (17, some - 3, 3))
            run -= some
        tokens += [(value, 0, 0)] * run
    counts = np.bincount([t[0] for t in tokens], minlength=19)
    of_lengths = code_lengths(counts, 7)
    stored = max(k for k in range(19) if of_lengths[LENGTH_ORDER[k]]) + 1
    w.put(max(stored, 4) - 4, 4)
    for k in range(max(stored, 4)):
        w.put(int(of_lengths[LENGTH_ORDER[k]]), 3)
    w.put(0, 1)
    codes, sizes = canonical(of_lengths).tolist(), of_lengths.tolist() if (counts > 0).sum() > 1 else [0] * 19
    value = at = 0
    for s, extra, n in tokens:
        value |= (codes[s] | extra << sizes[s]) << at
        at += sizes[s] + n
    w.put(value, at)


def _split_length(value: int) -> tuple[int, int, int]:
    """(symbol, extra bits' value, their number) of a length or distance."""
    value -= 1
    if value < 4:
        return value, 0, 0
    top = value.bit_length() - 1
    extra = top - 1
    return 2 * top + (value >> extra & 1), value & (1 << extra) - 1, extra


def encode_image(payload: np.ndarray) -> bytes:
    """One WebP file of WIDTH pixels a row: literals by four prefix codes; a run of one pixel at the end
    (the padding) as back-references to the pixel before."""
    pixels = payload.reshape(-1, 4)
    words = np.ascontiguousarray(pixels).view("<u4")[:, 0]
    odd = np.flatnonzero(words != words[-1])
    tail = int(odd[-1]) + 1 if len(odd) else 0
    runs, rest = [], len(words) - tail - 1
    literals = pixels[: tail + 1]
    while rest:
        runs.append(min(rest, 4096))
        rest -= runs[-1]
    run_symbols = [_split_length(r) for r in runs]
    distance = _split_length(NEAR.index((1, 0)) + 1)
    greens = np.bincount(literals[:, 1], minlength=280)
    for symbol, _, _ in run_symbols:
        greens[256 + symbol] += 1
    others = code_lengths(np.bincount(literals[:, (0, 2, 3)].ravel(), minlength=256), 12)
    lengths = [others, code_lengths(greens, 12), others, others]  # of blue, green, red, alpha
    of_others, of_greens = (canonical(x) if (x > 0).sum() > 1 else None for x in lengths[:2])  # a lone symbol takes no bits
    codes = [of_others, of_greens, of_others, of_others]
    far = np.zeros(40, np.int64)
    far[distance[0]] = bool(runs)
    w = _Writer()
    for value, n in ((0x2F, 8), (WIDTH - 1, 14), (len(words) // WIDTH - 1, 14), (1, 1), (0, 3), (0, 1), (0, 1), (0, 1)):
        w.put(value, n)
    _put_prefix(w, lengths[1])
    thrice = _Writer()
    _put_prefix(thrice, others)
    for _ in range(3):
        w.put(thrice.value, thrice.n)
    _put_prefix(w, far)
    head, head_bits = w.value, w.n
    # all literals' codes at once: one value of up to 48 bits a pixel
    value, size = np.zeros(len(literals), np.uint64), np.zeros(len(literals), np.uint64)
    for k in (1, 2, 0, 3):
        if codes[k] is not None:
            value |= codes[k].astype(np.uint64)[literals[:, k]] << size
            size += lengths[k].astype(np.uint64)[literals[:, k]]
    ends = np.cumsum(size) + np.uint64(head_bits)
    at = ends - size
    n_bits = int(ends[-1])
    cells = np.zeros(n_bits // 32 + 4, np.uint64)  # 32-bit cells: disjoint bits, so sums are unions
    cell, shift = (at >> np.uint64(5)).astype(np.int64), at & np.uint64(31)
    low, spill = value << shift, value >> (np.uint64(63) - shift) >> np.uint64(1)
    for part, k in ((low & np.uint64(0xFFFFFFFF), 0), (low >> np.uint64(32), 1), (spill, 2)):
        starts = np.flatnonzero(np.diff(cell, prepend=-1))
        cells[cell[starts] + k] += np.add.reduceat(part, starts)
    total = int.from_bytes(cells.astype("<u4").tobytes()[: (n_bits >> 3) + 1], "little") if runs else None
    if runs:
        tail_bits = _Writer()
        for s, extra, n in run_symbols:
            tail_bits.put(int(codes[1][256 + s]), int(lengths[1][256 + s]))
            tail_bits.put(extra, n)
            tail_bits.put(distance[1], distance[2])  # the distance symbol stands alone: no bits of its own
        total |= head | tail_bits.value << n_bits
        n_bits += tail_bits.n
        body = total.to_bytes((n_bits + 7) // 8, "little")
    else:
        body = bytearray(cells.astype("<u4").tobytes()[: (n_bits + 7) // 8])
        for k, b in enumerate(head.to_bytes((head_bits + 7) // 8, "little")):
            body[k] |= b
        body = bytes(body)
    chunk = b"VP8L" + struct.pack("<I", len(body)) + body + b"\0" * (len(body) & 1)
    return b"RIFF" + struct.pack("<I", 4 + len(chunk)) + b"WEBP" + chunk


def payload_of(text: str | None) -> bytes:
    """The text in UTF-8, filled with bytes 255 up to a positive multiple of UNIT."""
    raw = (text or "").encode()
    return raw + b"\xff" * (UNIT - len(raw) % UNIT if not raw or len(raw) % UNIT else 0)


def encode_payload(payload: bytes) -> bytes:
    """WebP files one after another, each of at most MAX_SIDE rows of UNIT bytes."""
    data, most = np.frombuffer(payload, np.uint8), MAX_SIDE * UNIT
    return b"".join(encode_image(data[i : i + most]) for i in range(0, len(data), most))


def decode_payload(media: bytes) -> bytes:
    """The samples of `encode_payload`'s files, in its order of bytes."""
    out, at = [], 0
    while at < len(media):
        size = struct.unpack_from("<I", media, at + 4)[0] + 8
        argb = decode(media[at : at + size])
        out.append(np.ascontiguousarray(argb[..., ::-1]).tobytes())
        at += size
    return b"".join(out)


def grid_feature(samples: np.ndarray, side: int = 8) -> str:
    """64 bits as hex: which of 8 x 8 equal cells of the samples, read as rows, are above their mean."""
    cells = samples[: len(samples) // (side * side) * side * side].reshape(side * side, -1).mean(axis=1)
    return np.packbits(cells > cells.mean()).tobytes().hex()


def store(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A media column: doc_id, n_bytes and media (WebP files) of each text."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len((t or "").encode()) for t in texts], pa.int64()), pa.array([encode_payload(payload_of(t)) for t in texts], pa.binary())], ["doc_id", "n_bytes", "media"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(scan, "doc_id long, n_bytes long, media binary")


def pixel_arrays(media: DataFrame, media_col: str = "media") -> DataFrame:
    """The frame with width, height and pixels (binary, rows of alpha, red, green, blue) of one WebP file."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [decode(x) if x is not None else None for x in batch.column(0).to_pylist()]
            parts = [pa.array([None if p is None else f(p) for p in found], t) for f, t in ((lambda p: p.shape[1], pa.int32()), (lambda p: p.shape[0], pa.int32()), (lambda p: np.ascontiguousarray(p).tobytes(), pa.binary()))]
            yield pa.RecordBatch.from_arrays(parts, ["width", "height", "pixels"])

    return media.select(media_col).mapInArrow(scan, "width int, height int, pixels binary")


def digests(media: DataFrame) -> DataFrame:
    """The stored media read back: digests of what they hold, and a feature of their samples."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for stored in batch.column(2).to_pylist():
                back = decode_payload(stored)
                rows.append((len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-32:]), len(stored), hashlib.sha256(stored).hexdigest(), grid_feature(np.frombuffer(back, np.uint8))))
            names = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
            types = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], *(pa.array([r[k] for r in rows], t) for k, t in enumerate(types))], ["doc_id", "n_bytes", *names])

    return media.mapInArrow(scan, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def op3_webp(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "webp")
    media = scratch.save(store(table(spark, sf_dir, "documents")), "media")
    return digests(media)
