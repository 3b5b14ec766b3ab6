"""Round trips of `webp`; `Maker` writes what the decoder must read but `encode_image` doesn't use."""

import hashlib
import struct
import zlib

import numpy as np
import pytest

from millrace.llm import webp as W


class Maker:
    """Writes entropy-coded images with chosen cache, references and groups."""

    def __init__(self):
        self.w = W._Writer()

    def image(self, pixels, width, tokens=None, cache_bits=0, groups=None, block=2, top=False):
        """tokens: pixel ints, ('copy', length, distance code) or ('cache', index); groups: a group number for each block."""
        w = self.w
        w.put(cache_bits > 0, 1)
        if cache_bits:
            w.put(cache_bits, 4)
        tokens = list(pixels) if tokens is None else tokens
        across = width + (1 << block) - 1 >> block
        if top:
            w.put(groups is not None, 1)
            if groups is not None:
                w.put(block - 2, 3)
                self.image([g << 8 for g in groups], across)
        count = max(groups) + 1 if groups is not None else 1
        counts = [[np.zeros(280 + (1 << cache_bits if cache_bits else 0), int), *(np.zeros(256, int) for _ in range(3)), np.zeros(40, int)] for _ in range(count)]

        def parts():
            at = 0
            for t in tokens:
                g = groups[(at // width >> block) * across + (at % width >> block)] if groups is not None else 0
                if isinstance(t, tuple) and t[0] == "copy":
                    a, b = W._split_length(t[1]), W._split_length(t[2])
                    yield g, ((0, 256 + a[0], a[1], a[2]), (4, b[0], b[1], b[2]))
                    at += t[1]
                elif isinstance(t, tuple):
                    yield g, ((0, 280 + t[1], 0, 0),)
                    at += 1
                else:
                    yield g, ((0, t >> 8 & 255, 0, 0), (1, t >> 16 & 255, 0, 0), (2, t & 255, 0, 0), (3, t >> 24, 0, 0))
                    at += 1

        for g, symbols in parts():
            for k, s, _, _ in symbols:
                counts[g][k][s] += 1
        lengths = [[W.code_lengths(c, 15) for c in group] for group in counts]
        for group in lengths:
            for one in group:
                W._put_prefix(w, one)
        codes = [[W.canonical(one) for one in group] for group in lengths]
        for g, symbols in parts():
            for k, s, extra, n in symbols:
                if (lengths[g][k] > 0).sum() > 1:
                    w.put(int(codes[g][k][s]), int(lengths[g][k][s]))
                w.put(extra, n)

    def file(self, across, down, transforms, **image):
        head = W._Writer()
        for value, n in ((0x2F, 8), (across - 1, 14), (down - 1, 14), (1, 1), (0, 3)):
            head.put(value, n)
        self.w = head
        for kind, write in transforms:
            head.put(1, 1)
            head.put(kind, 2)
            write(self)
        head.put(0, 1)
        self.image(top=True, **image)
        body = head.value.to_bytes((head.n + 7) // 8, "little")
        chunk = b"VP8L" + struct.pack("<I", len(body)) + body + b"\0" * (len(body) & 1)
        junk = b"XYZW" + struct.pack("<I", 3) + b"abc\0"
        return b"RIFF" + struct.pack("<I", 4 + len(junk) + len(chunk)) + b"WEBP" + junk + chunk


def noise(h, w, seed=0, top=256):
    return np.random.default_rng(seed).integers(0, top, (h, w, 4)).astype(np.uint8)


def words(argb):
    return np.ascontiguousarray(argb[..., ::-1]).view("<u4")[..., 0].astype(np.int64)


def test_literals_any_size():
    for h, w in ((1, 1), (1, 7), (5, 3), (40, 33)):
        p = noise(h, w, h, 40)
        assert (W.decode(Maker().file(w, h, [], pixels=words(p).ravel().tolist(), width=w)) == p).all()


def test_back_references_by_map_and_by_distance():
    w, h = 10, 12
    rng = np.random.default_rng(2)
    out, tokens = [], []
    while len(out) < w * h:
        if len(out) > 45 and rng.random() < 0.4:
            length = int(min(rng.integers(1, 30), w * h - len(out)))
            code = int(rng.integers(1, 165))
            d = W._distance(code, w)
            if d > len(out):
                continue
            for _ in range(length):
                out.append(out[-d])
            tokens.append(("copy", length, code))
        else:
            out.append(int(rng.integers(0, 1 << 32)))
            tokens.append(out[-1])
    for cache in (0, 3):  # both walks
        got = W.decode(Maker().file(w, h, [], pixels=None, width=w, tokens=tokens, cache_bits=cache))
        assert words(got).ravel().tolist() == out


def test_distance_map_by_rule():
    assert W.NEAR[:12] == [(0, 1), (1, 0), (1, 1), (-1, 1), (0, 2), (2, 0), (1, 2), (-1, 2), (2, 1), (-2, 1), (2, 2), (-2, 2)]
    assert len(W.NEAR) == 120 and W.NEAR[-2:] == [(8, 6), (8, 7)] and W.NEAR[34:40] == [(0, 5), (3, 4), (-3, 4), (4, 3), (-4, 3), (5, 0)]


def test_colour_cache():
    few = np.random.default_rng(4).integers(0, 1 << 32, 9).tolist()
    rng, bits = np.random.default_rng(5), 4
    cache, out, tokens = [0] * 16, [], []
    for _ in range(8 * 25):
        p = few[rng.integers(0, 9)]
        key = (0x1E35A7BD * p & 0xFFFFFFFF) >> 32 - bits
        tokens.append(("cache", key) if cache[key] == p else p)
        cache[key] = p
        out.append(p)
    assert sum(isinstance(t, tuple) for t in tokens) > 50
    assert words(W.decode(Maker().file(8, 25, [], pixels=None, width=8, tokens=tokens, cache_bits=bits))).ravel().tolist() == out


def test_groups():
    p = noise(9, 14, 3, 30)
    groups = [k % 3 for k in range(4 * 3)]
    assert (W.decode(Maker().file(14, 9, [], pixels=words(p).ravel().tolist(), width=14, groups=groups)) == p).all()


def test_subtract_green_and_cross_colour():
    p = noise(11, 13, 6)
    f = noise(3, 4, 7)
    bgra = p[..., ::-1].astype(np.int64)
    r = bgra.copy()
    signed = lambda x: (x + 128) % 256 - 128
    for y in range(11):
        for x in range(13):
            red_to_blue, to_blue, to_red = (signed(int(v)) for v in f[y >> 2, x >> 2, 1:])
            g = signed(int(bgra[y, x, 1]))
            r[y, x, 2] = bgra[y, x, 2] - (to_red * g >> 5)
            r[y, x, 0] = bgra[y, x, 0] - (to_blue * g >> 5) - (red_to_blue * signed(int(bgra[y, x, 2])) >> 5)
    r %= 256
    r[..., 0] = (r[..., 0] - r[..., 1]) % 256
    r[..., 2] = (r[..., 2] - r[..., 1]) % 256
    residue = np.ascontiguousarray(r.astype(np.uint8)).view("<u4")[..., 0].astype(np.int64)

    def cross(m):
        m.w.put(0, 3)
        m.image(words(f).ravel().tolist(), 4)

    got = W.decode(Maker().file(13, 11, [(W.CROSS_COLOUR, cross), (W.SUBTRACT_GREEN, lambda m: None)], pixels=residue.ravel().tolist(), width=13))
    assert (got == p).all()


def scalar_predict(mode, l, t, tr, tl):
    avg = lambda a, b: [(x + y) // 2 for x, y in zip(a, b)]
    clamp = lambda v: max(0, min(255, v))
    if mode == 11:
        p = [a + b - c for a, b, c in zip(l, t, tl)]
        return l if sum(abs(x - y) for x, y in zip(p, l)) < sum(abs(x - y) for x, y in zip(p, t)) else t
    if mode == 12:
        return [clamp(a + b - c) for a, b, c in zip(l, t, tl)]
    if mode == 13:
        return [clamp(a + int((a - c) / 2)) for a, c in zip(avg(l, t), tl)]
    return {0: [0, 0, 0, 255], 1: l, 2: t, 3: tr, 4: tl, 5: avg(avg(l, tr), t), 6: avg(l, tl), 7: avg(l, t), 8: avg(tl, t), 9: avg(t, tr), 10: avg(avg(l, tl), avg(t, tr))}.get(mode, [0, 0, 0, 255])


def test_every_predictor():
    h, w = 16, 17
    p = noise(h, w, 8)
    bgra = p[..., ::-1].tolist()
    modes = [k % 16 for k in range(5 * 4)]
    out = []
    for y in range(h):
        for x in range(w):
            if y == 0:
                guess = bgra[0][x - 1] if x else [0, 0, 0, 255]
            elif x == 0:
                guess = bgra[y - 1][0]
            else:
                right = bgra[y - 1][x + 1] if x + 1 < w else bgra[y][0]
                guess = scalar_predict(modes[(y >> 2) * 5 + (x >> 2)], bgra[y][x - 1], bgra[y - 1][x], right, bgra[y - 1][x - 1])
            b = [(a - g) % 256 for a, g in zip(bgra[y][x], guess)]
            out.append(b[0] | b[1] << 8 | b[2] << 16 | b[3] << 24)

    def predictor(m):
        m.w.put(0, 3)
        m.image([k << 8 for k in modes], 5)

    assert (W.decode(Maker().file(w, h, [(W.PREDICTOR, predictor)], pixels=out, width=w)) == p).all()


@pytest.mark.parametrize("n", [1, 2, 3, 4, 9, 16, 17, 200])
def test_palette_with_bundles(n):
    rng = np.random.default_rng(n)
    colours = rng.integers(0, 256, (n, 4)).astype(np.uint8)
    h, w = 7, 13
    which = rng.integers(0, n, (h, w))
    each = 1 << (3 if n <= 2 else 2 if n <= 4 else 1 if n <= 16 else 0)
    bits = 8 // each
    inner = -(-w // each)
    rows = [[sum(int(which[y, x * each + k]) << bits * k for k in range(each) if x * each + k < w) << 8 for x in range(inner)] for y in range(h)]
    deltas = np.diff(colours.astype(int), axis=0, prepend=0) % 256

    def palette(m):
        m.w.put(n - 1, 8)
        m.image(words(deltas.astype(np.uint8).reshape(1, n, 4)).ravel().tolist(), n)

    got = W.decode(Maker().file(w, h, [(W.PALETTE, palette)], pixels=sum(rows, []), width=inner))
    assert (got == colours[which]).all()


def test_limited_code_lengths():
    lengths = W.code_lengths(np.array([2**k for k in range(40)]), 12)
    assert lengths.max() <= 12 and sum(2.0 ** -int(n) for n in lengths) == 1


@pytest.mark.parametrize("text", [None, "", "a", "é" * 288, "x" * 575, "x" * 576, "x" * 577, "\x00" * 576, "ab " * 40_000, "".join(map(chr, range(32, 3000)))])
def test_payload_round_trip(text):
    payload = W.payload_of(text)
    raw = (text or "").encode()
    assert len(payload) % 576 == 0 and len(payload) > 0 and payload[: len(raw)] == raw and len(payload) - len(raw) <= 576 and set(payload[len(raw) :]) <= {255}
    assert W.decode_payload(W.encode_payload(payload)) == payload


def test_random_payloads_across_stretches(monkeypatch):
    rng = np.random.default_rng(0)
    monkeypatch.setattr(W, "STRETCH", 100)
    for k in range(12):
        payload = rng.integers(0, rng.integers(1, 257), 576 * int(rng.integers(1, 20))).astype(np.uint8).tobytes()
        assert W.decode_payload(W.encode_payload(payload)) == payload


def test_several_images(monkeypatch):
    monkeypatch.setattr(W, "MAX_SIDE", 2)
    payload = np.random.default_rng(1).integers(0, 99, 576 * 7).astype(np.uint8).tobytes()
    media = W.encode_payload(payload)
    assert media.count(b"RIFF") == 4 and W.decode_payload(media) == payload


def test_damage_is_noticed():
    media = W.encode_payload(W.payload_of("some text " * 300))
    for bad in (media[:30], b"RIFX" + media[4:], media[:-40], media[:20] + b"\x00" + media[21:]):
        with pytest.raises(ValueError):
            W.decode(bad)


def test_query_columns(spark):
    texts = [(1, "a"), (2, None), (3, ""), (4, "a"), (5, "long " * 3000)]
    df = spark.createDataFrame([(i, t, b"") for i, t in texts], "doc_id long, text string, media binary")
    rows = {r.doc_id: r for r in W.digests(W.store(df)).collect()}
    for i, t in texts:
        payload = W.payload_of(t)
        r = rows[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len((t or "").encode()), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
    assert rows[1][1:] == rows[4][1:] and rows[2][1:] == rows[3][1:]
    pixels = W.pixel_arrays(W.store(df.filter("doc_id = 1"))).first()
    assert (pixels.width, pixels.height) == (144, 1) and pixels.pixels[3] == ord("a")


def test_empty_table(spark):
    assert W.digests(W.store(spark.createDataFrame([], "doc_id long, text string"))).count() == 0
