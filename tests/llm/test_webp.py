"""The decoder against images that an independent, plain encoder writes with each feature of the format."""

from __future__ import annotations

import struct

import numpy as np
import pytest

from ravelin.llm import media, webp


class Writer:
    def __init__(self):
        self.bits = []

    def put(self, value, n):
        self.bits += [value >> k & 1 for k in range(n)]

    def flat(self, alphabet, used):
        """A code with eight bits for each of the first 256 symbols, or nine where 512 are used; returns its coder."""
        size = used.bit_length() - 1
        self.put(0, 1)
        self.put(15, 4)
        for s in webp.CODE_LENGTH_ORDER:
            self.put(1 if s in (size, 0) else 0, 3)
        self.put(0, 1)
        for k in range(alphabet):  # the code of the two lengths: 0 for length 0, 1 for the other
            self.put(1 if k < used else 0, 1)
        return lambda s: [s >> k & 1 for k in range(size - 1, -1, -1)]

    def codes(self, cache_bits=0):
        green = 280 + (1 << cache_bits if cache_bits else 0)
        return [self.flat(green, 256 if green == 280 else 512) if green in (280, 280 + 1024) else None, self.flat(256, 256), self.flat(256, 256), self.flat(256, 256), self.single()]

    def single(self, symbol=0):
        self.put(1, 1)
        self.put(0, 1)
        self.put(0, 1)
        self.put(symbol, 1)
        return lambda s: []

    def image(self, pixels, main=True):
        """Literals only: pixels are rows of (r, g, b, a)."""
        self.put(0, 1)
        if main:
            self.put(0, 1)
        green, red, blue, alpha, _ = self.codes()
        for r, g, b, a in pixels.reshape(-1, 4).tolist():
            self.bits += green(g) + red(r) + blue(b) + alpha(a)

    def file(self, width, height, alpha=True):
        head = Writer()
        head.put(width - 1, 14)
        head.put(height - 1, 14)
        head.put(int(alpha), 1)
        head.put(0, 3)
        body = b"\x2f" + np.packbits(np.array(head.bits + self.bits, np.uint8), bitorder="little").tobytes()
        body += b"" if len(body) % 2 == 0 else b"\0"
        return b"RIFF" + struct.pack("<I", len(body) + 12) + b"WEBPVP8L" + struct.pack("<I", len(body)) + body


@pytest.fixture
def image():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 256, (11, 13, 4))
    return ((base + np.arange(13)[None, :, None] * 3) % 256).astype(np.int64)


def test_literals(image):
    w = Writer()
    w.put(0, 1)
    w.image(image)
    assert (webp.decode(w.file(13, 11)) == image).all()
    opaque = webp.decode(w.file(13, 11, alpha=False))
    assert (opaque[..., :3] == image[..., :3]).all() and (opaque[..., 3] == 255).all()


def test_subtract_green(image):
    w = Writer()
    w.put(1, 1)
    w.put(2, 2)
    w.put(0, 1)
    sent = image.copy()
    sent[..., 0] = (sent[..., 0] - sent[..., 1]) % 256
    sent[..., 2] = (sent[..., 2] - sent[..., 1]) % 256
    w.image(sent)
    assert (webp.decode(w.file(13, 11)) == image).all()


def predicted(mode, img, x, y):
    px = lambda a, b: img[b, a].tolist()
    left, top, tl = px(x - 1, y), px(x, y - 1), px(x - 1, y - 1)
    tr = px(x + 1, y - 1) if x + 1 < img.shape[1] else px(0, y)
    avg = lambda p, q: [(i + j) // 2 for i, j in zip(p, q, strict=True)]
    clip = lambda v: max(0, min(255, v))
    if mode == 11:
        pl = sum(abs(t - c) for t, c in zip(top, tl, strict=True))
        pt = sum(abs(s - c) for s, c in zip(left, tl, strict=True))
        return left if pl < pt else top
    if mode == 12:
        return [clip(a + b - c) for a, b, c in zip(left, top, tl, strict=True)]
    if mode == 13:
        return [clip(a + int((a - c) / 2)) for a, c in zip(avg(left, top), tl, strict=True)]
    return {
        0: [0, 0, 0, 255], 1: left, 2: top, 3: tr, 4: tl, 5: avg(avg(left, tr), top), 6: avg(left, tl), 7: avg(left, top), 8: avg(tl, top), 9: avg(top, tr),
        10: avg(avg(left, tl), avg(top, tr)),
    }[mode]


@pytest.mark.parametrize("modes", [[m] * 12 for m in range(14)] + [[11, 12, 13, 5, 1, 2, 3, 4, 0, 6, 7, 10]])
def test_predictors(image, modes):
    w = Writer()
    w.put(1, 1)
    w.put(0, 2)
    w.put(0, 3)  # blocks of four
    grid = np.zeros((3, 4, 4), np.int64)
    grid[..., 1] = np.array(modes).reshape(3, 4)
    w.image(grid, main=False)
    w.put(0, 1)
    sent = image.copy()
    for y in range(11):
        for x in range(13):
            guess = [0, 0, 0, 255] if x == y == 0 else image[0, x - 1] if y == 0 else image[y - 1, 0] if x == 0 else predicted(int(grid[y // 4, x // 4, 1]), image, x, y)
            sent[y, x] = (image[y, x] - np.array(guess)) % 256
    w.image(sent)
    assert (webp.decode(w.file(13, 11)) == image).all()


def test_cross_colour(image):
    w = Writer()
    w.put(1, 1)
    w.put(1, 2)
    w.put(0, 3)
    rng = np.random.default_rng(9)
    grid = rng.integers(0, 256, (3, 4, 4))  # red_to_blue, green_to_blue, green_to_red, -
    w.image(grid, main=False)
    w.put(0, 1)
    sent = image.copy()
    signed = lambda v: v - 256 if v > 127 else v
    for y in range(11):
        for x in range(13):
            rb, gb, gr, _ = (signed(int(v)) for v in grid[y // 4, x // 4])
            r, g, b, _ = (int(v) for v in image[y, x])
            sent[y, x, 0] = (r - (gr * signed(g) >> 5)) % 256
            sent[y, x, 2] = (b - (gb * signed(g) >> 5) - (rb * signed(r) >> 5)) % 256
    w.image(sent)
    assert (webp.decode(w.file(13, 11)) == image).all()


@pytest.mark.parametrize("colours", [2, 3, 4, 11, 16, 40])
def test_palettes(colours):
    rng = np.random.default_rng(colours)
    palette = rng.integers(0, 256, (colours, 4))
    index = rng.integers(0, colours, (6, 13))
    w = Writer()
    w.put(1, 1)
    w.put(3, 2)
    w.put(colours - 1, 8)
    w.image(np.diff(palette, axis=0, prepend=0) % 256, main=False)
    w.put(0, 1)
    per = 8 if colours <= 2 else 4 if colours <= 4 else 2 if colours <= 16 else 1
    wide = -(-13 // per)
    sent = np.zeros((6, wide, 4), np.int64)
    for y in range(6):
        for x in range(13):
            sent[y, x // per, 1] |= int(index[y, x]) << (x % per) * (8 // per)
    w.image(sent)
    assert (webp.decode(w.file(13, 6)) == palette[index]).all()


def test_copies_and_cache():
    """A plain stream of literals, copies by the distance map and by number, and cache hits."""
    first, second = (10, 20, 30, 40), (50, 60, 70, 80)
    w = Writer()
    w.put(0, 1)
    w.put(1, 1)
    w.put(1, 4)  # a cache of two colours
    w.put(0, 1)
    lengths = np.zeros(282, np.int64)
    for s in (20, 60, 256 + 2, 256 + 5, 280, 281):
        lengths[s] = 3
    lengths[20] = lengths[60] = 2
    lengths[281] = lengths[280] = 3
    codes = {}
    bits = webp.BitWriter()
    webp.put_lengths(bits, lengths)
    for s in np.flatnonzero(lengths):
        codes[int(s)] = (int(webp.canonical(lengths)[s]), int(lengths[s]))
    body = np.unpackbits(np.frombuffer(bits.value.to_bytes((bits.size + 7) // 8, "little"), np.uint8), bitorder="little")[: bits.size]
    w.bits += body.tolist()
    for channel in (0, 2, 3):
        w.put(1, 1)
        w.put(1, 1)
        w.put(1, 1)
        w.put(first[channel], 8)
        w.put(second[channel], 8)
    w.put(1, 1)  # distances: symbols 1 (the pixel to the left) and 14 (with extra bits)
    w.put(1, 1)
    w.put(1, 1)
    w.put(1, 8)
    w.put(14, 8)
    out = []
    literal = lambda p, k: (w.put(*codes[p[1]]), [w.put(k, 1) for _ in range(3)], out.append(p))
    literal(first, 0)
    literal(second, 1)
    w.put(*codes[261])  # length symbol 5 is seven and one bit: eight pixels, from the left one
    w.put(1, 1)
    w.put(0, 1)
    out += [second] * 8
    slot = lambda p: (0x1E35A7BD * (p[3] << 24 | p[0] << 16 | p[1] << 8 | p[2]) & 0xFFFFFFFF) >> 31
    hit = first if slot(first) != slot(second) else second
    w.put(*codes[280 + slot(hit)])
    out.append(hit)
    w.put(*codes[258])  # three pixels, by distance symbol 14 with six bits: 129 - 120 back
    w.put(1, 1)
    w.put(0, 6)
    for _ in range(3):
        out.append(out[-9])
    assert [tuple(p) for p in webp.decode(w.file(14, 1))[0].tolist()] == out


def test_meta_prefix_groups(image):
    """Two groups by blocks: the second one's codes hold a single colour."""
    w = Writer()
    w.put(0, 1)
    w.put(0, 1)
    w.put(1, 1)
    w.put(0, 3)
    grid = np.zeros((3, 4, 4), np.int64)
    grid[1, 2, 1] = grid[2, 0, 1] = 1
    w.image(grid, main=False)
    green, red, blue, alpha, _ = w.codes()
    for _ in range(5):
        w.single(1)
    for y in range(11):
        for x in range(13):
            if grid[y // 4, x // 4, 1]:
                image[y, x] = 1
            else:
                r, g, b, a = image[y, x].tolist()
                w.bits += green(g) + red(r) + blue(b) + alpha(a)
    assert (webp.decode(w.file(13, 11)) == image).all()


def test_all_transforms_together(image):
    w = Writer()
    w.put(1, 1)
    w.put(2, 2)
    sent = image.copy()
    sent[..., 0] = (sent[..., 0] - sent[..., 1]) % 256
    sent[..., 2] = (sent[..., 2] - sent[..., 1]) % 256
    w.put(1, 1)
    w.put(0, 2)
    w.put(2, 3)
    grid = np.zeros((1, 1, 4), np.int64)
    grid[..., 1] = 7
    w.image(grid, main=False)
    w.put(0, 1)
    left = sent.copy()
    for y in range(11):
        for x in range(13):
            guess = [0, 0, 0, 255] if x == y == 0 else sent[0, x - 1] if y == 0 else sent[y - 1, 0] if x == 0 else predicted(7, sent, x, y)
            left[y, x] = (sent[y, x] - np.array(guess)) % 256
    w.image(left)
    assert (webp.decode(w.file(13, 11)) == image).all()


@pytest.mark.parametrize("payload", [b" " * 192, b"a" * 576, bytes(range(256)) * 3, b"ab" * 96, (b"a line that stands here again and again\n" * 50)[:1920], b"x" + b" " * 191])
def test_round_trips(payload):
    files = media.encode_payload(payload)
    assert media.decode_samples(files).tobytes() == payload
    assert (webp.decode(files)[..., 3] == 255).all()


def test_several_images(monkeypatch):
    monkeypatch.setattr(media, "MOST", 192 * 4)
    payload = bytes(range(192)) * 11
    assert len(media.split_files(media.encode_payload(payload))) == 3
    assert media.decode_samples(media.encode_payload(payload)).tobytes() == payload


@pytest.mark.parametrize("broken", [b"", b"RIFF", webp.encode_gray(b"abc" * 64, 192)[:40], webp.encode_gray(bytes(range(192)), 192)[:-60]])
def test_broken_files(broken):
    with pytest.raises(ValueError):
        webp.decode(broken)


def test_code_lengths_are_bounded():
    counts = np.array([1, 1] + [2**k for k in range(1, 30)])
    lengths = webp.code_lengths(counts, 13)
    assert lengths.max() <= 13 and sum(2.0**-k for k in lengths.tolist()) == 1


def test_pixels_column(spark):
    from ravelin.llm import media as m

    frame = m.store(spark.createDataFrame([(1, "hello"), (2, None)], "doc_id long, text string"))
    rows = m.pixels(frame).collect()
    assert [(r.pixels[0].width, r.pixels[0].height) for r in rows] == [(192, 1), (192, 1)]
    assert bytes(rows[0].pixels[0].rgba)[:8] == b"hhh\xffeee\xff"
