"""Lossless WebP (VP8L) in numpy: a whole decoder, and an encoder for 8-bit gray samples.

The decoder reads prefix codes of both kinds, meta prefix groups, back-references with the neighbourhood distance map
and the colour cache, and inverts the predictor, cross-colour, subtract-green and palette transforms. Where an image has
one prefix group whose red, blue and alpha codes hold one symbol each (gray and palette images), code lengths are looked
up for all bit positions at once and the chain of symbols is followed through them.

The encoder writes gray samples as subtract-green plus palette (with pixels bundled where the palette has at most 16
entries), back-references for repeated lines and for runs, and canonical prefix codes.
"""

from __future__ import annotations

import heapq
import struct
from functools import lru_cache

import numpy as np

# Fixed values of the format.
CODE_LENGTH_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
NEIGHBOURS = (
    (0, 1), (1, 0), (1, 1), (-1, 1), (0, 2), (2, 0), (1, 2), (-1, 2), (2, 1), (-2, 1), (2, 2), (-2, 2), (0, 3), (3, 0), (1, 3), (-1, 3),
    (3, 1), (-3, 1), (2, 3), (-2, 3), (3, 2), (-3, 2), (0, 4), (4, 0), (1, 4), (-1, 4), (4, 1), (-4, 1), (3, 3), (-3, 3), (2, 4), (-2, 4),
    (4, 2), (-4, 2), (0, 5), (3, 4), (-3, 4), (4, 3), (-4, 3), (5, 0), (1, 5), (-1, 5), (5, 1), (-5, 1), (2, 5), (-2, 5), (5, 2), (-5, 2),
    (4, 4), (-4, 4), (3, 5), (-3, 5), (5, 3), (-5, 3), (0, 6), (6, 0), (1, 6), (-1, 6), (6, 1), (-6, 1), (2, 6), (-2, 6), (6, 2), (-6, 2),
    (4, 5), (-4, 5), (5, 4), (-5, 4), (3, 6), (-3, 6), (6, 3), (-6, 3), (0, 7), (7, 0), (1, 7), (-1, 7), (5, 5), (-5, 5), (7, 1), (-7, 1),
    (4, 6), (-4, 6), (6, 4), (-6, 4), (2, 7), (-2, 7), (7, 2), (-7, 2), (3, 7), (-3, 7), (7, 3), (-7, 3), (5, 6), (-5, 6), (6, 5), (-6, 5),
    (8, 0), (4, 7), (-4, 7), (7, 4), (-7, 4), (8, 1), (8, 2), (6, 6), (-6, 6), (8, 3), (5, 7), (-5, 7), (7, 5), (-7, 5), (8, 4), (6, 7),
    (-6, 7), (7, 6), (-7, 6), (8, 5), (7, 7), (-7, 7), (8, 6), (8, 7),
)
CACHE_MULTIPLIER = 0x1E35A7BD
LENGTHS = 24
DISTANCES = 40
PREDICTOR, CROSS_COLOUR, SUBTRACT_GREEN, PALETTE = range(4)
OPAQUE = 0xFF000000
MAX_SIDE = 1 << 14


class Bits:
    """Reads bits from the least significant end of each byte."""

    def __init__(self, data: bytes) -> None:
        self.data, self.at, self.end = data + bytes(8), 0, 8 * len(data)

    def peek(self) -> int:
        i = self.at >> 3
        return int.from_bytes(self.data[i : i + 8], "little") >> (self.at & 7)

    def read(self, n: int) -> int:
        if self.at + n > self.end:
            raise ValueError("the image ends too early")
        got = self.peek() & ((1 << n) - 1)
        self.at += n
        return got


@lru_cache(16)
def _reversed(bits: int) -> np.ndarray:
    """Each number below 2**bits with its bits in the opposite order."""
    out = np.zeros(1, np.int32)
    for _ in range(bits):
        out = np.concatenate([out * 2, out * 2 + 1])
    return out


class PrefixCode:
    """A canonical prefix code: by the next `bits` bits, the symbol and its length. One symbol alone takes no bits."""

    def __init__(self, lengths: np.ndarray) -> None:
        lengths = np.asarray(lengths)
        used = np.flatnonzero(lengths)
        if len(used) <= 1:
            self.bits, self.only = 0, int(used[0]) if len(used) else 0
            self.symbols, self.sizes = np.array([self.only]), np.zeros(1, np.uint8)
            return
        self.only = None
        self.bits = bits = int(lengths.max())
        order = used[np.argsort(lengths[used], kind="stable")]
        share = 1 << (bits - lengths[order].astype(np.int64))
        if share.sum() != 1 << bits:
            raise ValueError("a prefix code isn't complete")
        back = _reversed(bits)
        self.symbols = np.repeat(order, share)[back]
        self.sizes = np.repeat(lengths[order], share).astype(np.uint8)[back]

    def read(self, bits: Bits) -> int:
        if self.only is not None:
            return self.only
        at = bits.peek() & ((1 << self.bits) - 1)
        bits.at += int(self.sizes[at])
        if bits.at > bits.end:
            raise ValueError("the image ends too early")
        return int(self.symbols[at])


def _read_code(bits: Bits, alphabet: int) -> PrefixCode:
    lengths = np.zeros(alphabet, np.int32)
    if bits.read(1):
        two, wide = bits.read(1), bits.read(1)
        lengths[bits.read(8 if wide else 1)] = 1
        if two:
            lengths[bits.read(8)] = 1
        return PrefixCode(lengths)
    of_lengths = np.zeros(19, np.int32)
    for k in range(4 + bits.read(4)):
        of_lengths[CODE_LENGTH_ORDER[k]] = bits.read(3)
    code = PrefixCode(of_lengths)
    left = 2 + bits.read(2 + 2 * bits.read(3)) if bits.read(1) else alphabet
    at, last = 0, 8
    while at < alphabet and left:
        left -= 1
        size = code.read(bits)
        if size < 16:
            lengths[at] = size
            last = size or last
            at += 1
            continue
        value, n = (last, 3 + bits.read(2)) if size == 16 else (0, 3 + bits.read(3)) if size == 17 else (0, 11 + bits.read(7))
        if at + n > alphabet:
            raise ValueError("too many code lengths")
        lengths[at : at + n] = value
        at += n
    return PrefixCode(lengths)


def _read_amount(bits: Bits, symbol: int) -> int:
    """A length or distance from its prefix symbol."""
    if symbol < 4:
        return symbol + 1
    extra = (symbol - 2) >> 1
    return ((2 + (symbol & 1)) << extra) + bits.read(extra) + 1


def _distance(code: int, width: int) -> int:
    if code > len(NEIGHBOURS):
        return code - len(NEIGHBOURS)
    x, y = NEIGHBOURS[code - 1]
    return max(1, x + y * width)


def _copy(out: np.ndarray, at: int, distance: int, n: int) -> None:
    if distance > at or at + n > len(out):
        raise ValueError("a back-reference leaves the image")
    while n:  # what a copy has written may be its own source
        some = min(n, distance)
        out[at : at + some] = out[at - distance : at - distance + some]
        at, n, distance = at + some, n - some, distance + some


def _pixels(bits: Bits, width: int, height: int, main: bool) -> np.ndarray:
    """An entropy-coded image as unsigned ARGB numbers in scan order."""
    cache_bits = bits.read(4) if bits.read(1) else 0
    if cache_bits > 11:
        raise ValueError("the colour cache is too large")
    which, block = None, 0
    if main and bits.read(1):
        block = bits.read(3) + 2
        across = -(-width >> block)
        which = (_pixels(bits, across, -(-height >> block), False) >> 8) & 0xFFFF
    groups = []
    for _ in range(int(which.max()) + 1 if which is not None else 1):
        groups.append([_read_code(bits, n) for n in (256 + LENGTHS + (1 << cache_bits if cache_bits else 0), 256, 256, 256, DISTANCES)])
    total = width * height
    green, red, blue, alpha, _ = groups[0]
    if len(groups) == 1 and not cache_bits and green.only is None and None not in (red.only, blue.only, alpha.only):
        return _gray_pixels(bits, groups[0], width, total)
    out = np.zeros(total, np.uint32)
    cache = np.zeros(1 << cache_bits, np.uint32)
    cached = 0
    at = 0

    def remember(upto: int) -> None:
        nonlocal cached
        if cache_bits and cached < upto:
            new = out[cached:upto]
            cache[((new.astype(np.uint64) * CACHE_MULTIPLIER & 0xFFFFFFFF) >> (32 - cache_bits)).astype(np.int64)] = new
            cached = upto

    while at < total:
        group = groups[0] if which is None else groups[int(which[(at // width >> block) * across + (at % width >> block)])]
        s = group[0].read(bits)
        if s < 256:
            r, b, a = group[1].read(bits), group[2].read(bits), group[3].read(bits)
            out[at] = a << 24 | r << 16 | s << 8 | b
            at += 1
        elif s < 256 + LENGTHS:
            n = _read_amount(bits, s - 256)
            _copy(out, at, _distance(_read_amount(bits, group[4].read(bits)), width), n)
            at += n
        else:
            remember(at)
            out[at] = cache[s - 256 - LENGTHS]
            at += 1
    return out


def _gray_pixels(bits: Bits, group: list[PrefixCode], width: int, total: int) -> np.ndarray:
    """_pixels where only the green code and back-references take bits."""
    green, red, blue, alpha, far = group
    start = bits.at >> 3
    raw = np.frombuffer(bits.data, np.uint8)[start:]
    words = raw[:-3].astype(np.uint32)
    for k in (1, 2, 3):
        words |= raw[k : len(raw) - 3 + k].astype(np.uint32) << np.uint32(8 * k)
    window = ((words[:, None] >> np.arange(8, dtype=np.uint32)) & np.uint32((1 << green.bits) - 1)).ravel()
    is_copy = green.symbols >= 256
    sizes = np.where(is_copy, 0, green.sizes).astype(np.uint8)[window].tobytes()
    first = 8 * start
    out = np.zeros(total, np.uint8)
    at, p = 0, bits.at - first
    limit = bits.end - first
    while at < total:
        chain: list[int] = []
        add = chain.append
        try:
            for _ in range(total - at):
                step = sizes[p]
                if not step:
                    break
                add(p)
                p += step
        except IndexError:
            p = limit + 1
        if p > limit:
            raise ValueError("the image ends too early")
        if chain:
            out[at : at + len(chain)] = green.symbols[window[chain]]
            at += len(chain)
        if at < total:
            bits.at = first + p
            n = _read_amount(bits, green.read(bits) - 256)
            _copy(out, at, _distance(_read_amount(bits, far.read(bits)), width), n)
            at += n
            p = bits.at - first
    bits.at = first + p
    return out.astype(np.uint32) << np.uint32(8) | np.uint32(alpha.only << 24 | red.only << 16 | blue.only)


def _channels(pixels: np.ndarray, height: int, width: int) -> np.ndarray:
    """(height, width, 4) bytes in the order blue, green, red, alpha."""
    return np.ascontiguousarray(pixels.astype("<u4")).view(np.uint8).reshape(height, width, 4)


def _average(a, b):
    return (a + b) >> 1


def _predict(mode: int, left, top, top_right, top_left):
    """One pixel's prediction from int vectors of four channels."""
    if mode == 5:
        return _average(_average(left, top_right), top)
    if mode == 6:
        return _average(left, top_left)
    if mode == 7:
        return _average(left, top)
    if mode == 10:
        return _average(_average(left, top_left), _average(top, top_right))
    if mode == 11:
        return left if abs(top - top_left).sum() < abs(left - top_left).sum() else top
    if mode == 12:
        return np.clip(left + top - top_left, 0, 255)
    if mode == 13:
        half = _average(left, top)
        return np.clip(half + np.trunc((half - top_left) / 2).astype(np.int64), 0, 255)
    raise ValueError("no such predictor")


def _undo_predictor(pixels: np.ndarray, modes: np.ndarray, block: int, width: int, height: int) -> np.ndarray:
    img = _channels(pixels, height, width).astype(np.int64)
    modes = (modes >> 8 & 0xF).reshape(-(-height >> block), -1)
    black = np.array([0, 0, 0, 255])
    img[0, 0] = (img[0, 0] + black) & 255
    img[0] = np.cumsum(img[0], axis=0) & 255
    for y in range(1, height):
        row, above = img[y], img[y - 1]
        row[0] = (row[0] + above[0]) & 255
        for x0 in range(0, width, 1 << block):
            a, b = max(1, x0), min(width, x0 + (1 << block))
            if a >= b:
                continue
            mode = int(modes[y >> block, x0 >> block])
            top, top_left = above[a:b], above[a - 1 : b - 1]
            top_right = np.concatenate([above[a + 1 : b + 1], row[:1]])[: b - a]  # past the last column: the row's first pixel
            if mode in (0, 14, 15):
                row[a:b] = (row[a:b] + black) & 255
            elif mode == 1:
                row[a:b] = np.cumsum(np.concatenate([row[a - 1 : a], row[a:b]]), axis=0)[1:] & 255
            elif mode in (2, 3, 4, 8, 9):
                guess = {2: top, 3: top_right, 4: top_left, 8: _average(top_left, top), 9: _average(top, top_right)}[mode]
                row[a:b] = (row[a:b] + guess) & 255
            else:
                for x in range(a, b):
                    row[x] = (row[x] + _predict(mode, row[x - 1], top[x - a], top_right[x - a], top_left[x - a])) & 255
    return img.astype(np.uint8).reshape(-1, 4).view("<u4").ravel()


def _undo_cross_colour(pixels: np.ndarray, factors: np.ndarray, block: int, width: int, height: int) -> np.ndarray:
    img = _channels(pixels, height, width).astype(np.int64)
    by_block = _channels(factors, -(-height >> block), -(-width >> block)).view(np.int8).astype(np.int64)
    each = by_block[np.arange(height)[:, None] >> block, np.arange(width)[None, :] >> block]
    green_to_red, green_to_blue, red_to_blue = each[..., 0], each[..., 1], each[..., 2]
    signed = lambda x: ((x & 255) ^ 128) - 128
    green = signed(img[..., 1])
    red = (img[..., 2] + (green_to_red * green >> 5)) & 255
    img[..., 2] = red
    img[..., 0] = (img[..., 0] + (green_to_blue * green >> 5) + (red_to_blue * signed(red) >> 5)) & 255
    return img.astype(np.uint8).reshape(-1, 4).view("<u4").ravel()


def _bundle_bits(colours: int) -> int:
    """Each byte of green holds 2**bits palette indices."""
    return 3 if colours <= 2 else 2 if colours <= 4 else 1 if colours <= 16 else 0


def _undo_palette(pixels: np.ndarray, palette: np.ndarray, bundle: int, width: int, height: int) -> np.ndarray:
    index = pixels >> np.uint32(8) & np.uint32(255)
    if bundle:
        each = 8 >> bundle
        parts = index[:, None] >> (np.arange(1 << bundle, dtype=np.uint32) * np.uint32(each)) & np.uint32((1 << each) - 1)
        index = parts.reshape(height, -1)[:, :width].ravel()
    whole = np.zeros(256, np.uint32)  # indices beyond the palette are transparent black
    whole[: len(palette)] = palette
    return whole[index]


def decode(data: bytes) -> np.ndarray:
    """The (height, width, 4) RGBA pixels of one lossless WebP file. ValueError where the file is broken."""
    if len(data) < 25 or data[:4] != b"RIFF" or data[8:16] != b"WEBPVP8L" or data[20] != 0x2F:
        raise ValueError("no lossless WebP file")
    (size,) = struct.unpack("<I", data[16:20])
    bits = Bits(data[21 : 20 + size])
    width, height = bits.read(14) + 1, bits.read(14) + 1
    has_alpha = bits.read(1)
    if bits.read(3):
        raise ValueError("unknown version")
    undo, full = [], width
    while bits.read(1):
        kind = bits.read(2)
        if kind in [x[0] for x in undo]:
            raise ValueError("a transform comes twice")
        if kind in (PREDICTOR, CROSS_COLOUR):
            block = bits.read(3) + 2
            undo.append((kind, _pixels(bits, -(-width >> block), -(-height >> block), False), block, width))
        elif kind == PALETTE:
            n = bits.read(8) + 1
            steps = _channels(_pixels(bits, n, 1, False), 1, n)[0]
            palette = np.ascontiguousarray(np.cumsum(steps, axis=0).astype(np.uint8)).view("<u4").ravel()
            undo.append((kind, palette, _bundle_bits(n), width))
            width = -(-width >> _bundle_bits(n))
        else:
            undo.append((kind, None, 0, width))
    pixels = _pixels(bits, width, height, True)
    for kind, side, block, width in reversed(undo):
        if kind == PREDICTOR:
            pixels = _undo_predictor(pixels, side, block, width, height)
        elif kind == CROSS_COLOUR:
            pixels = _undo_cross_colour(pixels, side, block, width, height)
        elif kind == PALETTE:
            pixels = _undo_palette(pixels, side, block, width, height)
        else:
            green = pixels >> np.uint32(8) & np.uint32(255)
            blue = (pixels + green) & np.uint32(255)
            red = (pixels >> np.uint32(16)) + green & np.uint32(255)
            pixels = pixels & np.uint32(0xFF00FF00) | red << np.uint32(16) | blue
    rgba = _channels(pixels, height, full)[..., [2, 1, 0, 3]]
    if not has_alpha:
        rgba[..., 3] = 255
    return rgba


def code_lengths(counts: np.ndarray, most: int = 13) -> np.ndarray:
    """Lengths of an optimal prefix code; counts are flattened until no code is longer than `most` bits."""
    out = np.zeros(len(counts), np.int32)
    used = np.flatnonzero(counts).tolist()
    if len(used) < 2:
        out[used] = 1
        return out
    weight = [int(counts[s]) for s in used]
    while True:
        n = len(used)
        heap = sorted((w, k) for k, w in enumerate(weight))
        parent = [0] * (2 * n - 1)
        for new in range(n, 2 * n - 1):
            w, a = heapq.heappop(heap)
            v, b = heap[0]
            parent[a] = parent[b] = new
            heapq.heapreplace(heap, (w + v, new))
        depth = [0] * (2 * n - 1)
        for k in range(2 * n - 3, -1, -1):
            depth[k] = depth[parent[k]] + 1
        if max(depth[:n]) <= most:
            out[used] = depth[:n]
            return out
        weight = [w >> 1 | 1 for w in weight]


def canonical(lengths: np.ndarray) -> np.ndarray:
    """The code of each symbol, first bit in the lowest place."""
    codes = np.zeros(len(lengths), np.int64)
    order = np.flatnonzero(lengths)
    order = order[np.argsort(lengths[order], kind="stable")]
    if len(order) < 2:
        return codes
    size = lengths[order].astype(np.int64)
    most = int(size.max())
    starts = np.concatenate([[0], np.cumsum(1 << (most - size))[:-1]])
    codes[order] = _reversed(most)[starts]
    return codes


class BitWriter:
    """Gathers (value, number of bits) and packs them from the least significant end."""

    def __init__(self) -> None:
        self.value, self.size = 0, 0
        self.parts: list[np.ndarray] = []

    def put(self, value: int, n: int) -> None:
        self.value |= value << self.size
        self.size += n

    def _flush(self) -> None:
        if self.size:
            raw = np.frombuffer(self.value.to_bytes((self.size + 7) // 8, "little"), np.uint8)
            self.parts.append(np.unpackbits(raw, count=self.size, bitorder="little"))
            self.value = self.size = 0

    def put_all(self, symbols: np.ndarray, codes: np.ndarray, lengths: np.ndarray) -> None:
        self._flush()
        most = np.arange(max(1, int(lengths.max())))
        bit = (codes[:, None] >> most & 1).astype(np.uint8)
        self.parts.append(bit[symbols][(most < lengths[:, None])[symbols]])

    def bytes(self) -> bytes:
        self._flush()
        return np.packbits(np.concatenate(self.parts), bitorder="little").tobytes()


def amount_prefix(n: int) -> tuple[int, int, int]:
    """(prefix symbol, extra bits, number of extra bits) of a length or distance code of at least 1."""
    if n <= 4:
        return n - 1, 0, 0
    n -= 1
    extra = n.bit_length() - 2
    return 2 * extra + 2 + (n >> extra & 1), n & ((1 << extra) - 1), extra


def put_single(bits: BitWriter, symbol: int) -> None:
    """A code of one symbol below 256."""
    bits.put(0b001 if symbol < 2 else 0b101, 3)
    bits.put(symbol, 1 if symbol < 2 else 8)


def put_lengths(bits: BitWriter, lengths: np.ndarray) -> None:
    """A code by its lengths of at most 13: they take four bits each, and runs of zeros are shortened."""
    bits.put(0, 1)
    bits.put(len(CODE_LENGTH_ORDER) - 4, 4)
    known = [*range(14), 17, 18]
    for s in CODE_LENGTH_ORDER:
        bits.put(4 if s in known else 0, 3)
    bits.put(0, 1)
    back = _reversed(4)
    values, at, n = lengths.tolist(), 0, len(lengths)
    while at < n:
        run = at
        while run < n and not values[run]:
            run += 1
        run = min(run - at, 138)
        if run < 3:
            bits.put(int(back[values[at]]), 4)
            at += 1
        elif run < 11:
            bits.put(int(back[14]), 4)
            bits.put(run - 3, 3)
            at += run
        else:
            bits.put(int(back[15]), 4)
            bits.put(run - 11, 7)
            at += run


@lru_cache(1)
def _flat() -> tuple[np.ndarray, np.ndarray]:
    lengths = np.full(256, 8, np.int64)
    return canonical(lengths), lengths


def _put_flat(bits: BitWriter) -> None:
    """A green code with eight bits for each of 256 literals: the code-length code has the length 8 alone."""
    bits.put(0, 1)
    bits.put(12 - 4, 4)  # up to length 8 in CODE_LENGTH_ORDER
    for s in CODE_LENGTH_ORDER[:12]:
        bits.put(1 if s == 8 else 0, 3)
    bits.put(1, 1)
    bits.put(3, 3)  # eight bits hold the number of lengths
    bits.put(256 - 2, 8)


def _put_palette(bits: BitWriter, values: np.ndarray) -> None:
    """Colours (255, 0, value, 0) as differences."""
    bits.put(1, 1)
    bits.put(PALETTE, 2)
    bits.put(len(values) - 1, 8)
    bits.put(0, 1)  # no colour cache
    _put_flat(bits)
    put_single(bits, 0)
    put_single(bits, 0)
    bits.put(0b111, 3)  # alpha: the two symbols 0 and 255
    bits.put(0, 8)
    bits.put(255, 8)
    put_single(bits, 0)
    steps = np.diff(values, prepend=0)
    codes, _ = _flat()
    for k, s in enumerate(steps.tolist()):
        bits.put(int(codes[s]), 8)
        bits.put(1 if k == 0 else 0, 1)


def _copies(payload: bytes, least: int = 24, most: int = 4096) -> list[tuple[int, int, int]]:
    """(position, length, distance) of repeated lines and of the run of spaces at the end, in order."""
    out, seen, at = [], {}, 0
    for line in payload.split(b"\n"):
        n = len(line)
        if n >= least:
            before = seen.get(line)
            if before is not None and at - before < 1 << 18:
                out += [(at + k, min(most, n - k), at - before) for k in range(0, n, most)]
            seen[line] = at
        at += n + 1
    tail = len(payload.rstrip(b" ")) + 1
    if len(payload) - tail >= 8 and not (out and out[-1][0] + out[-1][1] > tail):
        out += [(k, min(most, len(payload) - k), 1) for k in range(tail, len(payload), most)]
    return out


def encode_gray(samples: bytes, width: int) -> bytes:
    """A lossless WebP file of 8-bit gray samples; their number is a positive multiple of width."""
    n = len(samples)
    height = n // width
    if n != width * height or not 0 < width <= MAX_SIDE or not 0 < height <= MAX_SIDE:
        raise ValueError("the samples don't fill an image")
    raw = np.frombuffer(samples, np.uint8)
    counts = np.bincount(raw, minlength=256)
    values = np.flatnonzero(counts)
    place = np.zeros(256, np.int64)
    place[values] = np.arange(len(values))
    bits = BitWriter()
    bits.put(width - 1, 14)
    bits.put(height - 1, 14)
    bits.put(0, 4)
    bits.put(1, 1)
    bits.put(SUBTRACT_GREEN, 2)
    _put_palette(bits, values)
    bits.put(0, 1)  # no more transforms
    bits.put(0, 2)  # neither colour cache nor meta prefix groups
    symbols = place[raw]
    bundle = _bundle_bits(len(values))
    copies: list[tuple[int, int, int]] = []
    if bundle:
        per, each = 1 << bundle, 8 >> bundle
        rows = np.zeros((height, -(-width // per) * per), np.int64)
        rows[:, :width] = symbols.reshape(height, width)
        symbols = (rows.reshape(-1, per) << (np.arange(per) * each)).sum(axis=1)
    else:
        copies = _copies(samples)
    marks, far_symbols = [], []
    if copies:
        keep = np.ones(n, bool)
        for at, size, distance in copies:
            keep[at : at + size] = False
            keep[at] = True
            a, b = amount_prefix(size), amount_prefix(distance + len(NEIGHBOURS))
            symbols[at] = 256 + a[0]
            far_symbols.append(b[0])
            marks.append((a, b))
        symbols = symbols[keep]
    lengths = code_lengths(np.bincount(symbols, minlength=256 + LENGTHS))
    if np.count_nonzero(lengths) == 1 and not copies and (s := int(symbols[0])) < 256:
        put_single(bits, s)
    else:
        if np.count_nonzero(lengths) == 1:
            lengths[0] = 1
        put_lengths(bits, lengths)
    for _ in range(3):
        put_single(bits, 0)
    far = code_lengths(np.bincount(far_symbols, minlength=DISTANCES)) if far_symbols else np.zeros(DISTANCES, np.int32)
    if np.count_nonzero(far) <= 1:
        put_single(bits, int(far_symbols[0]) if far_symbols else 0)
    else:
        put_lengths(bits, far)
    codes, far_codes = canonical(lengths), canonical(far)
    single = np.count_nonzero(lengths) == 1
    start = 0
    for where, (a, b) in zip(np.flatnonzero(symbols >= 256).tolist(), marks, strict=True):
        bits.put_all(symbols[start : where + 1], codes, lengths)
        bits.put(a[1], a[2])
        if np.count_nonzero(far) > 1:
            bits.put(int(far_codes[b[0]]), int(far[b[0]]))
        bits.put(b[1], b[2])
        start = where + 1
    if start < len(symbols) and not single:
        bits.put_all(symbols[start:], codes, lengths)
    body = b"\x2f" + bits.bytes()
    padded = body + bytes(len(body) & 1)
    return b"RIFF" + struct.pack("<I", 12 + len(padded)) + b"WEBPVP8L" + struct.pack("<I", len(body)) + padded
