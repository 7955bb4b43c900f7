"""Media columns in lossless WebP (VP8L, RFC 9649): a decoder to pixel arrays, and an encoder to store samples.

The decoder reads every feature of the format: simple and normal prefix codes, meta prefix codes, back-references,
the colour cache, and the predictor, cross-colour, subtract-green and palette transforms. Where one set of codes covers
an image and only the green code takes bits (grey samples), the codes are looked up at all bit positions at once, and
positions are linked eight codes ahead; other images are decoded pixel by pixel.

The encoder stores bytes as grey pixels (red = green = blue) in rows of 64, or packs them through a palette when there
are at most 16 values; zero padding and repeated lines become back-references. Its other options (predictor,
cross-colour, colour cache, meta codes) serve callers with real images.

Defined results: null texts are empty payloads; a payload is padded with zero bytes to a positive multiple of 64;
more than 16,384 rows go to further images, concatenated; equal payloads give equal bytes; damaged media raise
``ValueError`` rather than give wrong pixels; repeated rows are stored each; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import zlib
from collections.abc import Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import pieces, utf8

WIDTH, MOST_ROWS = 64, 16_384
# Fixed values of the format.
LENGTH_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
PREDICTOR, CROSS, GREEN, PALETTE = range(4)
LITERALS, LENGTH_CODES, DISTANCE_CODES = 256, 24, 40
HASH_MULTIPLIER = 0x1E35A7BD
#: Neighbour offsets (x, y) of the 120 short distance codes: nearest first, then by |x|, left after right.
NEAR = sorted(((x, y) for y in range(8) for x in range(-7, 9) if y or x > 0), key=lambda p: (p[0] ** 2 + p[1] ** 2, abs(p[0]), p[0] < 0))
MOST_BITS = 12


# ---------------------------------------------------------------- prefix codes


def code_lengths(counts: Sequence[int], most: int) -> list[int]:
    """Huffman code lengths of at most ``most`` bits."""
    used = [i for i, c in enumerate(counts) if c]
    out = [0] * len(counts)
    if len(used) < 2:
        for i in used:
            out[i] = 1
        return out
    weights = [counts[i] for i in used]
    while True:
        heap = [(w, i) for i, w in enumerate(weights)]
        heapq.heapify(heap)
        parent = [0] * (2 * len(used) - 1)
        for node in range(len(used), 2 * len(used) - 1):
            a = heapq.heappop(heap)
            b = heap[0]
            parent[a[1]] = parent[b[1]] = node
            heapq.heapreplace(heap, (a[0] + b[0], node))
        depth = [0] * len(parent)
        for node in range(len(parent) - 2, -1, -1):
            depth[node] = depth[parent[node]] + 1
        if max(depth[: len(used)]) <= most:
            for i, d in zip(used, depth):
                out[i] = d
            return out
        weights = [(w >> 2) + 1 for w in weights]


def codes(lengths: Sequence[int]) -> list[int]:
    """Canonical codes, bit-reversed as the stream has them."""
    out, code = [0] * len(lengths), 0
    order = sorted((n, i) for i, n in enumerate(lengths) if n)
    last = 0
    for n, i in order:
        code <<= n - last
        last = n
        out[i] = int(f"{code:0{n}b}"[::-1], 2)
        code += 1
    return out


class Code:
    """A prefix code for reading: a table over the next ``bits`` bits of symbol << 8 | length."""

    def __init__(self, lengths: Sequence[int]):
        used = [i for i, n in enumerate(lengths) if n]
        if not used:
            raise ValueError("an empty prefix code")
        self.only = used[0] if len(used) == 1 else None
        if self.only is not None:
            self.bits, self.table = 0, np.array([self.only << 8], np.uint32)
        else:
            if sum(1 << (15 - n) for n in lengths if n) != 1 << 15:
                raise ValueError("a prefix code that isn't complete")
            self.bits = max(lengths)
            self.table = np.zeros(1 << self.bits, np.uint32)
            for i, c in zip(used, [codes(lengths)[i] for i in used] if len(used) < 3 else _picked(lengths, used)):
                self.table[c :: 1 << lengths[i]] = i << 8 | lengths[i]
        self.list: list[int] | None = None

    def read(self, bits: "Bits") -> int:
        if self.only is not None:
            return self.only
        if self.list is None:
            self.list = self.table.tolist()
        entry = self.list[bits.peek(self.bits)]
        bits.at += entry & 255
        return entry >> 8


def _picked(lengths: Sequence[int], used: list[int]) -> list[int]:
    all_codes = codes(lengths)
    return [all_codes[i] for i in used]


@lru_cache(maxsize=256)
def _code(lengths: tuple[int, ...]) -> Code:
    return Code(lengths)


class Bits:
    def __init__(self, data: bytes):
        self.data, self.at, self.end = data + b"\0" * 16, 0, 8 * len(data)

    def peek(self, n: int) -> int:
        i = self.at >> 3
        return int.from_bytes(self.data[i : i + 8], "little") >> (self.at & 7) & ((1 << n) - 1)

    def read(self, n: int) -> int:
        value = self.peek(n)
        self.at += n
        if self.at > self.end:
            raise ValueError("the stream ends early")
        return value


# ---------------------------------------------------------------- decoding


def _read_code(bits: Bits, size: int) -> Code:
    lengths = [0] * size
    if bits.read(1):
        many = bits.read(1) + 1
        symbols = [bits.read(8 if bits.read(1) else 1)] + [bits.read(8) for _ in range(many - 1)]
        for s in symbols:
            lengths[s] = 1
        return _code(tuple(lengths))
    own = [0] * 19
    for i in range(4 + bits.read(4)):
        own[LENGTH_ORDER[i]] = bits.read(3)
    code = _code(tuple(own))
    left = 2 + bits.read(2 + 2 * bits.read(3)) if bits.read(1) else size
    i, last = 0, 8
    while i < size and left:
        left -= 1
        token = code.read(bits)
        if token < 16:
            lengths[i] = token
            last = token or last
            i += 1
            continue
        value, many = (last, 3 + bits.read(2)) if token == 16 else (0, 3 + bits.read(3)) if token == 17 else (0, 11 + bits.read(7))
        if i + many > size:
            raise ValueError("code lengths run over")
        lengths[i : i + many] = [value] * many
        i += many
    return _code(tuple(lengths))


def _value(bits: Bits, prefix: int) -> int:
    if prefix < 4:
        return prefix + 1
    extra = (prefix - 2) >> 1
    return ((2 + (prefix & 1)) << extra) + bits.read(extra) + 1


def _distance(code: int, width: int) -> int:
    if code > 120:
        return code - 120
    x, y = NEAR[code - 1]
    return max(1, x + y * width)


def _copy(out: np.ndarray, at: int, length: int, distance: int) -> None:
    if distance > at or at + length > len(out):
        raise ValueError("a back-reference leaves the image")
    source = out[at - distance : at - distance + length]
    out[at : at + length] = source if len(source) == length and distance >= length else np.resize(out[at - distance : at], length)


def _grey_run(bits: Bits, width: int, count: int, group: list[Code]) -> np.ndarray:
    """Pixels of one group of codes of which only green (and distance) takes bits, without a cache."""
    green, red, blue, alpha, distance = group
    fixed = np.uint32(alpha.only << 24 | red.only << 16 | blue.only)
    out = np.zeros(count, np.uint8)
    first = bits.at >> 3
    data = np.frombuffer(bits.data, np.uint8)[first:]
    window = data[:-3].astype(np.uint32)
    for i in range(1, 4):
        window |= data[i : len(data) - 3 + i].astype(np.uint32) << np.uint32(8 * i)
    at_all = ((window[:, None] >> np.arange(8, dtype=np.uint32)) & np.uint32((1 << green.bits) - 1)).ravel()
    entry = green.table[at_all]
    n = len(entry)
    step = np.arange(n, dtype=np.int32)
    one = step + np.where(entry < LITERALS << 8, entry & np.uint32(255), 0).astype(np.int32)
    one[n - 16 :] = step[n - 16 :]  # the padding is never left
    two = one[one]
    four = two[two]
    eight = four[four]
    jump, single, symbol = memoryview(eight), memoryview(one), memoryview(entry)
    done, p = 0, bits.at - 8 * first
    limit = bits.end - 8 * first
    while done < count:
        starts = []
        for _ in range((count - done + 7) // 8):
            starts.append(p)
            p = jump[p]
            if single[p] == p:
                break
        s = np.array(starts, np.int32)
        for hop in (four, two, one):
            s = np.stack([s, hop[s]], axis=1).ravel()
        if single[p] == p:
            s = s[: np.searchsorted(s, p)]
        s = s[: count - done]
        out[done : done + len(s)] = entry[s] >> np.uint32(8)
        done += len(s)
        if done == count:
            p = single[int(s[-1])] if len(s) else p
            break
        if single[p] == p:
            if p >= limit:
                raise ValueError("the stream ends early")
            bits.at = 8 * first + p + (symbol[p] & 255)
            length = _value(bits, (symbol[p] >> 8) - LITERALS)
            _copy(out, done, length, _distance(_value(bits, distance.read(bits)), width))
            done += length
            p = bits.at - 8 * first
    bits.at = 8 * first + p
    if bits.at > bits.end:
        raise ValueError("the stream ends early")
    return fixed | out.astype(np.uint32) << np.uint32(8)


def _pixels(bits: Bits, width: int, height: int, top: bool) -> np.ndarray:
    """An entropy-coded image as ARGB in one row of width * height."""
    cache_bits = bits.read(4) if bits.read(1) else 0
    if cache_bits > 11:
        raise ValueError("a colour cache of more than 11 bits")
    meta, meta_bits = None, 0
    if top and bits.read(1):
        meta_bits = bits.read(3) + 2
        meta_width = -(-width >> meta_bits)
        meta = (_pixels(bits, meta_width, -(-height >> meta_bits), False) >> np.uint32(8) & np.uint32(0xFFFF)).tolist()
    sizes = (LITERALS + LENGTH_CODES + (1 << cache_bits if cache_bits else 0), 256, 256, 256, DISTANCE_CODES)
    groups = [[_read_code(bits, size) for size in sizes] for _ in range(max(meta) + 1 if meta else 1)]
    count = width * height
    if not meta and not cache_bits and all(c.only is not None for c in groups[0][1:4]) and groups[0][0].only is None:
        return _grey_run(bits, width, count, groups[0])
    out = np.zeros(count, np.uint32)
    cache, shift, cached = [0] * (1 << cache_bits), 32 - cache_bits, 0
    at = 0
    while at < count:
        group = groups[meta[(at // width >> meta_bits) * meta_width + (at % width >> meta_bits)] if meta else 0]
        symbol = group[0].read(bits)
        if symbol < LITERALS:
            red, blue, alpha = group[1].read(bits), group[2].read(bits), group[3].read(bits)
            out[at] = alpha << 24 | red << 16 | symbol << 8 | blue
            at += 1
        elif symbol < LITERALS + LENGTH_CODES:
            length = _value(bits, symbol - LITERALS)
            _copy(out, at, length, _distance(_value(bits, group[4].read(bits)), width))
            at += length
        else:
            for colour in out[cached:at].tolist():
                cache[HASH_MULTIPLIER * colour >> shift & ((1 << cache_bits) - 1)] = colour
            cached = at
            out[at] = cache[symbol - LITERALS - LENGTH_CODES]
            at += 1
        if bits.at > bits.end:
            raise ValueError("the stream ends early")
    return out


def _channels(argb: np.ndarray) -> np.ndarray:
    return np.stack([(argb >> np.uint32(s)) & np.uint32(255) for s in (24, 16, 8, 0)], axis=-1).astype(np.int32)


def _argb(channels: np.ndarray) -> np.ndarray:
    c = (channels & 255).astype(np.uint32)
    return c[..., 0] << np.uint32(24) | c[..., 1] << np.uint32(16) | c[..., 2] << np.uint32(8) | c[..., 3]


def predicted(mode: np.ndarray, left: np.ndarray, top: np.ndarray, right: np.ndarray, corner: np.ndarray) -> np.ndarray:
    """Prediction of each pixel (rows of A, R, G, B) from its neighbours, by mode 0 to 13."""
    mean = lambda a, b: (a + b) >> 1
    near_left = np.abs(top - corner).sum(axis=1) < np.abs(left - corner).sum(axis=1)
    black = np.zeros_like(left)
    black[:, 0] = 255
    half = mean(left, top)
    diff = half - corner
    choices = (
        black, left, top, right, corner,
        mean(mean(left, right), top), mean(left, corner), half, mean(corner, top), mean(top, right),
        mean(mean(left, corner), mean(top, right)),
        np.where(near_left[:, None], left, top),
        np.clip(left + top - corner, 0, 255),
        np.clip(half + np.where(diff < 0, -(-diff // 2), diff // 2), 0, 255),
    )
    out = np.zeros_like(left)
    for m in np.unique(mode).tolist():
        at = mode == m
        out[at] = choices[m if m < 14 else 0][at]
    return out


def _modes(image: np.ndarray, size_bits: int, height: int, width: int) -> np.ndarray:
    y, x = np.arange(height)[:, None] >> size_bits, np.arange(width)[None, :] >> size_bits
    return image.reshape(-1, -(-width >> size_bits))[y, x]


def _fronts(height: int, width: int):
    """Pixels in an order in which each front needs only earlier ones: by x + 2 y."""
    for front in range(width + 2 * (height - 1)):
        y = np.arange(max(0, (front - width + 2) // 2), min(height - 1, front // 2) + 1)
        yield y, front - 2 * y


def _neighbours(c: np.ndarray, y: np.ndarray, x: np.ndarray, mode: np.ndarray):
    height, width = c.shape[:2]
    up, left = np.maximum(y - 1, 0), np.maximum(x - 1, 0)
    beyond = x + 1 == width
    right = c[np.where(beyond, y, up), np.where(beyond, 0, x + 1)]
    mode = np.where(y == 0, np.where(x == 0, 0, 1), np.where(x == 0, 2, mode))
    return mode, c[y, left], c[up, x], right, c[up, left]


def _unpredict(argb: np.ndarray, image: np.ndarray, size_bits: int) -> np.ndarray:
    c = _channels(argb)
    mode = _modes(image >> np.uint32(8) & np.uint32(15), size_bits, *argb.shape).astype(np.int64)
    for y, x in _fronts(*argb.shape):
        c[y, x] = (c[y, x] + predicted(*_neighbours(c, y, x, mode[y, x]))) & 255
    return _argb(c)


def _signed(x: np.ndarray) -> np.ndarray:
    return ((x & 255) ^ 128) - 128


def _cross(argb: np.ndarray, image: np.ndarray, size_bits: int, sign: int) -> np.ndarray:
    """Cross-colour: ``sign`` 1 inverts the transform, -1 applies it."""
    c = _channels(argb)
    element = _modes(image, size_bits, *argb.shape).astype(np.int64)
    green_red, green_blue, red_blue = (_signed(element >> s) for s in (0, 8, 16))
    green, red = _signed(c[..., 2]), c[..., 1]
    fresh = (red + sign * (green_red * green >> 5)) & 255
    blue = c[..., 3] + sign * (green_blue * green >> 5) + sign * (red_blue * _signed(fresh if sign > 0 else red) >> 5)
    c[..., 1], c[..., 3] = fresh, blue & 255
    return _argb(c)


def _subtract_green(argb: np.ndarray, sign: int) -> np.ndarray:
    green = argb >> np.uint32(8) & np.uint32(255)
    if sign > 0:
        both = (argb & np.uint32(0x00FF00FF)) + (green << np.uint32(16) | green)
    else:
        both = (argb & np.uint32(0x00FF00FF)) + np.uint32(0x01000100) - (green << np.uint32(16) | green)
    return argb & np.uint32(0xFF00FF00) | both & np.uint32(0x00FF00FF)


def _unpack(argb: np.ndarray, palette: np.ndarray, width: int) -> np.ndarray:
    index = argb >> np.uint32(8) & np.uint32(255)
    bits = _bundle(len(palette))
    if bits:
        each = 8 >> bits
        index = (index[:, :, None] >> np.arange(0, 8, each, dtype=np.uint32) & np.uint32((1 << each) - 1)).reshape(len(argb), -1)[:, :width]
    table = np.zeros(256, np.uint32)
    table[: len(palette)] = palette
    return table[index]


def _bundle(n: int) -> int:
    return 3 if n <= 2 else 2 if n <= 4 else 1 if n <= 16 else 0


def decode(media: bytes) -> np.ndarray:
    """The ARGB pixels (height, width) of one lossless WebP file."""
    if media[:4] != b"RIFF" or media[8:16] != b"WEBPVP8L":
        raise ValueError("not a lossless WebP file")
    bits = Bits(media[20 : 20 + int.from_bytes(media[16:20], "little")])
    if bits.read(8) != 0x2F:
        raise ValueError("no VP8L signature")
    full = width = bits.read(14) + 1
    height = bits.read(14) + 1
    bits.read(1)
    if bits.read(3):
        raise ValueError("an unknown version")
    transforms: list[tuple] = []
    while bits.read(1):
        kind = bits.read(2)
        if kind in {t[0] for t in transforms}:
            raise ValueError("a transform is used twice")
        if kind in (PREDICTOR, CROSS):
            size_bits = bits.read(3) + 2
            transforms.append((kind, _pixels(bits, -(-width >> size_bits), -(-height >> size_bits), False), size_bits))
        elif kind == GREEN:
            transforms.append((kind,))
        else:
            size = bits.read(8) + 1
            palette = _argb(np.cumsum(_channels(_pixels(bits, size, 1, False)), axis=0))
            transforms.append((kind, palette, width))
            width = -(-width >> _bundle(size))
    argb = _pixels(bits, width, height, True).reshape(height, width)
    for kind, *given in reversed(transforms):
        if kind == PREDICTOR:
            argb = _unpredict(argb, *given)
        elif kind == CROSS:
            argb = _cross(argb, *given, 1)
        elif kind == GREEN:
            argb = _subtract_green(argb, 1)
        else:
            argb = _unpack(argb, *given)
    if argb.shape != (height, full):
        raise ValueError("the image has another size")
    return argb


# ---------------------------------------------------------------- encoding


class Writer:
    def __init__(self):
        self.value = self.at = 0

    def put(self, value: int, n: int) -> None:
        self.value |= value << self.at
        self.at += n

    def put_many(self, values: np.ndarray, lengths: np.ndarray) -> None:
        """Fields of at most 20 bits each; sums of disjoint bits are exact in doubles."""
        ends = np.cumsum(lengths)
        offset = ends - lengths
        sums = np.bincount(offset >> 5, (values << (offset & 31)).astype(np.float64)).astype(np.uint64)
        words = np.zeros(len(sums) + 1, np.uint64)
        words[:-1] = sums & np.uint64(0xFFFFFFFF)
        words[1:] += sums >> np.uint64(32)
        self.value |= int.from_bytes(words.astype("<u4").tobytes(), "little") << self.at
        self.at += int(ends[-1]) if len(ends) else 0

    def bytes(self) -> bytes:
        return self.value.to_bytes(-(-self.at // 8), "little")


def _prefix(value: int) -> tuple[int, int, int]:
    """(prefix code, extra bits, their value) of a length or distance code from 1."""
    v = value - 1
    if v < 4:
        return v, 0, 0
    high = v.bit_length() - 1
    second = v >> (high - 1) & 1
    extra = high - 1
    return 2 * high + second, extra, v - ((2 + second) << extra)


def _put_code(out: Writer, lengths: Sequence[int]) -> None:
    used = [i for i, n in enumerate(lengths) if n]
    if len(used) <= 2 and all(i < 256 for i in used):
        used = used or [0]
        out.put(1, 1)
        out.put(len(used) - 1, 1)
        out.put(1, 1)
        for i in used:
            out.put(i, 8)
        return
    tokens: list[tuple[int, int, int]] = []
    i = 0
    while i < len(lengths):
        j = i
        while j < len(lengths) and lengths[j] == lengths[i]:
            j += 1
        run = j - i
        if lengths[i]:
            tokens += [(lengths[i], 0, 0)] * run
        else:
            while run >= 3:
                many = min(run, 138)
                tokens.append((17, many - 3, 3) if many < 11 else (18, many - 11, 7))
                run -= many
            tokens += [(0, 0, 0)] * run
        i = j
    counts = [0] * 19
    for t, _, _ in tokens:
        counts[t] += 1
    own = code_lengths(counts, 7)
    own_codes, single = codes(own), sum(map(bool, own)) == 1
    out.put(0, 1)
    last = max(k for k in range(19) if own[LENGTH_ORDER[k]])
    out.put(max(0, last - 3), 4)
    for k in range(max(4, last + 1)):
        out.put(own[LENGTH_ORDER[k]], 3)
    out.put(0, 1)
    for t, extra, n in tokens:
        out.put(own_codes[t], 0 if single else own[t])
        out.put(extra, n)


def _put_pixels(out: Writer, argb: np.ndarray, width: int, top: bool, copies: Sequence[tuple[int, int, int]] = (), cache_bits: int = 0, meta: tuple[np.ndarray, int] | None = None) -> None:
    """An entropy-coded image; ``copies``: (position, length, distance), in order and apart; ``meta``: (group of each
    tile, size bits)."""
    height, count = len(argb) // width, len(argb)
    out.put(1 if cache_bits else 0, 1)
    if cache_bits:
        out.put(cache_bits, 4)
    if top:
        out.put(0 if meta is None else 1, 1)
    if meta is not None:
        out.put(meta[1] - 2, 3)
        _put_pixels(out, meta[0].ravel().astype(np.uint32) << np.uint32(8), -(-width >> meta[1]), False)
    group_of = _modes(meta[0], meta[1], height, width).ravel() if meta is not None else None
    n_groups = int(meta[0].max()) + 1 if meta is not None else 1
    sizes = (LITERALS + LENGTH_CODES + (1 << cache_bits if cache_bits else 0), 256, 256, 256, DISTANCE_CODES)
    grey = not cache_bits and meta is None and not (argb & np.uint32(0xFFFF00FF) != argb[0] & np.uint32(0xFFFF00FF)).any()
    if grey:
        keep = np.ones(count, bool)
        for at, length, _ in copies:
            keep[at : at + length] = False
        green = (argb >> np.uint32(8) & np.uint32(255)).astype(np.int64)
        literal = np.flatnonzero(keep)
        counts = np.bincount(green[literal], minlength=sizes[0]).tolist()
        far = [0] * DISTANCE_CODES
        fields = []
        for at, length, distance in copies:
            a, b = _prefix(length), _prefix(distance + 120)
            counts[LITERALS + a[0]] += 1
            far[b[0]] += 1
            fields.append((at, a, b))
        lengths, far_lengths = code_lengths(counts, MOST_BITS), code_lengths(far, 15)
        _put_code(out, lengths)
        for shift in (16, 0, 24):
            _put_code(out, [1 if i == int(argb[0]) >> shift & 255 else 0 for i in range(256)])
        _put_code(out, far_lengths)
        bits = np.array(lengths) if sum(map(bool, lengths)) > 1 else np.zeros(sizes[0], np.int64)
        code = np.array(codes(lengths))
        far_bits = far_lengths if sum(map(bool, far_lengths)) > 1 else [0] * DISTANCE_CODES
        far_code = codes(far_lengths)
        if not fields:
            out.put_many(code[green], bits[green])
            return
        values, widths, last = [], [], 0
        for at, a, b in fields:
            g = green[last:at]
            values += [code[g], [code[LITERALS + a[0]], a[2], far_code[b[0]], b[2]]]
            widths += [bits[g], [bits[LITERALS + a[0]], a[1], far_bits[b[0]], b[1]]]
            last = at + next(n for p, n, _ in copies if p == at) if len(copies) < 4 else at + _length(a)
        values.append(code[green[last:]])
        widths.append(bits[green[last:]])
        out.put_many(np.concatenate(values).astype(np.int64), np.concatenate(widths).astype(np.int64))
        return
    tokens, cache, at, copied = [], [None] * (1 << cache_bits), 0, {p: (n, d) for p, n, d in copies}
    pixels = argb.tolist()
    place = lambda colour: (HASH_MULTIPLIER * colour & 0xFFFFFFFF) >> (32 - cache_bits)
    while at < count:
        group = int(group_of[at]) if group_of is not None else 0
        if at in copied:
            n, d = copied[at]
            tokens.append((group, "copy", _prefix(n), _prefix(d + 120)))
        else:
            n, colour = 1, pixels[at]
            if cache_bits and cache[place(colour)] == colour:
                tokens.append((group, "cache", place(colour), None))
            else:
                tokens.append((group, "pixel", colour, None))
        if cache_bits:
            for colour in pixels[at : at + n]:
                cache[place(colour)] = colour
        at += n
    counts = [[[0] * size for size in sizes] for _ in range(n_groups)]
    for group, kind, a, b in tokens:
        c = counts[group]
        if kind == "copy":
            c[0][LITERALS + a[0]] += 1
            c[4][b[0]] += 1
        elif kind == "cache":
            c[0][LITERALS + LENGTH_CODES + a] += 1
        else:
            for k, shift in enumerate((8, 16, 0, 24)):
                c[k][a >> shift & 255] += 1
    written = []
    for c in counts:
        lengths = [code_lengths(x, 15) for x in c]
        for x in lengths:
            _put_code(out, x)
        written.append([(codes(x), x if sum(map(bool, x)) > 1 else [0] * len(x)) for x in lengths])
    put = lambda own, k, s: out.put(own[k][0][s] if own[k][1][s] else 0, own[k][1][s])
    for group, kind, a, b in tokens:
        own = written[group]
        if kind == "copy":
            put(own, 0, LITERALS + a[0])
            out.put(a[2], a[1])
            put(own, 4, b[0])
            out.put(b[2], b[1])
        elif kind == "cache":
            put(own, 0, LITERALS + LENGTH_CODES + a)
        else:
            for k, shift in enumerate((8, 16, 0, 24)):
                put(own, k, a >> shift & 255)


def _length(prefix: tuple[int, int, int]) -> int:
    code, extra, value = prefix
    return code + 1 if code < 4 else ((2 + (code & 1)) << extra) + value + 1


def encode(argb: np.ndarray, predictor: tuple[np.ndarray, int] | None = None, cross: tuple[np.ndarray, int] | None = None, green: bool = False, palette: np.ndarray | None = None, copies: Sequence[tuple[int, int, int]] = (), cache_bits: int = 0, meta: tuple[np.ndarray, int] | None = None) -> bytes:
    """One lossless WebP file of ARGB pixels (height, width), with the transforms asked for in this order."""
    height, width = argb.shape
    out = Writer()
    for value, n in ((0x2F, 8), (width - 1, 14), (height - 1, 14), (int((argb >> np.uint32(24) != 255).any()), 1), (0, 3)):
        out.put(value, n)
    if palette is not None:
        out.put(1 | PALETTE << 1, 3)
        out.put(len(palette) - 1, 8)
        _put_pixels(out, _argb(np.diff(_channels(palette), axis=0, prepend=0)), len(palette), False)
        order = np.argsort(palette, kind="stable")
        index = order[np.searchsorted(palette[order], argb)].astype(np.uint32)
        bits = _bundle(len(palette))
        if bits:
            each, many = 8 >> bits, 1 << bits
            index = np.pad(index, ((0, 0), (0, -width % many))).reshape(height, -1, many)
            index = (index << (np.arange(many, dtype=np.uint32) * np.uint32(each))).sum(axis=2, dtype=np.uint32)
        argb, width = np.uint32(0xFF000000) | index << np.uint32(8), index.shape[1]
    if predictor is not None:
        out.put(1 | PREDICTOR << 1, 3)
        out.put(predictor[1] - 2, 3)
        _put_pixels(out, predictor[0].ravel().astype(np.uint32) << np.uint32(8), predictor[0].shape[1], False)
        c, mode = _channels(argb), _modes(predictor[0], predictor[1], height, width)
        y, x = (a.ravel() for a in np.indices((height, width)))
        argb = _argb((c[y, x] - predicted(*_neighbours(c, y, x, mode[y, x]))) & 255).reshape(height, width)
    if cross is not None:
        out.put(1 | CROSS << 1, 3)
        out.put(cross[1] - 2, 3)
        _put_pixels(out, cross[0].ravel().astype(np.uint32), cross[0].shape[1], False)
        argb = _cross(argb, cross[0], cross[1], -1)
    if green:
        out.put(1 | GREEN << 1, 3)
        argb = _subtract_green(argb, -1)
    out.put(0, 1)
    _put_pixels(out, argb.ravel(), width, True, copies, cache_bits, meta)
    data = out.bytes()
    chunk = b"VP8L" + len(data).to_bytes(4, "little") + data + b"\0" * (len(data) % 2)
    return b"RIFF" + (4 + len(chunk)).to_bytes(4, "little") + b"WEBP" + chunk


def payload(text: bytes) -> bytes:
    return text + b"\0" * (-len(text) % WIDTH if text else WIDTH)


def _copies(samples: bytes, n_text: int, least: int = 24) -> list[tuple[int, int, int]]:
    """Back-references for lines seen before and for the padding."""
    found = []
    if samples.count(b"\n", 0, n_text) > 1:
        seen: dict[bytes, int] = {}
        at = 0
        for line in samples[:n_text].split(b"\n"):
            if len(line) >= least:
                if line in seen:
                    found += [(at + i, min(4096, len(line) - i), at - seen[line]) for i in range(0, len(line), 4096)]
                seen[line] = at
            at += len(line) + 1
    if len(samples) - n_text > 4:
        found.append((n_text + 1, len(samples) - n_text - 1, 1))
    return found


def store(text: bytes) -> bytes:
    """The payload of ``text`` as lossless WebP: one file, or several in a row beyond 16,384 rows of 64 samples."""
    whole, out = payload(text), []
    for begin in range(0, len(whole), WIDTH * MOST_ROWS):
        part = whole[begin : begin + WIDTH * MOST_ROWS]
        samples = np.frombuffer(part, np.uint8)
        values = np.flatnonzero(np.bincount(samples, minlength=256))
        grey = np.uint32(0xFF000000) | samples.astype(np.uint32) * np.uint32(0x010101)
        if len(values) <= 16:
            out.append(encode(grey.reshape(-1, WIDTH), palette=np.uint32(0xFF000000) | values.astype(np.uint32) * np.uint32(0x010101)))
        else:
            out.append(encode(grey.reshape(-1, WIDTH), green=True, copies=_copies(part, max(0, min(len(part), len(text) - begin)))))
    return b"".join(out)


def files(media: bytes) -> list[bytes]:
    """The WebP files that follow each other in ``media``."""
    out, at = [], 0
    while at < len(media):
        size = 8 + int.from_bytes(media[at + 4 : at + 8], "little")
        out.append(media[at : at + size])
        at += size
    return out


def load(media: bytes) -> np.ndarray:
    """The grey samples (rows, 64) of stored media."""
    return np.concatenate([(decode(x) >> np.uint32(8) & np.uint32(255)).astype(np.uint8) for x in files(media)])


def feature(samples: np.ndarray) -> str:
    """rows x width, distinct values, sum, and total variation along and across the rows."""
    signed = samples.astype(np.int16)
    return f"{samples.shape[0]}x{samples.shape[1]}:{np.count_nonzero(np.bincount(samples.ravel()))}:{int(samples.sum(dtype=np.int64))}:{int(np.abs(np.diff(signed, axis=1)).sum(dtype=np.int64))}:{int(np.abs(np.diff(signed, axis=0)).sum(dtype=np.int64))}"


def store_column(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """id, n_bytes (unpadded), media."""
    kind = docs.schema[id_column].dataType.simpleString()

    def run(batches):
        for batch in pieces(batches):
            texts = utf8(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(map(len, texts), pa.int64()), pa.array(map(store, texts), pa.binary())], [id_column, "n_bytes", "media"])

    return docs.select(id_column, text_column).mapInArrow(run, f"`{id_column}` {kind}, n_bytes long, media binary")


def pixel_arrays(media: DataFrame, id_column: str = "doc_id", media_column: str = "media") -> DataFrame:
    """id, height, width, pixels (ARGB, little-endian unsigned 32-bit, row by row), one row for each file in the media."""
    kind = media.schema[id_column].dataType.simpleString()

    def run(batches):
        for batch in pieces(batches):
            rows = [(i, x) for i, m in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for x in map(decode, files(m or b""))]
            yield pa.RecordBatch.from_arrays(
                [pa.array([i for i, _ in rows], batch.schema.field(0).type), pa.array([x.shape[0] for _, x in rows], pa.int32()), pa.array([x.shape[1] for _, x in rows], pa.int32()), pa.array([x.astype("<u4").tobytes() for _, x in rows], pa.binary())],
                [id_column, "height", "width", "pixels"],
            )

    return media.select(id_column, media_column).mapInArrow(run, f"`{id_column}` {kind}, height int, width int, pixels binary")


def digests(media: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature: all but n_bytes from
    what the stored media decode to."""
    kind = media.schema[id_column].dataType.simpleString()

    def run(batches):
        for batch in pieces(batches):
            columns: list[list] = [[] for _ in range(6)]
            for m in batch.column(2):
                m = m.as_py()
                samples = load(m)
                data = samples.tobytes()
                for column, value in zip(columns, (len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-WIDTH:]), len(m), hashlib.sha256(m).hexdigest(), feature(samples))):
                    column.append(value)
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *map(pa.array, columns, kinds)], [id_column, "n_bytes", *DIGESTS])

    return media.select(id_column, "n_bytes", "media").mapInArrow(run, f"`{id_column}` {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


DIGESTS = ("payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")
