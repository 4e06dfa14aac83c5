"""Lossless WebP (operator 7): a decoder for whole batches of images, and writers.

``decode_many`` reads RIFF/VP8L files: it decodes the prefix codes, back-references and colour cache,
with one or many groups of codes, and inverts the predictor, cross-colour, subtract-green and palette
transforms. All images of a batch advance pixel by pixel together, one numpy step for all that are
not done, so the work per pixel is array work. ``encode`` writes one image with any of these
features; ``encode_many`` writes a batch of RGBA byte strings by array work, with back-references, colour
cache and transforms.

As a media column a text's UTF-8 bytes, padded with zero bytes to a positive multiple of 64, are the
R, G, B, A samples of an image 16 pixels wide; beyond 256 rows (16 KiB) further images follow it, so a long
text takes no more steps than a short one.

Defined cases: a null text is an empty one (64 zero bytes); equal texts give equal files; a file that
breaks the format raises WebPError.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

WIDTH, MAX_ROWS, SMALL = 16, 256, 256  # pixels of a row, rows of an image, pixels of a small image
_BLACK = 0xFF000000
# Fixed values of the format.
_LENGTH_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
_CACHE_MULTIPLIER = 0x1E35A7BD
# The 120 short distances are the neighbours in reach, nearest first; ties by |x|, then x > 0 first.
_NEAR = sorted(((x, y) for y in range(8) for x in range(-7, 9) if y or x > 0), key=lambda p: (p[0] ** 2 + p[1] ** 2, abs(p[0]), p[0] < 0))


class WebPError(ValueError):
    """The file breaks the format."""


# ---------------------------------------------------------------- bits
class _Reader:
    def __init__(self, data: bytes, bit: int = 0):
        self.data, self.bit = data, bit

    def __call__(self, n: int) -> int:
        if not n:
            return 0
        a = self.bit >> 3
        if self.bit + n > 8 * len(self.data):
            raise WebPError("the stream is cut off")
        v = int.from_bytes(self.data[a : a + 5], "little") >> (self.bit & 7) & ((1 << n) - 1)
        self.bit += n
        return v


def _packed(values: np.ndarray, sizes: np.ndarray, at: np.ndarray, words: int) -> np.ndarray:
    """Words of 64 bits, into which values of at most 64 bits are written from rising places on."""
    word, shift = at >> 6, (at & 63).astype(np.uint64)
    out = np.zeros(words, np.uint64)
    first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
    out[word[first]] = np.bitwise_or.reduceat(values << shift, first)
    over = np.flatnonzero((at & 63) + sizes > 64)  # at most one of each word runs over its end
    out[word[over] + 1] |= values[over] >> (np.uint64(64) - shift[over])
    return out


class _Writer:
    def __init__(self):
        self.value, self.bit, self.size = 0, 0, 0  # bits not yet in ``done``, their number, bytes in ``done``
        self.done: list[bytes] = []

    def __call__(self, v: int, n: int) -> None:
        self.value |= v << self.bit
        self.bit += n
        if self.bit >= 512:
            whole = self.bit >> 3
            self.done.append((self.value & (1 << 8 * whole) - 1).to_bytes(whole, "little"))
            self.value >>= 8 * whole
            self.bit &= 7
            self.size += whole

    def many(self, values: np.ndarray, sizes: np.ndarray) -> None:
        """Values of at most 64 bits, one after the other."""
        ends = np.cumsum(sizes)
        if len(ends):
            packed = _packed(values, sizes, ends - sizes, (int(ends[-1]) >> 6) + 2)
            self(int.from_bytes(packed.tobytes(), "little"), int(ends[-1]))

    def bits(self) -> int:
        return 8 * self.size + self.bit

    def bytes(self) -> bytes:
        return b"".join(self.done) + self.value.to_bytes(-(-self.bit // 8), "little")


# ---------------------------------------------------------------- prefix codes
@lru_cache(maxsize=None)
def _reversed(n: int) -> np.ndarray:
    """Every number of n bits with its bits in reverse."""
    out = np.zeros(1, np.int64)
    for _ in range(n):
        out = np.concatenate([2 * out, 2 * out + 1])
    return out


def _in_order(lengths) -> tuple[np.ndarray, np.ndarray]:
    """Symbols that have a code, in the codes' order, and the codes' lengths."""
    n = np.frombuffer(lengths, np.uint8).astype(np.int64) if isinstance(lengths, bytes) else np.asarray(lengths, np.int64)
    order = np.argsort(n, kind="stable")
    order = order[np.count_nonzero(n == 0) :]
    return order, n[order]


def _codes_of(n: np.ndarray) -> np.ndarray:
    """Of symbols that have a code their codes, with the first bit lowest, by the codes' lengths."""
    order = np.argsort(n, kind="stable")
    n = n[order]
    longest = int(n[-1])
    share = 1 << (longest - n)
    out = np.empty(len(n), np.int64)
    out[order] = _reversed(longest)[np.cumsum(share) - share]
    return out


def canonical(lengths) -> tuple[np.ndarray, np.ndarray]:
    """Of each symbol its code, with the first bit lowest, and the code's length (0: it has none)."""
    size = np.asarray(lengths, np.int64)
    bits, used = np.zeros(len(size), np.int64), np.flatnonzero(size)
    if len(used):
        bits[used] = _codes_of(size[used])
    return bits, size


@lru_cache(maxsize=256)
def _table(lengths: bytes | tuple[int, ...]) -> np.ndarray:
    """By as many next bits as the longest code has: symbol << 4 | length of its code."""
    order, n = _in_order(lengths)
    if len(order) == 1:  # a lone symbol takes no bits
        return order << 4
    share = 1 << (15 - n)
    if share.sum() != 1 << 15:
        raise WebPError("a prefix code is not complete")
    longest = int(n[-1])
    return np.repeat(order << 4 | n, share >> (15 - longest))[_reversed(longest)]


@lru_cache(maxsize=256)
def _short_table(lengths: tuple[int, ...]) -> list[int]:
    """As ``_table``, by the next 7 bits (no code of code lengths is longer)."""
    table = _table(lengths)
    return np.tile(table, 128 // len(table)).tolist()


def _read_lengths(read: _Reader, size: int) -> bytes:
    out = bytearray(size)
    if read(1):
        two, wide = read(1), read(1)
        first = read(8 if wide else 1)
        second = read(8) if two else first
        if max(first, second) >= size:
            raise WebPError("a symbol is out of range")
        out[first] = out[second] = 1
        return bytes(out)
    short = [0] * 19
    for k in range(4 + read(4)):
        short[_LENGTH_ORDER[k]] = read(3)
    table = _short_table(tuple(short))
    left = 2 + read(2 + 2 * read(3)) if read(1) else size
    if left > size:
        raise WebPError("too many code lengths")
    # token by token, on the stream itself: this runs for every code of every file
    data, bit, end = read.data, read.bit, 8 * len(read.data)
    at, last = 0, 8
    while at < size and left:
        left -= 1
        a = bit >> 3
        window = int.from_bytes(data[a : a + 4], "little") >> (bit & 7)
        hit = table[window & 127]
        n, s = hit & 15, hit >> 4
        bit += n
        if s < 16:
            out[at] = s
            last = s or last
            at += 1
        else:
            window >>= n
            if s == 16:
                run, bit = 3 + (window & 3), bit + 2
                out[at : at + run] = bytes([last]) * min(run, size - at)
            elif s == 17:
                run, bit = 3 + (window & 7), bit + 3
            else:
                run, bit = 11 + (window & 127), bit + 7
            at += run
            if at > size:
                raise WebPError("code lengths run over")
        if bit > end:
            raise WebPError("the stream is cut off")
    read.bit = bit
    return bytes(out)


_KNOWN: dict[tuple[int, int], tuple[int, int, list[np.ndarray]]] = {}  # by cache size and first 64 bits: bits, their value and the tables they say
_MOST_KNOWN = 256


def _read_group(read: _Reader, cache_bits: int) -> list[np.ndarray]:
    """The tables of the next five codes. Most files share their codes: those read before are known again by all of their bits."""
    begin, a, shift = read.bit, read.bit >> 3, read.bit & 7
    key = cache_bits, int.from_bytes(read.data[a : a + 9], "little") >> shift & (1 << 64) - 1
    n, value, tables = _KNOWN.get(key, (0, 0, []))
    if n and begin + n <= 8 * len(read.data) and int.from_bytes(read.data[a : a + (n + shift + 7 >> 3)], "little") >> shift & (1 << n) - 1 == value:
        read.bit += n
        return tables
    tables = [_table(_read_lengths(read, size)) for size in (280 + (1 << cache_bits if cache_bits else 0), 256, 256, 256, 40)]
    n = read.bit - begin
    if n > 64:
        if len(_KNOWN) >= _MOST_KNOWN:
            _KNOWN.clear()
        _KNOWN[key] = n, int.from_bytes(read.data[a : a + (n + shift + 7 >> 3)], "little") >> shift & (1 << n) - 1, tables
    return tables


# ---------------------------------------------------------------- decoding
class _Job:
    """One entropy-coded image: where its pixels begin and what codes they use."""

    def __init__(self, data: bytes, width: int, height: int):
        self.data, self.width, self.height = data, width, height
        self.cache_bits, self.meta, self.meta_bits = 0, None, 0
        self.groups: list[list[np.ndarray]] = []
        self.bit = 0


def _read_image(read: _Reader, width: int, height: int, main: bool) -> _Job:
    job = _Job(read.data, width, height)
    if read(1):
        job.cache_bits = read(4)
        if not 1 <= job.cache_bits <= 11:
            raise WebPError("colour cache size")
    groups = 1
    if main and read(1):
        job.meta_bits = read(3) + 2
        job.meta = (_part(read, -(-width // (1 << job.meta_bits)), -(-height // (1 << job.meta_bits))) >> np.uint32(8)) & np.uint32(0xFFFF)
        groups = int(job.meta.max()) + 1
    job.groups = [_read_group(read, job.cache_bits) for _ in range(groups)]
    job.bit = read.bit
    return job


def _near_distance(code: int, width: int) -> int:
    """The distance, in pixels, that a distance's number stands for."""
    if code > 120:
        return code - 120
    x, y = _NEAR[code - 1]
    return max(1, x + y * width)


_PARTS: dict[tuple[int, int, int], tuple[int, int, np.ndarray]] = {}  # as ``_KNOWN``, by width, height and first 64 bits
_MOST_PARTS, _PART_PIXELS = 1024, 16


def _part(read: _Reader, width: int, height: int) -> np.ndarray:
    """An image inside the stream (transform data, code groups, palette): a few pixels. Those of very few are often the same and known again by all of their bits."""
    if width * height > _PART_PIXELS:
        return _decoded_part(read, width, height)
    begin, a, shift = read.bit, read.bit >> 3, read.bit & 7
    key = width, height, int.from_bytes(read.data[a : a + 9], "little") >> shift & (1 << 64) - 1
    n, value, image = _PARTS.get(key, (0, 0, None))
    if image is not None and begin + n <= 8 * len(read.data) and int.from_bytes(read.data[a : a + (n + shift + 7 >> 3)], "little") >> shift & (1 << n) - 1 == value:
        read.bit += n
        return image
    image = _decoded_part(read, width, height)
    image.flags.writeable = False
    if len(_PARTS) >= _MOST_PARTS:
        _PARTS.clear()
    n = read.bit - begin
    _PARTS[key] = n, int.from_bytes(read.data[a : a + (n + shift + 7 >> 3)], "little") >> shift & (1 << n) - 1, image
    return image


def _decoded_part(read: _Reader, width: int, height: int) -> np.ndarray:
    """Decoded at once and one by one."""
    job = _read_image(read, width, height, False)
    data, bit, tables, size = read.data, job.bit, job.groups[0], width * height
    green, *others = (int(t[0]) for t in tables[:4])
    if not any(x & 15 for x in (green, *others)) and green >> 4 < 256:  # codes of no bits: one colour
        red, blue, alpha = (x >> 4 for x in others)
        return np.full((height, width), alpha << 24 | red << 16 | green >> 4 << 8 | blue, np.uint32)
    out: list[int] = []
    cache, shift, cached = [0] * (1 << job.cache_bits), 32 - job.cache_bits, 0  # the first ``cached`` pixels are in the cache

    def number(prefix: int, bit: int) -> tuple[int, int]:
        if prefix < 4:
            return prefix + 1, bit
        n = prefix - 2 >> 1
        return (2 + (prefix & 1) << n) + (int.from_bytes(data[bit >> 3 : (bit >> 3) + 4], "little") >> (bit & 7) & (1 << n) - 1) + 1, bit + n

    while len(out) < size:
        if bit > 8 * len(data):
            raise WebPError("the stream is cut off")
        window = int.from_bytes(data[bit >> 3 : (bit >> 3) + 9], "little") >> (bit & 7)
        hit = int(tables[0][window & len(tables[0]) - 1])
        symbol, n = hit >> 4, hit & 15
        if symbol < 256:
            value = symbol << 8
            for t, place in zip(tables[1:4], (16, 0, 24), strict=True):
                hit = int(t[window >> n & len(t) - 1])
                value |= hit >> 4 << place
                n += hit & 15
            bit += n
            out.append(value)
        elif symbol < 280:
            length, bit = number(symbol - 256, bit + n)
            hit = int(tables[4][int.from_bytes(data[bit >> 3 : (bit >> 3) + 4], "little") >> (bit & 7) & len(tables[4]) - 1])
            far, bit = number(hit >> 4, bit + (hit & 15))
            far = _near_distance(far, width)
            if far > len(out) or length > size - len(out):
                raise WebPError("a back-reference leaves the image")
            for _ in range(length):
                out.append(out[-far])
        else:
            for v in out[cached:]:
                cache[(v * _CACHE_MULTIPLIER & 0xFFFFFFFF) >> shift] = v
            cached = len(out)
            bit += n
            out.append(cache[symbol - 280])
    if bit > 8 * len(data):
        raise WebPError("the stream is cut off")
    read.bit = bit
    return np.array(out, np.uint32).reshape(height, width)


_STEPS = 16  # tokens between two looks at which images are done


def _pixels(jobs: list[_Job]) -> list[np.ndarray]:
    """ARGB values of each job's pixels. All jobs advance together, a token each at a step; copies and cache entries are filled in after that."""
    sizes = np.array([j.width * j.height for j in jobs], np.int64)
    ends = np.cumsum(sizes + 1) - 1  # each image is followed by one spare place
    firsts = ends - sizes
    out = np.zeros(int(ends[-1]) + 1, np.uint32)
    tables: list[np.ndarray] = []
    known: dict[int, int] = {}
    codes: list[list[int]] = []  # a row for each group of codes: the numbers of its tables
    row = np.zeros(len(jobs), np.int64)
    for k, j in enumerate(jobs):
        row[k] = len(codes)
        for group in j.groups:
            for t in group:
                if id(t) not in known:
                    known[id(t)] = len(tables)
                    tables.append(t)
            codes.append([known[id(t)] for t in group])
    table = np.concatenate(tables)
    lengths = np.array([len(t) for t in tables], np.int64)
    begin, mask = (np.cumsum(lengths) - lengths)[np.array(codes)], lengths[np.array(codes)] - 1
    # a pixel's four codes are read from one word, of which 57 bits are sure, if they never have more
    once = int((np.bitwise_count(mask[:, :4])).sum(1, dtype=np.int64).max()) <= 57
    blobs, at = [], 0
    starts: dict[int, int] = {}
    pos, stop = np.zeros(len(jobs), np.int64), np.zeros(len(jobs), np.int64)
    for k, j in enumerate(jobs):
        if id(j.data) not in starts:
            starts[id(j.data)] = at
            blobs.append(j.data)
            at += len(j.data)
        pos[k] = 8 * starts[id(j.data)] + j.bit
        stop[k] = 8 * (starts[id(j.data)] + len(j.data))
    raw = b"".join(blobs) + bytes(16 * _STEPS)  # as far as a stream that is cut off can be read before that is seen
    word = np.ndarray((len(raw) - 7,), "<i8", raw, strides=(1,)).copy()  # the 64 bits from each byte on
    widths = np.array([j.width for j in jobs], np.int64)
    grouped = np.array([j.meta is not None for j in jobs])
    if grouped.any():
        meta = np.concatenate([j.meta.ravel() if j.meta is not None else np.zeros(1, np.uint32) for j in jobs]).astype(np.int64)
        meta_at = np.concatenate([[0], np.cumsum([1 if j.meta is None else j.meta.size for j in jobs])])[:-1]
        meta_bits = np.array([j.meta_bits if j.meta is not None else 31 for j in jobs], np.int64)
        meta_width = np.array([-(-j.width // (1 << j.meta_bits)) if j.meta is not None else 1 for j in jobs], np.int64)
    near = np.array([x for x, _ in _NEAR] + [0]), np.array([y for _, y in _NEAR] + [0])
    copies: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # place, length, distance
    entries: list[tuple[np.ndarray, np.ndarray]] = []  # place, slot

    def number(prefix, p):
        """The value a prefix and the bits at p say, and the place after these."""
        n = np.maximum(0, (prefix - 2) >> 1)
        base = np.where(prefix < 4, prefix, (2 + (prefix & 1)) << n)
        return base + (word[p >> 3] >> (p & 7) & ((1 << n) - 1)) + 1, p + n

    lane, px, end = np.arange(len(jobs)), firsts.copy(), ends
    while len(lane):
        several = grouped[lane].any()
        first, limit = firsts[lane], stop[lane]
        if not several:
            b, m = begin[row[lane]].T.copy(), mask[row[lane]].T.copy()
        more = True
        while more:
            for _ in range(_STEPS):
                live = px < end  # an image that is done stays where it is
                if several:
                    inner, w, shift = np.minimum(px, end - 1) - first, widths[lane], meta_bits[lane]
                    r = row[lane] + meta[meta_at[lane] + (inner // w >> shift) * meta_width[lane] + (inner % w >> shift)]
                    b, m = begin[r].T, mask[r].T
                window = word[pos >> 3] >> (pos & 7)
                hit = table[(window & m[0]) + b[0]]
                used = hit & 15
                window >>= used
                green = hit >> 4
                value = green << 8
                for c, shift in ((1, 16), (2, 0), (3, 24)):
                    if c == 3 and not once:
                        window = word[(pos + used) >> 3] >> ((pos + used) & 7)
                    hit = table[(window & m[c]) + b[c]]
                    n = hit & 15
                    used += n
                    window >>= n
                    hit >>= 4
                    hit <<= shift
                    value |= hit
                out[px] = value
                other = np.flatnonzero((green >= 256) & live)
                step = live.astype(np.int64)
                used *= step
                if len(other):
                    kind, p = green[other], pos[other]
                    p += table[(word[p >> 3] >> (p & 7) & m[0][other]) + b[0][other]] & 15
                    entry = kind >= 280
                    if entry.any():
                        entries.append((px[other[entry]], kind[entry] - 280))
                    back = ~entry
                    if back.any():
                        who, q = other[back], p[back]
                        length, q = number(kind[back] - 256, q)
                        hit = table[(word[q >> 3] >> (q & 7) & m[4][who]) + b[4][who]]
                        far, q = number(hit >> 4, q + (hit & 15))
                        k = np.minimum(far - 1, 120)
                        far = np.where(far > 120, far - 120, np.maximum(1, near[0][k] + near[1][k] * widths[lane[who]]))
                        if (far > px[who] - first[who]).any() or (length > end[who] - px[who]).any():
                            raise WebPError("a back-reference leaves the image")
                        copies.append((px[who], length, far))
                        step[who], p[back] = length, q
                    used[other] = p - pos[other]
                pos += used
                px += step
            if (pos > limit).any():
                raise WebPError("the stream is cut off")
            more = bool((px < end).all())
        left = np.flatnonzero(px < end)
        lane, pos, px, end = lane[left], pos[left], px[left], end[left]
    if copies or entries:
        cache_bits = np.array([j.cache_bits for j in jobs], np.int64)
        copied, cached = ([np.concatenate(x) for x in zip(*found, strict=True)] or [np.zeros(0, np.int64)] * 3 for found in (copies, entries))
        for i, j in C.pieces(np.append(firsts, len(out)), 1 << 20):  # images are apart, so a million pixels at a time
            a, b = firsts[i], ends[j - 1] + 1
            (place, length, far), (cell, slot) = ([x[(part[0] >= a) & (part[0] < b)] for x in part] for part in (copied, cached[:2]))
            _fill_in(out[a:b], (place - a, length, far), (cell - a, slot), firsts[i:j] - a, ends[i:j] - a, cache_bits[i:j])
    return [out[a:b].reshape(j.height, j.width) for a, b, j in zip(firsts.tolist(), ends.tolist(), jobs, strict=True)]


def _ranges(begins: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers of all ranges, one after the other."""
    return np.arange(int(sizes.sum())) + np.repeat(begins - (np.cumsum(sizes) - sizes), sizes)


def _follow(source: np.ndarray, places: np.ndarray) -> None:
    """Lets the places' sources be the ones at the ends of their chains."""
    while len(places):
        now = source[places]
        beyond = source[now]
        source[places] = beyond
        places = places[beyond != now]


def _fill_in(out: np.ndarray, copies: tuple, entries: tuple, firsts: np.ndarray, ends: np.ndarray, cache_bits: np.ndarray) -> None:
    """Pixels that came as back-references or cache entries get the values of those they repeat."""
    out[-1] = 0  # the last spare place: what an empty entry of the cache holds
    source = np.arange(len(out))
    place, length, far = copies
    copied = _ranges(place, length)
    source[copied] = copied - np.repeat(far, length)
    _follow(source, copied)
    todo = copied
    place, entry = entries
    if len(place):
        image = np.flatnonzero(cache_bits)
        sizes = (ends - firsts)[image]
        pixels = _ranges(firsts[image], sizes)
        slot = np.zeros(len(out), np.uint64)
        slot[pixels] = (out[pixels] * np.uint32(_CACHE_MULTIPLIER)) >> np.repeat(32 - cache_bits[image], sizes).astype(np.uint32)
        slot[place] = entry
        is_entry = np.zeros(len(out), bool)
        is_entry[place] = True
        images, inside, at = np.repeat(np.arange(len(image), dtype=np.uint64), sizes) << np.uint64(11), pixels, np.arange(len(pixels))
        while True:
            slot[copied] = slot[source[copied]]
            key = (images | slot[inside]) << np.uint64(32) | inside.astype(np.uint64)
            key.sort()
            pixels = (key & np.uint64(0xFFFFFFFF)).astype(np.int64)
            key >>= np.uint64(32)
            mine = is_entry[pixels]
            start = np.maximum.accumulate(np.where(np.concatenate([[True], key[1:] != key[:-1]]), at, 0))
            last = np.maximum.accumulate(np.where(mine, -1, at))
            # an entry no pixel was put in before is 0, whose own slot is the first one
            empty = pixels[mine & (last < start) & (key & np.uint64(2047) != 0)]
            if not len(empty):
                break
            slot[empty], is_entry[empty], source[empty] = 0, False, len(out) - 1
        # the others are the last pixel before them, in their image and slot, that is none
        source[pixels[mine]] = np.where(last >= start, pixels[last], len(out) - 1)[mine]
        todo = np.concatenate([copied, place])
        _follow(source, todo)
    out[todo] = out[source[todo]]


# ---------------------------------------------------------------- inverse transforms
def _split(argb: np.ndarray) -> np.ndarray:
    """(..., 4) of A, R, G, B as int32."""
    return np.stack([argb >> np.uint32(s) & np.uint32(0xFF) for s in (24, 16, 8, 0)], -1).astype(np.int32)


def _join(parts: np.ndarray) -> np.ndarray:
    p = parts.astype(np.uint32) & np.uint32(0xFF)
    return p[..., 0] << np.uint32(24) | p[..., 1] << np.uint32(16) | p[..., 2] << np.uint32(8) | p[..., 3]


def _guess(mode: int, left: np.ndarray, top: np.ndarray, top_right: np.ndarray, top_left: np.ndarray) -> np.ndarray:
    """What a mode predicts from the neighbours of many pixels, (n, 4) of int16 each."""
    half = lambda a, b: (a + b) >> 1
    if mode == 0 or mode > 13:
        return np.broadcast_to(np.array([255, 0, 0, 0], np.int16), left.shape)
    if mode == 11:
        near_left = np.abs(top - top_left).sum(1) < np.abs(left - top_left).sum(1)
        return np.where(near_left[:, None], left, top)
    if mode == 12:
        return np.clip(left + top - top_left, 0, 255)
    if mode == 13:
        mean = half(left, top)
        diff = mean - top_left
        return np.clip(mean + ((diff + (diff < 0)) >> 1), 0, 255)
    return {
        1: lambda: left, 2: lambda: top, 3: lambda: top_right, 4: lambda: top_left, 5: lambda: half(half(left, top_right), top), 6: lambda: half(left, top_left), 7: lambda: half(left, top),
        8: lambda: half(top_left, top), 9: lambda: half(top, top_right), 10: lambda: half(half(left, top_left), half(top, top_right)),
    }[mode]()


def _modes_of(height: int, width: int, modes: np.ndarray, bits: int) -> np.ndarray:
    """The mode of each pixel; the first is predicted black, others of the first row from the left, of the first column from above."""
    kind = (modes >> np.uint32(8) & np.uint32(0xFF)).astype(np.int16)
    out = kind[(np.arange(height) >> bits)[:, None], (np.arange(width) >> bits)[None, :]]
    out[0], out[1:, 0], out[0, 0] = 1, 2, 0
    return out.ravel()


def _in_waves(images: list[np.ndarray], modes: list[np.ndarray], invert: bool) -> list[np.ndarray]:
    """``predictor`` for many images at once, each with the modes of its pixels. A pixel's neighbours are done when x + 2y of its image is less, so all pixels of
    one such sum and one mode are a step; the writer, which knows the true pixels, needs a step for each mode only."""
    width = np.concatenate([np.full(x.size, x.shape[1], np.int64) for x in images])
    mode = np.concatenate(modes).astype(np.int64)
    key = mode
    if invert:
        key = mode + 16 * np.concatenate([(np.arange(x.shape[1])[None, :] + 2 * np.arange(x.shape[0])[:, None]).ravel() for x in images])
    order = np.argsort(key, kind="stable")
    key = key[order]
    cuts = [0, *(np.flatnonzero(key[1:] != key[:-1]) + 1).tolist(), len(key)]
    src = np.concatenate([_split(x.ravel()) for x in images]).astype(np.int16)
    out = src.copy()
    seen = out if invert else src  # predictions come from true pixels
    for i, j in zip(cuts, cuts[1:]):
        at = order[i:j]
        above = np.maximum(at - width[at], 0)  # in a first row nothing looks there
        guess = _guess(int(mode[at[0]]), seen[np.maximum(at - 1, 0)], seen[above], seen[above + 1 if len(seen) > 1 else above], seen[np.maximum(above - 1, 0)])
        out[at] = (src[at] + guess if invert else src[at] - guess) & 0xFF
    ends = np.cumsum([x.size for x in images])
    return [_join(x).reshape(image.shape) for x, image in zip(np.split(out, ends[:-1]), images, strict=True)]


def predictor(image: np.ndarray, modes: np.ndarray, bits: int, invert: bool = True) -> np.ndarray:
    """Add (or, for the writer, take off) the predictions."""
    return _in_waves([image], [_modes_of(*image.shape, modes, bits)], invert)[0]


def cross_colour(image: np.ndarray, elements: np.ndarray, bits: int, invert: bool = True) -> np.ndarray:
    height, width = image.shape
    e = elements[np.arange(height)[:, None] >> bits, np.arange(width)[None, :] >> bits]
    signed = lambda v: (v.astype(np.int32) & 0xFF ^ 0x80) - 0x80
    red_to_blue, green_to_blue, green_to_red = signed(e >> np.uint32(16)), signed(e >> np.uint32(8)), signed(e)
    p = _split(image)
    delta = lambda t, c: t * ((c & 0xFF ^ 0x80) - 0x80) >> 5
    sign = 1 if invert else -1
    true_red = p[..., 1] + delta(green_to_red, p[..., 2]) if invert else p[..., 1]
    blue = p[..., 3] + sign * (delta(green_to_blue, p[..., 2]) + delta(red_to_blue, true_red & 0xFF))
    p[..., 1] = p[..., 1] + sign * delta(green_to_red, p[..., 2])
    p[..., 3] = blue
    return _join(p)


def subtract_green(image: np.ndarray, invert: bool = True) -> np.ndarray:
    p = _split(image)
    for c in (1, 3):
        p[..., c] += p[..., 2] if invert else -p[..., 2]
    return _join(p)


def _palette_bits(n: int) -> int:
    return 3 if n <= 2 else 2 if n <= 4 else 1 if n <= 16 else 0


def unpack_palette(image: np.ndarray, palette: np.ndarray, width: int) -> np.ndarray:
    bits = _palette_bits(len(palette))
    x = np.arange(width)
    depth = 8 >> bits
    green = (image >> np.uint32(8) & np.uint32(0xFF)).astype(np.int64)
    index = green[:, x >> bits] >> (depth * (x & ((1 << bits) - 1))) & ((1 << depth) - 1)
    return np.concatenate([palette, np.zeros(256, np.uint32)])[index]


def _open(data: bytes) -> tuple[_Job, list]:
    """Everything before the main image's pixels."""
    if data[:4] != b"RIFF" or data[8:16] != b"WEBPVP8L" or len(data) < 25:
        raise WebPError("not a lossless WebP file")
    riff, chunk = struct.unpack_from("<I", data, 4)[0], struct.unpack_from("<I", data, 16)[0]
    if riff + 8 > len(data) or chunk + 20 > len(data) or chunk + 12 > riff:
        raise WebPError("chunk lengths")
    body = data[20 : 20 + chunk]
    if body[0] != 0x2F:
        raise WebPError("signature")
    read = _Reader(body, 8)
    width, height = read(14) + 1, read(14) + 1
    read(1)
    if read(3):
        raise WebPError("version")
    todo: list = []
    coded_width, kinds = width, set()
    while read(1):
        kind = read(2)
        if kind in kinds:
            raise WebPError("a transform occurs twice")
        kinds.add(kind)
        if kind in (0, 1):
            bits = read(3) + 2
            todo.append((kind, _part(read, -(-coded_width // (1 << bits)), -(-height // (1 << bits))), bits))
        elif kind == 2:
            todo.append((2, None, 0))
        else:
            table = _part(read, read(8) + 1, 1)
            palette = _join(np.cumsum(_split(table[0]), 0) & 0xFF)
            todo.append((3, palette, coded_width))
            coded_width = -(-coded_width // (1 << _palette_bits(len(palette))))
    job = _read_image(read, coded_width, height, True)
    return job, todo


def decode_many(files: list[bytes]) -> list[np.ndarray]:
    """(height, width) ARGB values of each file."""
    opened = [_open(f) for f in files]
    images = _pixels([job for job, _ in opened]) if opened else []

    def undo(k: int, todo: list) -> None:
        while todo and todo[-1][0]:
            kind, data, bits = todo.pop()
            images[k] = cross_colour(images[k], data, bits) if kind == 1 else subtract_green(images[k]) if kind == 2 else unpack_palette(images[k], data, bits)

    predicted, size = [], 0
    for k, (_, todo) in enumerate(opened):
        undo(k, todo)
        if todo:
            predicted.append(k)
            size += images[k].size
        if predicted and (size >= 1 << 20 or k + 1 == len(opened)):  # predictions of a million pixels are undone at once
            done = _in_waves([images[p] for p in predicted], [_modes_of(*images[p].shape, *opened[p][1].pop()[1:]) for p in predicted], True)
            for p, image in zip(predicted, done, strict=True):
                images[p] = image
                undo(p, opened[p][1])
            predicted, size = [], 0
    return images


# ---------------------------------------------------------------- writing
def code_lengths(weights: list[float], longest: int) -> list[int]:
    """Lengths of an optimal prefix code; weights are flattened until none is longer than ``longest``."""
    used = [s for s, w in enumerate(weights) if w > 0]
    out = [0] * len(weights)
    for s, n in zip(used, _lengths_of([weights[s] for s in used], longest), strict=True):
        out[s] = n
    return out


def _lengths_of(weights: list[float], longest: int) -> list[int]:
    """``code_lengths`` of symbols that all have a weight."""
    n = len(weights)
    if n < 2:
        return [1] * n
    floor = 0.0
    while True:
        leaves = sorted(zip([w if w > floor else floor for w in weights], range(n), strict=True))
        # the two lightest nodes are joined, leaves first; joined ones come in order of their weight, too
        w, parent = [x for x, _ in leaves], [0] * (2 * n - 1)
        leaf, joined = 0, n
        for k in range(n, 2 * n - 1):
            total = 0.0
            for _ in (0, 1):
                if leaf < n and (joined >= k or w[leaf] <= w[joined]):
                    a, leaf = leaf, leaf + 1
                else:
                    a, joined = joined, joined + 1
                parent[a] = k
                total += w[a]
            w.append(total)
        depth = [0] * (2 * n - 1)
        for k in range(2 * n - 3, -1, -1):
            depth[k] = depth[parent[k]] + 1
        if max(depth[:n]) <= longest:
            out = [0] * n
            for (_, k), d in zip(leaves, depth, strict=False):
                out[k] = d
            return out
        floor = max(2 * floor, sum(weights) / 4096)


def _write_code(write: _Writer, lengths: list[int]) -> None:
    used = [s for s, n in enumerate(lengths) if n]
    _write_lengths(write, len(lengths), used, [lengths[s] for s in used])


@lru_cache(maxsize=4096)
def _short_codes(lengths: tuple[int, ...]) -> tuple[list[int], list[int]]:
    bits, sizes = canonical(lengths)
    return bits.tolist(), sizes.tolist()


def _write_lengths(write: _Writer, size: int, used: list[int], lengths: list[int]) -> None:
    """The code lengths of ``size`` symbols, of which only the used ones have a code."""
    if len(used) <= 2 and all(s < 256 for s in used):
        used = used or [0]
        write(1, 1)
        write(len(used) - 1, 1)
        write(1, 1)
        for s in used:
            write(s, 8)
        return
    runs: list[list[int]] = []  # length, symbols
    end, before = 0, 0
    for s, n in zip(used, lengths, strict=True):
        if s > end:
            runs.append([0, s - end])
            before = 0
        if n == before:
            runs[-1][1] += 1
        else:
            runs.append([n, 1])
        end, before = s + 1, n
    if size > end:
        runs.append([0, size - end])
    tokens: list[tuple[int, int, int]] = []
    last = 8
    for length, left in runs:
        while left:
            if length == 0 and left >= 3:
                run = min(left, 138)
                tokens.append((17, run - 3, 3) if run < 11 else (18, run - 11, 7))
            elif length == last and left >= 3:
                run = min(left, 6)
                tokens.append((16, run - 3, 2))
            else:
                run = 1
                tokens.append((length, 0, 0))
                last = length or last
            left -= run
    times = [0.0] * 19
    for t in tokens:
        times[t[0]] += 1.0
    short = code_lengths(times, 7)
    if sum(n > 0 for n in short) == 1:
        short[next(s for s in range(19) if not short[s])] = 1
    bits, sizes = _short_codes(tuple(short))
    write(0, 1)
    write(15, 4)
    value, at = 0, 0
    for s in _LENGTH_ORDER:
        value |= short[s] << at
        at += 3
    at += 1
    for s, v, n in tokens:
        value |= (bits[s] | v << sizes[s]) << at
        at += sizes[s] + n
    write(value, at)


def _prefix(value: int) -> tuple[int, int, int]:
    """(prefix code, extra bits, their number) of a length or distance from 1."""
    if value <= 4:
        return value - 1, 0, 0
    v = value - 1
    n = v.bit_length() - 2
    return 2 * (n + 1) + (v >> n & 1), v & ((1 << n) - 1), n


def _greedy_copies(flat: list[int]) -> list[tuple[int, int, int]]:
    """Place, length and distance of back-references: from the left, to the last place where the next three pixels were before."""
    before, last = [], {}
    for i, three in enumerate(zip(flat, flat[1:], flat[2:])):
        before.append(last.get(three, -1))
        last[three] = i
    out, i, size = [], 0, len(flat)
    while i < len(before):
        j, n = before[i], 1
        if j >= 0:
            n = 3
            while i + n < size and flat[j + n] == flat[i + n] and n < 4096:
                n += 1
            out.append((i, n, i - j))
        i += n
    return out


def _emit_part(write: _Writer, image: np.ndarray) -> None:
    """An image inside the stream, without cache and copies."""
    if image.size > _PART_PIXELS:
        _emit(write, image, 0, False, None, False)
    else:
        write(*_written_part(image.shape, image.astype(np.uint32).tobytes()))


@lru_cache(maxsize=1024)
def _written_part(shape: tuple[int, int], pixels: bytes) -> tuple[int, int]:
    """The bits of a part of very few pixels, and their number."""
    write = _Writer()
    _emit(write, np.frombuffer(pixels, np.uint32).reshape(shape), 0, False, None, False)
    return int.from_bytes(write.bytes(), "little"), write.bits()


def _emit(write: _Writer, image: np.ndarray, cache_bits: int, backrefs: bool, group_bits: int | None, main: bool) -> None:
    """Cache size, code groups and pixels of one entropy-coded image."""
    height, width = image.shape
    flat = image.ravel()
    place = np.arange(len(flat))
    group = (place // width >> group_bits) % 2 if main and group_bits else np.zeros(len(flat), np.int64)
    copies = np.array(_greedy_copies(flat.tolist()) if backrefs else [], np.int64).reshape(-1, 3)
    is_copy, length, far = np.zeros(len(flat), bool), np.zeros(len(flat), np.int64), np.zeros(len(flat), np.int64)
    is_copy[copies[:, 0]], length[copies[:, 0]], far[copies[:, 0]] = True, copies[:, 1], copies[:, 2]
    single = np.ones(len(flat), bool)
    single[_ranges(copies[:, 0], copies[:, 1])] = False
    in_cache = np.zeros(len(flat), bool)
    if cache_bits:  # it holds the last pixel of each slot, and 0 before that
        slot = ((flat * np.uint32(_CACHE_MULTIPLIER)) >> np.uint32(32 - cache_bits)).astype(np.int64)
        order = np.argsort(slot, kind="stable")
        held = np.where(np.concatenate([[False], slot[order[1:]] == slot[order[:-1]]]), np.concatenate([[0], flat[order[:-1]]]), 0)
        in_cache[order] = held == flat[order]
    ops = np.flatnonzero(single | is_copy)
    pixel, entry, copy = (np.flatnonzero(x[ops]) for x in (single & ~in_cache, single & in_cache, is_copy))
    # each op's symbols in turn: rows, code, symbols, and extra bits with their number
    parts = [(pixel, k, (flat[ops[pixel]] >> np.uint32(s) & np.uint32(0xFF)).astype(np.int64), None, None) for k, s in ((0, 8), (1, 16), (2, 0), (3, 24))]
    if len(entry):
        parts.append((entry, 0, 280 + slot[ops[entry]], None, None))
    for k, base, values in ((0, 256, length[ops[copy]]), (4, 0, far[ops[copy]] + 120)) if len(copy) else ():
        prefix, extra, n = _prefixes(values)
        parts.append((copy, k, base + prefix, extra, n))
    n_groups, group = int(group.max()) + 1, group[ops]
    sizes = (280 + (1 << cache_bits if cache_bits else 0), 256, 256, 256, 40)
    weights = np.zeros((n_groups, 5, sizes[0]))
    for rows, k, symbols, _, _ in parts:
        weights[:, k] += np.bincount(group[rows] * sizes[0] + symbols, minlength=n_groups * sizes[0]).reshape(n_groups, -1)
    write(1 if cache_bits else 0, 1)
    if cache_bits:
        write(cache_bits, 4)
    if main:
        write(1 if n_groups > 1 else 0, 1)
        if n_groups > 1:
            write(group_bits - 2, 3)
            small = np.array([[(y % 2) << 8 for _ in range(-(-width // (1 << group_bits)))] for y in range(-(-height // (1 << group_bits)))], np.uint32)
            _emit_part(write, small)
    bits, count = np.zeros(weights.shape, np.uint64), np.zeros(weights.shape, np.int64)
    for g in range(n_groups):
        for k, size in enumerate(sizes):
            used = np.flatnonzero(weights[g, k, :size])
            lengths = _lengths_of(weights[g, k, used].tolist(), 15)
            _write_lengths(write, size, used.tolist(), lengths)
            if len(used) > 1:
                count[g, k, used] = lengths
                bits[g, k, used] = _codes_of(count[g, k, used])
    value, n = np.zeros(len(ops), np.uint64), np.zeros(len(ops), np.int64)
    for rows, k, symbols, extra, size in parts:
        value[rows] |= bits[group[rows], k, symbols] << n[rows].astype(np.uint64)
        n[rows] += count[group[rows], k, symbols]
        if extra is not None:
            value[rows] |= extra.astype(np.uint64) << n[rows].astype(np.uint64)
            n[rows] += size
    write.many(value, n)


def _wrap(body: bytes) -> bytes:
    pad = len(body) & 1
    return b"RIFF" + struct.pack("<I", 12 + len(body) + pad) + b"WEBPVP8L" + struct.pack("<I", len(body)) + body + bytes(pad)


def encode(image: np.ndarray, modes: np.ndarray | None = None, elements: np.ndarray | None = None, bits: int = 2, green: bool = False, palette: bool = False, cache_bits: int = 0, backrefs: bool = False, group_bits: int | None = None) -> bytes:
    """One image (ARGB values) with the transforms and coding features asked for."""
    height, width = image.shape
    write = _Writer()
    write(0x2F, 8)
    write(width - 1, 14)
    write(height - 1, 14)
    write(1, 1)
    write(0, 3)
    if palette:
        colours, index = np.unique(image, return_inverse=True)
        if len(colours) > 256:
            raise WebPError("more than 256 colours")
        index = index.reshape(image.shape).astype(np.uint32)
        write(1, 1)
        write(3, 2)
        write(len(colours) - 1, 8)
        steps = _split(colours)
        steps[1:] -= steps[:-1].copy()
        _emit_part(write, _join(steps)[None, :])
        shift = _palette_bits(len(colours))
        packed = np.zeros((height, -(-width // (1 << shift))), np.uint32)
        for x in range(width):
            packed[:, x >> shift] |= index[:, x] << np.uint32((8 >> shift) * (x & ((1 << shift) - 1)))
        image = packed << np.uint32(8) | np.uint32(_BLACK)
    for kind, data in ((0, modes), (1, elements)):
        if data is not None:
            write(1, 1)
            write(kind, 2)
            write(bits - 2, 3)
            _emit_part(write, data)
            image = (predictor if kind == 0 else cross_colour)(image, data, bits, invert=False)
    if green:
        write(1, 1)
        write(2, 2)
        image = subtract_green(image, invert=False)
    write(0, 1)
    _emit(write, image, cache_bits, backrefs, group_bits, True)
    return _wrap(write.bytes())


CACHE_BITS = 7
_WAYS = ((None, None), (2, None), (1, 0xFF080404), *((0, _BLACK | mode << 8) for mode in range(14)))  # none, or a transform of the whole image: kind, and its one element


_LATIN, _ANY, _RESIDUAL = range(3)  # what the pixels' bytes are: a short header for most texts, all bytes, differences
_IN_LATIN = np.zeros(256, bool)
_IN_LATIN[[0, 9, 10, 13, *range(0x20, 0x7F), *range(0x80, 0xC0), 0xC2, 0xC3, 0xE2]] = True


def _weight(b: int, kind: int) -> float:
    """How often a byte is expected, by its class; 0 has no code."""
    if kind == _RESIDUAL:
        return 12.0 if b == 0 else 2.0 if min(b, 256 - b) < 32 else 0.3
    if kind == _LATIN and not _IN_LATIN[b]:
        return 0.0
    return 16.0 if b == 0x20 else 4.0 if 97 <= b <= 122 else 1.0 if b == 0xC3 else 0.25 if 0x20 < b < 0x7F or b == 10 else 0.1 if 0x80 <= b < 0xC0 else 0.02


def _in_runs(weights: list[float], lengths: list[int]) -> list[int]:
    """Symbols of equal weight exchange their lengths so that equal ones come in runs, which headers say shortly."""
    out = list(lengths)
    for w in set(weights):
        same = [s for s, x in enumerate(weights) if x == w]
        for s, n in zip(same, sorted(lengths[s] for s in same), strict=True):
            out[s] = n
    return out


@lru_cache(maxsize=None)
def _codes(kind: int, cached: bool) -> tuple[list[list[int]], np.ndarray, np.ndarray]:
    """The code lengths of green, red, blue, alpha and distances; and of each symbol (a row for each code) its bits and their number."""
    plain = [_weight(b, kind) for b in range(256)]
    green = plain + [sum(plain) * 0.002] * 24 + [sum(plain) * 0.15 / (1 << CACHE_BITS)] * (cached << CACHE_BITS)
    lengths = [_in_runs(w, code_lengths(w, 15)) for w in (green, plain, plain, plain, [1.0] * 40)]
    bits, n = np.zeros((5, 280 + (1 << CACHE_BITS)), np.uint64), np.zeros((5, 280 + (1 << CACHE_BITS)), np.int64)
    for k, x in enumerate(lengths):
        bits[k, : len(x)], n[k, : len(x)] = canonical(x)
    return lengths, bits, n


@lru_cache(maxsize=None)
def _head(way: int, kind_of_bytes: int, cached: bool) -> tuple[int, int]:
    """What comes between the size and the pixels: bits and their number."""
    write = _Writer()
    kind, element = _WAYS[way]
    if kind is not None:
        write(1, 1)
        write(kind, 2)
        if element is not None:
            write(7, 3)
            _emit_part(write, np.array([[element]], np.uint32))
    write(0, 1)
    write(int(cached), 1)
    if cached:
        write(CACHE_BITS, 4)
    write(0, 1)
    for lengths in _codes(kind_of_bytes, cached)[0]:
        _write_code(write, lengths)
    return int.from_bytes(write.bytes(), "little"), write.bits()


def _prefixes(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Like ``_prefix``, for many values."""
    v = values - 1
    n = np.maximum(0, np.floor(np.log2(np.maximum(v, 1))).astype(np.int64) - 1)
    small = v < 4
    return np.where(small, v, 2 * (n + 1) + (v >> n & 1)), np.where(small, 0, v & ((1 << n) - 1)), np.where(small, 0, n)


def _grouped(keys: np.ndarray) -> np.ndarray:
    """Places ordered so that equal keys are neighbours, in their order: keys and places are sorted as one number, which is faster than argsort."""
    low = np.uint64(len(keys).bit_length())
    both = keys >> low << low | np.arange(len(keys), dtype=np.uint64)
    both.sort()
    order = (both & (np.uint64(1) << low) - np.uint64(1)).astype(np.int64)
    both >>= low
    keys = keys[order]
    if ((both[1:] == both[:-1]) & (keys[1:] != keys[:-1])).any():  # keys that differ in the bits cut off only
        order = order[np.lexsort((order, keys))]
    return order


def _copies(px: np.ndarray, image: np.ndarray, ends: np.ndarray, least: int = 4) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Back-references: place, length and distance of disjoint stretches of ``least`` pixels or more that their image had before."""
    n = len(px) - least + 1
    if n < 1:
        return (np.zeros(0, np.int64),) * 3
    key = image[:n].astype(np.uint64)
    for k in range(least):
        key = key * np.uint64(0x9E3779B97F4A7C15) + px[k : k + n]
        key ^= key >> np.uint64(29)
    key *= np.uint64(0x9E3779B97F4A7C15)  # the last pixel's bits reach the upper ones, too
    order = _grouped(key)
    before = np.full(n, -1)
    same = key[order[1:]] == key[order[:-1]]
    before[order[1:][same]] = order[:-1][same]
    at = np.flatnonzero((before >= 0) & (np.arange(n) + least <= ends[image[:n]]))
    good = image[at] == image[before[at]]
    for k in range(least):
        good &= px[at + k] == px[before[at] + k]
    at = at[good]
    far = at - before[at]
    new = np.ones(len(at), bool)
    new[1:] = (at[1:] != at[:-1] + 1) | (far[1:] != far[:-1])
    first = np.flatnonzero(new)
    begin, far, end = at[first], far[first], at[np.append(first[1:] - 1, len(at) - 1)] + least if len(at) else at
    begin[1:] = np.maximum(begin[1:], np.maximum.accumulate(end)[:-1])  # a part of such a stretch is one as well
    keep = end - begin >= least
    return begin[keep], (end - begin)[keep], far[keep]


def _every_feature(image: np.ndarray, lot: int) -> bytes:
    """A small image, written with features drawn by lot from all that the format has."""
    height, width = image.shape
    how: dict = {"cache_bits": (0, 2, 6, 11)[lot & 3], "backrefs": bool(lot & 4), "green": bool(lot & 8), "palette": bool(lot & 16), "group_bits": 2 if lot & 32 else None}
    if how["palette"]:
        width = -(-width // (1 << _palette_bits(len(np.unique(image)))))
    blocks = np.arange(-(-height // 4) * -(-width // 4), dtype=np.uint32).reshape(-(-height // 4), -1)
    if lot & 64:
        how["modes"] = (blocks + np.uint32(lot >> 8)) % np.uint32(14) << np.uint32(8) | np.uint32(_BLACK)
    if lot & 128:
        how["elements"] = (blocks * np.uint32(0x030507) + np.uint32(lot >> 8)) & np.uint32(0xFFFFFF) | np.uint32(_BLACK)
    return encode(image, **how)


def _guess_bytes(mode: int, left: np.ndarray, top: np.ndarray, top_right: np.ndarray, top_left: np.ndarray) -> np.ndarray:
    """``_guess`` on the pixels' bytes (B, G, R, A), in bytes as far as it goes."""
    half = lambda a, b: (a & b) + ((a ^ b) >> np.uint8(1))
    if mode == 0:
        return np.full(len(left) // 4, _BLACK, np.uint32).view(np.uint8)
    if mode == 11:
        far = []
        for a in (top, left):
            x = (np.maximum(a, top_left) - np.minimum(a, top_left)).view(np.uint32)
            x = (x & np.uint32(0xFF00FF)) + (x >> np.uint32(8) & np.uint32(0xFF00FF))
            far.append((x + (x >> np.uint32(16))) & np.uint32(0xFFFF))
        return np.where(far[0] < far[1], left.view(np.uint32), top.view(np.uint32)).view(np.uint8)
    if mode > 11:
        return _guess(mode, *(x.astype(np.int16) for x in (left, top, top_right, top_left))).astype(np.uint8)
    return {
        1: lambda: left, 2: lambda: top, 3: lambda: top_right, 4: lambda: top_left, 5: lambda: half(half(left, top_right), top), 6: lambda: half(left, top_left), 7: lambda: half(left, top),
        8: lambda: half(top_left, top), 9: lambda: half(top, top_right), 10: lambda: half(half(left, top_left), half(top, top_right)),
    }[mode]()


def _best_ways(px: np.ndarray, begins: np.ndarray, image: np.ndarray, latin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each image (16 pixels wide) the way of all ``_WAYS`` that makes its pixels shortest by the lengths of their codes, the first of
    equal ones; and the pixels as that way writes them."""

    def price(kind: int) -> bytes:
        n = _codes(kind, False)[2][1, :256]
        return np.where(n > 0, n, 16).astype(np.uint8).tobytes()

    def bits(pixels: np.ndarray, of: bytes) -> np.ndarray:
        """Of each image, whose pixels' bytes cost what ``of`` says."""
        return np.add.reduceat(np.frombuffer(pixels.tobytes().translate(of), np.uint32) * np.uint32(0x01010101) >> np.uint32(24), begins, dtype=np.int64)

    out, best = px.copy(), np.where(latin, bits(px, price(_LATIN)), bits(px, price(_ANY)))
    way, cost = np.zeros(len(begins), np.int64), price(_RESIDUAL)
    inner = np.arange(len(px)) - begins[image]
    left, top, top_right, top_left = (np.roll(px, k).view(np.uint8) for k in (1, WIDTH, WIDTH - 1, WIDTH + 1))
    src = px.view(np.uint8)
    edge = np.flatnonzero((inner < WIDTH) | (inner % WIDTH == 0))  # predicted alike in all modes
    guess = np.where(inner < WIDTH, left.view(np.uint32), top.view(np.uint32))
    guess[begins] = _BLACK
    at_edge = (src - guess.view(np.uint8)).view(np.uint32)[edge]
    for k, (kind, element) in enumerate(_WAYS):
        if kind is None:
            continue
        if kind == 2:
            now = subtract_green(px, invert=False)
        elif kind == 1:
            now = cross_colour(px[None, :], np.array([[element]], np.uint32), 30, invert=False)[0]
        else:
            now = (src - _guess_bytes(element >> 8 & 0xFF, left, top, top_right, top_left)).view(np.uint32)
            now[edge] = at_edge
        price_now = bits(now, cost)
        better = price_now < best
        best[better], way[better] = price_now[better], k
        if better.any():
            mine = better[image]
            out[mine] = now[mine]
    return way, out


def encode_many(payload: np.ndarray, offsets: np.ndarray) -> list[bytes]:
    """A file for each row of RGBA bytes (64 * n bytes, at most MAX_ROWS * 64): 16 pixels wide.

    How a file is written depends on its bytes alone. Every small image gets features from all over the format, drawn by the bytes'
    CRC (several groups of codes, a palette, blocks of different modes, codes of its own, and so on). Every larger one is tried with every
    transform and mode and gets the one that makes it shortest; back-references are used wherever four pixels occur again, the colour
    cache where it saves pixels enough.
    """
    raw, off = payload.reshape(-1, 4).astype(np.uint32), np.asarray(offsets) // 4
    px = raw[:, 3] << np.uint32(24) | raw[:, 0] << np.uint32(16) | raw[:, 1] << np.uint32(8) | raw[:, 2]
    sizes, files = np.diff(off), [b""] * (len(offsets) - 1)
    small = sizes <= SMALL
    for k in np.flatnonzero(small).tolist():
        files[k] = _every_feature(px[off[k] : off[k + 1]].reshape(-1, WIDTH), zlib.crc32(payload[offsets[k] : offsets[k + 1]]) >> 3)
    rest = np.flatnonzero(~small)
    if not len(rest):
        return files
    latin = np.add.reduceat(~_IN_LATIN[payload], np.asarray(offsets)[:-1], dtype=np.int64)[rest] == 0
    px, sizes = px[np.repeat(~small, sizes)], sizes[rest]
    ends = np.cumsum(sizes)
    begins, image = ends - sizes, np.repeat(np.arange(len(rest)), sizes)
    way, px = _best_ways(px, begins, image, latin)
    copy, length, far = _copies(px, image, ends)
    edge = np.zeros(len(px) + 1, np.int8)
    edge[copy] += 1
    np.add.at(edge, copy + length, -1)
    covered = np.cumsum(edge[:-1], dtype=np.int8) > 0
    # the cache holds the last pixel of each slot
    slot = (px * np.uint32(_CACHE_MULTIPLIER)) >> np.uint32(32 - CACHE_BITS)
    order = _grouped((image.astype(np.uint64) << np.uint64(CACHE_BITS) | slot) << np.uint64(32))
    hit = np.zeros(len(px), bool)
    hit[order[1:]] = (px[order[1:]] == px[order[:-1]]) & (image[order[1:]] == image[order[:-1]])
    hit &= ~covered
    cached = np.bincount(image[hit], minlength=len(rest)) * 8 >= np.bincount(image[~covered], minlength=len(rest))
    hit &= cached[image]

    single = ~covered
    single[copy] = True
    at = np.flatnonzero(single)
    is_copy, is_hit = np.zeros(len(px), bool), hit
    is_copy[copy] = True
    is_copy, is_hit = is_copy[at], is_hit[at]
    kinds = np.where(way > 0, _RESIDUAL, np.where(latin, _LATIN, _ANY))
    which = 2 * kinds + cached
    tables = [_codes(k >> 1, bool(k & 1)) for k in range(6)]
    bits, count = np.stack([t[1] for t in tables]), np.stack([t[2] for t in tables]).astype(np.uint64)
    known, n_symbols = (bits << np.uint64(4) | count).ravel(), bits.shape[2]  # a code's bits and their number in one
    code, v = 5 * n_symbols * which[image[at]], px[at]
    value, n = np.zeros(len(at), np.uint64), np.zeros(len(at), np.uint64)

    def put(rows, *symbols):
        """Each row's symbols in turn: channel, symbols, and extra bits with their number, if any."""
        base, v, size = code[rows], np.zeros(len(rows), np.uint64), np.zeros(len(rows), np.uint64)
        for channel, symbol, *extra in symbols:
            hit = known[base + (channel * n_symbols + symbol)]
            v |= hit >> np.uint64(4) << size
            size += hit & np.uint64(15)
            if extra:
                v |= extra[0].astype(np.uint64) << size
                size += extra[1].astype(np.uint64)
        value[rows], n[rows] = v, size

    rows = np.flatnonzero(~is_copy & ~is_hit)
    colour = v[rows]
    put(rows, *((channel, (colour >> np.uint32(shift) & np.uint32(0xFF)).astype(np.int64)) for channel, shift in enumerate((8, 16, 0, 24))))
    rows = np.flatnonzero(is_hit)
    put(rows, (0, 280 + slot[at[rows]].astype(np.int64)))
    near = np.zeros(16 * 8 + 16, np.int64)  # the number of a distance that a neighbour in reach has
    for k, (x, y) in reversed(list(enumerate(_NEAR, 1))):
        near[max(1, x + y * WIDTH)] = k
    reach = np.where(far < len(near), near[np.minimum(far, len(near) - 1)], 0)
    prefix, extra, size = _prefixes(length)
    far, far_extra, far_size = _prefixes(np.where(reach > 0, reach, far + 120))
    put(np.flatnonzero(is_copy), (0, 256 + prefix, extra, size), (4, far, far_extra, far_size))
    n = n.astype(np.int64)

    heads = [_head(w, kind, c) for w, kind, c in zip(way.tolist(), kinds.tolist(), cached.tolist(), strict=True)]
    lead = np.array([b & 7 for _, b in heads], np.int64)  # bits of the header's last byte, which the pixels go on in
    done = np.concatenate([[0], np.cumsum(n)])
    first_op = np.searchsorted(at, np.append(begins, len(px)))
    body = np.diff(done[first_op])
    words = -(-(body + lead) // 64) + 1
    start = 64 * np.concatenate([[0], np.cumsum(words)])
    bit = done[:-1] + np.repeat(start[:-1] + lead - done[first_op[:-1]], np.diff(first_op))
    stream = _packed(value, n, bit, int(start[-1] >> 6) + 1).tobytes()
    for k, (head, size) in enumerate(heads):
        height, a = int(sizes[k]) // WIDTH, int(start[k]) >> 3
        pixels = bytearray(stream[a : a + -(-int(body[k] + lead[k]) // 8)])
        if lead[k]:
            pixels[0] |= head >> 8 * (size >> 3)
        front = (0x2F | (WIDTH - 1) << 8 | (height - 1) << 22 | 1 << 36).to_bytes(5, "little")
        files[rest[k]] = _wrap(front + (head & (1 << 8 * (size >> 3)) - 1).to_bytes(size >> 3, "little") + bytes(pixels))
    return files


# ---------------------------------------------------------------- media column
def _padded(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.maximum(64, -(-np.diff(offsets) // 64) * 64)
    off = np.concatenate([[0], np.cumsum(sizes)])
    out = np.zeros(int(off[-1]), np.uint8)
    out[np.arange(len(buf)) + np.repeat(off[:-1] - offsets[:-1], np.diff(offsets))] = buf
    return out, off


def features(images: list[np.ndarray]) -> list[str]:
    """Of each image (height, width, RGBA): size, mean of each channel in thousandths, and a 64-bit hash of 8 x 8 mean brightnesses against their mean."""
    out = [""] * len(images)
    for width in {x.shape[1] for x in images}:
        which = [k for k, x in enumerate(images) if x.shape[1] == width]
        heights = np.array([images[k].shape[0] for k in which], np.int64)
        begins = np.cumsum(heights) - heights
        channels = np.ascontiguousarray(np.concatenate([images[k].reshape(-1, 4) for k in which]).T)
        means = np.stack([np.add.reduceat(c, begins * width, dtype=np.int64) * 1000 // (heights * width) for c in channels], 1)
        grey = channels.sum(0, dtype=np.int32).reshape(-1, width)
        bands = begins[:, None] + np.arange(8) * heights[:, None] // 8
        low = heights < 8  # their rows are repeated
        bands[low] = begins[low, None] + np.arange(8) // -(-8 // heights[low, None])
        rows = np.add.reduceat(grey, bands.ravel(), 0, dtype=np.int64).reshape(-1, 8, width)
        rows[low] = grey[bands[low]]
        cells = rows.reshape(-1, 8, 8, width // 8).sum(3) * 8 // np.maximum(1, rows.sum(2, keepdims=True) // 8)
        bits = 64 * cells >= cells.sum((1, 2), keepdims=True)
        hashes = np.packbits(bits.reshape(-1, 64), axis=1).view(">u8").ravel().tolist()
        for k, height, m, x in zip(which, heights.tolist(), means.tolist(), hashes, strict=True):
            out[k] = f"{width}x{height}:{','.join(map(str, m))}:{x:016x}"
    return out


def store(docs: DataFrame, text: str = "text", id: str = "doc_id") -> DataFrame:
    """doc_id, n_bytes and the media column: the WebP files of each text (several beyond 16 KiB, one after the other)."""
    rows = docs.select(F.col(id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))

    def run(batches):
        for batch in batches:
            buf, offsets = C.text_bytes(batch.column("text"))
            for i, j in C.pieces(offsets, 1 << 21):
                data, off = _padded(buf[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                cuts = np.unique(np.concatenate([off, *(np.arange(a, b, 64 * MAX_ROWS) for a, b in zip(off[:-1], off[1:], strict=True) if b - a > 64 * MAX_ROWS)]))
                files = encode_many(data, cuts)
                at = np.searchsorted(cuts, off)
                media = [b"".join(files[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(i, j - i), pa.array(np.diff(offsets[i : j + 1])), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "media"])

    return rows.mapInArrow(run, "doc_id long, n_bytes long, media binary")


def _files(media: bytes) -> list[bytes]:
    out, at = [], 0
    while at < len(media):
        end = at + 8 + struct.unpack_from("<I", media, at + 4)[0] if len(media) >= at + 8 else len(media) + 1
        if end > len(media):
            raise WebPError("the file is cut off")
        out.append(media[at:end])
        at = end
    return out


def _decoded_bytes(file: bytes) -> int:
    """What a file's header says; 0 if it has none."""
    size = int.from_bytes(file[21:25], "little")
    return 4 * ((size & 0x3FFF) + 1) * ((size >> 14 & 0x3FFF) + 1) if len(file) >= 25 else 0


def read_media(stored: DataFrame, batch_bytes: int = 12 << 20) -> DataFrame:
    """doc_id, n_bytes, payload (bytes), media_bytes, media_sha256, feature of each stored row; decoded some ``batch_bytes`` of media, or twice that of pixels, at a time."""

    def run(batches):
        for batch in batches:
            media = [x.as_buffer().to_pybytes() for x in batch.column("media")]
            sizes = np.array([len(m) for m in media], np.int64)
            weights = np.maximum(sizes, [sum(map(_decoded_bytes, _files(m))) // 2 for m in media])
            for i, j in C.pieces(np.concatenate([[0], np.cumsum(weights)]), batch_bytes):
                files = [_files(m) for m in media[i:j]]
                images = decode_many([f for fs in files for f in fs])
                rgba, at = [], 0
                for fs in files:
                    argb = np.concatenate(images[at : at + len(fs)])
                    at += len(fs)
                    pixels = np.empty((*argb.shape, 4), np.uint8)
                    for c, shift in enumerate((16, 8, 0, 24)):
                        pixels[..., c] = argb >> np.uint32(shift)
                    rgba.append(pixels)
                digests = [hashlib.sha256(m).hexdigest() for m in media[i:j]]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(i, j - i), batch.column("n_bytes").slice(i, j - i), pa.array([x.tobytes() for x in rgba], pa.binary()),
                        pa.array(sizes[i:j]), pa.array(digests), pa.array(features(rgba)),
                    ],
                    names=["doc_id", "n_bytes", "payload", "media_bytes", "media_sha256", "feature"],
                )

    return stored.mapInArrow(run, "doc_id long, n_bytes long, payload binary, media_bytes long, media_sha256 string, feature string")


def op7_webp(spark, sf_dir: str) -> DataFrame:
    """Store every text as WebP, read the files back, and report payload and features."""
    stored = C.materialize(store(spark.read.parquet(f"{sf_dir}/documents.parquet")), "webp")
    read = read_media(stored)
    tail = F.expr("substring(payload, length(payload) - 63, 64)")
    return read.select("doc_id", "n_bytes", F.length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_sha256"), F.crc32(tail).alias("tail_crc32"), "media_bytes", "media_sha256", "feature")
