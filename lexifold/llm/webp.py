"""Lossless WebP: a decoder for the whole format, and pages of 8-bit samples that carry bytes.

`decode` reads any lossless files, many at once in lockstep: prefix codes, back-references, colour cache, entropy images,
and the predictor, cross-colour, subtract-green and palette transforms. Payloads are stored as pages of at most PAGE_ROWS
rows of WIDTH samples, three to a pixel, each page a WebP file of its own, one after the other. The writer refers back to
runs of pixels that a page has seen, keeps a colour cache where that makes the page smaller, and tries a palette, the
subtract-green transform and a predictor on pages whose samples they suit, of which the smallest is kept. What is stored
is read back by `decode`, and features are computed from those pixels.

Pages are written and read many at a time, so memory is bounded by CHUNK and the longest text. A null text is empty; an
empty text is one row of samples 255. Equal texts have equal media, repeated rows give repeated results. An empty table
gives no rows. Columns other than doc_id and text are left out, whatever their names.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import lean, slices, table, utf8

WIDTH, PAGE_ROWS, FILL = 576, 16, 255
PAGE = WIDTH * PAGE_ROWS
CHUNK = 8 << 20
#: Pages that are written, and read, in one go.
LANES, READ_LANES = 512, 1024
LIMIT = 12
#: Symbols of a code of greens: values and prefixes of lengths; colours of the cache follow. Symbols of the other codes.
SYMBOLS = 256 + 24
OTHERS = (256, 256, 256, 40)
# Fixed values of the format: the order in which lengths of the length code are stored, and near offsets of distances.
LENGTH_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
NEAR = (
    (0, 1), (1, 0), (1, 1), (-1, 1), (0, 2), (2, 0), (1, 2), (-1, 2), (2, 1), (-2, 1), (2, 2), (-2, 2),
    (0, 3), (3, 0), (1, 3), (-1, 3), (3, 1), (-3, 1), (2, 3), (-2, 3), (3, 2), (-3, 2), (0, 4), (4, 0),
    (1, 4), (-1, 4), (4, 1), (-4, 1), (3, 3), (-3, 3), (2, 4), (-2, 4), (4, 2), (-4, 2), (0, 5), (3, 4),
    (-3, 4), (4, 3), (-4, 3), (5, 0), (1, 5), (-1, 5), (5, 1), (-5, 1), (2, 5), (-2, 5), (5, 2), (-5, 2),
    (4, 4), (-4, 4), (3, 5), (-3, 5), (5, 3), (-5, 3), (0, 6), (6, 0), (1, 6), (-1, 6), (6, 1), (-6, 1),
    (2, 6), (-2, 6), (6, 2), (-6, 2), (4, 5), (-4, 5), (5, 4), (-5, 4), (3, 6), (-3, 6), (6, 3), (-6, 3),
    (0, 7), (7, 0), (1, 7), (-1, 7), (5, 5), (-5, 5), (7, 1), (-7, 1), (4, 6), (-4, 6), (6, 4), (-6, 4),
    (2, 7), (-2, 7), (7, 2), (-7, 2), (3, 7), (-3, 7), (7, 3), (-7, 3), (5, 6), (-5, 6), (6, 5), (-6, 5),
    (8, 0), (4, 7), (-4, 7), (7, 4), (-7, 4), (8, 1), (8, 2), (6, 6), (-6, 6), (8, 3), (5, 7), (-5, 7),
    (7, 5), (-7, 5), (8, 4), (6, 7), (-6, 7), (7, 6), (-7, 6), (8, 5), (7, 7), (-7, 7), (8, 6), (8, 7))
CACHE_FACTOR = 0x1E35A7BD
#: Bytes after the last stream, more than lanes read on between two checks.
AHEAD = 1 << 14
PREDICTOR, CROSS_COLOUR, SUBTRACT_GREEN, PALETTE = range(4)
BLACK = 0xFF000000


@cache
def reversed_bits(n: int) -> np.ndarray:
    out = np.zeros(1, np.int64)
    for _ in range(n):
        out = np.concatenate([out * 2, out * 2 + 1])
    return out


class Streams:
    """Bit streams, the lowest bit of each byte first, with a place in each."""

    def __init__(self, streams: list[bytes]):
        size = np.array([len(x) for x in streams], np.int64)
        blob = b"".join(streams) + bytes(AHEAD - sum(map(len, streams)) % 8)
        self.window = np.empty(len(blob) - 8, np.int64)
        for k in range(8):
            self.window[k::8] = np.frombuffer(blob[k: len(blob) - 8 + k], "<i8")
        self.at = 8 * (np.cumsum(size) - size)
        self.end = self.at + 8 * size

    def look(self, at: np.ndarray) -> np.ndarray:
        """The next bits, 56 of them at least."""
        return self.window[at >> 3] >> (at & 7)

    def take(self, lanes: np.ndarray, n: int | np.ndarray) -> np.ndarray:
        out = self.look(self.at[lanes]) & ((1 << n) - 1)
        self.at[lanes] += n
        return out

    def check(self, lanes: np.ndarray, at: np.ndarray) -> None:
        if (at > self.end[lanes]).any():
            raise ValueError("a stream ends early")


def tables(lengths: np.ndarray) -> np.ndarray:
    """For each row of code lengths a table from the next bits to a symbol and its length << 16; a lone symbol takes none."""
    row, symbol = np.nonzero(lengths)
    n = lengths[row, symbol].astype(np.int64)
    many = np.bincount(row, minlength=len(lengths))
    if not many.all():
        raise ValueError("a code without symbols")
    lone = many == 1
    use = ~lone[row]
    bits = int(n[use].max(initial=0))
    out = np.zeros((len(lengths), 1 << bits), np.int32)
    out[lone] = symbol[~use][:, None]
    row, symbol, n = row[use], symbol[use], n[use]
    span = 1 << (bits - n)
    if (np.bincount(row, span, len(lengths))[~lone] != 1 << bits).any():
        raise ValueError("a code that isn't complete")
    order = np.argsort((row << 20) + (n << 16) + symbol)
    out[~lone] = np.repeat((symbol | n << 16)[order], span[order]).reshape(-1, 1 << bits)[:, reversed_bits(bits)]
    return out


#: Of each symbol of a length code: how many lengths it stands for at least, and the bits that tell how many more.
LEAST, MORE = np.array([1] * 16 + [3, 3, 11]), np.array([0] * 16 + [2, 3, 7])


def read_lengths(s: Streams, lanes: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The lengths of a code of `size` symbols in each lane."""
    most = int(size.max())
    out = np.zeros((lanes.size, max(most, 256)), np.uint8)
    simple = s.take(lanes, 1) > 0
    some = np.flatnonzero(simple)
    if some.size:
        two, wide = s.take(lanes[some], 1) > 0, s.take(lanes[some], 1) > 0
        out[some, s.take(lanes[some], np.where(wide, 8, 1))] = 1
        some = some[two]
        out[some, s.take(lanes[some], 8)] = 1
    some = np.flatnonzero(~simple)
    s.check(lanes, s.at[lanes])
    if some.size:
        own = lanes[some]
        kinds = np.zeros((some.size, 19), np.int64)
        n = 4 + s.take(own, 4)
        for k in range(int(n.max())):
            i = np.flatnonzero(n > k)
            kinds[i, LENGTH_ORDER[k]] = s.take(own[i], 3)
        code = tables(kinds)
        mask, end = code.shape[1] - 1, size[some]
        left = end.copy()
        i = np.flatnonzero(s.take(own, 1))
        left[i] = 2 + s.take(own[i], 2 + 2 * s.take(own[i], 3))
        at, last, runs = np.zeros(some.size, np.int64), np.full(some.size, 8), []
        live = np.arange(some.size)
        while live.size:
            lane = own[live]
            entry = code[live, s.look(s.at[lane]) & mask]
            symbol = entry & 0xFFFF
            s.at[lane] += entry >> 16
            run = LEAST[symbol] + s.take(lane, MORE[symbol])
            value = np.where(symbol < 16, symbol, np.where(symbol == 16, last[live], 0))
            keep = value > 0
            runs.append((live[keep], at[live[keep]], run[keep], value[keep]))
            last[live] = np.where(keep, value, last[live])
            at[live] += run
            left[live] -= 1
            live = live[(at[live] < end[live]) & (left[live] > 0)]
        if (at > end).any():
            raise ValueError("lengths run over")
        s.check(own, s.at[own])
        lane, at, run, value = (np.concatenate(x) for x in zip(*runs, strict=True))
        first = np.cumsum(run) - run
        out[some[np.repeat(lane, run)], np.repeat(at - first, run) + np.arange(int(run.sum()))] = np.repeat(value, run)
    if out[:, most:].any():
        raise ValueError("a symbol beyond its code")
    return out[:, :most]


def stretch(s: Streams, at: np.ndarray, prefix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A length or distance by its prefix and the bits after it, and the place after those."""
    more = np.maximum((prefix - 2) >> 1, 0)
    extra = s.look(at) & ((1 << more) - 1)
    return np.where(prefix < 4, prefix, ((2 + (prefix & 1)) << more) + extra) + 1, at + more


def near_distances(width: int) -> np.ndarray:
    """The distances, in pixels, that the first codes of distances stand for."""
    return np.array([max(1, dx + dy * width) for dx, dy in NEAR], np.int64)


def read_pixels(s: Streams, lanes: np.ndarray, width: np.ndarray, height: np.ndarray, main: bool) -> list[np.ndarray]:
    """An entropy-coded image of each lane as ARGB values in rows; all lanes go on by a pixel in each step."""
    count = width * height
    order = np.argsort(-count, kind="stable")
    lanes, width, height, count = lanes[order], width[order], height[order], count[order]
    cache_bits, tile, across = (np.zeros(lanes.size, np.int64) for _ in range(3))
    cached = np.flatnonzero(s.take(lanes, 1))
    cache_bits[cached] = s.take(lanes[cached], 4)
    groups, group_home, group_of = np.ones(lanes.size, np.int64), np.zeros(lanes.size, np.int64), np.zeros(1, np.int64)
    if main:
        some = np.flatnonzero(s.take(lanes, 1))
        if some.size:
            tile[some] = s.take(lanes[some], 3) + 2
            across[some] = -(-width[some] >> tile[some])
            maps = [(x >> 8 & 0xFFFF).astype(np.int64) for x in read_pixels(s, lanes[some], across[some], -(-height[some] >> tile[some]), False)]
            sizes = np.array([x.size for x in maps])
            group_of = np.concatenate([group_of, *maps])
            group_home[some] = np.cumsum(sizes) - sizes + 1
            groups[some] = [int(x.max()) + 1 for x in maps]
    first = np.cumsum(groups) - groups
    colours = np.where(cache_bits > 0, 1 << cache_bits, 0)
    lengths = [np.zeros((int(groups.sum()), n), np.uint8) for n in (SYMBOLS + int(colours.max()), *OTHERS)]
    for g in range(int(groups.max())):
        some = np.flatnonzero(groups > g)
        for k, n in enumerate((SYMBOLS + colours[some], *(np.full(some.size, n) for n in OTHERS))):
            found = read_lengths(s, lanes[some], n)
            lengths[k][first[some] + g, : found.shape[1]] = found
    # greens, reds, blues and alphas as they stand in a pixel, with the bits that they take << 32
    found = [tables(x) for x in lengths]
    masks = [x.shape[1] - 1 for x in found]
    far = found[4]
    flat = [((x & 0xFFFF).astype(np.int64) << move | (x >> 16).astype(np.int64) << 32).ravel() for x, move in zip(found[:4], (8, 16, 0, 24), strict=True)]
    near = {int(w): near_distances(int(w)) for w in np.unique(width)}
    shift, slots, wide = 32 - cache_bits, np.maximum(colours, 1), cache_bits > 0
    cache_home = np.cumsum(slots) - slots
    caches = np.zeros(int(slots.sum()), np.uint32)
    total = int(count[0])
    out = np.zeros((total, lanes.size), np.uint32)
    at, left, back = s.at[lanes], np.zeros(lanes.size, np.int64), np.ones(lanes.size, np.int64)
    grouped, any_cache = bool((groups > 1).any()), bool(cached.size)
    live = np.searchsorted(-count, -np.arange(total), "left")
    home = [first * (mask + 1) for mask in masks[:4]]
    low, factor, shift = (1 << 32) - 1, np.uint32(CACHE_FACTOR), np.minimum(shift, 31).astype(np.uint32)
    any_left = False
    for t in range(total):
        m = live[t]
        if t % 256 == 0:
            s.check(lanes[:m], at[:m])
        row = first[:m]
        if grouped:
            y, x = np.divmod(t, width[:m])
            row = row + group_of[np.where(across[:m] > 0, group_home[:m] + (y >> tile[:m]) * across[:m] + (x >> tile[:m]), 0)]
            home = [row * (mask + 1) for mask in masks[:4]]
        place = at[:m]
        word = s.look(place)
        entry = flat[0].take(home[0][:m] + (word & masks[0]))
        took = entry >> 32
        after = place + took
        plain, end = entry & low, after
        pixel = plain
        for code, mask, base in zip(flat[1:], masks[1:], home[1:], strict=False):
            if mask:
                word = word >> took
                entry = code.take(base[:m] + (word & mask))
                took = entry >> 32
                end = end + took
                pixel = pixel | entry
            else:
                pixel = pixel | code.take(base[:m])
        pixel = pixel.astype(np.uint32)
        special = np.flatnonzero(plain >= 1 << 16)
        copied = np.flatnonzero(left[:m]) if any_left else special[:0]
        if special.size or copied.size:
            if copied.size:
                end[copied] = place[copied]
                special = special[left[special] == 0]
            end[special] = after[special]
            symbol = plain[special] >> 8
            cache_hit = symbol >= SYMBOLS
            hit, refer, symbol, slot = special[cache_hit], special[~cache_hit], symbol[~cache_hit], symbol[cache_hit]
            if hit.size:
                pixel[hit] = caches[cache_home[hit] + slot - SYMBOLS]
            if refer.size:
                n, p = stretch(s, end[refer], symbol - 256)
                entry = far[row[refer], s.look(p) & masks[4]]
                d, p = stretch(s, p + (entry >> 16), (entry & 0xFFFF).astype(np.int64))
                close = np.flatnonzero(d <= len(NEAR))
                d -= len(NEAR)
                for j in close:
                    d[j] = near[int(width[refer[j]])][d[j] + len(NEAR) - 1]
                if (d > t).any() or (t + n > count[refer]).any():
                    raise ValueError("a back-reference leaves the image")
                end[refer], left[refer], back[refer] = p, n, d
                copied = np.concatenate([copied, refer])
            if copied.size:
                pixel[copied] = out[t - back[copied], copied]
                left[copied] -= 1
                any_left = bool(left[copied].any())
        at[:m] = end
        out[t, :m] = pixel
        if any_cache:
            caches[cache_home[:m] + (pixel * factor >> shift[:m]) * wide[:m]] = pixel
    s.check(lanes, at)
    s.at[lanes] = at
    found: list[np.ndarray] = [np.zeros(0, np.uint32)] * lanes.size
    for j, i in enumerate(order):
        found[i] = out[: count[j], j]
    return found


def planes(pixels: np.ndarray) -> np.ndarray:
    """A, R, G, B of each pixel."""
    return np.ascontiguousarray(pixels.astype("<u4")).view(np.uint8).reshape(*pixels.shape, 4)[..., ::-1].astype(np.int32)


def predicted(modes: np.ndarray, left: np.ndarray, top: np.ndarray, corner: np.ndarray, right: np.ndarray) -> np.ndarray:
    """What each mode says of a pixel by those around it; rows are lanes, columns A, R, G, B."""
    out = np.zeros_like(left)
    out[:, 0] = 255
    mean = lambda a, b: (a + b) >> 1
    for mode in np.unique(modes):
        i = np.flatnonzero(modes == mode)
        a, b, c, d = left[i], top[i], corner[i], right[i]
        if mode in (0, 14, 15):
            continue
        if mode == 11:
            guess = a + b - c
            out[i] = np.where((abs(guess - a).sum(1) < abs(guess - b).sum(1))[:, None], a, b)
        elif mode == 12:
            out[i] = np.clip(a + b - c, 0, 255)
        elif mode == 13:
            half = mean(a, b) - c
            out[i] = np.clip(mean(a, b) + np.where(half < 0, -(-half >> 1), half >> 1), 0, 255)
        else:
            out[i] = {1: lambda: a, 2: lambda: b, 3: lambda: d, 4: lambda: c, 5: lambda: mean(mean(a, d), b), 6: lambda: mean(a, c), 7: lambda: mean(a, b), 8: lambda: mean(c, b), 9: lambda: mean(b, d), 10: lambda: mean(mean(a, c), mean(b, d))}[int(mode)]()
    return out


def undo_predictor(images: list[np.ndarray], modes: list[np.ndarray], tile: list[int]) -> list[np.ndarray]:
    """Images of one width, all lanes a pixel a step."""
    order = np.argsort([-len(x) for x in images], kind="stable")
    w, rows = images[0].shape[1], np.array([len(images[i]) for i in order])
    out = np.zeros((int(rows[0]) * w + 1, len(images), 4), np.int32)
    for y in range(int(rows[0])):
        m = int((rows > y).sum())
        row = np.stack([images[i][y] for i in order[:m]], 1)
        kind = np.stack([np.repeat(modes[i][y >> tile[i], :, 2] & 15, 1 << tile[i])[:w] for i in order[:m]], 1)
        for x in range(w):
            p = y * w + x
            if y == 0:
                guess = out[p - 1, :m] if x else np.array([255, 0, 0, 0])
            elif x == 0:
                guess = out[p - w, :m]
            else:  # right of the last column stands the first pixel of the row itself
                guess = predicted(kind[x], out[p - 1, :m], out[p - w, :m], out[p - w - 1, :m], out[p - w + 1, :m])
            out[p, :m] = (row[x] + guess) & 255
    back: list[np.ndarray] = [np.zeros(0)] * len(images)
    for j, i in enumerate(order):
        back[i] = out[: rows[j] * w, j].reshape(rows[j], w, 4)
    return back


def undo_cross_colour(image: np.ndarray, factors: np.ndarray, tile: int) -> np.ndarray:
    h, w, _ = image.shape
    f = np.repeat(np.repeat(factors, 1 << tile, 0), 1 << tile, 1)[:h, :w]
    signed = lambda v: (v & 255 ^ 128) - 128
    out = image.copy()
    green = signed(image[..., 2])
    out[..., 1] = (image[..., 1] + (signed(f[..., 3]) * green >> 5)) & 255
    out[..., 3] = (image[..., 3] + (signed(f[..., 2]) * green >> 5) + (signed(f[..., 1]) * signed(out[..., 1]) >> 5)) & 255
    return out


def undo_green(image: np.ndarray) -> np.ndarray:
    out = image.copy()
    out[..., [1, 3]] = (image[..., [1, 3]] + image[..., 2:3]) & 255
    return out


def undo_palette(image: np.ndarray, palette: np.ndarray, width: int, pack: int) -> np.ndarray:
    index = image[..., 2]
    if pack:
        each = 8 >> pack
        index = (index[..., None] >> (each * np.arange(1 << pack)) & ((1 << each) - 1)).reshape(len(index), -1)[:, :width]
    full = np.zeros((256, 4), np.int32)
    full[: len(palette)] = palette
    return full[index]


def packing(colours: int | np.ndarray) -> np.ndarray:
    """How often the width of an image halves that has so many colours."""
    return np.where(np.asarray(colours) <= 2, 3, np.where(np.asarray(colours) <= 4, 2, np.where(np.asarray(colours) <= 16, 1, 0)))


def decode(files: list[bytes]) -> list[np.ndarray]:
    """The pixels of lossless WebP files: height, width, and A, R, G, B."""
    for f in files:
        if f[:4] != b"RIFF" or f[8:16] != b"WEBPVP8L" or f[20] != 0x2F:
            raise ValueError("not a lossless WebP file")
    s = Streams([f[21: 20 + int.from_bytes(f[16:20], "little")] for f in files])
    every = np.arange(len(files))
    width, height = s.take(every, 14) + 1, s.take(every, 14) + 1
    s.take(every, 1)
    if s.take(every, 3).any():
        raise ValueError("an unknown version")
    undo: list[list[tuple]] = [[] for _ in files]
    across = width.copy()
    lanes = every
    while (lanes := lanes[s.take(lanes, 1) > 0]).size:
        kind = s.take(lanes, 2)
        blocks = lanes[kind < 2]
        if blocks.size:
            tile = s.take(blocks, 3) + 2
            w, h = -(-across[blocks] >> tile), -(-height[blocks] >> tile)
            for i, k, t, x, y, px in zip(blocks, kind[kind < 2], tile, w, h, read_pixels(s, blocks, w, h, False), strict=True):
                undo[i].append((int(k), planes(px.reshape(y, x)), int(t)))
        for i in lanes[kind == SUBTRACT_GREEN]:
            undo[i].append((SUBTRACT_GREEN,))
        some = lanes[kind == PALETTE]
        if some.size:
            n = s.take(some, 8) + 1
            for i, c, px in zip(some, n, read_pixels(s, some, n, np.ones_like(n), False), strict=True):
                pack = int(packing(int(c)))
                undo[i].append((PALETTE, np.cumsum(planes(px), 0) & 255, int(across[i]), pack))
                across[i] = -(-across[i] >> pack)
    images = [planes(px.reshape(h, w)) for px, h, w in zip(read_pixels(s, every, across, height, True), height, across, strict=True)]
    while any(undo):
        waiting: dict[int, list[int]] = {}
        for i, steps in enumerate(undo):
            while steps and steps[-1][0] != PREDICTOR:
                k, *more = steps.pop()
                images[i] = {CROSS_COLOUR: undo_cross_colour, SUBTRACT_GREEN: undo_green, PALETTE: undo_palette}[k](images[i], *more)
            if steps:
                waiting.setdefault(images[i].shape[1], []).append(i)
        for own in waiting.values():
            _, modes, tile = zip(*(undo[i].pop() for i in own), strict=True)
            for i, image in zip(own, undo_predictor([images[i] for i in own], list(modes), list(tile)), strict=True):
                images[i] = image
    return [x.astype(np.uint8) for x in images]


def code_lengths(counts: np.ndarray) -> np.ndarray:
    """Lengths of a complete prefix code of at most LIMIT bits for each row of counts, 0 for rows of fewer than two symbols.

    Shannon's lengths leave room; it goes to the most frequent symbols first, until none is left.
    """
    used = (counts > 0) & ((counts > 0).sum(1) > 1)[:, None]
    total = counts.sum(1, keepdims=True)
    weight = np.where(used, counts + total // 2048 + 1, 0)
    share = np.maximum(weight.sum(1, keepdims=True), 1) / np.maximum(weight, 1)
    length = np.where(used, np.clip(np.ceil(np.log2(share) - 1e-9), 1, LIMIT), 0).astype(np.int64)
    room = np.where(used.any(1), (1 << LIMIT) - np.where(used, 1 << (LIMIT - length), 0).sum(1), 0)
    order = np.argsort(-counts, 1, kind="stable")[:, : int(used.sum(1).max())]
    rows = np.arange(len(counts))
    while (room > 0).any():
        for column in order.T:
            n = length[rows, column]
            cost = 1 << (LIMIT - n)
            go = (n > 1) & (cost <= room)
            length[rows, column] -= go
            room -= np.where(go, cost, 0)
    return length


class Pieces:
    """Bits of several streams, gathered in any order; those of one stream keep theirs."""

    def __init__(self, lanes: int):
        self.lanes, self.held = lanes, []

    def put(self, lane: np.ndarray, value: np.ndarray | int, n: np.ndarray | int) -> None:
        """Values of at most 17 bits."""
        self.held.append((lane, np.broadcast_to(value, lane.shape), np.broadcast_to(n, lane.shape)))

    def streams(self) -> list[bytes]:
        lane, value, n = (np.concatenate(x).astype(np.int64) for x in zip(*self.held, strict=True))
        order = np.argsort(lane.astype(np.uint16), kind="stable")
        lane, value, n = lane[order], value[order], n[order]
        size = np.bincount(lane, n, self.lanes).astype(np.int64)
        words = (size + 15) // 16
        base = np.cumsum(words) - words
        at = base[lane] * 16 + np.cumsum(n) - n - (np.cumsum(size) - size)[lane]
        value = value << (at & 15)
        total = int(words.sum()) + 2
        out = np.bincount(at >> 4, value & 0xFFFF, total) + np.bincount((at >> 4) + 1, value >> 16, total)
        raw = out.astype("<u2").tobytes()
        return [raw[2 * b: 2 * b + (k + 7) // 8] for b, k in zip(base.tolist(), size.tolist(), strict=True)]


def own_bits(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bits of each symbol of each row of code lengths, lowest first, and how many."""
    order = np.argsort(np.where(lengths > 0, lengths, 99) * 4096 + np.arange(lengths.shape[1]), 1)
    n = np.take_along_axis(lengths, order, 1)
    span = np.where(n > 0, 1 << (LIMIT - n), 0)
    left = np.minimum(np.cumsum(span, 1) - span, (1 << LIMIT) - 1)
    codes = np.zeros_like(lengths)
    np.put_along_axis(codes, order, reversed_bits(LIMIT)[left], 1)
    return codes, lengths


#: The code of code lengths that the writer always uses: 13 symbols of 4 bits and 6 of 5.
_KINDS = np.array([[4] * 13 + [5] * 6], np.int64)
_KIND_BITS = own_bits(_KINDS)[0][0]
#: What stands before lengths: not simple, 19 kinds, their lengths, and no number of lengths.
_BEFORE = [(0, 1), (15, 4), *((int(_KINDS[0, i]), 3) for i in LENGTH_ORDER), (0, 1)]


def put_code(out: Pieces, lane: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Writes a code for the counts of each lane; gives the bits of its symbols and how many (none of a lone one)."""
    many = (counts > 0).sum(1)
    lone = many < 2
    out.put(lane[lone], 5 + (counts[lone].argmax(1) << 3), 11)  # simple, one symbol, of eight bits
    lengths = code_lengths(counts)
    some = np.flatnonzero(~lone)
    for value, n in _BEFORE:
        out.put(lane[some], value, n)
    flat = lengths[some]
    if some.size:
        zero = (flat == 0).ravel()
        size = flat.shape[1]
        edge = np.ones(zero.size, bool)
        edge[1:] = ~zero[1:] | ~zero[:-1]
        edge[::size] = True
        start = np.flatnonzero(edge)
        run = np.diff(np.append(start, zero.size))
        run[~zero[start]] = 0
        full, rest = run // 138, run % 138
        n = np.where(run > 0, full + np.where(rest >= 3, 1, rest), 1)
        at = np.repeat(np.arange(start.size), n)
        j = np.arange(at.size) - (np.cumsum(n) - n)[at]
        long, rest = j < full[at], rest[at]
        kind = np.where(run[at] == 0, flat.ravel()[start[at]], np.where(long, 18, np.where(rest >= 11, 18, np.where(rest >= 3, 17, 0))))
        value = np.where(kind == 18, np.where(long, 127, rest - 11), np.where(kind == 17, rest - 3, 0))
        bits = _KINDS[0, kind]
        out.put(lane[some][start[at] // size], _KIND_BITS[kind] | value << bits, bits + MORE[kind])
    return own_bits(lengths)


def prefix(value: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Prefix, the bits after it and their number, for lengths and distance codes of at least 1."""
    x = value - 1
    high = np.maximum(np.frexp(np.maximum(x, 1).astype(float))[1] - 1, 1)
    more = np.where(x < 4, 0, high - 1)
    return np.where(x < 4, x, 2 * high + (x >> np.maximum(high - 1, 0) & 1)), x & ((1 << more) - 1), more


def cost(counts: np.ndarray) -> np.ndarray:
    """About how many bits symbols with such counts take in each row, and the lengths of their code."""
    total = counts.sum(1, keepdims=True)
    return np.where(counts > 0, counts * np.log2(np.maximum(total, 1) / np.maximum(counts, 1)) + 4, 0).sum(1)


def seen_before(pixels: np.ndarray, cache_bits: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each pixel (a row for each step, a column for each lane): its cache slot, whether that holds it, and the
    distance to where it and the two after it stood last (0: nowhere)."""
    total, lanes = pixels.shape
    key = (pixels.astype(np.int64) * CACHE_FACTOR & 0xFFFFFFFF) >> (32 - cache_bits)
    three = pixels[:-2].astype(np.uint64) if total > 2 else np.zeros((0, lanes), np.uint64)
    for k in (1, 2):
        three = three * np.uint64(0x9E3779B97F4A7C15) + pixels[k: total - 2 + k]
    slot = (three * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(52)).astype(np.int64)
    slots = 1 << int(cache_bits.max())
    caches, latest = np.zeros(lanes * slots, np.uint32), np.full(lanes << 12, -1, np.int32)
    held, last = np.zeros((total, lanes), bool), np.full((total, lanes), -1, np.int32)
    home, far = np.arange(lanes) * slots, np.arange(lanes) << 12
    for t in range(total):
        i = home + key[t]
        held[t] = caches[i] == pixels[t]
        caches[i] = pixels[t]
        if t < len(slot):
            i = far + slot[t]
            last[t] = latest[i]
            latest[i] = t
    held &= cache_bits > 0
    t, lane = np.nonzero(last >= 0)
    was = last[t, lane]
    same = (pixels[t, lane] == pixels[was, lane]) & (pixels[t + 1, lane] == pixels[was + 1, lane]) & (pixels[t + 2, lane] == pixels[was + 2, lane])
    distance = np.zeros((total, lanes), np.int64)
    distance[t[same], lane[same]] = t[same] - was[same]
    return key, held, distance


def put_image(out: Pieces, lane: np.ndarray, pixels: np.ndarray, count: np.ndarray, width: int, main: bool) -> None:
    """Writes an entropy-coded image for each lane: pixels are columns, of which `count` count."""
    total, lanes = pixels.shape
    bits = np.clip(np.log2(count).astype(np.int64) - 2, 0, 10) if main else np.zeros(lanes, np.int64)
    key, held, distance = seen_before(pixels, bits)
    inside = (np.arange(total)[:, None] < count).T
    near = np.zeros(9 * width + 9, np.int64)
    for code, d in zip(range(len(NEAR), 0, -1), near_distances(width)[::-1], strict=True):
        near[d] = code
    # runs of pixels at one distance; each goes two pixels on, up to the next
    d = np.where(inside, distance.T, 0)
    d[np.arange(total) + 2 >= count[:, None]] = 0
    fresh = np.ones((lanes, total), bool)
    fresh[:, 1:] = d[:, 1:] != d[:, :-1]
    d = d.ravel()
    stop = np.flatnonzero(fresh.ravel())
    used = d[stop] > 0
    start, stop = stop[used], np.append(stop[1:], d.size)[used]
    stop = np.minimum(stop + 2, np.minimum(np.append(start[1:], d.size), (start // total) * total + count[start // total]))
    use = stop - start >= 4
    start, stop = start[use], stop[use]
    size = stop - start
    within = np.zeros(d.size + 1, np.int8)
    np.add.at(within, start, 1)
    np.add.at(within, stop, -1)
    far = d[start]
    code = np.where(far < near.size, near[np.minimum(far, near.size - 1)], 0)
    n_prefix, n_extra, n_more = prefix(size)
    d_prefix, d_extra, d_more = prefix(np.where(code > 0, code, far + len(NEAR)))
    owner = start // total
    one = np.flatnonzero(inside.ravel() & (np.cumsum(within[:-1], dtype=np.int8) == 0))
    of, step = np.divmod(one, total)
    colour = pixels[step, of]
    hit, slot = held[step, of], key[step, of]
    home = of * 256
    channel = lambda rows, shift: np.bincount(home[rows] + (colour[rows] >> np.uint32(shift) & np.uint32(255)), minlength=lanes * 256).reshape(lanes, 256)
    lengths = np.bincount(owner * 24 + n_prefix, minlength=lanes * 24).reshape(lanes, 24)
    slots = 1 << int(bits.max())
    cached = np.bincount(of[hit] * slots + slot[hit], minlength=lanes * slots).reshape(lanes, slots)
    every = [channel(slice(None), shift) for shift in (8, 16, 0)]
    rest = [x - channel(hit, shift) for x, shift in zip(every, (8, 16, 0), strict=True)]
    with_cache = cost(np.concatenate([rest[0], lengths, cached], 1)) + cost(rest[1]) + cost(rest[2])
    without = cost(np.concatenate([every[0], lengths], 1)) + cost(every[1]) + cost(every[2])
    keep = (with_cache < without) & (bits > 0)
    hit &= keep[of]
    cached[~keep] = 0
    out.put(lane, np.where(keep, 1 | bits << 1, 0), np.where(keep, 5, 1))
    if main:
        out.put(lane, 0, 1)  # one group of codes
    literal = [np.where(keep[:, None], x, y) for x, y in zip(rest, every, strict=True)]
    greens = np.concatenate([literal[0], lengths, cached], 1)
    odd = ((greens > 0).sum(1) == 1) & (greens.argmax(1) > 255)
    greens[odd, 0] += 1  # a lone symbol has to be a value
    codes = []
    widths = np.where(keep, SYMBOLS + (1 << bits), SYMBOLS)
    for w in np.unique(widths):  # a code has as many symbols as its cache wants
        i = np.flatnonzero(widths == w)
        part = Pieces(out.lanes)
        codes.append((i, part, put_code(part, lane[i], greens[i, :w])))
    green_code, green_size = (np.zeros(greens.shape, np.int64) for _ in range(2))
    for i, part, (c, n) in codes:
        out.held += part.held
        green_code[i, : c.shape[1]], green_size[i, : c.shape[1]] = c, n
    red, blue = put_code(out, lane, literal[1]), put_code(out, lane, literal[2])
    shade = colour[~hit] >> np.uint32(24)
    if not shade.size or (shade == shade[0]).all():
        out.put(lane, 5 + ((int(shade[0]) if shade.size else 255) << 3), 11)
        alpha = None
    else:
        alpha = put_code(out, lane, channel(~hit, 24))
    distances = put_code(out, lane, np.bincount(owner * 40 + d_prefix, minlength=lanes * 40).reshape(lanes, 40))
    # tokens in the order of pixels, each with up to four pieces
    place = np.concatenate([start, one])
    row = place // total
    symbol = np.concatenate([256 + n_prefix, np.where(hit, SYMBOLS + slot, colour >> np.uint32(8) & np.uint32(255))])
    value, n = np.zeros((place.size, 4), np.int64), np.zeros((place.size, 4), np.int64)
    value[:, 0], n[:, 0] = green_code[row, symbol], green_size[row, symbol]
    k = start.size
    value[:k, 1], n[:k, 1] = n_extra, n_more
    value[:k, 2], n[:k, 2] = (x[owner, d_prefix] for x in distances)
    value[:k, 3], n[:k, 3] = d_extra, d_more
    plain = np.flatnonzero(~hit)
    for j, (c, size_), shift in ((1, red, 16), (2, blue, 0), *([(3, alpha, 24)] if alpha else [])):
        value[k + plain, j], n[k + plain, j] = (x[of[plain], colour[plain] >> np.uint32(shift) & np.uint32(255)] for x in (c, size_))
    order = np.argsort(place, kind="stable")
    value, n, row = value[order].ravel(), n[order].ravel(), np.repeat(row[order], 4)
    some = n > 0
    out.put(lane[row[some]], value[some], n[some])


def residuals(pixels: np.ndarray, width: int) -> np.ndarray:
    """What is left of each pixel less the one on its left (above in the first column, black at first); rows are steps."""
    guess = np.empty_like(pixels)
    guess[1:] = pixels[:-1]
    guess[width::width] = pixels[:-width:width]
    guess[0] = BLACK
    out = np.zeros_like(pixels)
    for shift in (0, 8, 16, 24):
        k = np.uint32(shift)
        out |= ((pixels >> k) - (guess >> k) & np.uint32(255)) << k
    return out


def less_green(pixels: np.ndarray) -> np.ndarray:
    g = pixels >> np.uint32(8) & np.uint32(255)
    red, blue = (pixels >> np.uint32(16)) - g & np.uint32(255), pixels - g & np.uint32(255)
    return pixels & np.uint32(0xFF00FF00) | red << np.uint32(16) | blue


def write(pixels: np.ndarray, rows: np.ndarray, how: int | None, width: int = WIDTH // 3) -> list[bytes]:
    """A WebP file for each column of pixels, with one transform or none."""
    every = np.arange(len(rows))
    out = Pieces(len(rows))
    for value in (width - 1 & 0x3FFF, None):
        out.put(every, rows - 1 if value is None else value, 14)
    out.put(every, 0, 4)  # no alpha in use, version 0
    count, across = rows * width, width
    one = lambda v: np.full((1, every.size), v, np.uint32)
    if how is not None:
        out.put(every, 1 | how << 1, 3)
    if how == PREDICTOR:
        out.put(every, 7, 3)  # tiles of 512 pixels a side, of mode 1
        put_image(out, every, one(BLACK | 1 << 8), np.ones_like(rows), 1, False)
        pixels = residuals(pixels, width)
    elif how == SUBTRACT_GREEN:
        pixels = less_green(pixels)
    elif how == PALETTE:  # pages of one number of bits for an index
        own = [np.unique(pixels[:n, i], return_inverse=True) for i, n in enumerate(count)]
        colours = np.array([len(c) for c, _ in own])
        pack = int(packing(int(colours.max())))
        table_ = np.zeros((int(colours.max()), every.size), np.uint32)
        for i, (c, _) in enumerate(own):
            p = planes(c)
            p[1:] = (p[1:] - p[:-1]) & 255
            table_[: c.size, i] = p[..., 0].astype(np.int64) << 24 | p[..., 1] << 16 | p[..., 2] << 8 | p[..., 3]
        out.put(every, colours - 1, 8)
        put_image(out, every, table_, colours, 1, False)
        across = -(-width >> pack)
        packed = np.full((int(rows.max()) * across, every.size), BLACK, np.int64)
        for i, (_, index) in enumerate(own):
            line = np.zeros((rows[i], across << pack), np.int64)
            line[:, :width] = index.reshape(rows[i], width)
            value = (line.reshape(rows[i], across, 1 << pack) << (8 >> pack) * np.arange(1 << pack)).sum(2)
            packed[: value.size, i] |= value.ravel() << 8
        pixels, count = packed.astype(np.uint32), rows * across
    out.put(every, 0, 1)
    put_image(out, every, pixels, count, across, True)
    files = []
    for stream in out.streams():
        chunk = b"VP8L" + (len(stream) + 1).to_bytes(4, "little") + b"\x2f" + stream
        chunk += bytes(len(chunk) % 2)
        files.append(b"RIFF" + (len(chunk) + 4).to_bytes(4, "little") + b"WEBP" + chunk)
    return files


def channels_cost(pixels: np.ndarray, home: np.ndarray, lanes: int) -> np.ndarray:
    """About how many bits the values of each lane take one by one; pixels of all lanes, and 256 times their lane."""
    return sum(cost(np.bincount(home + (pixels >> np.uint32(shift) & np.uint32(255)), minlength=lanes * 256).reshape(lanes, 256)) for shift in (16, 8, 0))


def write_pages(samples: np.ndarray, starts: np.ndarray, rows: np.ndarray) -> list[bytes]:
    """WebP files of pages: rows of WIDTH samples from each start on; the smallest of the forms that suit a page."""
    out: list[bytes] = [b""] * len(rows)
    order = np.argsort(-rows, kind="stable")
    width = WIDTH // 3
    for lo in range(0, order.size, LANES):
        own = order[lo: lo + LANES]
        n = rows[own]
        pixels = np.full((int(n[0]) * width, own.size), BLACK, np.uint32)
        for i, (a, r) in enumerate(zip(starts[own], n, strict=True)):
            c = samples[a: a + r * WIDTH].reshape(-1, 3).astype(np.uint32)
            pixels[: len(c), i] |= c[:, 0] << 16 | c[:, 1] << 8 | c[:, 2]
        for i, f in zip(own, write(pixels, n, None), strict=True):
            out[i] = f
        step, lane = np.nonzero(np.arange(len(pixels))[:, None] < n * width)
        home = lane * 256
        value = lambda change: channels_cost(change[step, lane], home, own.size)
        plain = 0.9 * value(pixels)
        tries = [(how, np.flatnonzero(value(change) < plain)) for how, change in ((PREDICTOR, residuals(pixels, width)), (SUBTRACT_GREEN, less_green(pixels)))]
        # at least as many colours as a hash has values
        kinds = np.bincount(home + (pixels[step, lane] * np.uint32(CACHE_FACTOR) >> np.uint32(24)), minlength=own.size * 256).reshape(-1, 256)
        colours = np.array([len(np.unique(pixels[: r * width, i])) if few else 256 for i, (r, few) in enumerate(zip(n, (kinds > 0).sum(1) <= 16, strict=True))])
        tries += [(PALETTE, np.flatnonzero((packing(colours) == k) & (colours <= 16))) for k in (1, 2, 3)]
        for how, some in tries:
            if some.size:
                for i, f in zip(own[some], write(pixels[: int(n[some].max()) * width, some], n[some], how), strict=True):
                    out[i] = min(out[i], f, key=len)
    return out


def store(texts: pa.Array) -> tuple[list[bytes], np.ndarray]:
    """The media of each text: its pages one after the other; and the sizes of texts in bytes."""
    data, offsets = utf8(texts)
    size = np.diff(offsets)
    rows = np.maximum(-(-size // WIDTH), 1)
    pages = -(-rows // PAGE_ROWS)
    text = np.repeat(np.arange(len(size)), pages)
    first = (np.arange(text.size) - (np.cumsum(pages) - pages)[text]) * PAGE_ROWS
    page_rows = np.minimum(rows[text] - first, PAGE_ROWS)
    out = [b""] * len(size)
    lo = 0
    while lo < text.size:  # pages of a long text come in parts, too
        hi = max(lo + 1, int(np.searchsorted(np.cumsum(page_rows[lo:]) * WIDTH, CHUNK, "right")) + lo)
        starts = (np.cumsum(page_rows[lo:hi]) - page_rows[lo:hi]) * WIDTH
        samples = np.full(int(page_rows[lo:hi].sum()) * WIDTH, FILL, np.uint8)
        for a, t, f, r in zip(starts, text[lo:hi], first[lo:hi], page_rows[lo:hi], strict=True):
            raw = data[offsets[t] + f * WIDTH: min(offsets[t + 1], offsets[t] + (f + r) * WIDTH)]
            samples[a: a + raw.size] = raw
        for t, f in zip(text[lo:hi], write_pages(samples, starts, page_rows[lo:hi]), strict=True):
            out[t] += f
        lo = hi
    return out, size


def load(media: list[bytes]) -> Iterator[np.ndarray]:
    """The payload of each media, read back: the samples of its pages' pixels."""
    files, owner = [], []
    for i, m in enumerate(media):
        at = 0
        while at < len(m):
            n = 8 + int.from_bytes(m[at + 4: at + 8], "little")
            files.append(m[at: at + n])
            owner.append(i)
            at += n
    rows = np.array([int.from_bytes(f[21:25], "little") >> 14 & 0x3FFF for f in files])
    order = np.argsort(rows, kind="stable")
    found: list[bytes] = [b""] * len(files)
    for lo in range(0, order.size, READ_LANES):
        own = order[lo: lo + READ_LANES]
        for i, image in zip(own, decode([files[i] for i in own]), strict=True):
            found[i] = image[..., 1:].tobytes()
    parts: list[list[bytes]] = [[] for _ in media]
    for i, x in zip(owner, found, strict=True):
        parts[i].append(x)
    return (np.frombuffer(b"".join(p), np.uint8) for p in parts)


def feature(samples: np.ndarray) -> str:
    """Rows, mean and mean square of the samples, and the mean step between neighbours, in thousandths."""
    wide = samples.astype(np.int64)
    n = wide.size
    return f"{n // WIDTH}:{int(wide.sum()) * 1000 // n}:{int((wide * wide).sum()) * 1000 // n}:{int(np.abs(np.diff(wide)).sum()) * 1000 // n}"


def media_features(docs: DataFrame, keep_media: bool = False) -> DataFrame:
    """doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature and, if wanted, media."""
    kinds = "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string" + ", media binary" * keep_media
    names = ["doc_id", *(x.split()[0] for x in kinds.split(", "))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text", CHUNK):
                media, size = store(batch.column("text"))
                back = []
                for samples in load(media):
                    raw = samples.tobytes()
                    back.append((len(raw), hashlib.sha256(raw).hexdigest(), zlib.crc32(raw[-32:]), feature(samples)))
                n, digest, tail, made = zip(*back, strict=True)
                columns = [batch.column("doc_id"), pa.array(size, pa.int64()), pa.array(n, pa.int64()), pa.array(digest), pa.array(tail, pa.int64()), pa.array([len(m) for m in media], pa.int64()), pa.array([hashlib.sha256(m).hexdigest() for m in media]), pa.array(made)]
                yield pa.RecordBatch.from_arrays([*columns, *[pa.array(media, pa.binary())] * keep_media], names)

    return lean(docs).select("doc_id", "text").mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, {kinds}")


def op1_webp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_features(table(spark, sf_dir, "documents"))
