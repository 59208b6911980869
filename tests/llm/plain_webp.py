"""A lossless WebP decoder one pixel at a time, for comparison."""

import numpy as np

SYMBOLS = 256 + 24
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


class Bits:
    """Reads bits, the lowest of each byte first."""

    def __init__(self, data: bytes):
        self.value, self.at, self.end = int.from_bytes(data, "little"), 0, 8 * len(data)
        self.data = data

    def take(self, n: int) -> int:
        if n == 0:
            return 0
        lo = self.at >> 3
        word = int.from_bytes(self.data[lo: lo + 8], "little") >> (self.at & 7)
        self.at += n
        if self.at > self.end:
            raise ValueError("the stream ends early")
        return word & ((1 << n) - 1)


class Code:
    """A prefix code by its lengths; a lone symbol takes no bits."""

    def __init__(self, lengths: list[int]):
        used = [(n, s) for s, n in enumerate(lengths) if n]
        self.only = used[0][1] if len(used) == 1 else None
        self.symbols: dict[tuple[int, int], int] = {}
        if not used:
            raise ValueError("a code without symbols")
        if self.only is None and sum(1 << (15 - n) for n, _ in used) != 1 << 15:
            raise ValueError("a code that isn't complete")
        value, last = 0, 0
        for n, s in sorted(used):
            value <<= n - last
            self.symbols[n, value] = s
            value, last = value + 1, n

    def read(self, bits: Bits) -> int:
        if self.only is not None:
            return self.only
        value = 0
        for n in range(1, 16):
            value = value << 1 | bits.take(1)
            if (s := self.symbols.get((n, value))) is not None:
                return s
        raise ValueError("no such code")


def read_lengths(bits: Bits, size: int) -> list[int]:
    out = [0] * size
    if bits.take(1):
        two, wide = bits.take(1), bits.take(1)
        out[bits.take(8 if wide else 1)] = 1
        if two:
            out[bits.take(8)] = 1
        return out
    own = [0] * 19
    for i in LENGTH_ORDER[: 4 + bits.take(4)]:
        own[i] = bits.take(3)
    code = Code(own)
    left = 2 + bits.take(2 + 2 * bits.take(3)) if bits.take(1) else size
    at, last = 0, 8
    while at < size and left:
        left -= 1
        s = code.read(bits)
        if s < 16:
            out[at], at = s, at + 1
            last = s or last
        else:
            n = 3 + bits.take(2) if s == 16 else 3 + bits.take(3) if s == 17 else 11 + bits.take(7)
            out[at: at + n] = [last if s == 16 else 0] * n
            at += n
    if len(out) != size:
        raise ValueError("lengths run over")
    return out


def stretch(bits: Bits, prefix: int) -> int:
    if prefix < 4:
        return prefix + 1
    extra = (prefix - 2) >> 1
    return ((2 + (prefix & 1)) << extra) + bits.take(extra) + 1


def read_pixels(bits: Bits, width: int, height: int, main: bool) -> list[int]:
    """An entropy-coded image as ARGB values in rows."""
    cache_bits = bits.take(4) if bits.take(1) else 0
    groups, tile, group_of = 1, 0, None
    if main and bits.take(1):
        tile = bits.take(3) + 2
        across = -(-width >> tile)
        group_of = [p >> 8 & 0xFFFF for p in read_pixels(bits, across, -(-height >> tile), False)]
        groups = max(group_of) + 1
    cache = [0] * (1 << cache_bits if cache_bits else 0)
    codes = [[Code(read_lengths(bits, n)) for n in (SYMBOLS + len(cache), 256, 256, 256, 40)] for _ in range(groups)]
    out: list[int] = []
    total = width * height
    green, red, blue, alpha, far = codes[0]

    def put(pixel: int) -> None:
        out.append(pixel)
        if cache_bits:
            cache[(CACHE_FACTOR * pixel & 0xFFFFFFFF) >> (32 - cache_bits)] = pixel

    while len(out) < total:
        if group_of:
            y, x = divmod(len(out), width)
            green, red, blue, alpha, far = codes[group_of[(y >> tile) * across + (x >> tile)]]
        s = green.read(bits)
        if s < 256:
            r, b, a = red.read(bits), blue.read(bits), alpha.read(bits)
            put(a << 24 | r << 16 | s << 8 | b)
        elif s < SYMBOLS:
            n, d = stretch(bits, s - 256), stretch(bits, far.read(bits))
            d = max(1, NEAR[d - 1][0] + NEAR[d - 1][1] * width) if d <= len(NEAR) else d - len(NEAR)
            if d > len(out) or len(out) + n > total:
                raise ValueError("a back-reference leaves the image")
            for _ in range(n):
                put(out[-d])
        else:
            put(cache[s - SYMBOLS])
    return out


def planes(pixels: list[int]) -> np.ndarray:
    """A, R, G, B of each pixel."""
    return np.array(pixels, np.uint32).astype("<u4").view(np.uint8).reshape(-1, 4)[:, ::-1].astype(np.int32)


def predicted(mode: int, left: np.ndarray, top: np.ndarray, corner: np.ndarray, right: np.ndarray) -> np.ndarray:
    mean = lambda a, b: (a + b) >> 1
    if mode == 0 or mode > 13:
        return np.array([255, 0, 0, 0])
    if mode == 11:
        guess = left + top - corner
        return left if np.abs(guess - left).sum() < np.abs(guess - top).sum() else top
    if mode == 12:
        return np.clip(left + top - corner, 0, 255)
    if mode == 13:
        middle = mean(left, top)
        half = middle - corner
        return np.clip(middle + np.trunc(half / 2).astype(int), 0, 255)
    return (left, top, right, corner, mean(mean(left, right), top), mean(left, corner), mean(left, top), mean(corner, top), mean(top, right), mean(mean(left, corner), mean(top, right)))[mode - 1]


def undo_predictor(image: np.ndarray, modes: np.ndarray, tile: int) -> np.ndarray:
    h, w, _ = image.shape
    out = np.zeros((h, w, 4), np.int32)
    flat = out.reshape(-1, 4)
    for y in range(h):
        for x in range(w):
            if y == 0:
                p = flat[x - 1] if x else np.array([255, 0, 0, 0])
            elif x == 0:
                p = out[y - 1, 0]
            else:  # right of the last column stands the first pixel of the row itself
                p = predicted(int(modes[y >> tile, x >> tile, 2]) & 15, out[y, x - 1], out[y - 1, x], out[y - 1, x - 1], flat[(y - 1) * w + x + 1])
            out[y, x] = (image[y, x] + p) & 255
    return out


def undo_cross_colour(image: np.ndarray, factors: np.ndarray, tile: int) -> np.ndarray:
    h, w, _ = image.shape
    f = np.repeat(np.repeat(factors, 1 << tile, 0), 1 << tile, 1)[:h, :w]
    signed = lambda v: (v & 255 ^ 128) - 128
    out = image.copy()
    green = signed(image[..., 2])
    out[..., 1] = (image[..., 1] + (signed(f[..., 3]) * green >> 5)) & 255
    out[..., 3] = (image[..., 3] + (signed(f[..., 2]) * green >> 5) + (signed(f[..., 1]) * signed(out[..., 1]) >> 5)) & 255
    return out


def undo_palette(image: np.ndarray, palette: np.ndarray, width: int, pack: int) -> np.ndarray:
    index = image[..., 2]
    if pack:
        each = 8 >> pack
        shifts = each * np.arange(1 << pack)
        index = (index[..., None] >> shifts & ((1 << each) - 1)).reshape(len(index), -1)[:, :width]
    full = np.zeros((256, 4), np.int32)
    full[: len(palette)] = palette
    return full[index]


def decode(data: bytes) -> np.ndarray:
    """The pixels of a lossless WebP file: height, width, and A, R, G, B."""
    if data[:4] != b"RIFF" or data[8:16] != b"WEBPVP8L" or data[20] != 0x2F:
        raise ValueError("not a lossless WebP file")
    bits = Bits(data[21: 20 + int.from_bytes(data[16:20], "little")])
    width, height = bits.take(14) + 1, bits.take(14) + 1
    bits.take(1)
    if bits.take(3):
        raise ValueError("an unknown version")
    undo, across = [], width
    while bits.take(1):
        kind = bits.take(2)
        if kind < 2:
            tile = bits.take(3) + 2
            w, h = -(-across >> tile), -(-height >> tile)
            block = planes(read_pixels(bits, w, h, False)).reshape(h, w, 4)
            undo.append((undo_predictor if kind == 0 else undo_cross_colour, block, tile))
        elif kind == 2:
            undo.append((lambda image: np.concatenate([image[..., :1], (image[..., 1:2] + image[..., 2:3]) & 255, image[..., 2:3], (image[..., 3:] + image[..., 2:3]) & 255], 2),))
        else:
            n = bits.take(8) + 1
            palette = np.cumsum(planes(read_pixels(bits, n, 1, False)), 0) & 255
            pack = 3 if n <= 2 else 2 if n <= 4 else 1 if n <= 16 else 0
            undo.append((undo_palette, palette, across, pack))
            across = -(-across >> pack)
    image = planes(read_pixels(bits, across, height, True)).reshape(height, across, 4)
    for f, *more in reversed(undo):
        image = f(image, *more)
    return image.astype(np.uint8)
