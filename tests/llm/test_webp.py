import hashlib
import struct
import zlib
from collections import Counter

import numpy as np
import plain_webp
import pyarrow as pa
import pytest

from lexifold.llm import webp

SCHEMA = "doc_id long, text string, feature int, media string"


def payload(text):
    raw = (text or "").encode()
    return raw + b"\xff" * (max(-(-len(raw) // 576), 1) * 576 - len(raw))


def walk(n, seed=0):
    return "".join(chr(78 + int(x) % 32) for x in np.abs(np.cumsum(np.random.default_rng(seed).integers(-1, 2, (n // 3, 3)), 0)).ravel())


def samples(seed=0):
    r = np.random.default_rng(seed)
    words = ["".join(r.choice(list("abcdefghié☃ "), r.integers(1, 9))) for _ in range(80)]
    out = [" ".join(r.choice(words, r.integers(1, 1500))) for _ in range(30)]
    return [*out, out[0], None, "", "x", "\x00" * 577, "ab" * 4000, "abc" * 3000, "01" * 5000, "\x7f" * 575, "é" * 288, "z" * 576, walk(9000), "".join(map(chr, r.integers(1, 127, 20_000))), "line of text\n" * 900, "a" * 20_000 + "b", *("".join(r.choice(["abc", "xyz"], 192 * 16 * 2)) for _ in range(2))]


def files_of(media):
    while media:
        n = 8 + int.from_bytes(media[4:8], "little")
        yield media[:n]
        media = media[n:]


def test_round_trip():
    texts = samples()
    media, size = webp.store(pa.array(texts))
    for t, n, m, back in zip(texts, size, media, webp.load(media), strict=True):
        assert n == len((t or "").encode()) and back.tobytes() == payload(t)
        plain = [plain_webp.decode(f) for f in files_of(m)]
        assert b"".join(x[..., 1:].tobytes() for x in plain) == back.tobytes() and all((x[..., 0] == 255).all() for x in plain)


def test_what_the_writer_uses(monkeypatch):
    seen = Counter()

    class Reader(plain_webp.Bits):
        def take(self, n):
            return super().take(n)

    old_pixels, old_stretch = plain_webp.read_pixels, plain_webp.stretch

    def pixels(bits, width, height, main):
        at = bits.at
        if main and bits.take(1):
            seen["cache"] += 1
        bits.at = at
        return old_pixels(bits, width, height, main)

    def stretch(bits, prefix):
        seen["reference"] += 1
        return old_stretch(bits, prefix)

    for name in ("undo_predictor", "undo_palette"):
        monkeypatch.setattr(plain_webp, name, lambda *a, f=getattr(plain_webp, name), name=name: (seen.update([name]), f(*a))[1])
    monkeypatch.setattr(plain_webp, "read_pixels", pixels)
    monkeypatch.setattr(plain_webp, "stretch", stretch)
    media, _ = webp.store(pa.array(samples()))
    for m in media:
        for f in files_of(m):
            plain_webp.decode(f)
    assert seen["cache"] > 20 and seen["reference"] > 200 and seen["undo_predictor"] > 0 and seen["undo_palette"] > 2
    used = Counter(f[25] & 7 for m in media for f in files_of(m))  # first transform: present, kind
    assert len(used) >= 3
    assert sum(map(len, media)) < 0.5 * sum(len(payload(t)) for t in samples())


def put(fields):
    value, at = 0, 0
    for v, n in fields:
        value |= int(v) << at
        at += n
    return value.to_bytes((at + 7) // 8, "little")


def wrap(width, height, fields):
    stream = b"\x2f" + put([(width - 1, 14), (height - 1, 14), (1, 1), (0, 3), *fields])
    body = b"VP8L" + len(stream).to_bytes(4, "little") + stream + b"\0" * (len(stream) % 2)
    return b"RIFF" + (len(body) + 4).to_bytes(4, "little") + b"WEBP" + body


def one(symbol):
    return [(1, 1), (0, 1), (1, 1), (symbol, 8)]


def two(a, b):
    return [(1, 1), (1, 1), (1, 1), (a, 8), (b, 8)]


def canonical(lengths):
    """symbol -> (bits, lowest first, and how many)."""
    out, code, last = {}, 0, 0
    for n, s in sorted((n, s) for s, n in enumerate(lengths) if n):
        code <<= n - last
        out[s] = (int(f"{code:0{n}b}"[::-1], 2), n)
        code, last = code + 1, n
    return out


KINDS = [4] * 13 + [5] * 6
KIND = canonical(KINDS)


class Made:
    """A random valid stream."""

    def __init__(self, seed):
        self.r = np.random.default_rng(seed)
        self.bits = []

    def code(self, size, symbols):
        """Writes a code for some symbols; gives their bits."""
        r, symbols = self.r, sorted(set(map(int, symbols)))
        if len(symbols) == 1 and symbols[0] < 256:
            self.bits += [(1, 1), (0, 1), (0, 1), (symbols[0], 1)] if symbols[0] < 2 and r.random() < 0.5 else one(symbols[0])
            return {symbols[0]: (0, 0)}
        if len(symbols) == 2 and symbols[1] < 256 and r.random() < 0.5:
            self.bits += two(*symbols)
            return {symbols[0]: (0, 1), symbols[1]: (1, 1)}
        if len(symbols) == 1:
            symbols.append(0)
        depth = [0]
        while len(depth) < len(symbols):  # split a random leaf
            at = int(r.integers(len(depth)))
            if depth[at] < 15:
                depth[at: at + 1] = [depth[at] + 1] * 2
        lengths = [0] * size
        for s, n in zip(symbols, r.permutation(depth), strict=True):
            lengths[s] = int(n)
        self.bits += [(0, 1), (15, 4), *((KINDS[i], 3) for i in webp.LENGTH_ORDER)]
        tokens, at, last = [], 0, 8
        while at < size:
            run = 1
            while at + run < size and lengths[at + run] == lengths[at]:
                run += 1
            n = lengths[at]
            if n == 0 and run >= 3 and r.random() < 0.9:
                run = min(run, 138)
                tokens.append((KIND[18], (run - 11, 7)) if run >= 11 else (KIND[17], (run - 3, 3)))
            elif n and n == last and run >= 3 and r.random() < 0.8:
                run = min(run, 6)
                tokens.append((KIND[16], (run - 3, 2)))
            else:
                run, last = 1, n or last
                tokens.append((KIND[n],))
            at += run
        short = list(tokens)
        while short and short[-1][0] in (KIND[0], KIND[17], KIND[18]):
            short.pop()  # what is left out is zeros, if the number of tokens says so
        if len(short) >= 2 and r.random() < 0.7:
            tokens = short
            wide = max((len(tokens) - 2).bit_length(), 2)
            wide += wide % 2
            self.bits += [(1, 1), ((wide - 2) // 2, 3), (len(tokens) - 2, wide)]
        else:
            self.bits.append((0, 1))
        self.bits += [f for t in tokens for f in t]
        return canonical(lengths)

    def image(self, width, height, main, greens=None):
        r = self.r
        cache = int(r.integers(1, 12)) if r.random() < 0.5 and greens is None else 0
        self.bits += [(1, 1), (cache, 4)] if cache else [(0, 1)]
        groups, tile = 1, 0
        if main:
            if r.random() < 0.5:
                tile, groups = int(r.integers(2, 5)), 2
                self.bits += [(1, 1), (tile - 2, 3)]
                across = -(-width >> tile)
                of = self.image(across, -(-height >> tile), False, greens=[0, 1])
                groups = max(of) + 1
            else:
                self.bits += [(0, 1)]
        codes = []
        for _ in range(groups):
            if greens is not None:
                sets = [greens, [0], [0], [255], [0]]
            else:
                sets = [[*r.integers(0, 256, r.integers(1, 12)), *(r.integers(256, 262, 2) if r.random() < 0.7 else []), *(r.integers(280, 280 + (1 << cache), 3) if cache else [])], *(r.integers(0, 256, r.integers(1, 6)) for _ in range(3)), r.integers(0, 12, r.integers(1, 6))]
            codes.append([self.code(n, s) for n, s in zip((280 + (1 << cache if cache else 0), 256, 256, 256, 40), sets, strict=True)])
        out, total, values = 0, width * height, []
        while out < total:
            y, x = divmod(out, width)
            green, red, blue, alpha, far = codes[of[(y >> tile) * across + (x >> tile)] if tile else 0]
            s = int(r.choice(list(green)))
            if 256 <= s < 280:
                p, k = s - 256, int(r.choice(list(far)))
                more = lambda q: (0, 0) if q < 4 else (int(r.integers(1 << ((q - 2) >> 1))), (q - 2) >> 1)
                value = lambda q, e: q + 1 if q < 4 else ((2 + (q & 1)) << ((q - 2) >> 1)) + e[0] + 1
                a, b = more(p), more(k)
                n, d = value(p, a), value(k, b)
                d = max(1, webp.NEAR[d - 1][0] + webp.NEAR[d - 1][1] * width) if d <= 120 else d - 120
                if d > out or out + n > total:
                    if not any(g < 256 for g in green):
                        raise AssertionError
                    s = int(r.choice([g for g in green if g < 256]))
                else:
                    self.bits += [green[s], a, far[k], b]
                    out += n
                    continue
            self.bits.append(green[s])
            if s < 256:
                values.append(s)
                self.bits += [c[int(r.choice(list(c)))] for c in (red, blue, alpha)]
            out += 1
        return values

    def file(self):
        r = self.r
        width, height = (int(x) for x in r.integers(1, 40, 2))
        across = width
        for kind in r.permutation(4)[: r.integers(0, 5)]:
            self.bits += [(1, 1), (kind, 2)]
            if kind < 2:
                tile = int(r.integers(2, 6))
                self.bits.append((tile - 2, 3))
                self.image(-(-across >> tile), -(-height >> tile), False)
            elif kind == 3:
                n = int(r.choice([1, 2, 3, 4, 5, 16, 17, 40, 256]))
                self.bits.append((n - 1, 8))
                self.image(n, 1, False)
                across = -(-across >> int(webp.packing(n)))
        self.bits.append((0, 1))
        self.image(across, height, True)
        return wrap(width, height, self.bits)


def test_random_files_against_the_plain_decoder():
    files = [Made(seed).file() for seed in range(300)]
    for f, got in zip(files, webp.decode(files), strict=True):
        want = plain_webp.decode(f)
        assert got.shape == want.shape and (got == want).all()
    assert (webp.decode(files[7:8])[0] == plain_webp.decode(files[7])).all()


def test_transforms_by_hand():
    # palette of two colours, eight indexes in a sample: 0xff000000 then, by difference, green 200, blue 7, alpha wrapped
    palette = [(1, 1), (3, 2), (1, 8), (0, 1), *two(0, 200), *one(0), *two(0, 7), *one(255), *one(0), *((b, 1) for b in (0, 0, 1, 1))]
    image = [(0, 1), (0, 1), (0, 1), *one(0b10), *one(0), *one(0), *one(255), *one(0)]
    got = webp.decode([wrap(2, 1, [*palette, *image])])[0]
    assert got[0, 0].tolist() == [255, 0, 0, 0] and got[0, 1].tolist() == [254, 0, 200, 7]
    # predictor: left of each pixel, residual green 1
    head = [(1, 1), (0, 2), (0, 3), (0, 1), *one(1), *one(0), *one(0), *one(255), *one(0), (0, 1)]
    image = [(0, 1), (0, 1), *one(1), *one(0), *one(0), *one(0), *one(0)]
    assert webp.decode([wrap(3, 2, [*head, *image])])[0][..., 2].tolist() == [[1, 2, 3], [2, 3, 4]]
    # cross-colour: the factor's blue channel is what red takes of green, in parts of 32
    head = [(1, 1), (1, 2), (0, 3), (0, 1), *one(0), *one(0), *one(32), *one(255), *one(0), (0, 1)]
    image = [(0, 1), (0, 1), *one(5), *one(1), *one(0), *one(255), *one(0)]
    assert webp.decode([wrap(2, 2, [*head, *image])])[0][0, 0].tolist() == [255, 1 + 5, 5, 0]


def test_damaged_files_are_refused():
    media, _ = webp.store(pa.array(["some text " * 100]))
    whole = media[0]
    for bad in (b"RIFX" + whole[4:], whole[:8] + b"WEBPVP8 " + whole[16:], whole[:20] + b"\x00" + whole[21:], whole[:16] + struct.pack("<I", 60) + whole[20:80]):
        with pytest.raises(ValueError):
            webp.decode([bad])


def test_rows(spark):
    rows = [*enumerate(samples(3)), (0, samples(3)[0]), (None, "nobody"), (500, "long " * 60_000)]
    docs = spark.createDataFrame([(d, t, 1, "m") for d, t in rows], SCHEMA)
    got = webp.media_features(docs, keep_media=True).collect()
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r)
    assert len(got) == len(rows) and len(by[0]) == 2 and by[0][0] == by[0][1]
    for d, t in rows:
        r, raw = by[d][0], payload(t)
        wide = np.frombuffer(raw, np.uint8).astype(int)
        n = len(wide)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len((t or "").encode()), n, hashlib.sha256(raw).hexdigest(), zlib.crc32(raw[-32:]))
        assert (r.media_bytes, r.media_sha256) == (len(r.media), hashlib.sha256(r.media).hexdigest())
        assert r.feature == f"{n // 576}:{wide.sum() * 1000 // n}:{(wide * wide).sum() * 1000 // n}:{abs(np.diff(wide)).sum() * 1000 // n}"


def test_empty_table(spark):
    assert webp.media_features(spark.createDataFrame([], SCHEMA)).collect() == []
