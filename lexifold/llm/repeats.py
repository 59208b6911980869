"""Removal of repeated 50-byte strings by prefix-free parsing.

Each text is parsed at triggers, the positions where a hash rolling over KMER bytes is least among those of a window of
50 bytes; equal windows have their trigger at one offset, and every window has one. The windows of one trigger make a
phrase: the text on either side of the trigger that they reach.

1. Documents are dealt over parts, whole. Each part makes the dictionary of its parse: for each trigger the two strings
   of KMER + SIDE bytes that end or begin with it. A window reaches over one of them, since it has 38 bytes beside its
   trigger. Fingerprints of these strings are sent by range, each once a part.
2. A string that is in one document only rules out its windows; of the others, the part learns which they are and how
   often they occur. Fingerprints only choose candidates: a false match costs time, not correctness.
3. The part parses again and sends the phrases that are left, each content once with the smallest document that has it,
   to a bucket by their trigger. Where one string belongs to more than HOT phrases, windows are sent one by one under
   128 bits of their content, so that no bucket gathers what is very common.
4. In a bucket, the dictionary's suffixes (the text before the trigger, read backwards) and the parse (the text from the
   trigger on) are sorted, each once, with the common prefixes of neighbours. The order of windows follows from the two:
   those that have `a` bytes before the trigger are one group where neighbours share `a` bytes in the first order and
   50 - a in the second. A window of the group of one in a smaller document is removed. This compares the bytes.
5. Spans go back to the parts, where texts are cut.

A null text is empty. A null doc_id is larger than any other. Rows with the same doc_id are documents that don't see each
other. Texts of fewer than 50 bytes lose nothing; very long texts are parsed in pieces that overlap by 49 bytes, but a
text has to fit in a task. An empty table gives no rows. Other columns are left out, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import U64, cuts, lean, mix64, pack, pack_sorted, shares, slices, table, unpack, unpack_sorted

DEPTH, KMER, SIDE = 50, 12, 19
#: Places of a trigger in a window, and the longest text beside it.
SLACK = DEPTH - KMER + 1
CHUNK, PART, RANGE, BUCKET = 4 << 20, 10 << 20, 24 << 20, 12 << 20
#: Places in a piece; the other bits of a hash choose the trigger, the same for every piece.
PLACES = U64((1 << 24) - 1)
#: Bits of a fingerprint that are sent.
SENT = 48
#: Phrases that share a string of KMER + SIDE bytes, beyond which their windows are dealt one by one.
HOT = 4096
LAST = np.iinfo(np.int64).max


def words(data: np.ndarray) -> np.ndarray:
    """The 8 bytes from each position on as one number."""
    padded = np.concatenate([data, np.zeros(8 + -data.size % 8, np.uint8)])
    out = np.empty(padded.size - 8, U64)
    for k in range(8):
        out[k::8] = np.frombuffer(padded[k: padded.size - 8 + k].tobytes(), "<u8")
    return out[: data.size]


def rolling(w: np.ndarray) -> np.ndarray:
    """The hash of the KMER bytes from each position on, given the words at all positions."""
    rest = np.zeros_like(w)
    rest[: max(w.size - 8, 0)] = w[8:]
    return mix64(w * U64(0x9E3779B97F4A7C15) ^ mix64(rest & U64((1 << 8 * (KMER - 8)) - 1)))


def parse(w: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Phrases: first and last window, trigger, and text, of texts end to end. Equal hashes go to the first place."""
    n = w.size
    none = np.zeros(0, np.int64)
    if n < DEPTH:
        return none, none, none, none
    assert n <= int(PLACES)
    best = (rolling(w) & ~PLACES) | np.arange(n, dtype=U64)
    width = 1
    while width < SLACK:
        shift = min(width, SLACK - width)
        best = np.minimum(best[:-shift], best[shift:])
        width += shift
    best = (best[: n - DEPTH + 1] & PLACES).astype(np.int64)
    size = np.diff(offsets)
    valid = np.zeros(n + 1, np.int32)
    some = size >= DEPTH
    np.add.at(valid, offsets[:-1][some], 1)
    np.add.at(valid, offsets[1:][some] - DEPTH + 1, -1)
    start = np.flatnonzero(np.cumsum(valid[:-1])[: best.size])
    trigger = best[start]
    fresh = np.ones(start.size, bool)
    fresh[1:] = (trigger[1:] != trigger[:-1]) | (np.diff(start) != 1)
    at = np.flatnonzero(fresh)
    lo = start[at]
    hi = start[np.append(at[1:], start.size) - 1] if at.size else lo
    return lo, hi, trigger[at], np.searchsorted(offsets, lo, "right") - 1


def strings(w: np.ndarray, lo: np.ndarray, hi: np.ndarray, trigger: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Fingerprints of the KMER + SIDE bytes that end (first half) or begin with each trigger; the phrase of each."""
    before, after = np.flatnonzero(trigger - lo >= SIDE), np.flatnonzero(hi + DEPTH - trigger >= KMER + SIDE)
    at = np.concatenate([trigger[before] - SIDE, trigger[after]])
    side = np.repeat(np.array([1, 2], U64), [before.size, after.size])
    h = side * U64(0x9E3779B97F4A7C15)
    for k in (0, 8, 16, KMER + SIDE - 8):
        h = mix64(h ^ w[at + k] + U64(k))
    return h, np.concatenate([before, after]), before.size


def contents(w: np.ndarray, lo: np.ndarray, size: np.ndarray) -> np.ndarray:
    """128 bits of the bytes of each range of at least 8."""
    a, b = size.astype(U64), mix64(size.astype(U64))
    for k in range(0, int(size.max()) if size.size else 0, 8):
        x = w[lo + np.minimum(k, size - 8)]
        use = size > k
        a, b = np.where(use, mix64(a ^ x + U64(k)), a), np.where(use, mix64(b + (x ^ U64(0x94D049BB133111EB)) * U64(2 * k + 1)), b)
    return np.stack([a, b], 1)


def gather(data: np.ndarray, lo: np.ndarray, size: np.ndarray) -> np.ndarray:
    first = np.cumsum(size) - size
    return data[np.repeat(lo - first, size) + np.arange(int(size.sum()))]


class Part:
    """Documents of a part, and pieces of at most about CHUNK bytes of their texts end to end."""

    def __init__(self, packed: pa.Table):
        own = [pa.ipc.open_stream(zstandard.decompress(b)).read_all() for b in packed.column("rows").to_pylist()]
        rows = pa.concat_tables(own) if own else SHAPE.empty_table()
        self.doc = np.array(pa.compute.fill_null(rows.column("doc_id"), LAST), np.int64)
        self.key = np.array(rows.column("key"), np.int64)
        self.ids = rows.column("doc_id")
        self.texts = rows.column("text")

    def pieces(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """Bytes, offsets, and for each text its document and where in it the piece begins."""
        held, which, begin, total = [], [], [], 0
        for i, text in enumerate(self.texts):
            raw = b"" if (t := text.as_py()) is None else t.encode()
            for at in range(0, max(len(raw) - DEPTH + 1, 0), CHUNK):
                piece = raw[at: at + CHUNK + DEPTH - 1]
                held.append(piece)
                which.append(i)
                begin.append(at)
                total += len(piece)
                if total >= CHUNK:
                    yield self._joined(held, which, begin)
                    held, which, begin, total = [], [], [], 0
        if held:
            yield self._joined(held, which, begin)

    @staticmethod
    def _joined(held: list[bytes], which: list[int], begin: list[int]) -> tuple[np.ndarray, ...]:
        return np.frombuffer(b"".join(held), np.uint8), np.cumsum([0, *map(len, held)]), np.array(which), np.array(begin)


SHAPE = pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("key", pa.int64())])


def dealt(docs: DataFrame, parts: int) -> DataFrame:
    """(part, rows): packed documents by part; key tells rows with one doc_id apart."""
    key = F.coalesce(F.xxhash64("text"), F.lit(0))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", key.alias("key"), F.pmod(F.xxhash64("doc_id", key), F.lit(parts)).cast("long").alias("part"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text", CHUNK):
                place = np.array(batch.column("part"), np.int64)
                order = np.argsort(place, kind="stable")
                groups = [i for i in np.split(order, np.flatnonzero(np.diff(place[order])) + 1) if i.size]
                packed = []
                for i in groups:
                    sink = pa.BufferOutputStream()
                    own = pa.Table.from_batches([batch]).select(["doc_id", "text", "key"]).take(pa.array(i)).cast(SHAPE)
                    with pa.ipc.new_stream(sink, SHAPE) as out:
                        out.write_table(own)
                    packed.append(zstandard.compress(sink.getvalue().to_pybytes(), 3))
                yield pa.RecordBatch.from_arrays([pa.array([int(place[i[0]]) for i in groups], pa.int64()), pa.array(packed, pa.binary())], ["part", "rows"])

    return rows.mapInArrow(run, "part long, rows binary")


def part_strings(part: Part) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The sorted fingerprints of a part, the phrases that each has, and whether more than one document has it."""
    prints, owners = [], []
    for data, offsets, which, _ in part.pieces():
        w = words(data)
        lo, hi, trigger, row = parse(w, offsets)
        h, phrase, _ = strings(w, lo, hi, trigger)
        prints.append(h)
        owners.append(part.doc[which[row[phrase]]])
    h, doc = (np.concatenate(x) if x else np.zeros(0, k) for x, k in ((prints, U64), (owners, np.int64)))
    order = np.lexsort((doc, h))
    h, doc = h[order], doc[order]
    first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if h.size else np.zeros(0, int)
    last = np.append(first[1:], h.size) - 1
    return h[first], last - first + 1, doc[first] != doc[last] if h.size else np.zeros(0, bool)


def known(packed: DataFrame, ranges: int, most: int = HOT) -> DataFrame:
    """(part, range, body): of each fingerprint of a part, 0 if one document has it, 1 if more, 2 if it is hot."""

    def send(got: pa.Table) -> pa.Table:
        h, n, several = part_strings(Part(got))
        at = cuts(h, ranges)
        some = np.flatnonzero(np.diff(at))
        body = []
        for r in some:
            i = slice(at[r], at[r + 1])
            body.append([pack_sorted(h[i], SENT), pack(np.minimum(n[i], 255).astype(np.uint8)), pack(np.packbits(several[i]))])
        part = got.column("part")[0].as_py()
        return pa.table({"part": pa.array([part] * len(some), pa.int64()), "range": pa.array(some, pa.int32()), "body": pa.array(body, pa.list_(pa.binary()))})

    def answer(got: pa.Table) -> pa.Table:
        bodies = got.column("body").to_pylist()
        prints = [unpack_sorted(b[0]) for b in bodies]
        _, number = np.unique(np.concatenate(prints), return_inverse=True)
        kinds = int(number.max()) + 1
        count = np.bincount(number, np.concatenate([unpack(b[1], np.uint8) for b in bodies]), kinds)
        several = np.concatenate([np.unpackbits(unpack(b[2], np.uint8), count=h.size) for b, h in zip(bodies, prints, strict=True)])
        code = ((np.bincount(number, minlength=kinds) > 1) | (np.bincount(number, several, kinds) > 0)).astype(np.uint8)
        code[(code > 0) & (count > most)] = 2
        ends = np.cumsum([0, *(h.size for h in prints)])
        back = [pack(code[number[a:b]], 3) for a, b in zip(ends[:-1], ends[1:], strict=True)]
        return pa.table({"part": got.column("part"), "range": got.column("range"), "body": pa.array(back, pa.binary())})

    sent = packed.groupBy("part").applyInArrow(send, "part long, range int, body array<binary>")
    return sent.groupBy("range").applyInArrow(answer, "part long, range int, body binary")


def firsts(x: np.ndarray) -> np.ndarray:
    """Of each row of a sorted table the number of the first equal row."""
    head = np.ones(len(x), bool)
    head[1:] = (x[1:] != x[:-1]).any(1)
    return np.flatnonzero(head)[np.cumsum(head) - 1]


def by(bucket: np.ndarray, rows: np.ndarray) -> list[np.ndarray]:
    """The rows of each bucket that has any."""
    rows = rows[np.argsort(bucket[rows], kind="stable")]
    return [i for i in np.split(rows, np.flatnonzero(np.diff(bucket[rows])) + 1) if i.size]


def spans_rows(part: np.ndarray, doc: np.ndarray, key: np.ndarray, lo: np.ndarray, end: np.ndarray) -> list[tuple[int, list[bytes]]]:
    """Spans by the part of their document."""
    return [(int(part[i[0]]), [pack(doc[i]), pack(key[i]), pack(lo[i]), pack(end[i] - lo[i])]) for i in by(part, np.arange(part.size))]


#: What a body holds: spans already found, phrases, or windows.
SPANS, PHRASES, WINDOWS = 0, 1, 2


def candidates(packed: DataFrame, codes: DataFrame, buckets: int) -> DataFrame:
    """(bucket, kind, body): what may be repeated, by trigger or window, and spans that a part itself finds covered."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[tuple[int, int, list[bytes]]] = []
        part = Part(left)
        name = left.column("part")[0].as_py() if left.num_rows else 0
        right = right.sort_by("range")
        bodies = right.column("body").to_pylist()
        code = np.concatenate([unpack(b, np.uint8) for b in bodies]) if bodies else np.zeros(0, np.uint8)
        prints = part_strings(part)[0] if (code > 0).any() else np.zeros(0, U64)

        def cover(i: np.ndarray, doc: np.ndarray, key: np.ndarray, lo: np.ndarray, size: np.ndarray) -> None:
            for p, blobs in spans_rows(np.full(i.size, name), doc[i], key[i], lo[i], lo[i] + size[i]):
                out.append((p % buckets, SPANS, [p.to_bytes(8, "little"), *blobs]))

        found, windows = [], []
        for data, offsets, which, begin in part.pieces() if prints.size else ():
            w = words(data)
            lo, hi, trigger, row = parse(w, offsets)
            h, phrase, n_before = strings(w, lo, hi, trigger)
            of = code[np.searchsorted(prints, h)]
            # windows of SIDE bytes or more before the trigger have the string before it, the others the one after it
            state = np.zeros((2, lo.size), np.uint8)
            state[0, phrase[:n_before]] = of[:n_before]
            state[1, phrase[n_before:]] = of[n_before:]
            hot = np.flatnonzero((state == 2).any(0))
            if hot.size:
                n = hi[hot] - lo[hot] + 1
                at = gather(np.arange(data.size), lo[hot], n)
                owner = np.repeat(hot, n)
                use = np.where(trigger[owner] - at >= SIDE, state[0, owner], state[1, owner]) == 2
                at, text = at[use], row[owner[use]]
                windows.append((contents(w, at, np.full(at.size, DEPTH)), which[text], at - offsets[text] + begin[text]))
            lo = np.where(state[0] == 1, lo, np.maximum(lo, trigger - SIDE + 1))
            hi = np.where(state[1] == 1, hi, np.minimum(hi, trigger - SIDE))
            use = np.flatnonzero(lo <= hi)
            if use.size:
                lo, hi, trigger, text = lo[use], hi[use], trigger[use], row[use]
                size = hi - lo + DEPTH
                bucket = (rolling(w)[trigger] % U64(buckets)).astype(np.int64)
                found.append((gather(data, lo, size), size, trigger - lo, which[text], lo - offsets[text] + begin[text], bucket))
        if windows:
            print_, own, lo = (np.concatenate(x) for x in zip(*windows, strict=True))
            doc, key = part.doc[own], part.key[own]
            order = np.lexsort((doc, print_[:, 1], print_[:, 0]))
            print_, doc, key, lo = print_[order], doc[order], key[order], lo[order]
            least = doc[firsts(print_)]
            gone = doc > least
            cover(np.flatnonzero(gone), doc, key, lo, np.full(lo.size, DEPTH))
            bucket = (mix64(print_[:, 0]) % U64(buckets)).astype(np.int64)
            for i in by(bucket, np.flatnonzero(~gone)):
                out.append((int(bucket[i[0]]), WINDOWS, [pack(print_[i]), *map(pack, (doc[i], key[i], np.full(1, name), lo[i]))]))
        if found:
            texts, size, before, own, lo, bucket = (np.concatenate(x) for x in zip(*found, strict=True))
            doc, key = part.doc[own], part.key[own]
            first = np.cumsum(size) - size
            print_ = np.column_stack([contents(words(texts), first, size), before.astype(U64)])
            order = np.lexsort((doc, print_[:, 2], print_[:, 1], print_[:, 0]))
            of = np.empty(order.size, np.int64)
            of[order] = order[firsts(print_[order])]  # the phrase of this content with the smallest document
            # what the hash calls equal is compared
            same = size == size[of]
            i = np.flatnonzero(same & (of != np.arange(of.size)))
            if i.size:
                differ = gather(texts, first[i], size[i]) != gather(texts, first[of[i]], size[i])
                same[i] = np.add.reduceat(differ, np.cumsum(size[i]) - size[i]) == 0
            gone = same & (doc > doc[of])
            cover(np.flatnonzero(gone), doc, key, lo, size)
            for i in by(bucket, np.flatnonzero(~gone)):
                numbers = [doc[i], key[i], np.full(1, name), lo[i]]
                out.append((int(bucket[i[0]]), PHRASES, [pack(gather(texts, first[i], size[i]), 3), pack((size[i] - DEPTH).astype(np.uint8)), pack(before[i].astype(np.uint8)), *map(pack, numbers)]))
        return pa.table({"bucket": pa.array([b for b, _, _ in out], pa.int32()), "kind": pa.array([k for _, k, _ in out], pa.int32()), "body": pa.array([x for _, _, x in out], pa.list_(pa.binary()))})

    return packed.groupBy("part").cogroup(codes.groupBy("part")).applyInArrow(run, "bucket int, kind int, body array<binary>")


class Order:
    """The order of strings that begin at `at` and go forward or backward, `room` bytes of each and `length` at most."""

    def __init__(self, texts: np.ndarray, at: np.ndarray, step: int, length: int, room: np.ndarray):
        wide = -(-length // 8) * 8
        rows = np.zeros((at.size, wide), np.uint8)
        for j in range(length):
            i = np.flatnonzero(room > j)
            rows[i, j] = texts[at[i] + step * j]
        self.order = np.lexsort(rows.view(">u8").T[::-1])
        self.shared = np.empty(max(at.size - 1, 0), np.uint8)  # bytes that neighbours share
        for lo in range(0, self.shared.size, 1 << 16):
            block = rows[self.order[lo: lo + (1 << 16) + 1]]
            differ = block[1:] != block[:-1]
            self.shared[lo: lo + len(differ)] = np.where(differ.any(1), differ.argmax(1), wide)

    def groups(self, depth: int) -> np.ndarray:
        """The group of each string: those of one group share `depth` bytes."""
        out = np.zeros(self.order.size, np.int64)
        out[self.order[1:]] = np.cumsum(self.shared < depth)
        return out


def covered(texts: np.ndarray, size: np.ndarray, before: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The runs of bytes of phrases (end to end in texts) that smaller documents have: phrase, begin and end of each."""
    first = np.cumsum(size) - size
    trigger = first + before
    suffix = Order(texts, trigger - 1, -1, SLACK - 1, before)
    parsed = Order(texts, trigger, 1, DEPTH, size - before)
    hit = np.zeros((size.size, SLACK), bool)
    for a in range(SLACK):
        use = np.flatnonzero((before >= a) & (size - before >= DEPTH - a))
        if use.size < 2:
            continue
        key = suffix.groups(a)[use] * size.size + parsed.groups(DEPTH - a)[use]
        order = np.lexsort((doc[use], key))
        key, own = key[order], doc[use][order]
        head = np.ones(order.size, bool)
        head[1:] = key[1:] != key[:-1]
        least = own[np.flatnonzero(head)][np.cumsum(head) - 1]
        hit[use[order], SLACK - 1 - a] = own > least
    # windows in the order of the text: those with the most bytes before the trigger come first
    edged = np.zeros((size.size, SLACK + 2), np.int8)
    edged[:, 1:-1] = hit
    turn = np.diff(edged, axis=1)
    phrase, start = np.nonzero(turn == 1)
    _, end = np.nonzero(turn == -1)
    lo = start - (SLACK - 1) + before[phrase]
    return phrase, lo, lo + (end - start) + DEPTH - 1


def find(sent: DataFrame) -> DataFrame:
    """(part, body): spans to remove, by the part of their document."""

    def run(got: pa.Table) -> pa.Table:
        out: list[tuple[int, list[bytes]]] = []
        phrases, windows = [], []
        for kind, body in zip(got.column("kind").to_pylist(), got.column("body").to_pylist(), strict=True):
            if kind == SPANS:
                out.append((int.from_bytes(body[0], "little"), body[1:]))
                continue
            doc, key, part, lo = (unpack(b, np.int64) for b in body[-4:])
            part = np.repeat(part, doc.size)
            if kind == PHRASES:
                phrases.append((unpack(body[0], np.uint8), unpack(body[1], np.uint8).astype(np.int64) + DEPTH, unpack(body[2], np.uint8).astype(np.int64), doc, key, part, lo))
            else:
                windows.append((unpack(body[0], U64).reshape(-1, 2), doc, key, part, lo))
        if phrases:
            texts, size, before, doc, key, part, lo = (np.concatenate(x) for x in zip(*phrases, strict=True))
            i, begin, end = covered(texts, size, before, doc)
            out += spans_rows(part[i], doc[i], key[i], lo[i] + begin, lo[i] + end)
        if windows:
            print_, doc, key, part, lo = (np.concatenate(x) for x in zip(*windows, strict=True))
            order = np.lexsort((doc, print_[:, 1], print_[:, 0]))
            i = order[doc[order] > doc[order][firsts(print_[order])]]
            out += spans_rows(part[i], doc[i], key[i], lo[i], lo[i] + DEPTH)
        return pa.table({"part": pa.array([p for p, _ in out], pa.int64()), "body": pa.array([b for _, b in out], pa.list_(pa.binary()))})

    return sent.groupBy("bucket").applyInArrow(run, "part long, body array<binary>")


def merge(lo: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of overlapping or touching spans."""
    if not lo.size:
        return lo, end
    order = np.argsort(lo, kind="stable")
    lo, end = lo[order], np.maximum.accumulate(end[order])
    new = np.ones(lo.size, bool)
    new[1:] = lo[1:] > end[:-1]
    at = np.flatnonzero(new)
    return lo[at], end[np.append(at[1:], lo.size) - 1]


def remove_repeats(docs: DataFrame, keep_text: bool = False, part: int = PART, hot: int = HOT) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and, if wanted, kept (the remaining bytes)."""
    parts, ranges, buckets = shares(docs, "text", part, part * RANGE // PART, part * BUCKET // PART)
    packed = dealt(lean(docs), parts)  # one exchange, read three times
    spans = find(candidates(packed, known(packed, ranges, hot), buckets))

    def finish(left: pa.Table, right: pa.Table) -> pa.Table:
        part = Part(left)
        blobs = right.column("body").to_pylist()
        doc, key, lo, size = (np.concatenate([unpack(b[i], np.int64) for b in blobs]) if blobs else np.zeros(0, np.int64) for i in range(4))
        order = np.lexsort((key, doc))
        doc, key, lo, end = doc[order], key[order], lo[order], (lo + size)[order]
        out = []
        for d, k, text in zip(part.doc.tolist(), part.key.tolist(), part.texts, strict=True):
            raw = b"" if (text := text.as_py()) is None else text.encode()
            a, b = np.searchsorted(doc, [d, d], "left")[0], np.searchsorted(doc, d, "right")
            a, b = a + np.searchsorted(key[a:b], k, "left"), a + np.searchsorted(key[a:b], k, "right")
            s, e = merge(lo[a:b], end[a:b])
            kept, at = [], 0
            for x, y in zip(s.tolist(), e.tolist(), strict=True):
                kept.append(raw[at:x])
                at = y
            rest = b"".join([*kept, raw[at:]])
            out.append((len(raw), len(raw) - len(rest), len(s), hashlib.sha256(rest).hexdigest(), rest if keep_text else b""))
        n, r, m, h, rest = zip(*out, strict=True) if out else ((),) * 5
        columns = {"doc_id": part.ids, "n_bytes": pa.array(n, pa.int64()), "n_removed": pa.array(r, pa.int64()), "n_spans": pa.array(m, pa.int64()), "kept_sha256": pa.array(h, pa.string())}
        return pa.table(columns | ({"kept": pa.array(rest, pa.binary())} if keep_text else {}))

    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * keep_text
    return packed.groupBy("part").cogroup(spans.groupBy("part")).applyInArrow(finish, schema)


def op3_prefix_free(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"))
