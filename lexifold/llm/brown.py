"""Language-model scores: Brown classes by exchange clustering, class bigrams and word emissions.

Texts are cut once into words (A-Z lowered, split at the six ASCII spaces) and one end token each; a batch of texts is
kept as word numbers beside the sorted 64-bit hashes of its words. Counts of words come together by hash range, never on
the driver; what reaches the driver is bounded by parameters: the HEAD_WORDS most frequent words and one matrix of
bigrams among them, the length bands of all other words, and the end. The exchange algorithm puts the head words into
CLASSES classes; each band and the end is a class of its own. Then every other word that training has at least MIN_COUNT
times joins one of the CLASSES classes, by hash range: the one where its counts of classes before and after raise the
likelihood of the class bigrams most (all such words in one batch, against the matrix of the head words and bands).
Only rarer words stay in the bands. Class bigrams are then counted anew over all words. A word costs its class after the
class before, which is interpolated with the class alone, and the word within its class; a band keeps half a count for
unknown words.

A null text is empty: only its end is scored. Rows with a null doc_id train. Without training rows every count is 0.
Repeated rows each count. Hash ties between words (64 bits) would be counted as one word. An empty table gives no rows;
a very long text is a batch by itself. Columns other than doc_id and text are left out, whatever their names.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import U64, checkpointed, cuts, lean, pack, pack_sorted, shares, slices, table, unpack, unpack_sorted, utf8, word_hashes

HEAD_WORDS, CLASSES = 512, 24
MIN_COUNT = 3
#: Of a word that joins no class.
STAYS = 255
BAND_EDGES = (3, 5, 7, 9, 12)
BANDS = len(BAND_EDGES) + 1
SWEEPS = 4
KEEP = 0.9
CHUNK = 8 << 20
#: Counts come together by hash range, one range for so many bytes of text.
RANGE = 48 << 20


def held_out(column: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(column).cast("string")) % 5 == 1, F.lit(False))


def cut_words(docs: DataFrame) -> DataFrame:
    """(batch, body): the texts of a batch as word numbers, with the sorted hashes and the bands of its words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text", CHUNK):
                data, offsets = utf8(batch.column("text"))
                h, row, length = word_hashes(data, offsets)
                words, first, number = np.unique(h, return_index=True, return_inverse=True)
                train = ~np.array(batch.column("held_out"))
                band = np.searchsorted(BAND_EDGES, length[first]).astype(np.uint8)
                ids, sizes = batch.column("doc_id"), np.bincount(row, minlength=batch.num_rows).astype(np.uint32)
                known = np.array(pa.compute.is_valid(ids))
                doc_ids = np.array(pa.compute.fill_null(ids, 0), np.int64)
                texts = [*(pack(x) for x in (doc_ids, known, train, sizes, number.astype(np.uint32))), pack_sorted(words), pack(band)]
                yield pa.RecordBatch.from_arrays([pa.array([uuid.uuid4().hex]), pa.array([texts], pa.list_(pa.binary()))], ["batch", "body"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", held_out().alias("held_out")).mapInArrow(run, "batch string, body array<binary>")


def ranged(cut: DataFrame, ranges: int) -> DataFrame:
    """(batch, range, body): the words of a batch in a range, with their training counts and bands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, body in zip(batch.column("batch"), batch.column("body"), strict=True):
                _, _, train, sizes, number, words, band = body.as_py()
                words, band, sizes = unpack_sorted(words), unpack(band, np.uint8), unpack(sizes, np.uint32)
                use = np.repeat(unpack(train, bool), sizes)
                counts = np.bincount(unpack(number, np.uint32)[use], minlength=words.size).astype(np.uint32)
                at = cuts(words, ranges)
                parts = [(r, [pack_sorted(words[a:b]), pack(counts[a:b]), pack(band[a:b])]) for r, (a, b) in enumerate(zip(at[:-1], at[1:], strict=True)) if b > a]
                yield pa.RecordBatch.from_arrays([pa.array([name.as_py()] * len(parts), pa.string()), pa.array([r for r, _ in parts], pa.int32()), pa.array([p for _, p in parts], pa.list_(pa.binary()))], ["batch", "range", "body"])

    return cut.mapInArrow(run, "batch string, range int, body array<binary>")


def sum_counts(parts: DataFrame) -> DataFrame:
    """(range, batch, counts, head, bands): for each batch the counts of its words in a range over the whole table.

    One row without a batch for each range has its most frequent words (hash, count, band), and words and tokens of each
    band.
    """

    def run(parts: pd.DataFrame) -> pd.DataFrame:
        words = [unpack_sorted(b[0]) for b in parts["body"]]
        every, number = np.unique(np.concatenate(words), return_inverse=True)
        total = np.zeros(every.size, np.int64)
        band = np.zeros(every.size, np.uint8)
        at = 0
        for w, b in zip(words, parts["body"], strict=True):
            i = number[at: at + w.size]
            total[i] += unpack(b[1], np.uint32)
            band[i] = unpack(b[2], np.uint8)
            at += w.size
        rows, at = [], 0
        for w, name in zip(words, parts["batch"], strict=True):
            rows.append((parts["range"].iloc[0], name, pack(total[number[at: at + w.size]]), None, None))
            at += w.size
        top = np.lexsort((every.view(np.int64), -total))[:HEAD_WORDS]
        top = top[total[top] > 0]
        bands = [np.bincount(band[total > 0], minlength=BANDS), np.bincount(band, total, BANDS).astype(np.int64)]
        head = np.stack([every[top].view(np.int64), total[top], band[top].astype(np.int64)], 1)
        rows.append((parts["range"].iloc[0], None, None, head.tolist(), np.concatenate(bands).astype(np.int64)))
        return pd.DataFrame(rows, columns=["range", "batch", "counts", "head", "bands"])

    return parts.groupBy("range").applyInPandas(run, "range int, batch string, counts binary, head array<array<long>>, bands array<long>")


def summed_up(rows: DataFrame, column: str, size: int) -> np.ndarray:
    """The sum of an array column over all rows, place by place."""
    out = np.zeros(size, np.int64)
    for r in rows.select(F.posexplode(column)).groupBy("pos").agg(F.sum("col").alias("n")).collect():
        out[r["pos"]] = r["n"]
    return out


@dataclass
class Model:
    """Units are head words, then bands, then the end; cls is the class of each unit."""

    words: np.ndarray
    unit: np.ndarray
    counts: np.ndarray
    kinds: np.ndarray
    tokens: np.ndarray
    ends: int
    vocabulary: int
    cls: np.ndarray | None = None
    matrix: np.ndarray | None = None

    @property
    def total(self) -> int:
        return int(self.tokens.sum()) + self.ends

    @property
    def units(self) -> int:
        return len(self.words) + BANDS + 1

    def of(self, hashes: np.ndarray, band: np.ndarray) -> np.ndarray:
        """The unit of each word."""
        out = len(self.words) + band.astype(np.int64)
        if len(self.words):
            i = np.minimum(np.searchsorted(self.words, hashes), len(self.words) - 1)
            out = np.where(self.words[i] == hashes, self.unit[i], out)
        return out


def _chain(model: Model, texts: list[bytes]) -> tuple[np.ndarray, ...]:
    """Numbers, units and units before of all tokens of a batch with its ends (number -1), and the row of each."""
    _, _, train, sizes, number, words, band = texts
    sizes = unpack(sizes, np.uint32).astype(np.int64)
    number = unpack(number, np.uint32)
    unit_of = model.of(unpack_sorted(words), unpack(band, np.uint8))
    n = number.size + sizes.size
    stop = np.zeros(n, bool)
    stop[np.cumsum(sizes + 1) - 1] = True
    which = np.full(n, -1, np.int64)
    which[~stop] = number
    unit = np.full(n, model.units - 1, np.int64)
    unit[~stop] = unit_of[number]
    before = np.roll(unit, 1)
    if n:
        before[0] = model.units - 1
    return which, unit, before, np.repeat(np.arange(sizes.size), sizes + 1), unpack(train, bool)


def bigrams(cut: DataFrame, model: Model) -> np.ndarray:
    """How often one unit follows another in training texts: one matrix for each task, summed by rows of it."""
    n = model.units
    share = -(-n // 16)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros(n * n, np.int64)
        for batch in batches:
            for body in batch.column("body"):
                _, unit, before, row, train = _chain(model, body.as_py())
                use = train[row]
                out += np.bincount(before[use] * n + unit[use], minlength=n * n)
        rows = [pack(out[i * share * n: (i + 1) * share * n]) for i in range(16)]
        yield pa.RecordBatch.from_arrays([pa.array(range(16), pa.int32()), pa.array(rows, pa.binary())], ["part", "body"])

    def add(parts: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"part": parts["part"].iloc[:1], "body": [pack(sum(unpack(b, np.int64) for b in parts["body"]))]})

    parts = cut.select("body").mapInArrow(run, "part int, body binary").groupBy("part").applyInPandas(add, "part int, body binary").collect()
    found = {r["part"]: unpack(bytes(r["body"]), np.int64) for r in parts}
    return np.concatenate([found[i] for i in range(16)]).reshape(n, n) if found else np.zeros((n, n), np.int64)


def exchange(pairs: np.ndarray, heads: int, classes: int = CLASSES, sweeps: int = SWEEPS) -> np.ndarray:
    """The class of each unit: each head word in turn goes where the likelihood of the class bigrams is greatest."""
    units = len(pairs)
    classes = max(1, min(classes, heads))
    cls = np.concatenate([np.arange(heads) % classes, classes + np.arange(units - heads)])
    k = int(cls.max()) + 1
    one = np.eye(k)[cls]
    m = one.T @ pairs @ one
    f = lambda x: np.where(x > 0, x * np.log(np.maximum(x, 1)), 0.0)
    for _ in range(sweeps):
        moved = 0
        for w in range(heads):
            old, self_n = cls[w], pairs[w, w]
            out = np.bincount(cls, pairs[w], k)
            into = np.bincount(cls, pairs[:, w], k)
            out[old] -= self_n
            into[old] -= self_n
            m[old] -= out
            m[:, old] -= into
            m[old, old] -= self_n
            c = np.arange(classes)
            rows, columns = m[:classes], m[:, :classes].T
            gain = (f(rows + out) - f(rows)).sum(1) + (f(columns + into) - f(columns)).sum(1)
            d = m[c, c]
            gain += f(d + out[c] + into[c] + self_n) - f(d) - (f(d + out[c]) - f(d)) - (f(d + into[c]) - f(d))
            r, q, n_out, n_in = rows.sum(1), columns.sum(1), out.sum() + self_n, into.sum() + self_n
            gain -= f(r + n_out) - f(r) + f(q + n_in) - f(q)
            new = int(np.argmax(gain)) if gain.max() > gain[min(old, classes - 1)] + 1e-9 else old
            m[new] += out
            m[:, new] += into
            m[new, new] += self_n
            cls[w] = new
            moved += new != old
        if not moved:
            break
    return cls


def train(cut: DataFrame, summed: DataFrame) -> Model:
    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([int(unpack(b.as_py()[2], bool).sum()) for b in batch.column("body")], pa.int64())], ["n"])

    n_ends = cut.select("body").mapInArrow(ends, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    found = summed.where("batch IS NULL")
    top = found.select(F.explode("head").alias("h")).select(F.col("h")[0].alias("hash"), F.col("h")[1].alias("n"), F.col("h")[2].alias("band"))
    head = np.array([tuple(r) for r in top.orderBy(F.desc("n"), "hash").limit(HEAD_WORDS).collect()], np.int64).reshape(-1, 3).T
    head = [head[0].view(U64), head[1], head[2]]
    bands = summed_up(found, "bands", 2 * BANDS).reshape(2, BANDS)
    kinds, tokens = bands[0].copy(), bands[1].copy()
    vocabulary = int(kinds.sum()) + (n_ends > 0)
    counts = head[1]
    np.subtract.at(kinds, head[2], 1)
    np.subtract.at(tokens, head[2], counts)
    order = np.argsort(head[0])
    model = Model(head[0][order], order, counts, kinds, np.concatenate([counts, tokens]), int(n_ends), vocabulary)
    pairs = bigrams(cut, model)
    cls = exchange(pairs, len(counts))
    one = np.eye(int(cls.max()) + 1)[cls]
    model.cls = cls
    model.matrix = one.T @ pairs @ one
    return model


def contexts(cut: DataFrame, model: Model, ranges: int) -> DataFrame:
    """(range, batch, body): of each word of a batch that is no head word its hash and band, and how often which class
    stands before it (numbers from 0) and after it (from the number of classes) in training texts."""
    heads, k = len(model.counts), len(model.matrix)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, body in zip(batch.column("batch"), batch.column("body"), strict=True):
                texts = body.as_py()
                which, unit, before, row, train = _chain(model, texts)
                use = np.flatnonzero(train[row] & (unit >= heads) & (which >= 0))
                words, band = unpack_sorted(texts[5]), unpack(texts[6], np.uint8)
                found = []
                for side, beside in ((0, before[use]), (1, unit[use + 1] if use.size else use)):
                    found.append(np.unique(which[use] * (2 * k) + side * k + model.cls[beside], return_counts=True))
                key, n = (np.concatenate(x) for x in zip(*found, strict=True))
                order = np.argsort(key)
                key, n = key[order], n[order].astype(np.uint32)
                number = key // (2 * k)
                entries = np.bincount(number, minlength=words.size).astype(np.uint8)
                at = cuts(words, ranges)
                ends = np.searchsorted(number, at)
                rows = [(r, [pack_sorted(words[a:b]), pack(band[a:b]), pack(entries[a:b]), pack((key[i:j] % (2 * k)).astype(np.uint8)), pack(n[i:j])]) for r, (a, b, i, j) in enumerate(zip(at[:-1], at[1:], ends[:-1], ends[1:], strict=True)) if b > a]
                yield pa.RecordBatch.from_arrays([pa.array([r for r, _ in rows], pa.int32()), pa.array([name.as_py()] * len(rows), pa.string()), pa.array([p for _, p in rows], pa.list_(pa.binary()))], ["range", "batch", "body"])

    return cut.select("batch", "body").mapInArrow(run, "range int, batch string, body array<binary>")


def choose(into: np.ndarray, out: np.ndarray, m: np.ndarray, classes: int) -> np.ndarray:
    """The class that gains most by each word, given the counts of classes before (into) and after (out) it."""
    f = lambda x: np.where(x > 0, x * np.log(np.maximum(x, 1)), 0.0)
    rows, columns = m[:classes], m[:, :classes].T
    r, q = rows.sum(1), columns.sum(1)
    best = np.zeros(len(into), np.uint8)
    for lo in range(0, len(into), 1024):
        a, b = into[lo: lo + 1024, None], out[lo: lo + 1024, None]
        gain = (f(rows + b) - f(rows)).sum(2) + (f(columns + a) - f(columns)).sum(2)
        gain -= f(r + b.sum(2)) - f(r) + f(q + a.sum(2)) - f(q)
        best[lo: lo + 1024] = gain.argmax(1)
    return best


def assign(found: DataFrame, model: Model) -> DataFrame:
    """(range, batch, classes, sums): the class of each word of a batch in a range, STAYS where it joins none.

    One row without a batch for each range has the tokens that joined each class, and words and tokens that left each band.
    """
    k = len(model.matrix)
    classes = k - BANDS - 1

    def run(parts: pd.DataFrame) -> pd.DataFrame:
        words = [unpack_sorted(b[0]) for b in parts["body"]]
        every, number = np.unique(np.concatenate(words), return_inverse=True)
        total, band = np.zeros(every.size, np.int64), np.zeros(every.size, np.uint8)
        ends = np.cumsum([0, *(w.size for w in words)])
        own = [number[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]
        for i, b in zip(own, parts["body"], strict=True):
            band[i] = unpack(b[1], np.uint8)
            before = unpack(b[3], np.uint8) < k
            total += np.bincount(np.repeat(i, unpack(b[2], np.uint8))[before], unpack(b[4], np.uint32)[before], every.size).astype(np.int64)
        often = np.flatnonzero(total >= MIN_COUNT)
        place = np.full(every.size, -1, np.int64)
        place[often] = np.arange(often.size)
        counts = np.zeros(often.size * 2 * k, np.float32 if total.sum() < 1 << 24 else float)
        for i, b in zip(own, parts["body"], strict=True):
            at = np.repeat(place[i], unpack(b[2], np.uint8))
            use = at >= 0
            key = at[use] * (2 * k) + unpack(b[3], np.uint8)[use]  # each once in a batch
            counts[key] += unpack(b[4], np.uint32)[use]
        counts = counts.reshape(-1, 2 * k)
        best = np.full(every.size, STAYS, np.uint8)
        best[often] = choose(counts[:, :k], counts[:, k:], model.matrix, classes)
        rows = [(parts["range"].iloc[0], name, pack(best[i]), None) for name, i in zip(parts["batch"], own, strict=True)]
        sums = [np.bincount(best[often], total[often], k), np.bincount(band[often], minlength=k), np.bincount(band[often], total[often], k)]
        rows.append((parts["range"].iloc[0], None, None, np.concatenate(sums).astype(np.int64)))
        return pd.DataFrame(rows, columns=["range", "batch", "classes", "sums"])

    return found.groupBy("range").applyInPandas(run, "range int, batch string, classes binary, sums array<long>")


def classed(cut: DataFrame, summed: DataFrame, assigned: DataFrame, model: Model) -> DataFrame:
    """(body, pairs): the texts of each batch with count and class of each of its words, and class bigrams in training."""
    k = len(model.matrix)

    def run(key: tuple, parts: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        ids, known, train, sizes, number, words, band = own["body"].iloc[0]
        parts = parts.sort_values("range")
        counts = [unpack(b, np.int64) for b in parts["counts"] if b is not None]
        joined = [unpack(b, np.uint8) for b in parts["classes"] if b is not None]
        count, join = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (counts, joined))
        cls = model.cls[model.of(unpack_sorted(words), unpack(band, np.uint8))].astype(np.uint8)
        cls = np.where(join == STAYS, cls, join).astype(np.uint8)
        body = [ids, known, train, sizes, number, pack(count), pack(cls)]
        _, after, before, row, trained = _classes(body, k)
        use = trained[row]
        return pd.DataFrame({"body": [body], "pairs": [np.bincount(before[use] * k + after[use], minlength=k * k)]})

    both = summed.where("batch IS NOT NULL").select("batch", "range", "counts", F.lit(None).cast("binary").alias("classes"))
    both = both.union(assigned.where("batch IS NOT NULL").select("batch", "range", F.lit(None).cast("binary"), "classes"))
    texts = cut.select("batch", "body").groupBy("batch")
    return both.groupBy("batch").cogroup(texts).applyInPandas(run, "body array<binary>, pairs array<long>")


def _classes(body: list[bytes], k: int) -> tuple[np.ndarray, ...]:
    """Counts (-1 for ends), classes and classes before of all tokens of a batch, the row of each, and which rows train."""
    _, _, train, sizes, number, count, cls = body
    sizes, number = unpack(sizes, np.uint32).astype(np.int64), unpack(number, np.uint32)
    stop = np.zeros(number.size + sizes.size, bool)
    stop[np.cumsum(sizes + 1) - 1] = True
    c, at = np.full(stop.size, -1, np.int64), np.full(stop.size, k - 1, np.int64)
    c[~stop] = unpack(count, np.int64)[number]
    at[~stop] = unpack(cls, np.uint8)[number]
    return c, at, np.roll(at, 1), np.repeat(np.arange(sizes.size), sizes + 1), unpack(train, bool)


def score(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score and perplexity."""
    (ranges,) = shares(docs, "text", RANGE)
    cut = checkpointed(cut_words(lean(docs)))
    summed = checkpointed(sum_counts(ranged(cut, ranges)))
    model = train(cut, summed)
    k, heads = len(model.matrix), len(model.counts)
    classes = k - BANDS - 1
    assigned = checkpointed(assign(contexts(cut, model, ranges), model))
    sums = summed_up(assigned.where("batch IS NULL"), "sums", 3 * k).reshape(3, k)
    in_class = np.bincount(model.cls[:heads], model.counts, k) + sums[0]
    kinds_of, bands_of = model.kinds - sums[1][:BANDS], model.tokens[heads:] - sums[2][:BANDS]
    texts = checkpointed(classed(cut, summed, assigned, model))
    m = summed_up(texts, "pairs", k * k).reshape(k, k).astype(float)
    after, alone = m.sum(1, keepdims=True), m.sum(0)
    base = (alone + 0.5) / (alone.sum() + 0.5 * k)
    step = np.log10(np.where(after > 0, KEEP * m / np.maximum(after, 1) + (1 - KEEP) * base, base))
    ends, total, vocabulary = model.ends, model.total, model.vocabulary

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for body in (b.as_py() for batch in batches for b in batch.column("body")):
            c, cls, before, row, trained = _classes(body, k)
            c[c < 0] = ends
            plain = np.log10((c + 0.5) / (total + 0.5 * (vocabulary + 1)))
            emit = np.zeros(c.size)
            is_class, is_band = cls < classes, (cls >= classes) & (cls < k - 1)
            emit[is_class] = np.log10(c[is_class] / in_class[cls[is_class]])
            b = cls[is_band] - classes
            emit[is_band] = np.log10((c[is_band] + 0.5) / (bands_of[b] + 0.5 * (kinds_of[b] + 1)))
            n = len(trained)
            tokens, value = np.bincount(row, minlength=n), np.bincount(row, step[before, cls] + emit, n)
            out = [pa.array(unpack(body[0], np.int64), mask=~unpack(body[1], bool)), pa.array(~trained), pa.array(tokens), pa.array(np.bincount(row[c > 0], minlength=n)), pa.array(np.full(n, total)), pa.array(np.bincount(row, plain, n)), pa.array(value), pa.array(10 ** (-value / tokens))]
            yield pa.RecordBatch.from_arrays(out, ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity"])

    return texts.select("body").mapInArrow(run, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, perplexity double")


def op7_brown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"))
