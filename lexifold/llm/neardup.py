"""Near-duplicates by ProbMinHash, banding and exact verification.

A text's shingles are runs of five words (A-Z lowered, split at the six ASCII spaces; a shorter text is one shingle),
weighted by 1 + ln of how often they occur. Each shingle is a Poisson process of arrivals, an arrival falls on one of
BANDS * ROWS registers, a register keeps its first; a shingle stops once its next arrival is later than every register.
Registers of two texts are equal with the probability Jaccard similarity of their weighted shingles: the sum over the
shingles d of both of 1 / sum over d' of max(x[d'] / x[d], y[d'] / y[d]). Where no shingle repeats, that's the Jaccard
similarity of their sets. Texts that share a band are candidates; those whose probability Jaccard is 0.8 or more, computed
exactly, are linked. A class is a connected component of links. A pair of similarity 0.8 shares no band with probability
(1 - 0.8^ROWS)^BANDS, below 1e-5; that is all that is missed.

Copies are one text from the start. In a band's bucket, each text is compared with the smallest one; then labels of
different classes in a bucket with each other; and last all pairs whose classes still differ, save those that a bound
rules out: each set has a bitmap of the parities of its shingles' cells, and two bitmaps differ in no more bits than the
sets differ in shingles. Similar sets differ in at most a ninth of both sizes; with weights, in at most a fifth of both
weights, since a probability Jaccard is no larger than the overlap of the two distributions. So no pair that shares a
band goes unsettled. Buckets meet there in blocks of BLOCK texts, so no task gathers one.

Texts without a word (or null) are alone unless they are exact copies of each other; null texts are alone. A row with a
null doc_id has a null class. Rows with one doc_id are one document: their texts are compared apart, and
their classes join. Repeated rows count once. An empty table gives no rows; a very long text is one row's work in memory.
Columns other than doc_id and text are left out by `classes` and kept by `keep_one`, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import U64, checkpointed, lean, mix64, slices, table, utf8, word_hashes

WORDS, BANDS, ROWS = 5, 30, 5
#: Cells of a bitmap for each shingle, and the smallest and largest bitmap.
CELLS, LEAST, MOST = 4, 1 << 10, 1 << 18
CHUNK = 2 << 20
BLOCK = 4096


def shingles(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, hash and count of each different shingle of each row, in the order of rows."""
    data, offsets = utf8(column)
    h, row, _ = word_hashes(data, offsets)
    none = np.zeros(0, np.int64)
    if not h.size:
        return none, np.zeros(0, U64), none
    factors = mix64(np.arange(1, WORDS + 1, dtype=U64))
    whole = np.zeros(h.size, U64)
    for j in range(WORDS):  # words past the end of the row count as none
        left = max(h.size - j, 0)
        same = np.zeros(h.size, bool)
        same[:left] = row[j:] == row[:left]
        moved = np.zeros(h.size, U64)
        moved[:left] = h[j:]
        whole += np.where(same, mix64(moved) * (factors[j] | U64(1)), U64(0))
    full = np.zeros(h.size, bool)
    full[: max(h.size - WORDS + 1, 0)] = row[WORDS - 1:] == row[: max(h.size - WORDS + 1, 0)]
    first = np.ones(h.size, bool)
    first[1:] = row[1:] != row[:-1]
    use = full | first
    whole, row = mix64(whole[use]), row[use]
    _, at, n = np.unique(mix64(whole ^ mix64(row.astype(U64))), return_index=True, return_counts=True)
    order = np.argsort(row[at], kind="stable")
    return row[at][order], whole[at][order], n[order]


def sketch(row: np.ndarray, shingle: np.ndarray, count: np.ndarray, rows: int) -> np.ndarray:
    """The registers of each row; 0 where it has no shingle."""
    m = BANDS * ROWS
    registers = np.full(rows * m, np.iinfo(np.uint64).max, U64)
    weight = 1 + np.log(count)
    time = np.zeros(row.size)
    latest = np.full(rows, np.inf)
    step = 0
    while row.size:
        step += 1
        r = mix64(shingle + U64((step * 0x9E3779B97F4A7C15) & (1 << 64) - 1))
        time = time - np.log(((r >> U64(12)).astype(float) + 1) / (1 << 52)) / weight
        live = time <= latest[row]
        row, shingle, weight, time, r = row[live], shingle[live], weight[live], time[live], r[live]
        stamp = time.astype(np.float32).view(np.uint32).astype(U64) << U64(32) | shingle >> U64(32)
        np.minimum.at(registers, row * m + (mix64(r) % U64(m)).astype(np.int64), stamp)
        some = np.unique(row) if step > 8 else slice(None)
        top = (registers.reshape(rows, m)[some].max(1) >> U64(32)).astype(np.uint32).view(np.float32)
        latest[some] = np.where(np.isnan(top), np.inf, top)
    return np.where(registers == np.iinfo(np.uint64).max, U64(0), registers & U64(0xFFFFFFFF)).reshape(rows, m)


def banded(texts: DataFrame) -> DataFrame:
    """(doc_id, digest, bands): the band keys of each text that has a word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text", CHUNK):
                row, s, n = shingles(batch.column("text"))
                has = np.unique(row)
                found = sketch(np.searchsorted(has, row), s, n, has.size).reshape(has.size, BANDS, ROWS)
                key = np.broadcast_to(mix64(np.arange(1, BANDS + 1, dtype=U64)), (has.size, BANDS)).copy()
                for j in range(ROWS):
                    key = mix64(key ^ mix64(found[:, :, j] + U64(j + 1)))
                bands = pa.ListArray.from_arrays(np.arange(0, has.size * BANDS + 1, BANDS, dtype=np.int32), key.view(np.int64).ravel())
                yield pa.RecordBatch.from_arrays([*(batch.column(c).take(pa.array(has)) for c in ("doc_id", "digest")), bands], ["doc_id", "digest", "bands"])

    return texts.select("doc_id", "digest", "text").mapInArrow(run, "doc_id long, digest binary, bands array<long>")


def sets(texts: DataFrame) -> DataFrame:
    """(node, shingles, counts): the shingles of each text, and how often each occurs unless none repeats (then null)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text", CHUNK):
                row, s, n = shingles(batch.column("text"))
                ends = np.searchsorted(row, np.arange(batch.num_rows + 1)).astype(np.int32)
                plain = np.ones(batch.num_rows, bool)
                plain[row[n > 1]] = False
                counts = pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(np.where(plain, 0, np.diff(ends)))]).astype(np.int32), n[~plain[row]].astype(np.int32), mask=pa.array(plain))
                yield pa.RecordBatch.from_arrays([batch.column("node"), pa.ListArray.from_arrays(ends, s.view(np.int64)), counts], ["node", "shingles", "counts"])

    return texts.select("node", "text").mapInArrow(run, "node long, shingles array<long>, counts array<int>")


def similarity(a: np.ndarray, x: np.ndarray, b: np.ndarray, y: np.ndarray) -> float:
    """The probability Jaccard of two sets of shingles a and b with weights x and y.

    For a shingle of both, the maxima are x's share where y[d'] / x[d'] is at most its own ratio, else y's: so shingles
    are sorted by their ratio, and the sums are running ones.
    """
    every = np.union1d(a, b)
    u, v = np.zeros(every.size), np.zeros(every.size)
    u[np.searchsorted(every, a)], v[np.searchsorted(every, b)] = x, y
    both = (u > 0) & (v > 0)
    ratio = np.where(u > 0, v / np.where(u > 0, u, 1), np.inf)
    order = np.argsort(ratio, kind="stable")
    at = np.searchsorted(ratio[order], ratio[both], "right")
    below, above = np.concatenate([[0], np.cumsum(u[order])]), np.concatenate([[0], np.cumsum(v[order])])
    return float((1 / (below[at] / u[both] + (above[-1] - above[at]) / v[both])).sum())


def weights(counts: np.ndarray | None, size: int) -> np.ndarray:
    return np.ones(size) if counts is None else 1 + np.log(counts)


def linked(pairs: DataFrame, known: DataFrame) -> DataFrame:
    """The pairs (a, b) that are similar enough; merge joins, whose hot keys are split at run time."""
    side = lambda n: known.select(F.col("node").alias(n), F.col("shingles").alias(f"s{n}"), F.col("counts").alias(f"n{n}")).hint("merge")
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    repeats = F.col("na").isNotNull() | F.col("nb").isNotNull()
    common = F.when(~repeats, F.size(F.array_intersect("sa", "sb")))
    settled = both.withColumn("common", common).where(repeats | (5 * F.col("common") >= 4 * (F.size("sa") + F.size("sb") - F.col("common"))))
    # what has repeated shingles leaves with its sets, all others without
    slim = settled.select("a", "b", *(F.when(repeats, F.col(c)).alias(c) for c in ("sa", "na", "sb", "nb")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.ones(batch.num_rows, bool)
            for i in np.flatnonzero(np.array(batch.column("sa").is_valid())):
                sa, na, sb, nb = (None if not (v := batch.column(c)[i]).is_valid else np.array(v.values) for c in ("sa", "na", "sb", "nb"))
                keep[i] = similarity(sa.view(U64), weights(na, sa.size), sb.view(U64), weights(nb, sb.size)) >= 0.8 - 1e-12
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(pa.array(keep)) for c in ("a", "b")], ["a", "b"])

    return slim.mapInArrow(run, "a long, b long")


def bitmap(shingle: np.ndarray) -> np.ndarray:
    """The parity of each cell of a set, as 64-bit words; the number of cells is a power of two that grows with the set."""
    cells = min(max(1 << (CELLS * shingle.size - 1).bit_length(), LEAST), MOST)
    odd = np.bincount((shingle.view(U64) & U64(cells - 1)).astype(np.int64), minlength=cells) & 1
    return np.packbits(odd.astype(np.uint8)).view(U64)


def bitmaps(known: DataFrame) -> DataFrame:
    """(node, size, weight, cells): the size of each set, its weight (null where that's the size), and its bitmap."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, weight, cells = [], [], []
            for s, n in zip(batch.column("shingles"), batch.column("counts"), strict=True):
                s = np.array(s.values)
                size.append(s.size)
                weight.append(float(weights(np.array(n.values), s.size).sum()) if n.is_valid else None)
                cells.append(bitmap(s).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(size, pa.int64()), pa.array(weight, pa.float64()), pa.array(cells, pa.binary())], ["node", "size", "weight", "cells"])

    return known.select("node", "shingles", "counts").mapInArrow(run, "node long, size long, weight double, cells binary")


def possible(size: np.ndarray, weight: np.ndarray, cells: list[bytes], label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows with different labels whose sizes and bitmaps allow a similarity of 0.8; no similar pair is left out.

    weight is NaN where no shingle repeats. Of two bitmaps the longer is folded to the length of the other.
    """
    left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    plain = np.isnan(weight)
    weight = np.where(plain, size, weight)
    width = np.array([len(c) // 8 for c in cells])
    for w in np.unique(width):
        own = np.flatnonzero(width == w)
        # a set that is larger by more than either bound allows is none's partner
        near = 5 * (size - size[own].max()) <= weight + weight[own].max()
        larger = np.flatnonzero((width > w) & near)
        rows = np.concatenate([own, larger])
        x = np.empty((rows.size, w), U64)
        for i, r in enumerate(rows):
            x[i] = np.bitwise_xor.reduce(np.frombuffer(cells[r], U64).reshape(-1, w), 0)
        block = max(1, (1 << 21) // x.size)
        for lo in range(0, own.size, block):
            i = own[lo: lo + block, None]
            most = np.where(plain[i] & plain[rows], (size[i] + size[rows]) / 9, (weight[i] + weight[rows]) / 5) + 1e-6
            use = (label[i] != label[rows]) & (np.arange(lo, lo + i.size)[:, None] < np.arange(rows.size)) & (abs(size[i] - size[rows]) <= most)
            if use.any():
                use &= np.bitwise_count(x[lo: lo + i.size, None] ^ x).sum(2, dtype=np.int64) <= most
            a, b = np.nonzero(use)
            left.append(own[lo + a])
            right.append(rows[b])
    return np.concatenate(left), np.concatenate(right)


def unsettled(named: DataFrame, signs: DataFrame, block: int = BLOCK) -> DataFrame:
    """Pairs (a, b) of a bucket with different labels that may be similar.

    A bucket of more than `block` texts is dealt into blocks, and each two of them meet in a task. Only pairs that the
    bound cannot rule out leave the task, each in the first band that it shares.
    """

    def run(got: pa.Table) -> pa.Table:
        ids, label, part = (np.array(got.column(c)) for c in ("node", "label", "part"))
        band, p, q = (got.column(c)[0].as_py() for c in ("band", "p", "q"))
        keys = np.array(got.column("bands").combine_chunks().flatten()).reshape(got.num_rows, BANDS)
        i, j = possible(np.array(got.column("size")), got.column("weight").to_numpy(), got.column("cells").to_pylist(), label)
        use = (ids[i] != ids[j]) & ((part[i] != part[j]) | (p == q)) & ((keys[i] == keys[j]).argmax(1) == band)
        i, j = ids[i[use]], ids[j[use]]
        return pa.table({"a": np.minimum(i, j), "b": np.maximum(i, j)})

    sizes = checkpointed(named.groupBy("key").agg(F.ceil(F.count("*") / block).cast("int").alias("parts")))
    dealt = named.join(sizes.hint("merge"), "key").withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    met = dealt.join(signs.hint("merge"), "node").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    met = met.withColumn("p", F.least("part", "other")).withColumn("q", F.greatest("part", "other")).drop("other", "parts")
    return met.groupBy("key", "p", "q").applyInArrow(run, "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """(node, label): of each linked text the smallest one that it reaches."""
    edges = checkpointed(links.union(links.select("b", "a")).distinct())
    labels = edges.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label"))
    labels = checkpointed(labels)
    while True:
        seen = edges.join(labels.withColumnRenamed("node", "b").hint("merge"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("far"))
        moved = labels.join(seen.hint("merge"), "node").join(jump.hint("merge"), "label", "left")
        new = checkpointed(moved.select("node", F.least("label", "near", "far").alias("label"), F.col("label").alias("old")))
        done = new.where("label <> old").isEmpty()
        labels = new.drop("old")
        if done:
            return labels


def classes(docs: DataFrame) -> DataFrame:
    """(doc_id, class_id, copy_of): the class of each document by its smallest id; copy_of is the first of its copies."""
    docs = lean(docs)
    own = F.concat(F.unhex(F.md5(F.col("doc_id").cast("string"))), F.lit(b"null"))
    texts = docs.where("doc_id IS NOT NULL").select("doc_id", F.coalesce(F.unhex(F.md5("text")), own).alias("digest"), "text")
    every = checkpointed(texts.select("doc_id", "digest").distinct())
    # a text is a node, known by the smallest document that has it; both sides of joins are read anew, so that hot keys can be split
    nodes = checkpointed(every.groupBy("digest").agg(F.min("doc_id").alias("doc_id")).withColumn("node", F.monotonically_increasing_id()))
    sketches = checkpointed(banded(texts).join(nodes.hint("merge"), ["digest", "doc_id"]).dropDuplicates(["node"]).select("node", "bands"))
    members = sketches.select("node", F.posexplode("bands").alias("band", "key"))
    members = checkpointed(members)
    buckets = members.groupBy("key").agg(F.min("node").alias("a"), F.max("node").alias("last")).where("a < last").select("key", "a")
    members = checkpointed(members.join(buckets.hint("merge"), "key"))  # what stands alone in its bucket goes
    wanted = nodes.join(members.select("node").distinct().hint("merge"), "node")
    known = checkpointed(sets(texts.join(wanted.hint("merge"), ["digest", "doc_id"])).dropDuplicates(["node"]))
    tested = checkpointed(members.where("a < node").select("a", F.col("node").alias("b")).distinct())
    links = checkpointed(linked(tested, known))
    for last in (False, True):
        labels = components(links)
        named = members.select("key", "band", "node").join(labels.hint("merge"), "node", "left").select("key", "band", "node", F.coalesce("label", "node").alias("label"))
        mixed = named.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo < hi").select("key", "lo")
        named = named.join(mixed.hint("merge"), "key")
        if last:  # whatever is not settled
            named = checkpointed(named.select("key", "band", "node", "label"))
            signs = bitmaps(known.join(named.select("node").distinct().hint("merge"), "node", "left_semi")).join(sketches.hint("merge"), "node")
            pairs = unsettled(named, signs)
        else:  # one text for each label, all against the first label's
            one = named.groupBy("key", "label").agg(F.min("node").alias("b"), F.first("lo").alias("lo"))
            head = one.where("label = lo").select("key", F.col("b").alias("a"))
            pairs = one.where("label > lo").join(head.hint("merge"), "key").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        pairs = checkpointed(pairs.distinct().join(tested.hint("merge"), ["a", "b"], "left_anti"))
        if not pairs.isEmpty():
            links = checkpointed(links.union(linked(pairs, known)))
            tested = tested.union(pairs)
    # rows with one doc_id and different texts tie their classes
    owners = checkpointed(every.join(nodes.select("digest", "node", F.col("doc_id").alias("copy_of")).hint("merge"), "digest").select("doc_id", "node", "copy_of"))
    split = owners.groupBy("doc_id").agg(F.min("node").alias("a"), F.max("node").alias("last")).where("a < last").select("doc_id", "a")
    split = owners.join(split.hint("merge"), "doc_id").where("a < node").select("a", F.col("node").alias("b"))
    labels = components(links.union(split))
    least = labels.join(nodes.select("node", "doc_id").hint("merge"), "node").groupBy("label").agg(F.min("doc_id").alias("class_id"))
    named = owners.join(labels.join(least.hint("merge"), "label").select("node", "class_id").hint("merge"), "node", "left")
    found = named.groupBy("doc_id").agg(F.min(F.coalesce("class_id", "copy_of")).alias("class_id"), F.min("copy_of").alias("copy_of"))
    return found.union(docs.where("doc_id IS NULL").select("doc_id", F.lit(None).cast("long"), F.lit(None).cast("long")))


def op9_probminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(table(spark, sf_dir, "documents"))


def keep_one(docs: DataFrame) -> DataFrame:
    """The document with the smallest id of each class, one row of it; rows with a null doc_id stay."""
    gone = classes(docs).where("doc_id <> class_id").select("doc_id")
    named, nameless = docs.where("doc_id IS NOT NULL"), docs.where("doc_id IS NULL")  # apart: a null is no hot key
    name = "_row"
    while name in docs.columns:
        name += "_"
    row = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.xxhash64("text")))
    left = named.join(gone.hint("merge"), "doc_id", "left_anti").withColumn(name, row).where(F.col(name) == 1)
    return left.select(*docs.columns).union(nameless)
