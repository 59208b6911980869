"""Nearest neighbours by randomly rotated one-bit codes.

Vectors are normalised and, less the centroid of their cell, rotated; the signs are kept as packed bits, with the
distance to the centroid and the inner product of code and vector as correction scalars. A query is rounded to QUERY_BITS
bits in each cell, so that its inner product with a code is a few AND and popcount operations; the estimate comes with
an error bound. In each cell, every vector whose upper bound reaches the lower bound of the K-th best is reranked by the
exact cosine in double precision.

Cells: centroids are fitted on a sample drawn by hash (SAMPLE rows at most), about the square root of the number of
vectors, one for each four of the sample at most; every vector is in the cell of its nearest centroid. How many cells a
query visits is measured, at every size: the true neighbours of ASKED queries at most, drawn by hash, are found among all
vectors, and as many of the nearest cells are visited as hold RECALL of these neighbours. Where vectors have clusters
that's a few cells; where they are noise it is a large share of all. Vectors and queries of a cell meet in blocks of
BLOCK by BLOCK rows, so no task gathers a cell. Equal vectors are one class of which the K + 1 smallest ids are kept,
enough for any query.

Null vectors, zero ones, and those with null or non-finite components or of another length than most take no part; nor
do rows with a null id. Of rows with one id each stands for itself: it asks, is an answer, and a query never gets its own
id. Ties go to the smaller id. An empty table gives no rows; columns other than vec_id and embedding are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import checkpointed, table

K = 5
SAMPLE, ROUNDS = 65536, 8
ASKED, RECALL = 256, 0.97
BLOCK = 2048
QUERY_BITS = 6
#: Errors of an estimate stay below BOUND / sqrt(d - 1) times the scalar of a code, save for a share of about exp(-BOUND^2 / 2).
BOUND = 3.0
SALTS = 64


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id and embedding as doubles, of the vectors that take part."""
    v = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding")).where("vec_id IS NOT NULL AND embedding IS NOT NULL AND size(embedding) > 0")
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    v = v.where(fine & F.exists("embedding", lambda x: x != 0))
    common = v.groupBy(F.size("embedding").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    return v.where(F.size("embedding") == (common["n"] if common else 0))


def classes(v: DataFrame, k: int = K) -> DataFrame:
    """One row for each different vector: `ids`, its k + 1 smallest ids; salted, so that a frequent vector is no hot key."""
    key, salt = F.xxhash64("embedding"), F.pmod(F.xxhash64("vec_id"), F.lit(SALTS))
    near = v.withColumn("key", key).withColumn("salt", salt)
    first = near.withColumn("r", F.row_number().over(Window.partitionBy("key", "embedding", "salt").orderBy("vec_id"))).where(F.col("r") <= k + 1)
    return first.groupBy("key", "embedding").agg(F.slice(F.array_sort(F.collect_list("vec_id")), 1, k + 1).alias("ids")).select(F.element_at("ids", 1).alias("class"), "ids", "embedding")


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Lists of one length as rows."""
    flat = column.combine_chunks().flatten() if isinstance(column, pa.ChunkedArray) else column.flatten()
    return np.array(flat, float).reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def some(rows: DataFrame, name: str, most: int, label: str) -> tuple[np.ndarray, int]:
    """The vectors of about `most` rows at most, drawn by a hash of a column and in its order; and the number of rows."""
    n = rows.count()
    draw = F.pmod(F.xxhash64(F.lit(label), name), F.lit(1 << 31))
    drawn = rows.where(draw < int(min(1.0, most / max(n, 1)) * (1 << 31))).select(name, "embedding").orderBy(name)
    return matrix(drawn.toArrow().column("embedding")), n


def fit(reps: DataFrame, sample: int = SAMPLE) -> np.ndarray:
    """Centroids by k-means on the sample."""
    x, n = some(reps, "class", sample, "sample")
    if not len(x):
        return np.zeros((0, 0))
    x = unit(x)
    centres = x[np.linspace(0, len(x) - 1, int(max(1, min(np.sqrt(n), len(x) / 4)))).astype(int)]
    for _ in range(ROUNDS):
        at = np.concatenate([(x[lo: lo + 4096] @ centres.T).argmax(1) for lo in range(0, len(x), 4096)])
        total = np.zeros_like(centres)
        np.add.at(total, at, x)
        norm = np.sqrt((total * total).sum(1, keepdims=True))
        centres = np.where(norm > 1e-12, total / np.maximum(norm, 1e-12), centres)
    return centres


def rotation(d: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(d).standard_normal((d, d)))
    return q * np.sign(np.diag(r))


class Codes:
    """The index of one part of a cell."""

    def __init__(self, x: np.ndarray, centre: np.ndarray, turn: np.ndarray):
        d = x.shape[1]
        rest = (x - centre) @ turn
        self.far = np.sqrt((rest * rest).sum(1))
        direction = rest / np.maximum(self.far, 1e-12)[:, None]
        self.bits = np.packbits(direction > 0, axis=1)
        pad = -self.bits.shape[1] % 8
        self.bits = np.ascontiguousarray(np.pad(self.bits, ((0, 0), (0, pad)))).view(np.uint64)
        self.ones = np.bitwise_count(self.bits).sum(1).astype(float)
        self.own = np.maximum(np.abs(direction).sum(1) / np.sqrt(d), 1e-6)  # code times direction
        self.error = np.sqrt(np.maximum(1 - self.own ** 2, 0)) / self.own / np.sqrt(max(d - 1, 1))
        self.centre, self.turn, self.d = centre, turn, d

    def estimate(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Estimated inner products of unit queries (rows of q) with all vectors, and bounds of their errors."""
        rest = (q - self.centre) @ self.turn
        far = np.maximum(np.sqrt((rest * rest).sum(1)), 1e-12)[:, None]
        direction = rest / far
        low = direction.min(1, keepdims=True)
        step = np.maximum((direction.max(1, keepdims=True) - low) / ((1 << QUERY_BITS) - 1), 1e-12)
        level = np.round((direction - low) / step).astype(np.uint8)
        dot = np.zeros((len(q), len(self.far)))
        for j in range(QUERY_BITS):
            plane = np.packbits(level >> j & 1, axis=1)
            plane = np.ascontiguousarray(np.pad(plane, ((0, 0), (0, -plane.shape[1] % 8)))).view(np.uint64)
            for word in range(plane.shape[1]):
                dot += float(1 << j) * np.bitwise_count(plane[:, word, None] & self.bits[:, word])
        total = level.sum(1, dtype=float)[:, None]
        signed = 2 * (low * self.ones + step * dot) - (low * self.d + step * total)  # bits as plus and minus one
        cosine = signed / np.sqrt(self.d) / self.own
        error = BOUND * (self.error + step / 2 / self.own)
        base = (q @ self.centre)[:, None]
        # q.x = (q-c).(x-c) + q.c + x.c - c.c, and x.c follows from |x - c|
        xc = (1 + self.centre @ self.centre - self.far ** 2) / 2
        return far * self.far * cosine + base + xc - self.centre @ self.centre, far * self.far * error


def nearest_cells(x: np.ndarray, centres: np.ndarray, n: int) -> np.ndarray:
    """For each unit vector the n nearest cells, nearest first."""
    return np.concatenate([np.argsort(-(x[lo: lo + 2048] @ centres.T), 1, kind="stable")[:, :n] for lo in range(0, len(x), 2048)]) if len(x) else np.zeros((0, n), int)


def probes(placed: DataFrame, queries: DataFrame, centres: np.ndarray, k: int, asked: int = ASKED, recall: float = RECALL) -> int:
    """How many of the nearest cells hold a share of `recall` of the true neighbours of some queries."""
    q, _ = some(queries, "query", asked, "asked")
    if not len(q):
        return 1
    q = unit(q)

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                near = unit(matrix(batch.column("embedding"))) @ q.T
                near[near > 1 - 1e-9] = -2  # the query itself
                rows = np.argsort(-near, 0, kind="stable")[:k]
                columns = np.broadcast_to(np.arange(len(q)), rows.shape)
                yield pa.RecordBatch.from_arrays([pa.array(columns.ravel()), pa.array(near[rows, columns].ravel()), batch.column("cell").take(pa.array(rows.ravel()))], ["query", "near", "cell"])

    found = placed.select("embedding", "cell").mapInArrow(best, "query long, near double, cell int").where("near > -2")
    first = found.withColumn("r", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("near"), "cell"))).where(F.col("r") <= k).toArrow()
    if not len(first):
        return 1
    rank = np.argsort(nearest_cells(q, centres, len(centres)), 1)[np.array(first.column("query")), np.array(first.column("cell"))]
    return int(np.sort(rank)[int(np.ceil(recall * rank.size)) - 1]) + 1


def search(reps: DataFrame, queries: DataFrame, centres: np.ndarray, k: int = K) -> DataFrame:
    """(query, class, score): for each query class the best vector classes of every block of rows that it meets."""
    turn = rotation(centres.shape[1])

    def cells_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                cell = nearest_cells(unit(matrix(b.column("embedding"))), centres, 1)[:, 0]
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell, pa.int32())], [*b.schema.names, "cell"])

    placed = checkpointed(reps.select("class", "embedding").mapInArrow(cells_of, "class long, embedding array<double>, cell int"))
    visited = probes(placed, queries, centres, k)

    def visits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                near = nearest_cells(unit(matrix(b.column("embedding"))), centres, visited)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(near.astype(np.int32).tolist(), pa.list_(pa.int32()))], ["query", "embedding", "cells"])

    asks = checkpointed(queries.mapInArrow(visits, "query long, embedding array<double>, cells array<int>"))
    each = asks.select("query", F.explode("cells").alias("cell"))
    many = lambda rows, name: rows.groupBy("cell").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias(name))
    blocks = checkpointed(many(placed, "parts").join(many(each, "turns"), "cell"))  # one row for each cell
    numbers = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    # each block of vectors of a cell is dealt to each block of queries that visit it
    base = placed.join(F.broadcast(blocks), "cell").withColumn("part", F.pmod(F.xxhash64(F.lit("part"), "class"), F.col("parts")).cast("int")).withColumn("turn", F.explode(numbers("turns")))
    asking = asks.withColumn("cell", F.explode("cells")).drop("cells").join(F.broadcast(blocks), "cell").withColumn("turn", F.pmod(F.xxhash64(F.lit("turn"), "query"), F.col("turns")).cast("int")).withColumn("part", F.explode(numbers("parts")))

    def look(base: pa.Table, ask: pa.Table) -> pa.Table:
        names, found, scores = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
        if base.num_rows and ask.num_rows:
            raw, asked = matrix(base.column("embedding")), matrix(ask.column("embedding"))
            x, q = unit(raw), unit(asked)
            codes = Codes(x, centres[base.column("cell")[0].as_py()], turn)
            ids, query = np.array(base.column("class")), np.array(ask.column("query"))
            norm, asked_norm = np.sqrt((raw * raw).sum(1)), np.sqrt((asked * asked).sum(1))
            for lo in range(0, len(q), 256):
                estimate, error = codes.estimate(q[lo: lo + 256])
                least = estimate - error
                bar = -np.partition(-least, k, 1)[:, k: k + 1] if len(ids) > k + 1 else -np.inf
                row, at = np.nonzero(estimate + error >= bar)
                exact = np.empty(row.size)
                for i in range(0, row.size, 1 << 16):
                    r, a = row[i: i + (1 << 16)] + lo, at[i: i + (1 << 16)]
                    exact[i: i + (1 << 16)] = (raw[a] * asked[r]).sum(1) / (norm[a] * asked_norm[r])
                order = np.lexsort((ids[at], -exact, row))
                row, at, exact = row[order], at[order], exact[order]
                start = np.searchsorted(row, np.arange(row[-1] + 1)) if row.size else row
                keep = np.arange(row.size) - start[row] <= k
                names.append(query[row[keep] + lo])
                found.append(ids[at[keep]])
                scores.append(exact[keep])
        return pa.table({"query": np.concatenate(names), "class": np.concatenate(found), "score": np.concatenate(scores)})

    keys = ("cell", "part", "turn")
    return base.select(*keys, "class", "embedding").groupBy(*keys).cogroup(asking.select(*keys, "query", "embedding").groupBy(*keys)).applyInArrow(look, "query long, class long, score double")


def nearest(vectors: DataFrame, every: int = 50, k: int = K) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of each row whose vec_id is divisible by `every`."""
    v = checkpointed(usable(vectors))
    reps = checkpointed(classes(v, k))
    wanted = v.where(F.col("vec_id") % every == 0)
    centres = fit(reps)
    if not len(centres):
        return v.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    # rows with one vector ask once; their class is known by the vector
    asked = wanted.select("embedding").distinct().join(reps.hint("merge"), "embedding").select(F.col("class").alias("query"), "embedding")
    found = search(reps, asked, centres, k)
    kept = found.withColumn("r", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "class"))).where(F.col("r") <= k + 1)
    near = kept.join(reps.select("class", "ids").hint("merge"), "class").select("query", "score", F.explode("ids").alias("vec_id"))
    top = near.groupBy("query").agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "vec_id"))), 1, k + 1).alias("top"))
    named = wanted.join(reps.select("embedding", F.col("class").alias("query")).hint("merge"), "embedding").select("query", F.col("vec_id").alias("query_id"))
    rest = named.join(top.hint("merge"), "query").withColumn("top", F.slice(F.filter("top", lambda t: t["vec_id"] != F.col("query_id")), 1, k))
    return rest.select("query_id", F.posexplode("top").alias("r", "t")).select("query_id", (F.col("r") + 1).cast("int").alias("rank"), F.col("t.vec_id").alias("vec_id"), (-F.col("t.s")).alias("score"))


def op2_rabitq(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"))
