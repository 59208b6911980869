"""Language ID by interpolated Kneser-Ney character models, one per language, kept as sorted hash arrays.

Characters are lowered; each run of anything but letters is one boundary. Models of ORDER characters are counted on
about `sample_docs` whole labelled documents of each language, chosen by a hash of doc_id (the sample is a parameter; it
bounds what reaches the driver) and at most TRAINED of its documents. The language with the lowest cross-entropy per
character wins, ties to the first by code point. A second sample, of that size or the rest, sets the rejection limit: the
cross-entropy that all but a thousandth of it stay below, raised halfway to the one that all but a twentieth of the
sample of each language exceed when its own model is left out, where that is higher. With one language, the limit is as
far above its quantile as that is above the median. A language with fewer than FEW documents trains on all of them and
has no say in the limit.

A null text or one without a letter gives `und`, score 0, rejected. Without labelled rows each text is `und`. Rows
with a null doc_id are not held out and never train. Repeated rows give the same answer each, in training they count
each. Whole texts are read; a very long one is a task's work by itself. An empty table gives no rows. `classify` keeps
other columns but puts its own in place of any named lang_pred, score, rejected or bits; `keep_known` keeps all columns.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, StringType, StructField, StructType

from .common import U64, lean, mix64, slices, table, utf8

ORDER = 4
SAMPLE_DOCS = 300
TRAINED, FEW = 0.8, 5
KEPT, LEFT_OUT = 0.999, 0.05
SHARPNESS = 8.0
UND = "und"
CHUNK = 1 << 20


def held_out(column: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(column).cast("string")) % 4 == 2, F.lit(False))


@cache
def _letters() -> np.ndarray:
    """Of each code point: its lower-case code point if it is a letter, else 0."""
    out = np.zeros(0x110000, np.uint32)
    for i in range(0x110000):
        if (c := chr(i)).isalpha():
            out[i] = ord(low) if len(low := c.lower()) == 1 else i
    return out


def characters(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Lowered letters and 0 for each boundary, rows end to end with a boundary before and after; offsets of rows."""
    data, offsets = utf8(column)
    lead = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    points = np.frombuffer(data.tobytes().decode("utf8", "replace").encode("utf-32-le"), np.uint32)
    at = lead[offsets]
    full = np.zeros(points.size + len(at), np.uint32)
    row = np.repeat(np.arange(len(at) - 1), np.diff(at))
    full[np.arange(points.size) + row + 1] = _letters()[points]
    keep = np.ones(full.size, bool)
    keep[1:] = (full[1:] != 0) | (full[:-1] != 0)
    edges = np.zeros(full.size, bool)
    edges[at + np.arange(len(at))] = True  # the boundary before each row; the last one ends the table
    keep |= edges
    full, edges = full[keep], edges[keep]
    keep = np.ones(full.size, bool)
    keep[:-1] = (full[:-1] != 0) | edges[:-1] | ~edges[1:]  # a run at the end of a row is that row's last boundary
    return full[keep], np.flatnonzero(edges[keep])


def windows(chars: np.ndarray, edges: np.ndarray) -> Iterator[np.ndarray]:
    """Column by column the ORDER characters up to each one after the first; before its row there are only boundaries."""
    first, at = np.repeat(edges[:-1], np.diff(edges)), np.arange(1, chars.size)
    for back in range(ORDER - 1, 0, -1):
        yield np.where(at - back >= first, chars[np.maximum(at - back, 0)], 0)
    yield chars[1:]


def _hash(grams: np.ndarray) -> np.ndarray:
    h = np.zeros(len(grams), U64)
    for column in grams.T:
        h = mix64(h ^ (column.astype(U64) + U64(0x9E3779B97F4A7C15)))
    return h


@dataclass
class Level:
    """Grams of one length: sorted hashes with interpolated log2 probabilities; contexts with log2 back-off weights."""

    gram: np.ndarray
    logp: np.ndarray
    context: np.ndarray
    backoff: np.ndarray


class KneserNey:
    def __init__(self, grams: np.ndarray, counts: np.ndarray, alphabet: int):
        self.floor = -np.log2(alphabet + 2.0)
        self.levels: list[Level] = []
        at = [(grams, counts.astype(float))]
        for _ in range(grams.shape[1] - 1):  # lower orders count the different characters seen before a gram
            shorter, n = np.unique(at[-1][0][:, 1:], axis=0, return_counts=True)
            at.append((shorter, n.astype(float)))
        for g, n in reversed(at):
            once, twice = (n == 1).sum(), (n == 2).sum()
            d = min(max(once / max(once + 2 * twice, 1), 0.1), 0.9)
            context, inverse, kinds = np.unique(g[:, :-1], axis=0, return_inverse=True, return_counts=True)
            inverse = inverse.ravel()
            total = np.bincount(inverse, n, len(context))
            rest = d * kinds / total
            p = np.maximum(n - d, 0) / total[inverse] + rest[inverse] * np.exp2(self.log2(g[:, 1:]))
            gram, ctx = _hash(g), _hash(context)
            o, c = np.argsort(gram), np.argsort(ctx)
            self.levels.append(Level(gram[o], np.log2(p)[o], ctx[c], np.log2(rest)[c]))

    def log2(self, grams: np.ndarray) -> np.ndarray:
        """Log2 probability of the last character of each gram after the others."""
        k = grams.shape[1]
        if k == 0:
            return np.full(len(grams), self.floor)
        level = self.levels[k - 1]
        h = _hash(grams)
        i = np.minimum(np.searchsorted(level.gram, h), len(level.gram) - 1)
        out, lost = level.logp[i], level.gram[i] != h
        if lost.any():
            left = grams[lost]
            h = _hash(left[:, :-1])
            i = np.minimum(np.searchsorted(level.context, h), len(level.context) - 1)
            out[lost] = np.where(level.context[i] == h, level.backoff[i], 0) + self.log2(left[:, 1:])
        return out


@dataclass
class Model:
    languages: list[str]
    alphabet: np.ndarray
    models: list[KneserNey]
    limit: float = np.inf

    def entropies(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Bits per character of each row under each language, and whether the row has a letter."""
        chars, edges = characters(column)
        n = len(edges) - 1
        has = np.diff(np.concatenate([[0], np.cumsum(chars != 0)])[edges]) > 0
        if not self.languages or not n:
            return np.zeros((n, len(self.languages))), has
        ids = np.zeros(0x110000, np.int64)
        ids[1:] = 1
        ids[self.alphabet] = np.arange(2, len(self.alphabet) + 2)
        base = len(self.alphabet) + 2
        code = np.zeros(chars.size - 1, np.int64)
        for column in windows(ids[chars], edges):
            code = code * base + column
        seen, at = np.unique(code, return_inverse=True)
        points = np.concatenate([[0, 1], self.alphabet.astype(np.int64)])
        grams = np.stack([points[(seen // base ** (ORDER - 1 - j)) % base] for j in range(ORDER)], 1)
        out = np.zeros((n, len(self.languages)))
        length = np.maximum(np.diff(edges), 1)
        for k, m in enumerate(self.models):
            bits = m.log2(grams).astype(np.float32)[at]
            out[:, k] = -np.add.reduceat(bits.astype(float), edges[:-1]) / length  # each row begins after its boundary
        return out, has

    def answer(self, column: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
        e, has = self.entropies(column)
        if not self.languages:
            return [UND] * len(has), np.zeros(len(has)), np.ones(len(has), bool), np.zeros(len(has))
        best = e.argmin(1)
        low = e[np.arange(len(e)), best] if len(e) else np.zeros(0)
        score = np.where(has, 1 / np.exp(np.minimum(0, low[:, None] - e) * SHARPNESS).sum(1), 0.0)
        names = [self.languages[b] if h else UND for b, h in zip(best, has, strict=True)]
        return names, score, ~has | (low > self.limit), np.where(has, low, 0.0)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in slices(whole, "text", CHUNK):
            for lang in batch.column("lang").unique():
                own = characters(batch.filter(pa.compute.equal(batch.column("lang"), lang)).column("text"))
                grams, n = np.unique(np.stack([*windows(*own)], 1).astype(np.int32), axis=0, return_counts=True)
                yield pa.RecordBatch.from_pydict({"lang": pa.array([lang.as_py()] * len(n), pa.string()), **{f"c{j}": grams[:, j] for j in range(ORDER)}, "n": n.astype(np.int64)})


def limit(labelled: DataFrame, model: Model) -> float:
    """The rejection limit by a sample that did not train; infinite if it has no letter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text", CHUNK):
                e, has = model.entropies(batch.column("text"))
                own = np.array(batch.column("lang").to_pylist())[:, None] == np.array(model.languages)
                bits = [e.min(1)[has], np.where(own, np.inf, e).min(1)[has]]
                yield pa.RecordBatch.from_arrays([batch.column("lang").filter(pa.array(has)), *map(pa.array, bits)], ["lang", "low", "other"])

    seen = labelled.mapInArrow(run, "lang string, low double, other double").toPandas()
    if not len(seen):
        return np.inf
    high = float(seen["low"].quantile(KEPT))
    if len(model.languages) < 2:
        return 2 * high - float(seen["low"].median())
    other = float(seen.groupby("lang")["other"].quantile(LEFT_OUT).min())
    return max(high, (high + other) / 2)


def train(docs: DataFrame, sample_docs: int = SAMPLE_DOCS) -> Model:
    labelled = lean(docs).where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & F.col("text").isNotNull() & ~held_out())
    sizes = {r["lang"]: r["count"] for r in labelled.groupBy("lang").count().collect()}
    if not sizes:
        return Model([], np.zeros(0, np.int64), [])
    draw = F.pmod(F.xxhash64(F.lit("language sample"), "doc_id"), F.lit(1 << 31))
    parts = {k: int(min(1.0 if n < FEW else TRAINED, sample_docs / n) * (1 << 31)) for k, n in sizes.items()}
    share = F.create_map(*[x for k, part in parts.items() for x in (F.lit(k), F.lit(part).cast("long"))])[F.col("lang")]
    schema = "lang string, " + ", ".join(f"c{j} int" for j in range(ORDER)) + ", n long"
    keys = ["lang", *(f"c{j}" for j in range(ORDER))]
    seen = labelled.where(draw < share).select("lang", "text").mapInArrow(_count, schema).groupBy(*keys).agg(F.sum("n").alias("n")).toPandas()
    alphabet = np.unique(seen[keys[1:]].to_numpy())
    alphabet = alphabet[alphabet > 0].astype(np.int64)
    languages = sorted(seen["lang"].unique())
    models = []
    for lang in languages:
        own = seen[seen["lang"] == lang].sort_values(keys[1:])
        models.append(KneserNey(own[keys[1:]].to_numpy(np.int64), own["n"].to_numpy(), len(alphabet)))
    model = Model(languages, alphabet, models)
    model.limit = limit(labelled.where((draw >= share) & (draw < 2 * share)).select("lang", "text"), model)
    return model


def classify(docs: DataFrame, model: Model) -> DataFrame:
    """Adds lang_pred, score (0 to 1), rejected and bits (per character); the columns of docs stay, save those names."""
    docs = lean(docs).drop("lang_pred", "score", "rejected", "bits")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text", CHUNK):
                names, score, rejected, bits = model.answer(batch.column("text"))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(names, pa.string()), pa.array(score), pa.array(rejected), pa.array(bits)], [*batch.schema.names, "lang_pred", "score", "rejected", "bits"])

    added = (("lang_pred", StringType()), ("score", DoubleType()), ("rejected", BooleanType()), ("bits", DoubleType()))
    fields = StructType([*docs.schema.fields, *(StructField(n, t) for n, t in added)])
    return docs.mapInArrow(run, fields)


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = classify(docs.select("doc_id", "text"), train(docs.select("doc_id", "text", "lang")))
    return out.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "rejected", "bits")


def keep_known(docs: DataFrame) -> DataFrame:
    """The documents that language ID does not reject, with their columns."""
    model = train(docs.select("doc_id", "text", "lang"))

    @F.arrow_udf("boolean")
    def rejected(text: pa.Array) -> pa.Array:
        # only texts go to the workers, and only this comes back
        batch = pa.RecordBatch.from_arrays([text], ["text"])
        return pa.array(np.concatenate([np.zeros(0, bool), *(model.answer(part.column("text"))[2] for part in slices(batch, "text", CHUNK))]))

    return docs.where(~rejected("text"))
