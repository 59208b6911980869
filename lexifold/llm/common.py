"""Shared pieces of the training-data operators: reading, checkpoints and vectorised UTF-8 handling."""

from __future__ import annotations

import ctypes
import sys
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

U64 = np.uint64
#: Bytes that end a word: space, tab, newline, vertical tab, form feed, carriage return.
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A"): ord("Z") + 1] += 32


#: Bytes of rows that go to a Python worker at once, and what Spark sends unless told otherwise.
BATCH, SPARKS_BATCH = 8 << 20, 64 << 20
_BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"


def lean(df: DataFrame) -> DataFrame:
    """The same table, read by Python workers in batches of BATCH bytes; a session that has set another size keeps it.

    The JVM and the worker each hold a batch and its answer, of whole texts, beside the heap of an executor.
    """
    conf = df.sparkSession.conf
    if conf.get(_BATCH_SETTING, None) == f"{SPARKS_BATCH}b":
        conf.set(_BATCH_SETTING, str(BATCH))
    return df


def trim() -> None:
    """Gives free memory of this process back."""
    pa.default_memory_pool().release_unused()
    if _LIBC is not None:
        _LIBC.malloc_trim(0)


try:
    _LIBC = ctypes.CDLL("libc.so.6") if sys.platform == "linux" else None
except OSError:  # another C library
    _LIBC = None


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir. Where that is unset, a local master gets one of its own; a cluster has to name it."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not sc.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors see")
        sc.setCheckpointDir(folder or tempfile.mkdtemp())
    return sc.getCheckpointDir()


def written(df: DataFrame) -> DataFrame:
    """The rows of a table as written to the shared folder."""
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def removed(spark: SparkSession, folder: str) -> None:
    """Removes a folder of the shared one, where it is."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage in the shared folder.

    What led here isn't needed any more: Spark removes the shuffle files of plans that the driver's JVM has collected, so
    it is asked to collect them now, not when its heap is full.
    """
    shared_folder(df.sparkSession)
    kept = df.checkpoint(eager=True)
    df.sparkSession._jvm.System.gc()
    return kept


def shares(df: DataFrame, column: str, *share: int) -> list[int]:
    """How many parts of about so many bytes the text column of a table makes (1 at least), for each size."""
    total = df.agg(F.sum(F.octet_length(column))).first()[0] or 0
    return [int(total // s) + 1 for s in share]


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column end to end, and the offset of each row in them; a null is empty."""
    if column.null_count:
        column = pc.fill_null(column, "" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if len(column) == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset: column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0]: at[-1]], at - at[0]


def slices(batch: pa.RecordBatch, column: str, limit: int) -> Iterator[pa.RecordBatch]:
    """Runs of rows with about `limit` bytes of the column each; a longer row comes alone."""
    _, offsets = utf8(batch.column(batch.schema.get_field_index(column)))
    lo = 0
    while lo < batch.num_rows:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1)
        yield batch.slice(lo, hi - lo)
        lo = hi
    trim()


def mix64(x: np.ndarray) -> np.ndarray:
    """A finaliser that spreads 64-bit values over all bits."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


_BYTE = mix64(np.arange(1, 257, dtype=U64) * U64(0x9E3779B97F4A7C15))
_PLACE = U64(0xD1342543DE82EF95)


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each word (a run of bytes outside SPACE, A-Z lowered): a 64-bit hash, its row, its length in bytes.

    A hash is a sum of terms, each of a byte and its place mixed, so it has no algebra by which words could cancel.
    """
    n = data.size
    inside = ~SPACE[data]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    before = np.zeros(n, bool)
    before[1:] = inside[:-1]
    start = np.flatnonzero(inside & (~before | edge[:-1]))
    after = np.zeros(n, bool)
    after[:-1] = inside[1:]
    length = np.flatnonzero(inside & (~after | edge[1:])) + 1 - start
    if not start.size:
        return np.zeros(0, U64), np.zeros(0, np.int64), length
    at = np.flatnonzero(inside).astype(np.int32)  # rows of a batch are far shorter than 2 GB
    value = _BYTE[LOWER[data[at]]]
    at -= np.repeat(start.astype(np.int32), length)
    value += at.astype(U64) * _PLACE
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB), (31, 1)):  # mix64 in place
        value ^= value >> U64(shift)
        value *= U64(factor)
    first = np.cumsum(length) - length
    return mix64(np.add.reduceat(value, first)), np.searchsorted(offsets, start, "right") - 1, length


def pack(x: np.ndarray, level: int = 1) -> bytes:
    return zstandard.compress(np.ascontiguousarray(x).tobytes(), level)


def unpack(b: bytes, kind: type) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(b), kind)


def pack_sorted(h: np.ndarray, bits: int = 64) -> bytes:
    """The first bits of sorted 64-bit numbers: steps between them, byte by byte."""
    step = np.diff(h >> U64(64 - bits), prepend=U64(0))
    return pack(step.view(np.uint8).reshape(-1, 8).T, 3)


def unpack_sorted(b: bytes) -> np.ndarray:
    return np.cumsum(np.ascontiguousarray(unpack(b, np.uint8).reshape(8, -1).T).view(U64).ravel(), dtype=U64)


def cuts(h: np.ndarray, ranges: int) -> np.ndarray:
    """Where each range of 64-bit numbers begins among sorted ones."""
    edges = np.arange(1, ranges, dtype=U64) * U64((1 << 64) // ranges if ranges > 1 else 0)
    return np.concatenate([[0], np.searchsorted(h, edges), [h.size]])
