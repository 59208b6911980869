"""Where two tokenizers cut one text alike, and how often their tokens end together over a corpus.

A is a byte-level BPE, B a SentencePiece model; both read a space and the text, whose bytes the tokens of each are joined
back into. A batch of texts is laid end to end, with the byte offset of each document. The places where tokens of A end are
counted once, those of B once, and where both have one the text is cut: a group of tokens on either side. What belongs to
a document follows from prefix sums at its offsets: the number of a token that ends at a place, groups up to a place.

A link is a pair of tokens that end together, so each group has one. Pairs of ids are counted over the whole table: a
block of documents keeps its links by the number of the pair among those that the block has, Spark adds up the blocks'
counts, finds the highest count of each B id, and joins both back to the pairs of each block (a block has a pair once,
so no pair is a hot key); then the documents of a block are summed against these.

Texts that are null or empty, or that one of the two doesn't give back byte by byte (as B writes a literal U+2581 as a
space), have no tokens: zeros, and an empty digest. Repeated rows each count. A very long text is a block by itself. An
empty table gives no rows. Columns other than doc_id and text are left out, whatever their names.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
import sentencepiece
import tiktoken
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import lean, slices, table, trim, written

#: Bytes of text that are aligned at once, and that share one list of pairs.
CHUNK, BLOCK = 2 << 20, 24 << 20
SHAPE = "n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def _path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class ByteBpe:
    """A byte-level BPE from a tokenizer's JSON file, whose ids have to be in the order of its merges."""

    def __init__(self, path: str):
        import public_tokenizers

        with open(path, encoding="utf8") as f:
            spec = json.load(f)
        special = {t["content"] for t in spec["added_tokens"]}
        # printable bytes stand for themselves in the file, all others for characters from 256 on
        own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        rest = [b for b in range(256) if b not in set(own)]
        byte = {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}
        vocabulary = {bytes(byte[c] for c in entry): i for entry, i in spec["model"]["vocab"].items() if entry not in special}
        merges = ["".join(m if isinstance(m, list) else m.split(" ")) for m in spec["model"]["merges"]]
        if [spec["model"]["vocab"][m] for m in merges] != sorted(vocabulary.values())[len(vocabulary) - len(merges):]:
            raise ValueError("ids are not in the order of merges")
        self.bytes_of = [b""] * (1 + max(vocabulary.values()))
        for entry, i in vocabulary.items():
            self.bytes_of[i] = entry
        self.core = tiktoken.Encoding("byte-level", pat_str=public_tokenizers.PATTERN, mergeable_ranks=vocabulary, special_tokens={})

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        return [self.core.encode_to_numpy(" " + t, disallowed_special=()).astype(np.int32) for t in texts]


class Pieces:
    def __init__(self, path: str):
        self.core = sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.bytes_of = [bytes([int(sp.id_to_piece(i)[3:5], 16)]) if sp.is_byte(i) else sp.id_to_piece(i).replace("▁", " ").encode() for i in range(len(sp))]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(x, np.int32) for x in self.core.encode(texts, num_threads=1)]


@dataclass
class Aligned:
    """Of the texts of a batch, end to end: tokens, tokens of each text, groups of each text, tokens of each group, and
    the pair of ids (A in the upper half) that each group ends with."""

    a: np.ndarray
    b: np.ndarray
    n_a: np.ndarray
    n_b: np.ndarray
    n_groups: np.ndarray
    in_a: np.ndarray
    in_b: np.ndarray
    links: np.ndarray


class Aligner:
    def __init__(self, a_path: str, b_path: str):
        self.a, self.b = ByteBpe(a_path), Pieces(b_path)
        self.size = [np.array([*map(len, x.bytes_of)], np.int64) for x in (self.a, self.b)]
        # ids in decimal with what follows them: within A, after A, within B, after B
        width = max(len(str(len(x.bytes_of))) for x in (self.a, self.b)) + 1
        rows = [f"{i}{mark}".encode() for x, marks in ((self.a, ",|"), (self.b, ",;")) for mark in marks for i in range(len(x.bytes_of))]
        self.digits = np.array([list(r.ljust(width)) for r in rows], np.uint8)
        self.n_digits = np.array([*map(len, rows)], np.uint8)
        self.kinds = np.cumsum([0, *[len(self.a.bytes_of)] * 2, *[len(self.b.bytes_of)] * 2])

    def tokens(self, texts: list[str | None]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Ids of each text; none where the bytes of either side aren't those of the text."""
        none = np.zeros(0, np.int32)
        a, b = [none] * len(texts), [none] * len(texts)
        asked = [i for i, t in enumerate(texts) if t]
        some = [texts[i] for i in asked]
        for i, t, x, y in zip(asked, some, self.a.encode(some), self.b.encode(some), strict=True):
            want = b" " + t.encode()
            if b"".join(map(self.b.bytes_of.__getitem__, y.tolist())) == want == b"".join(map(self.a.bytes_of.__getitem__, x.tolist())):
                a[i], b[i] = x, y
        return a, b

    def align(self, texts: list[str | None]) -> Aligned:
        each_a, each_b = self.tokens(texts)
        a, b = (np.concatenate([np.zeros(0, np.int32), *x]) for x in (each_a, each_b))
        first_a, first_b = (np.cumsum([0, *map(len, x)]) for x in (each_a, each_b))
        ends_a, ends_b = np.cumsum(self.size[0][a]), np.cumsum(self.size[1][b])
        total = int(ends_a[-1]) if a.size else 0
        at_a, at_b = np.bincount(ends_a, minlength=total + 1) > 0, np.bincount(ends_b, minlength=total + 1) > 0
        both = at_a & at_b
        cut = np.flatnonzero(both)
        up_to_a, up_to_b = np.cumsum(at_a), np.cumsum(at_b)
        last_a, last_b = up_to_a[cut] - 1, up_to_b[cut] - 1
        # a document ends where its last token does, and has the groups up to there less those before it
        offset = np.concatenate([[0], ends_a])[first_a] if a.size else np.zeros(len(first_a), np.int64)
        n_groups = np.diff(np.cumsum(both)[offset])
        return Aligned(a, b, np.diff(first_a), np.diff(first_b), n_groups, np.diff(last_a, prepend=-1), np.diff(last_b, prepend=-1), a[last_a].astype(np.int64) << 32 | b[last_b])

    def digests(self, x: Aligned) -> list[str]:
        """Of each text, of its groups as they are written out; an empty string for one without tokens."""
        until_a, until_b = np.cumsum(x.in_a), np.cumsum(x.in_b)
        code_a, code_b = x.a.astype(np.int64), x.b + self.kinds[2]
        code_a[until_a - 1] += self.kinds[1]
        code_b[until_b - 1] += self.kinds[3] - self.kinds[2]
        code = np.empty(x.a.size + x.b.size, np.int64)
        code[np.arange(x.a.size) + np.repeat(until_b - x.in_b, x.in_a)] = code_a
        code[np.arange(x.b.size) + np.repeat(until_a, x.in_b)] = code_b
        n = self.n_digits[code]
        flat = self.digits[code][np.arange(self.digits.shape[1]) < n[:, None]].tobytes()
        ends = np.concatenate([[0], np.cumsum(n, dtype=np.int64)])[np.cumsum([0, *(x.n_a + x.n_b)])].tolist()
        return [hashlib.sha256(memoryview(flat)[lo: hi - 1]).hexdigest() if hi > lo else "" for lo, hi in zip(ends, ends[1:], strict=False)]


@cache
def aligner(a_path: str, b_path: str) -> Aligner:
    return Aligner(a_path, b_path)


def _paths(a_path: str | None, b_path: str | None) -> tuple[str, str]:
    return a_path or _path("byte_bpe_50k.json"), b_path or _path("piece_bpe_32k.model")


def groups(docs: DataFrame, a_path: str | None = None, b_path: str | None = None) -> DataFrame:
    """doc_id, a_ids, b_ids, and how many of each are in each group: a_sizes, b_sizes."""
    paths = _paths(a_path, b_path)

    def lists(flat: np.ndarray, sizes: np.ndarray) -> pa.ListArray:
        return pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32), flat.astype(np.int32))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = aligner(*paths)
        for whole in batches:
            for batch in slices(whole, "text", CHUNK):
                x = tool.align(batch.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), lists(x.a, x.n_a), lists(x.b, x.n_b), lists(x.in_a, x.n_groups), lists(x.in_b, x.n_groups)], ["doc_id", "a_ids", "b_ids", "a_sizes", "b_sizes"])

    kind = dict(docs.dtypes)["doc_id"]
    return lean(docs.select("doc_id", "text")).mapInArrow(run, f"doc_id {kind}, a_ids array<int>, b_ids array<int>, a_sizes array<int>, b_sizes array<int>")


def _packed(rows: pa.Table) -> bytes:
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, rows.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
        writer.write_table(rows)
    return out.getvalue().to_pybytes()


def blocks(docs: DataFrame, a_path: str | None = None, b_path: str | None = None) -> DataFrame:
    """One row for each block of documents: block, docs (what is known of each document, and its links as steps from pair
    to pair of the block and how often it has each), and the block's pairs in order: a, b, and n times in the block."""
    paths = _paths(a_path, b_path)

    def block(parts: list[tuple[pa.Array, Aligned, list[str]]]) -> pa.RecordBatch:
        n_groups = np.concatenate([x.n_groups for _, x, _ in parts])
        pairs, number, n = np.unique(np.concatenate([x.links for _, x, _ in parts]), return_inverse=True, return_counts=True)
        doc = np.repeat(np.arange(n_groups.size), n_groups)
        own, times = np.unique(doc * max(pairs.size, 1) + number, return_counts=True)
        doc, number = np.divmod(own, max(pairs.size, 1))
        first = np.searchsorted(doc, np.arange(n_groups.size + 1)).astype(np.int32)
        step = np.diff(number, prepend=0)
        step[first[:-1][np.diff(first) > 0]] = number[first[:-1][np.diff(first) > 0]]
        rows = pa.table({
            "doc_id": pa.concat_arrays([ids for ids, _, _ in parts]), "n_a": np.concatenate([x.n_a for _, x, _ in parts]), "n_b": np.concatenate([x.n_b for _, x, _ in parts]), "n_groups": n_groups,
            "groups_sha256": [d for _, _, digests in parts for d in digests], "step": pa.ListArray.from_arrays(first, step.astype(np.int32)), "times": pa.ListArray.from_arrays(first, times.astype(np.int32))})
        lone = lambda x: pa.ListArray.from_arrays(np.array([0, x.size], np.int32), x)
        return pa.RecordBatch.from_arrays([pa.array([uuid.uuid4().hex]), pa.array([_packed(rows)], pa.binary()), lone((pairs >> 32).astype(np.int32)), lone((pairs & 0xFFFFFFFF).astype(np.int32)), lone(n)], ["block", "docs", "a", "b", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool, parts, size = aligner(*paths), [], 0
        for whole in batches:
            for batch in slices(whole, "text", CHUNK):
                x = tool.align(batch.column("text").to_pylist())
                parts.append((batch.column("doc_id"), x, tool.digests(x)))
                x.a = x.b = x.in_a = x.in_b = np.zeros(0, np.int32)  # only counts and links are wanted from here
                size += batch.column("text").nbytes
                if size >= BLOCK:
                    yield block(parts)
                    parts, size = [], 0
                    trim()
        if parts:
            yield block(parts)

    return lean(docs.select("doc_id", "text")).mapInArrow(run, "block string, docs binary, a array<int>, b array<int>, n array<long>")


def pairs(of: DataFrame) -> DataFrame:
    """block, at, a, b, n: the pairs of blocks, by their places."""
    return of.select("block", F.posexplode(F.arrays_zip("a", "b", "n")).alias("at", "p")).select("block", "at", "p.a", "p.b", "p.n")


def link_counts(of: DataFrame) -> DataFrame:
    """a, b, count over the whole table, and whether no other a has more with this b."""
    counts = pairs(of).groupBy("a", "b").agg(F.sum("n").alias("count"))
    return counts.select("a", "b", "count", (F.col("count") == F.max("count").over(Window.partitionBy("b"))).alias("best"))


def aligned(docs: DataFrame, a_path: str | None = None, b_path: str | None = None) -> DataFrame:
    """doc_id with SHAPE: tokens, groups and links of each document; links whose pair has the highest count of its B id;
    the sum of the counts of all links; and a digest of the groups."""
    kind = dict(docs.dtypes)["doc_id"]
    of = written(blocks(docs, a_path, b_path))
    told = pairs(of).drop("n").join(link_counts(of), ["a", "b"]).select(F.col("block").alias("of_block"), "at", "count", "best")

    def summed(left: pa.Table, right: pa.Table) -> pa.Table:
        order = np.argsort(right["at"].to_numpy())
        count, best = right["count"].to_numpy()[order], right["best"].to_numpy()[order]
        out = []
        for body in left["docs"]:
            rows = pa.ipc.open_stream(body.as_buffer()).read_all().combine_chunks()
            first = rows["step"].chunk(0).offsets.to_numpy() if rows.num_rows else np.zeros(1, np.int32)
            step = rows["step"].chunk(0).flatten().to_numpy().astype(np.int64)
            times = rows["times"].chunk(0).flatten().to_numpy().astype(np.int64)
            # steps run on from document to document once what came before is taken off
            number = np.cumsum(step)
            before = np.concatenate([[0], number])[first[:-1]]
            number -= np.repeat(before, np.diff(first))
            sums = [np.diff(np.concatenate([[0], np.cumsum(x)])[first]) for x in (times, times * best[number], times * count[number])]
            out.append(pa.table([rows["doc_id"], rows["n_a"], rows["n_b"], rows["n_groups"], *map(pa.array, sums), rows["groups_sha256"]], ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]))
        return pa.concat_tables(out) if out else pa.table({})

    return of.select("block", "docs").groupBy("block").cogroup(told.groupBy("of_block")).applyInArrow(summed, f"doc_id {kind}, {SHAPE}")


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aligned(table(spark, sf_dir, "documents"))
