"""SentencePiece encoding and decoding: an Aho-Corasick automaton over the pieces drives one Viterbi pass.

The automaton reports at each position, by its output links, every piece that ends there; each one relaxes the best
score of that position. Scores are those of the model file; a character that is no piece costs more than any piece and
is written as byte pieces. Ties go to the longer piece. The result is the path of the best sum of scores. The default
model file was made for merging pairs, whose scores are ranks: the library, which merges, gives other ids for it, and the
same for model files of the unigram kind.

Some pieces are runs of space marks, but none holds a mark after another character (checked when the model is read). So
no piece crosses from a character to a space after it, and the pass over a text may end there and begin anew without
changing the path: texts go through in such units (a run of spaces with the word after it), and what a unit gave is kept
in a bounded cache. A literal space mark (U+2581) is written as bytes; so decoding gives each text back exactly.

A null text has no pieces, null ids, and is decoded as null, an empty one as the piece of the leading space mark. Repeated
rows give repeated results. A very long text is encoded in a row's memory, its units one by one. An empty table gives no
rows. Columns other than doc_id and text are left out, whatever their names.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import cache

import ahocorasick
import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, SparkSession

from .common import lean, table

MARK, STAND_IN = "▁", "\U0010ffff"
#: A run of spaces with the word after it, or the spaces that end a text.
UNIT = re.compile(" +[^ ]*")
CACHED = 500_000


def model_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Codec:
    def __init__(self, path: str):
        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.automaton = ahocorasick.Automaton()
        self.bytes_of: list[bytes] = []
        self.byte_id = [0] * 256
        low = 0.0
        for i in range(len(sp)):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.byte_id[int(piece[3:5], 16)] = i
                self.bytes_of.append(bytes([int(piece[3:5], 16)]))
            elif sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i):
                self.bytes_of.append(b"")
            else:
                if MARK in piece.lstrip(MARK):
                    raise ValueError(f"a space mark after another character: {piece}")
                self.automaton.add_word(piece, (len(piece), sp.get_score(i), i))
                self.bytes_of.append(piece.replace(MARK, " ").encode())
                low = min(low, sp.get_score(i)) if sp.get_score(i) > -1e8 else low
        self.automaton.make_automaton()
        self.unknown = low - 10.0
        self.units: dict[str, bytes] = {}

    def best(self, text: str, plain: str) -> list[int]:
        """Ids of the best path through `text`; `plain` gives the characters that are written as bytes."""
        n = len(text)
        score, size, piece = [0.0] * (n + 1), [0] * (n + 1), [-1] * (n + 1)
        done = 0

        def close(i: int) -> None:  # all pieces that end at i are known
            nonlocal done
            while done < i:
                done += 1
                if not size[done] or (score[done - 1] + self.unknown > score[done] and not single[done]):
                    score[done], size[done], piece[done] = score[done - 1] + self.unknown, 1, -1

        single = bytearray(n + 1)
        for end, (length, value, i) in self.automaton.iter(text):
            end += 1
            close(end - 1)
            total = score[end - length] + value
            if length == 1:
                single[end] = 1
            if not size[end] or total > score[end] or (total == score[end] and length > size[end]):
                score[end], size[end], piece[end] = total, length, i
        close(n)
        out: list[int] = []
        while n:
            if piece[n] < 0:
                out.extend(self.byte_id[b] for b in reversed(plain[n - 1].encode()))
            else:
                out.append(piece[n])
            n -= size[n]
        return out[::-1]

    def unit(self, unit: str) -> bytes:
        plain = unit.replace(" ", MARK)
        ids = np.array(self.best(unit.replace(MARK, STAND_IN).replace(" ", MARK), plain), np.int32).tobytes()
        if len(self.units) < CACHED and len(unit) < 64:
            self.units[unit] = ids
        return ids

    def encode(self, text: str) -> np.ndarray:
        known = self.units.get
        return np.frombuffer(b"".join([known(u) or self.unit(u) for u in UNIT.findall(" " + text)]), np.int32)

    def decode(self, ids: np.ndarray) -> str:
        return b"".join(map(self.bytes_of.__getitem__, ids.tolist()))[1:].decode("utf8")


@cache
def codec(path: str) -> Codec:
    return Codec(path)


def encode(docs: DataFrame, path: str | None = None, ids: bool = True) -> DataFrame:
    """doc_id, n_pieces, ids_sha256 (of 32-bit little-endian ids), text_sha256 (of the decoded text), exact and, where
    wanted, the ids. The result's columns are these alone."""
    path = path or model_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for batch in batches:
            for part in (batch.slice(i, 500) for i in range(0, batch.num_rows, 500)):
                rows = []
                for text in part.column("text"):
                    text = text.as_py()
                    code = np.zeros(0, np.int32) if text is None else c.encode(text)
                    back = None if text is None else c.decode(code)
                    rows.append((len(code), hashlib.sha256(code.tobytes()).hexdigest(), back if back is None else hashlib.sha256(back.encode()).hexdigest(), back == text, code))
                n, a, b, same, codes = zip(*rows, strict=True)
                out = [part.column("doc_id"), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string()), pa.array(same, pa.bool_())]
                if ids:
                    flat = np.concatenate(codes)
                    out.append(pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(n)]).astype(np.int32), flat, mask=pa.array([x is None for x in b])))
                yield pa.RecordBatch.from_arrays(out, names)

    names = ["doc_id", "n_pieces", "ids_sha256", "text_sha256", "exact", *["ids"] * ids]
    kind = dict(docs.dtypes)["doc_id"]
    return lean(docs).select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_pieces long, ids_sha256 string, text_sha256 string, exact boolean" + ", ids array<int>" * ids)


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id and the text that the ids stand for; null ids give a null text."""
    path = path or model_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for batch in batches:
            text = [None if x.as_py() is None else c.decode(np.array(x.as_py(), np.int32)) for x in batch.column("ids")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(text, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, f"doc_id {dict(encoded.dtypes)['doc_id']}, text string")


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(table(spark, sf_dir, "documents"), ids=False)
