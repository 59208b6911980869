import random
from zlib import crc32

import pyarrow as pa

from lexifold.operators import runs as R
from lexifold.operators.rules import key


class Texts:
    """Stands for a table, to get at what a task runs."""

    def mapInArrow(self, run, schema):
        return run


def rows(texts, users=None):
    return pa.RecordBatch.from_arrays([pa.array(users or [""] * len(texts)), pa.array([f" {i}" for i in range(len(texts))]), pa.array([0] * len(texts), pa.int64()), pa.array(texts)], ["user_id", "doc", "version", "text"])


def test_words_that_keep_coming_are_looked_at_once(monkeypatch):
    asked = []
    plain = R.bare
    monkeypatch.setattr(R, "bare", lambda word: asked.append(word) or plain(word))
    monkeypatch.setattr(R, "WORDS", 8)
    monkeypatch.setattr(R.T, "dealt", lambda docs: Texts())
    texts = [f"often {' '.join('abcdefgj'[(i + j) % 8] * 2 + str(i) for j in range(3))}" for i in range(40)]
    list(R.runs(None, bytes((1 << R.BITS) // 8), 2)(iter([rows(texts)])))
    assert asked.count("often") == 1 and len(set(asked)) == 121


def test_what_words_may_be_is_what_the_sieve_has():
    r = random.Random(9)
    word = lambda: "".join(r.choice("aehkskcshzqwouÉßß1×gpt") for _ in range(r.randrange(1, 9)))
    bits = bytes(r.getrandbits(8) & r.getrandbits(8) & r.getrandbits(8) for _ in range((1 << R.BITS) // 8))

    def may(k):
        at = crc32(f"u\0{k}".encode()) & (1 << R.BITS) - 1
        return bool(bits[at >> 3] >> (at & 7) & 1)

    for w in (word() for _ in range(5000)):
        k, flags = key(w), R.Seen("u", bits, {})[w]
        assert bool(flags & R.FIRST) == (not k or may(k)) and bool(flags & R.EMPTY) == (not k)
        assert bool(flags & R.EDITED) == (len(k) >= R.FUZZY_LENGTH and any(may(R.CUT + c) for c in R.cuts(k)))
        assert bool(flags & R.HEAD) == bool(k and may(R.BEGINS + k)) and bool(flags & R.MELTED) == bool(k and may(R.BEGINS + k[:-2]))
        low = w.casefold()
        assert bool(flags & R.GUARD) == (len(low) > 2 and low not in R.GLUE and may(R.GUARDS + low))
