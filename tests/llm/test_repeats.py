import hashlib

import numpy as np
import pytest

from lexifold.llm import repeats

SCHEMA = "doc_id long, text string, lang string, part long, rows string"


def expected(rows):
    """(n_bytes, n_removed, n_spans, kept_sha256) of each row by the definition."""
    least = {}
    for d, t in rows:
        raw, d = (t or "").encode(), float("inf") if d is None else d
        for j in range(len(raw) - 49):
            w = raw[j: j + 50]
            least[w] = min(least.get(w, d), d)
    out = []
    for d, t in rows:
        raw, d = (t or "").encode(), float("inf") if d is None else d
        gone = np.zeros(len(raw) + 2, bool)
        for j in range(len(raw) - 49):
            if least[raw[j: j + 50]] < d:
                gone[j + 1: j + 51] = True
        kept = bytes(np.frombuffer(raw, np.uint8)[~gone[1:-1]])
        out.append((-1 if d == float("inf") else d, len(raw), int(gone.sum()), int((np.diff(gone.astype(int)) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def corpus(seed):
    r = np.random.default_rng(seed)
    words = ["".join(r.choice(list("abcdeé"), r.integers(1, 9))) for _ in range(60)]
    say = lambda n: " ".join(r.choice(words, n))
    shared = [say(30) for _ in range(4)] + ["x" * 90, "ab" * 70, say(4).ljust(49, "z")[:49], say(9).ljust(50, "y")[:50], say(9).ljust(51, "w")[:51]]
    rows = []
    for i in range(70):
        parts = [say(int(r.integers(0, 12))) for _ in range(4)]
        for _ in range(int(r.integers(0, 3))):
            parts.insert(int(r.integers(0, 4)), shared[int(r.integers(len(shared)))])
        rows.append((i, "".join(parts)))
    common = say(9)[:45]
    rows += [(100 + i, say(8) + common + say(8)) for i in range(40)]  # one string in very many contexts
    rows += [(5, rows[7][1]), (5, rows[7][1]), (7, rows[7][1]), (900, rows[3][1]), (901, rows[3][1])]  # repeats, one id twice
    rows += [(None, rows[9][1]), (None, rows[9][1] + say(20)), (None, None), (300, None), (301, ""), (302, "short"), (303, "é" * 200), (304, "é" * 201), (-4, say(60)), (-3, "a" * 3000), (400, "a" * 2000 + say(40))]
    return rows


@pytest.mark.parametrize(("seed", "options"), [(0, {}), (1, {"part": 2000}), (2, {"part": 2000, "hot": 5}), (3, {"part": 500, "hot": 0}), (4, {"hot": 2})])
def test_against_brute_force(spark, seed, options):
    rows = corpus(seed)
    docs = spark.createDataFrame([(d, t, "x", 3, "y") for d, t in rows], SCHEMA)
    got = repeats.remove_repeats(docs, **options).collect()
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == expected(rows)


def test_long_text_in_pieces(spark):
    r = np.random.default_rng(5)
    long = "".join(r.choice(list("abcdefgh "), repeats.CHUNK + 5000))
    rows = [(1, long[repeats.CHUNK - 300: repeats.CHUNK + 400]), (2, long), (3, "b" * 60 + long[-700:])]
    got = {x.doc_id: (x.n_removed, x.n_spans) for x in repeats.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: (0, 0), 2: (700, 1), 3: (700, 1)}


def test_empty_table(spark):
    docs = spark.createDataFrame([], SCHEMA)
    assert repeats.remove_repeats(docs).collect() == []


def test_kept_text(spark):
    a, b = "the first passage of a text that is longer than fifty bytes by far", "another beginning: "
    docs = spark.createDataFrame([(1, a), (2, b + a + "!")], "doc_id long, text string")
    got = {x.doc_id: bytes(x.kept).decode() for x in repeats.remove_repeats(docs, keep_text=True).collect()}
    assert got == {1: a, 2: b + "!"}
