import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from lexifold.llm import brown
from lexifold.llm.common import utf8, word_hashes

SCHEMA = "doc_id long, text string, score double, held_out string"
WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def words(text):
    raw = (text or "").encode()
    return [bytes(c + 32 if 65 <= c <= 90 else c for c in w) for w in WORD.findall(raw)]


def rows(seed=0):
    r = np.random.default_rng(seed)
    vocabulary = ["".join(r.choice(list("abcdefgÉh"), r.integers(1, 9))) for _ in range(900)]
    p = 1 / np.sqrt(np.arange(1, 901))
    out = [(i, " ".join(r.choice(vocabulary, r.integers(0, 90), p=p / p.sum()))) for i in range(150)]
    return [*out, (3, out[3][1]), (200, None), (200, None), (201, ""), (202, " \t\n"), (None, "no id trains"), (203, "ABC abc Abc"), (204, "x" * 5000), (205, "é☃\x0bé\x1cz"), (206, "word " * 4000)]


def trains(doc_id):
    return doc_id is None or zlib.crc32(str(doc_id).encode()) % 5 != 1


@pytest.fixture
def docs(spark):
    return spark.createDataFrame([(d, t, 9.0, "x") for d, t in rows()], SCHEMA)


def test_against_brute_force(spark, docs):
    got = {}
    for x in brown.score(docs).collect():
        got.setdefault(x.doc_id, []).append(x)
    count, ends = Counter(), 0
    for d, t in rows():
        if trains(d):
            count.update(words(t))
            ends += 1
    total, kinds = sum(count.values()) + ends, len(count) + 1
    base = lambda c: np.log10((c + 0.5) / (total + 0.5 * (kinds + 1)))
    for d, t in rows():
        for x in got[d]:
            w = words(next(t for e, t in rows() if e == d)) if d is not None else words(t)
            assert (x.held_out, x.n_tokens, x.n_known, x.train_tokens) == (not trains(d), len(w) + 1, sum(count[i] > 0 for i in w) + 1, total)
            assert x.base_score == pytest.approx(sum(base(count[i]) for i in w) + base(ends))
            assert x.perplexity == pytest.approx(10 ** (-x.score / x.n_tokens))
    assert sum(map(len, got.values())) == len(rows()) and len(got[200]) == len(got[3]) == 2 and got[3][0].score == got[3][1].score
    # the model by its definition, with the classes that it has found
    cut = brown.cut_words(docs).cache()
    summed = brown.sum_counts(brown.ranged(cut, 3)).cache()
    model = brown.train(cut, summed)
    assigned = brown.assign(brown.contexts(cut, model, 3), model).cache()
    k = len(model.matrix)
    classes = k - brown.BANDS - 1
    joined = {}
    for b in cut.collect():
        own = sorted((r.range, r.classes) for r in assigned.where(f"batch = '{b.batch}'").collect())
        found = np.concatenate([brown.unpack(bytes(c), np.uint8) for _, c in own])
        for h, c in zip(brown.unpack_sorted(bytes(b.body[5])).tolist(), found.tolist(), strict=True):
            joined[h] = c
    every = sorted(count.keys() | {w for _, t in rows() for w in words(t)})
    data, offsets = utf8(pa.array([b" ".join(every).decode()]))
    h, _, length = word_hashes(data, offsets)
    band = np.searchsorted(brown.BAND_EDGES, length)
    of = {}
    for w, x, unit, b in zip(every, h.tolist(), model.of(h, band).tolist(), band.tolist(), strict=True):
        of[w] = int(model.cls[unit]) if joined[x] == brown.STAYS else joined[x]
        assert of[w] < classes or of[w] == classes + b
    assert sum(c < classes for c in of.values()) > brown.HEAD_WORDS  # more than the head words have classes
    of[None], count[None] = k - 1, ends
    pairs, single, held, kinds_of = Counter(), Counter(), Counter(), Counter()
    for d, t in rows():
        if trains(d):
            chain = [k - 1, *(of[w] for w in words(t)), k - 1]
            pairs.update(zip(chain[:-1], chain[1:], strict=True))
            single.update(chain[1:])
    for w, n in count.items():
        if n and w is not None:
            held[of[w]] += n
            kinds_of[of[w]] += 1

    def score(text):
        value, before = 0.0, k - 1
        for w in [*words(text), None]:
            c = of[w]
            alone = (single[c] + 0.5) / (sum(single.values()) + 0.5 * k)
            after = sum(n for (a, _), n in pairs.items() if a == before)
            value += np.log10(brown.KEEP * pairs[before, c] / after + (1 - brown.KEEP) * alone if after else alone)
            if c < classes:
                value += np.log10(count[w] / held[c])
            elif c < k - 1:
                value += np.log10((count[w] + 0.5) / (held[c] + 0.5 * (kinds_of[c] + 1)))
            before = c
        return value

    for d, t in rows()[::7]:
        if d is not None:
            assert got[d][0].score == pytest.approx(score(t), rel=1e-9)


def test_exchange_raises_the_likelihood():
    r = np.random.default_rng(1)
    heads, kinds = 40, 4
    own = r.integers(0, kinds, heads)  # words of one kind follow words of the kind before
    pairs = np.zeros((heads + 1, heads + 1), np.int64)
    for _ in range(20_000):
        a, b = r.integers(0, heads, 2)
        if own[b] == (own[a] + 1) % kinds:
            pairs[a, b] += 1
    found = brown.exchange(pairs, heads, kinds, 10)[:heads]
    best = sum(max(Counter(own[found == c]).values()) for c in set(found.tolist()))
    assert best >= 0.9 * heads

    def likelihood(cls):
        m = np.zeros((cls.max() + 1,) * 2)
        np.add.at(m, (cls[:, None].repeat(heads + 1, 1), cls[None].repeat(heads + 1, 0)), pairs)
        f = lambda x: (x * np.log(np.maximum(x, 1))).sum()
        return f(m) - f(m.sum(0)) - f(m.sum(1))

    assert likelihood(brown.exchange(pairs, heads, kinds, 10)) >= likelihood(np.append(np.arange(heads) % kinds, kinds))


def test_words_that_cancel():
    """Words of 1024 letters by the sequence whose differences cancel in any sum of powers."""
    bits = [bin(i).count("1") % 2 for i in range(1024)]
    a, b = ("".join("ab"[x ^ f] for x in bits) for f in (0, 1))
    data, offsets = utf8(pa.array([f"{a} {b}"]))
    assert len(set(word_hashes(data, offsets)[0].tolist())) == 2


def test_rare_words_join_classes_by_context(spark):
    r = np.random.default_rng(5)
    lines = []
    for _ in range(4000):  # two kinds of rare words of one length, which only their neighbours tell apart
        a, b = (f"{c}{r.integers(0, 500):04d}" for c in "xy")
        lines.append(f"alpha {a} beta gamma {b} delta " + f"h{r.integers(0, 600)} " * 4)
    docs = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    scored = brown.score(docs).toPandas().set_index("doc_id").sort_index()
    swapped = [t.replace("x", "?").replace("y", "x").replace("?", "y") for t in lines[:300]]
    extra = spark.createDataFrame([(i, t) for i, t in enumerate(swapped, 100000)], docs.schema).where(brown.held_out())
    both = brown.score(docs.union(extra)).toPandas().set_index("doc_id")
    other = both[both.index >= 100000]
    assert (scored.score.loc[other.index - 100000].to_numpy() - other.score.to_numpy()).mean() > 0.5


def test_empty_tables(spark):
    assert brown.score(spark.createDataFrame([], SCHEMA)).collect() == []
    held = [i for i in range(40) if not trains(i)]
    got = brown.score(spark.createDataFrame([(i, "a b", 1.0, "") for i in held], SCHEMA)).collect()
    assert all((x.n_known, x.train_tokens, x.n_tokens) == (0, 0, 3) and np.isfinite(x.score) for x in got) and len(got) == len(held)
