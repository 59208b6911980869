import numpy as np
import pytest

from lexifold.llm import neardup

SCHEMA = "doc_id long, text string, node long, _row int"
SPACES = " \t\n\v\f\r"


def shingles(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for c in SPACES:
        low = low.replace(c, " ")
    w = [x for x in low.split(" ") if x]
    out = {}
    for i in range(max(len(w) - 4, 1 if w else 0)):
        g = tuple(w[i: i + 5])
        out[g] = out.get(g, 0) + 1
    return {g: 1 + np.log(n) for g, n in out.items()}


def similarity(x, y):
    """By the definition, all pairs of shingles."""
    total = 0.0
    for d in x.keys() & y.keys():
        total += 1 / sum(max(x.get(e, 0) / x[d], y.get(e, 0) / y[d]) for e in x.keys() | y.keys())
    return total


def expected(rows):
    """doc_id -> class by brute force."""
    ids = sorted({d for d, _ in rows if d is not None})
    label = {d: d for d in ids}

    def join(a, b):
        lo, hi = sorted((label[a], label[b]))
        for d, x in label.items():
            if x == hi:
                label[d] = lo

    sets = [(d, t, shingles(t)) for d, t in rows if d is not None]
    for i, (d, t, x) in enumerate(sets):
        for e, u, y in sets[:i]:
            if (t is not None and t == u) or (x and y and min(len(x), len(y)) * 3 > max(len(x), len(y)) and similarity(x, y) >= 0.8):
                join(d, e)
    return label


def corpus(seed):
    r = np.random.default_rng(seed)
    rows = []
    for g in range(12):
        words = [f"g{g}w{i}" for i in r.permutation(90)]
        for k in range(5):
            own = list(words)
            for at in r.integers(0, 90, int(r.integers(0, 5))):
                own[at] = f"x{len(rows)}y{at}"
            rows.append((len(rows) * 3 % 97 + 100 * g, " ".join(own)))
        line = " ".join(words[:12])  # repeated lines, and the same text with more of them
        for n in (1, 2, 30, 40):
            rows.append((5000 + 10 * g + n, "\n".join([line] * n + [" ".join(words[40:])])))
    rows += [(9000, rows[0][1]), (9001, rows[0][1]), (9002, rows[0][1].upper()), (9003, ""), (9004, ""), (9005, None), (9006, None), (9007, " \t "), (9008, "two words"), (9009, "two  words"), (9010, "one two three four five"), (9011, "one two three four five six")]
    rows += [(9012, rows[4][1]), (9012, rows[40][1]), (9013, "alone with its words here"), (9013, "alone with its words here"), (None, rows[0][1]), (None, None)]
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(d, t, 7, 8) for d, t in rows], SCHEMA)


def test_against_brute_force(spark):
    rows = corpus(1)
    got = neardup.classes(frame(spark, rows)).collect()
    assert sum(r.doc_id is None for r in got) == 2
    found = {r.doc_id: r.class_id for r in got if r.doc_id is not None}
    assert len(got) == len(found) + 2 and found == expected(rows)


def test_similarity():
    r = np.random.default_rng(2)
    for _ in range(50):
        x, y = ({int(i): float(1 + np.log(r.integers(1, 30))) for i in r.choice(30, r.integers(1, 25), False)} for _ in range(2))
        pack = lambda z: (np.array(sorted(z), np.uint64), np.array([z[i] for i in sorted(z)]))
        assert neardup.similarity(*pack(x), *pack(y)) == pytest.approx(similarity(x, y))
    x = dict.fromkeys(range(8), 1.0)
    assert similarity(x, dict.fromkeys(range(10), 1.0)) == pytest.approx(0.8)


def test_bound_leaves_out_no_similar_pair():
    r = np.random.default_rng(3)
    sets, weights = [], []
    for n in (6, 20, 200, 250, 260, 1000, 5000):
        base = r.integers(0, 1 << 62, n).astype(np.uint64)
        for d, heavy in ((0, 0), (n // 9, 0), (n // 8, 0), (n // 5, 0), (0, n // 3), (n // 12, n // 4), (n // 9, n)):
            s = np.concatenate([base[d:], r.integers(0, 1 << 62, d).astype(np.uint64)])
            w = np.ones(n)
            w[:heavy] = 1 + np.log(300)
            sets.append(s)
            weights.append(w)
        sets.append(np.concatenate([base, r.integers(0, 1 << 62, 4 * n).astype(np.uint64)]))  # much larger, of little more weight
        weights.append(np.concatenate([np.full(n, 40.0), np.ones(4 * n)]))
        sets.append(base)
        weights.append(np.full(n, 40.0))
    size = np.array([s.size for s in sets])
    total = np.array([np.nan if (w == 1).all() else w.sum() for w in weights])
    cells = [neardup.bitmap(s).tobytes() for s in sets]
    found = {frozenset(p) for p in zip(*(x.tolist() for x in neardup.possible(size, total, cells, np.arange(len(sets)))), strict=True)}
    similar = {frozenset((i, j)) for i in range(len(sets)) for j in range(i) if neardup.similarity(sets[i], weights[i], sets[j], weights[j]) >= 0.8}
    assert len(similar) >= 20 and similar <= found and len(found) < len(sets) * (len(sets) - 1) / 4


def test_blocks_of_a_bucket_meet(spark):
    r = np.random.default_rng(4)
    words = [f"w{i}" for i in range(200)]
    texts = []
    for _ in range(30):
        own = list(words)
        for at in r.integers(0, 200, 2):
            own[at] = f"n{r.integers(1 << 30)}"
        texts.append(" ".join(own))
    docs = spark.createDataFrame(list(enumerate(texts)), "node long, text string")
    known = neardup.sets(docs)
    sketches = neardup.banded(docs.selectExpr("node AS doc_id", "unhex('00') AS digest", "text")).selectExpr("doc_id AS node", "bands")
    signs = neardup.bitmaps(known).join(sketches, "node").cache()
    named = sketches.selectExpr("bands[0] AS key", "0 AS band", "node", "node AS label")
    whole, dealt = ({tuple(p) for p in neardup.unsettled(named, signs, block).collect()} for block in (4096, 7))
    assert whole == dealt and whole


def test_one_stays(spark):
    rows = corpus(5)
    docs = frame(spark, rows)
    kept = neardup.keep_one(docs)
    assert kept.columns == docs.columns
    want = expected(rows)
    ids = [r.doc_id for r in kept.collect()]
    assert sorted(i for i in ids if i is not None) == sorted(set(want.values())) and ids.count(None) == 2


def test_empty_table(spark):
    docs = spark.createDataFrame([], SCHEMA)
    assert neardup.classes(docs).collect() == [] and neardup.keep_one(docs).collect() == []
