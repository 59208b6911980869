import numpy as np
import pytest

from lexifold.llm import rabitq

SCHEMA = "vec_id long, embedding array<double>, query long, cell string"


def exact(ids, x, k=5):
    """query -> [(vec_id, score)] by brute force."""
    u = x / np.sqrt((x * x).sum(1, keepdims=True))
    out = {}
    for q in np.flatnonzero(ids % 50 == 0):
        s = np.round(u @ u[q], 12)
        s[ids == ids[q]] = -9
        best = np.lexsort((ids, -s))[:k]
        out[int(ids[q])] = [(int(ids[i]), float(s[i])) for i in best if s[i] > -9]
    return out


def measured(spark, x):
    ids = np.arange(len(x)) * 5
    docs = spark.createDataFrame([(int(i), v.tolist(), 1, "c") for i, v in zip(ids, x, strict=True)], SCHEMA)
    got = {}
    for r in sorted(rabitq.nearest(docs).collect(), key=lambda r: r["rank"]):
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    want = exact(ids, x)
    assert set(got) == set(want) and all(len(v) == 5 for v in got.values())
    assert all(a[1] >= b[1] - 1e-12 for v in got.values() for a, b in zip(v, v[1:], strict=False))
    return np.mean([len({i for i, _ in got[q]} & {i for i, _ in want[q]}) / 5 for q in want])


@pytest.mark.parametrize("kind", ["noise", "clusters"])
def test_recall(spark, kind):
    r = np.random.default_rng(2)
    x = r.standard_normal((3000, 48))
    if kind == "clusters":
        x += 4 * r.standard_normal((40, 48))[r.integers(0, 40, 3000)]
    assert measured(spark, x) >= 0.9


def test_clusters_need_few_cells(spark):
    r = np.random.default_rng(3)
    x = 0.1 * r.standard_normal((4000, 32)) + r.standard_normal((20, 32))[np.arange(4000) % 20]
    docs = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "class long, embedding array<double>").cache()
    centres = rabitq.fit(docs)
    cell = rabitq.nearest_cells(rabitq.unit(x), centres, 1)[:, 0]
    placed = spark.createDataFrame([(v.tolist(), int(c)) for v, c in zip(x, cell, strict=True)], "embedding array<double>, cell int")
    n = rabitq.probes(placed, docs.withColumnRenamed("class", "query").where("query % 20 = 0"), centres, 5)
    assert len(centres) > 50 and n < len(centres) / 3


def test_estimates_stay_within_bounds():
    r = np.random.default_rng(4)
    x, q = rabitq.unit(r.standard_normal((2000, 70))), rabitq.unit(r.standard_normal((20, 70)))
    centre = rabitq.unit(r.standard_normal((1, 70)))[0] * 0.2
    estimate, error = rabitq.Codes(x, centre, rabitq.rotation(70)).estimate(q)
    assert (abs(estimate - q @ x.T) <= error).mean() > 0.99 and abs(estimate - q @ x.T).mean() < 0.1


def test_ties_nulls_and_few_rows(spark):
    v = [1.0, 2.0, 3.0]
    rows = [(50, v), (7, v), (100, v), (3, [2.0, 4.0, 6.0]), (8, [-1.0, 0.0, 0.5]), (None, v), (150, None), (200, [0.0] * 3), (250, [float("nan"), 1.0, 1.0]), (300, [float("inf"), 1.0, 1.0]), (350, [1.0]), (400, [None, 1.0, 1.0]), (9, v), (11, v), (12, v), (13, v)]
    got = rabitq.nearest(spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA)).collect()
    by = {q: [r.vec_id for r in sorted(got, key=lambda r: r["rank"]) if r.query_id == q] for q in {r.query_id for r in got}}
    assert by == {50: [3, 7, 9, 11, 12], 100: [3, 7, 9, 11, 12]} or by == {50: [7, 9, 11, 12, 13], 100: [7, 9, 11, 12, 13]}
    few = rabitq.nearest(spark.createDataFrame([(0, v, 1, "x"), (1, [1.0, 0.0, 0.0], 1, "x")], SCHEMA)).collect()
    assert [(r.query_id, r["rank"], r.vec_id) for r in few] == [(0, 1, 1)]
    assert rabitq.nearest(spark.createDataFrame([(0, v, 1, "x")], SCHEMA)).collect() == []


def test_empty_table(spark):
    assert rabitq.nearest(spark.createDataFrame([], SCHEMA)).collect() == []
    assert rabitq.nearest(spark.createDataFrame([(50, None, 1, "x")], SCHEMA)).collect() == []
