import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lexifold.llm import mixing

SCHEMA = "doc_id long, text string, source string, size long, n_chars long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def rows():
    out = [(i, f"w{i} " * (i % 41), f"s{i % 3}" if i % 7 else None, 999, 5) for i in range(120)]
    out += [(200, None, "s0", None, None), (201, "", None, 1, 1), (202, " \t\n", "s1", 1, 1), (3, out[3][1], "s0", 7, 7), (None, "a b c", "s2", 7, 7), (None, "a b c", "s2", 7, 7)]
    out += [(201, "", None, 1, 1)] * 3  # repeated rows without a word
    return [*out, (300, "long " * 5000, "s1", 0, 0), (301, "\x0bx\x0cy\x1cz ", "s3", 0, 0)]


def pour(total, limits, weights):
    """Targets by definition: shares by weight, excess over a limit given to the others again."""
    out = dict.fromkeys(limits, 0.0)
    open_, left = set(limits), total
    while open_:
        share = left / sum(weights[k] for k in open_)
        full = {k for k in open_ if share * weights[k] > limits[k]}
        if not full:
            return out | {k: share * weights[k] for k in open_}
        for k in full:
            out[k] = limits[k]
            left -= limits[k]
        open_ -= full
    return out


@pytest.fixture
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA)


def test_every_row_and_target(docs):
    got = mixing.taken(docs).collect()
    size = [len(WORD.findall(t or "")) for _, t, *_ in rows()]
    assert Counter((r.doc_id, r["size"]) for r in got) == Counter((d, n) for (d, *_), n in zip(rows(), size, strict=True))
    names = sorted({s for _, _, s, *_ in rows()}, key=lambda s: (s is None, s))
    total = {s: sum(n for (_, _, x, *_), n in zip(rows(), size, strict=True) if x == s) for s in names}
    want = pour(1.5 * sum(size), {s: 2.0 * total[s] for s in names}, {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)})
    for i, s in enumerate(names):
        own = [r for r in got if r.source_ix == i]
        assert all(r.source_size == total[s] and r.target == pytest.approx(want[s]) for r in own)
        assert abs(sum(r.taken for r in own) - want[s]) <= 2 * mixing.BLOCK_WORDS
    assert all(0 <= r.taken <= 2 * r["size"] for r in got)
    assert Counter(map(tuple, got)) == Counter(map(tuple, mixing.taken(docs).collect()))


def test_slots_of_shards(spark):
    docs = spark.createDataFrame([(i, "w " * 30, f"s{i % 3}") for i in range(9000)], "doc_id long, text string, source string")
    mixing.SHARD_DRAWS, kept = 500, mixing.SHARD_DRAWS
    try:
        sources = mixing.checkpointed(mixing.targets(mixing.numbered(docs)))
        shards = mixing.counts(sources).toPandas()
        slots = mixing.draw(sources).toPandas()
    finally:
        mixing.SHARD_DRAWS = kept
    wide = shards.pivot(index="shard", columns="source_ix", values="n")
    assert wide.std().min() > 2 and len(wide) > 10  # counts are drawn, not dealt evenly
    assert slots.groupby(["shard", "source_ix"]).size().equals(shards.set_index(["shard", "source_ix"])["n"].sort_index())
    for _, shard in slots.groupby("shard"):
        assert sorted(shard.place) == list(range(len(shard)))
    draws = {r.source_ix: (r.draws, r.blocks) for r in sources.collect()}
    for ix, own in slots.groupby("source_ix"):
        assert len(own) == draws[ix][0] and not own.duplicated(["pass", "block"]).any() and own.block.between(0, draws[ix][1] - 1).all()


def test_mix_gives_the_words_taken(docs):
    slots = mixing.mix(docs).groupBy("doc_id").agg(F.sum(F.col("hi") - F.col("lo")).alias("n")).toPandas().dropna().set_index("doc_id")["n"]
    taken = mixing.taken(docs).groupBy("doc_id").agg(F.sum("taken").alias("n")).toPandas().dropna().set_index("doc_id")["n"]
    assert slots.to_dict() == taken[taken > 0].to_dict()


def test_documents_of_the_mix(docs):
    got = mixing.mixed_documents(docs)
    assert got.columns == docs.columns
    found, given = got.collect(), {}
    for d, t, s, n, _ in rows():
        given.setdefault((d, s), []).append((t, n))
    for r in found:
        words = set(WORD.findall(r.text or ""))
        assert any(r["size"] == n and words <= set(WORD.findall(t or "")) for t, n in given[r.doc_id, r.source])
    assert sum(len(WORD.findall(r.text or "")) for r in found) == mixing.taken(docs).agg(F.sum("taken")).first()[0]
    assert sum(r.doc_id == 201 for r in found) == 4 and sum(r.doc_id == 200 for r in found) == 1


def test_empty_table(spark):
    docs = spark.createDataFrame([], SCHEMA)
    assert mixing.taken(docs).collect() == [] and mixing.mixed_documents(docs).collect() == [] and mixing.mix(docs).collect() == []
    docs = spark.createDataFrame([(1, None, None, 0, 0), (2, " ", "a", 0, 0)], SCHEMA)
    assert [(r["size"], r.target, r.taken) for r in mixing.taken(docs).collect()] == [(0, 0.0, 0)] * 2
