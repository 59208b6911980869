import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lexifold.llm import language, mixing, neardup, pieces, private

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, size long, spans string, _row int"


def rows():
    r = np.random.default_rng(0)
    made = {"en": "the house is warm and dogs sleep in it while a man reads his old book by night", "fi": "talo on lämmin ja koira nukkuu siinä kun mies lukee vanhaa kirjaansa yöllä yksin"}
    out = []
    for i in range(160):
        lang = "en" if i % 2 else "fi"
        out.append((i, " ".join(r.choice(made[lang].split(), r.integers(12, 120))), lang, f"s{i % 3}" if i % 9 else None))
    out += [(200, out[5][1], "en", "s0"), (201, out[5][1] + " yes", "en", "s1"), (202, None, None, None), (203, "", None, "s0"), (204, "12 34 !!", "en", "s0"), (205, "Россия большая страна " * 30, None, "s2")]
    out += [(3, out[3][1], "en", "s0"), (3, out[3][1], "en", "s0"), (None, "the house is warm and the book is old, mail jane.doe@mail.example.com", "en", "s1"), (206, "the man reads at 10.0.0.7 and the dog sleeps warm in his old house by night", "en", "s0"), (207, " ".join(made["en"].split() * 3000), "en", "s2")]
    return [(d, t, lang, s, len(t or ""), 0.5, 7, "own", 1) for d, t, lang, s in out]


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """What each stage is given and gives, with run() as a whole."""
    folder = tmp_path_factory.mktemp("sf")
    spark.createDataFrame(rows(), SCHEMA).write.parquet(str(folder / "documents.parquet"))
    docs, out = spark.read.parquet(str(folder / "documents.parquet")), []
    for name, stage in corpus_pipeline.STAGES:
        path = str(folder / name)
        stage(spark, docs, str(folder)).write.parquet(path)
        out.append((name, docs, spark.read.parquet(path)))
        docs = out[-1][2]
    return out, corpus_pipeline.run(spark, str(folder))


def test_columns_stay(stages):
    for name, before, after in stages[0][:-1]:
        assert after.columns == before.columns, name
        assert set(after.where("size IS NOT NULL").select("score", "spans").distinct().collect()) == {(0.5, "own")}


def test_language_stage(stages):
    name, before, after = stages[0][0]
    gone = {r.doc_id for r in before.collect()} - {r.doc_id for r in after.collect()}
    assert name == "language_id" and gone == {202, 203, 204, 205}
    want = language.classify(before, language.train(before)).where("NOT rejected")
    assert want.count() == after.count() == before.count() - 4


def test_near_duplicates_stage(stages):
    name, before, after = stages[0][1]
    classes = {r.doc_id: r.class_id for r in neardup.classes(before).collect()}
    ids = [r.doc_id for r in after.collect()]
    assert name == "near_dedup" and sorted(i for i in ids if i is not None) == sorted(set(classes.values()) - {None}) and ids.count(None) == 1
    assert classes[200] == classes[201] == classes[5] == 5 and ids.count(3) == 1


def test_personal_data_stage(stages):
    name, before, after = stages[0][2]
    old, new = ({r.doc_id: r for r in x.collect()} for x in (before, after))
    field = private.train()
    import pyarrow as pa

    assert name == "pii" and old.keys() == new.keys()
    for d, r in old.items():
        spans = private.find(pa.array([r.text]), field)[1][0]
        assert new[d].text == (private.masked(r.text, spans) if spans else r.text) and new[d].n_chars == len(new[d].text)
    assert "<EMAIL>" in new[None].text and "<IP>" in new[206].text


def test_mixing_stage(stages):
    name, before, after = stages[0][3]
    count = F.sum(mixing.words_in("text")).alias("n")
    got, source = (x.groupBy("source").agg(count) for x in (after, before))
    size = {r.source: r.n for r in source.collect()}
    names = sorted(size, key=lambda s: (s is None, s))
    target = {r.source_ix: r.target for r in mixing.taken(before).select("source_ix", "target").distinct().collect()}
    taken = {r.source: r.n for r in got.collect()}
    assert name == "mixing" and all(abs(taken[s] - target[i]) <= 2 * mixing.BLOCK_WORDS and taken[s] <= 2 * size[s] for i, s in enumerate(names))


def test_pieces_stage_and_run(stages):
    out, run = stages
    name, before, after = out[4]
    assert name == "sentencepiece" and after.count() == before.count() and after.where("NOT exact").isEmpty()
    c = pieces.codec(pieces.model_path())
    texts = sorted((r.doc_id is None, r.doc_id or 0, r.text) for r in before.collect())
    assert sorted((r.doc_id is None, r.doc_id or 0, c.decode(np.array(r.ids, np.int32))) for r in after.collect()) == texts
    assert all(r.ids_sha256 == hashlib.sha256(np.array(r.ids, np.int32).tobytes()).hexdigest() for r in after.collect())
    assert sorted(map(str, run.collect())) == sorted(map(str, after.collect()))


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
