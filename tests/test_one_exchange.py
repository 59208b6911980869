import random
from itertools import product

import pytest
from pyspark.sql import functions as F

from lexifold.functions import text as T
from lexifold.operators import correct
from lexifold.operators.judge import prompt
from lexifold.operators.rules import bare, key
from lexifold.operators.runs import _MELTS, joined_key

TERMS = "term string, preferred string, kind string, note string, trust int"
SPELLED = "term string, misspelling string, seen int, vetoes int, guard array<string>"


def sent(spark, df):
    """Bytes that a query writes to shuffles."""
    store = spark.sparkContext._jsc.sc().statusStore()

    def stages():
        s = store.stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)
        return {s.apply(i).stageId(): s.apply(i).shuffleWriteBytes() for i in range(s.size())}

    before = stages()
    df.write.format("noop").mode("overwrite").save()
    return sum(n for i, n in stages().items() if i not in before)


@pytest.fixture(scope="module")
def tables(spark):
    r = random.Random(5)
    word = lambda: "".join(r.choice("bcdfgjlmprtxy") for _ in range(7))
    texts = [" ".join([*(word() for _ in range(400)), r.choice(["marit", "Maarit", "kivi", "ma rit"]), word()]) for _ in range(300)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2).localCheckpoint()
    terms = spark.createDataFrame([("maarit", "Maarit", None, None, 2), ("kivi", "Kivi", None, None, 2)], TERMS)
    return docs, terms, spark.createDataFrame([("kivi", "kivi", 0, 1, ["maarit", "xyz"])], SPELLED)


def test_texts_are_shuffled_once(spark, tables):
    docs, terms, spelled = tables
    once = sent(spark, T.dealt(docs))
    decided = correct.decisions(docs, terms, spelled)
    asked = correct.judge_requests(docs, decided, terms)
    corrected = correct.correct(docs, terms, spelled)
    for made in (corrected, decided.groupBy("decision").count(), asked, asked.select("doc_id", prompt(F.col("sentence"), F.col("items")))):
        assert once <= sent(spark, made) < 1.2 * once


def test_what_two_words_read_as_begins_as_the_first_does():
    r = random.Random(7)
    few = ["".join(x) for n in range(1, 5) for x in product("ckshoe", repeat=n)]
    pairs = [(r.choice(few), r.choice(few)) for _ in range(60000)]
    word = lambda: "".join(r.choice("aehhkskcshzqwoouÉßß1×gptÆŉ") for _ in range(r.randrange(1, 7)))
    pairs += [(word(), word()) for _ in range(60000)]
    for a, b in pairs:
        if key(a):
            melts = not key(b) or bare(b)[0] in _MELTS
            assert joined_key(a, b).startswith(key(a)[:-2] if melts else key(a)), (a, b)


def test_words_near_a_key_and_words_that_guard(spark):
    terms = spark.createDataFrame([("maarit", "Maarit", None, None, 2), ("marat", "Marat", None, None, 2), ("cold widget", "Cold Widget", None, None, 2), ("kivi", "Kivi", None, None, 2)], TERMS)
    # a spelling whose term is gone has a key still, so a word of that key is no edit from another
    spelled = spark.createDataFrame([("gone", "kivo", 1, 0, []), ("kivi", "kivi", 1, 1, ["stone"])], SPELLED)
    docs = spark.createDataFrame([(1, "saw mart here"), (2, "the kivo fell"), (3, "a golt or kolt"), (4, "kivi, Stone"), (5, "kivi, stones"), (5, "kivi, stones"), (6, "x.y/kivi kivi")], "doc_id int, text string")
    got = sorted((x.doc_id, x.start, x.match, x.terms, x.decision) for x in correct.decisions(docs, terms, spelled).select("doc_id", "start", "match", F.col("terms"), "decision").collect())
    assert got == [(1, 4, "fuzzy", ["maarit", "marat"], "skipped:conflict"), (4, 0, "key", ["kivi"], "skipped:guarded"), (5, 0, "key", ["kivi"], "applied"), (6, 9, "key", ["kivi"], "applied")]
