import random

from pyspark.sql import functions as F

from lexifold.operators import correct
from lexifold.operators.kernel import Memory
from lexifold.operators.rules import key
from lexifold.operators.runs import BITS, joined_key, runs, sieve

NAMES = ("Maarit", "Cold Widget", "Kivimaa")


def memory_of(spark):
    m = Memory()
    for name in NAMES:
        m.apply("add_term", {"preferred": name}, "1")
    terms = spark.createDataFrame([(k, t.preferred, t.kind, t.note, t.trust) for k, t in m.terms.items()], "term string, preferred string, kind string, note string, trust int")
    return m, terms, spark.createDataFrame([], "term string, misspelling string, seen int, vetoes int, guard array<string>")


def test_only_runs_that_may_read_as_a_key_become_rows(spark):
    m, terms, spelled = memory_of(spark)
    plain = " ".join(["blue sky over there"] * 500)
    texts = [plain, f"{plain} Marit", "the kold widget, ma rit", "kold blue", None, "", "× kold × widget 7", "marit@x.org kold_widget"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    bits = sieve(correct.term_keys(terms, spelled))
    few = {(r.doc, r.start, r.end, r.match, r.n, r.key) for r in runs(docs, bits, 4).collect()}
    assert len(few) < 20 and {("=1", 10000, 10005, "key", 1, "marit"), ("=2", 4, 15, "key", 2, "kold vidget"), ("=2", 17, 23, "join", 2, "marit")} <= few
    # a sieve that lets all through gives the same once met with the keys
    every = runs(docs, b"\xff" * ((1 << BITS) // 8), 4)
    known = [r.key for r in correct.term_keys(terms, spelled).collect()]
    assert {(r.doc, r.start, r.end, r.match, r.n, r.key) for r in every.where(F.col("key").isin(known)).collect()} == {x for x in few if x[5] in known}
    assert every.count() > 4000
    out = {r.text: r.output for r in correct.correct(docs, terms, spelled).collect()}
    assert all(out[t] == m.correct(t)[0] for t in texts if t is not None)


def test_keys_of_joined_words():
    r = random.Random(3)
    word = lambda: "".join(r.choice("aehhkskcshzqwoouÉßß1×gptÆŉ") for _ in range(r.randrange(1, 6)))
    assert all(joined_key(a, b) == key(a + b) for a, b in ((word(), word()) for _ in range(20000)))


def test_a_term_elsewhere(spark):
    _, terms, _ = memory_of(spark)
    texts = ["Maarit saw x", "x saw Maarit", "x Maarits", "aMaarit x", "Cold  Widget x", "Widget x Cold", "Maarit", "Cold Cold, Widget x"]
    docs = spark.createDataFrame(list(enumerate(texts)) + [(0, texts[0])], "doc_id int, text string")
    from lexifold.functions import text as T
    at = F.when(F.instr("text", "x") > 0, F.instr("text", "x") - 1).otherwise(0)
    spans = T.owned(docs).distinct().select("user_id", "doc", "version", at.alias("start"), (at + F.when(F.instr("text", "x") > 0, 1).otherwise(6)).alias("end"), F.array(F.lit("maarit"), F.lit("cold widget")).alias("terms"))
    got = {int(r.doc[1:]): r.elsewhere for r in correct.elsewhere(spans, docs, terms).collect()}
    assert got == {0: "Maarit", 1: "Maarit", 2: None, 3: None, 4: "Cold Widget", 5: None, 6: None, 7: "Cold Widget"}
