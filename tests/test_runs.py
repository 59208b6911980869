import random

from lexifold.functions import text as T
from lexifold.operators import correct
from lexifold.operators.kernel import Memory
from lexifold.operators.rules import key

LONG = "Cold Plate × Of The Old Mill"


def memory_of(spark, user, names):
    m = Memory()
    for n in names:
        m.apply("add_term", {"preferred": n}, "0")
    return m, [(user, k, t.preferred, t.kind, t.note, t.trust) for k, t in m.terms.items()]


def test_long_terms_are_found_and_cost_others_nothing(spark):
    r = random.Random(0)
    words = LONG.lower().split() + ["kold", "plaate", "mil", "and", "Cold", "Plate"]
    a, rows_a = memory_of(spark, "a", [LONG, "Cold Plate", "Mill"])
    b, rows_b = memory_of(spark, "b", ["Cold Plate", "Mill"])
    texts = [" ".join(r.choice(words) for _ in range(r.randrange(12))) + r.choice(["", " kold plaate × of the old mil", " cold plate of × the old mill."]) for _ in range(60)]
    texts += ["a kold plaate × of the old mil.x", "kold plaate × of the  old mil", LONG, LONG + " " + LONG.upper()]
    docs = spark.createDataFrame([(u, i, t) for u in "ab" for i, t in enumerate(texts)], "user_id string, doc_id int, text string")
    kind = "user_id string, term string, preferred string, kind string, note string, trust int"
    spelled = spark.createDataFrame([], "user_id string, term string, misspelling string, seen int, vetoes int, guard array<string>")
    terms = spark.createDataFrame(rows_a + rows_b, kind)
    got = {(x.user_id, x.doc_id): x.output for x in correct.correct(docs, terms, spelled).select("user_id", "doc_id", "output").collect()}
    want = {(u, i): m.correct(t)[0] for u, m in (("a", a), ("b", b)) for i, t in enumerate(texts)}
    assert got == want and sum(LONG in x for x in want.values()) > 20
    tokens = correct.marked_tokens(docs)
    long = correct.long_runs(tokens, correct.beginnings(terms, spelled))
    assert long.where("user_id = 'b'").count() == 0 and long.where("user_id = 'a'").count() > 0
    assert correct.beginnings(spark.createDataFrame(rows_b, kind), spelled).count() == 0


def test_keys_in_steps_are_keys(spark):
    r = random.Random(1)
    words = ["Aadithya", "Straße", "ŉo", "Æther", "QUICK", "room22", "×", "ksh", "sshh", "Ǆ", "ɏ", "coffee", "Phool", "aabb", ""]
    words += ["".join(r.choice("aehhkskcshzqwoouÉßß1") for _ in range(r.randrange(1, 9))) for _ in range(3000)]
    rows = T.keyed(spark.createDataFrame([(w,) for w in words], "w string"), __import__("pyspark.sql.functions", fromlist=["col"]).col("w")).collect()
    assert all(x.key == key(x.w) for x in rows)


def test_repeated_rows_have_tokens_of_their_own(spark):
    docs = spark.createDataFrame([(1, "one two")] * 3 + [(None, "one")], "doc_id int, text string")
    t = T.tokens(docs, identifiers=True).collect()
    assert sorted((x.doc_id or 0, x.pos, x.start, x.end, x.word, x.ident) for x in t) == [(0, 0, 0, 3, "one", False)] + [(1, 0, 0, 3, "one", False)] * 3 + [(1, 1, 4, 7, "two", False)] * 3
