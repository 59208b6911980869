import random

from pyspark.sql import functions as F

from lexifold.functions import text as T
from lexifold.operators import align, correct
from lexifold.operators.kernel import Comparison, Memory, Reading
from lexifold.operators.rules import check_term, heading, opens_sentence, phrase_key
from lexifold.sources.generate import name, sentence

WORDS = ["Ask", "ask", "Marit", "12", "Élan", "ǅet", "×", "a", "’s", "(the", "“So", "End.", "x@y", "now,", "ß"]


def made(r, n):
    return "".join(r.choice(WORDS) + r.choice([" ", "  ", "\n", ". ", "-", "  "]) for _ in range(r.randrange(n)))


def test_headings_and_names_agree_with_the_fold(spark):
    r = random.Random(0)
    texts = [(i, made(r, 9)) for i in range(600)] + [(600, None), (601, ""), (602, "Marit"), (603, "Ask Marit"), (604, "a " * 20_000)]
    got = {x.id: x.heading for x in align.headings(spark.createDataFrame(texts, "id int, text string"), "id").collect()}
    assert got == {i: heading(t or "") for i, t in texts}
    pairs = [(i, made(r, 9), t) for i, t in texts]
    frame = spark.createDataFrame(pairs, "id int, formatted string, final string")
    said = {(x.id, x.old, x.new, x.start): x.proper for x in align.proper(align.edit_pairs(frame, "id"), frame, "id").collect()}
    want = {}
    for i, before, after in pairs:
        for e in Comparison(before, after or "").edits():
            want[i, *e] = e.new[:1].isupper() and e.old[:1].islower() and not heading(after) and not opens_sentence(after, e.at)
    assert said == want
    assert sum(want.values()) > 5


def test_edits_of_odd_rows(spark):
    rows = [("a", "Ask marit now", "Ask Marit now"), ("a", "Ask marit now", "Ask Marit now"), (None, "see ma arit go", "see Maarit go"), ("b", None, "x"), ("c", "same", "same"), ("d", "one two three", "four")]
    frame = spark.createDataFrame([(*x, 1, "n") for x in rows], "id string, formatted string, final string, start int, n string")
    got = sorted(map(tuple, align.edit_pairs(frame, "id").collect()), key=str)
    assert got == sorted([("a", 0, "marit", "Marit", 4), ("a", 0, "marit", "Marit", 4), (None, 0, "ma arit", "Maarit", 4)], key=str)
    assert align.edit_pairs(frame.limit(0), "id").collect() == []


def test_places_in_the_output(spark):
    r, m = random.Random(1), Memory()
    names = [name(r) for _ in range(5)]
    for n in names:
        m.apply("add_term", {"preferred": n}, "0")
    texts = [" ".join(sentence(r.choice(names)[:-1] + r.choice(["", "aa", "h"]), r) for _ in range(6)) for _ in range(80)]
    rows, outputs = [], {}
    for i, t in enumerate(texts):
        outputs[i], spans = m.correct(t)
        rows += [(i, s.start, s.end, s.applied) for s in spans]
    out = align.placed(spark.createDataFrame(rows, "id int, start int, end int, applied string"), ["id"]).collect()
    assert len(out) > 20 and all(outputs[x.id][x.out_start: x.out_end] == x.applied for x in out)


def test_every_white_space_ends_a_chunk(spark):
    """The DataFrame form and the fold agree beside every character that is white space."""
    assert len(T.SPACES) == 29 and " \t\n\x85\xa0  ".strip() == "" and all(c.isspace() for c in T.SPACES)
    m = Memory()
    m.apply("add_term", {"preferred": "Aaditya"}, "0")
    frames = ["foo.com{}Aditya said", "Aditya{}a@b now", "so{}Aditya{}left", "a@b{}\nAditya ran", "“a.b”{}Aditya", "a.b{}{}Aditya c@d", "x@{}Aditya{}@y"]
    texts = [f.replace("{}", c) for c in [*T.SPACES, "​", "᠎"] for f in frames]
    terms = spark.createDataFrame([("aaditya", "Aaditya", None, None, 2)], "term string, preferred string, kind string, note string, trust int")
    spelled = spark.createDataFrame([], "term string, misspelling string, seen int, vetoes int, guard array<string>")
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    got = {x.doc_id: x.output for x in correct.correct(docs, terms, spelled).select("doc_id", "output").collect()}
    assert got == {i: m.correct(t)[0] for i, t in enumerate(texts)}
    assert m.correct("foo.com\xa0Aditya said")[0] == "foo.com\xa0Aaditya said" and Reading("a.b\xa0c").identifier == [True, True, False]
    keys = spark.createDataFrame([(f"{c}Cold{c}{c}Widget{c}",) for c in T.SPACES], "s string").select("s", F.expr(T.phrase_key("s")).alias("k")).collect()
    assert all(x.k == phrase_key(x.s) == "kold vidget" and check_term(x.s) == ("Cold Widget", None) for x in keys)
