import json
import random

import pytest
from pyspark.sql import functions as F

from lexifold.operators import correct, evaluate, memory
from lexifold.operators.judge import Answer, costs, judged, parse, parsed, prompt
from lexifold.operators.kernel import Memory
from lexifold.sources import generate
from lexifold.sources.log import parse_cases

TERMS = "user_id string, term string, preferred string, kind string, note string, trust int"
SPELLED = "user_id string, term string, misspelling string, seen int, vetoes int, guard array<string>"


def frames(spark, memories):
    rows = [r | {"user_id": u} for u, m in memories.items() for r in memory.rows(u, m).to_dict("records")]
    terms = [(r["user_id"], r["term"], r["preferred"], r["kind"], r["note"], int(r["trust"])) for r in rows if r["part"] == "term"]
    spelled = [(r["user_id"], r["term"], r["misspelling"], int(r["seen"]), int(r["vetoes"]), r["guard"]) for r in rows if r["part"] == "misspelling"]
    return spark.createDataFrame(terms, TERMS), spark.createDataFrame(spelled, SPELLED)


def taught(*names):
    m = Memory()
    for name, trust in names:
        m.apply("add_term", {"preferred": name}, "1")
        m.apply("set_trust", {"preferred": name, "trust": trust}, "1")
    return m


def test_by_hand(spark):
    m = taught(("Maarit", 3), ("Cold Widget", 2), ("Kivimaa", 2), ("Erat", 1))
    texts = {
        "Ask Marit to come.": ("Ask Maarit to come.", [("Marit", "applied")]),
        "a ma rit here": ("a Maarit here", [("ma rit", "applied")]),
        "the kold widget": ("the Cold Widget", [("kold widget", "applied")]),
        "see marit@x.org": ("see marit@x.org", []),
        "Erath and Marit Holm": ("Erath and Marit Holm", [("Erath", "skipped:low-trust"), ("Marit", "skipped:context-unavailable")]),
        "MARIT SAID SO": ("MARIT SAID SO", [("MARIT", "skipped:context-unavailable")]),
        "Maarit, kivima": ("Maarit, kivima", [("kivima", "skipped:context-unavailable")]),
        "We saw marit": ("We saw marit", [("marit", "skipped:context-unavailable")]),
        "": ("", []),
    }
    docs = spark.createDataFrame([("u", i, t) for i, t in enumerate(texts)], "user_id string, doc_id long, text string")
    got = {r.text: r for r in correct.checked(correct.correct(docs, *frames(spark, {"u": m}))).collect()}
    for t, (output, spans) in texts.items():
        assert (got[t].output, [(c.text, c.decision) for c in got[t].candidates or []]) == (output, spans)
        assert m.correct(t)[0] == output and got[t].reason == ("" if spans else "no-candidates")


def test_frames_agree_with_the_fold_for_many_users(spark):
    r = random.Random(7)
    memories, docs = {}, []
    for u in range(12):
        m, names = Memory(), [generate.name(r) for _ in range(4)] + ["Cold Widget", "Joy"]
        for name in names:
            m.apply("add_term", {"preferred": name}, "1")
            m.apply("set_trust", {"preferred": name, "trust": r.randint(-1, 4)}, "1")
        for _ in range(12):
            right = r.choice(names)
            heard = generate.sentence(generate.misheard(right, r), r)
            m.apply("observation", {"formatted": heard, "final": r.choice([heard, heard.replace(heard.split()[1], right)])}, "2")
        memories[f"u{u}"] = m
        for i in range(25):
            a, b = (generate.misheard(r.choice(names), r) for _ in range(2))
            docs.append((f"u{u}", i, r.choice([f"{a} and {b}.", f"we saw {a.lower()} with {b.upper()}", f"{a}@{b}.org {b}", generate.sentence(a, r), f"{a[:2]} {a[2:]} 12, {b} s"])))
    got = {(x.user_id, x.doc_id): x for x in correct.checked(correct.correct(spark.createDataFrame(docs, "user_id string, doc_id long, text string"), *frames(spark, memories))).collect()}
    for u, i, t in docs:
        output, spans = memories[u].correct(t)
        assert (got[u, i].output, [(c.start, c.end, c.decision, c.applied) for c in got[u, i].candidates or []]) == (output, [(s.start, s.end, s.decision, s.applied) for s in spans]), t


def test_rows_of_one_id_and_none(spark):
    terms, spelled = frames(spark, {"": taught(("Maarit", 3))})
    rows = [(1, "Ask Marit."), (1, "Ask Marit."), (1, "Tell Marit so."), (None, "Ask Marit."), (None, "Call Marit."), (2, None), (3, "")]
    out = correct.checked(correct.correct(spark.createDataFrame(rows, "doc_id long, text string"), terms, spelled)).collect()
    assert sorted((r.doc_id or 0, r.output or "") for r in out) == sorted((d or 0, (t or "").replace("Marit", "Maarit")) for d, t in rows)
    m = taught(("Notes", 5))
    m.terms["notes"].spellings["nots"] = __import__("lexifold.operators.kernel", fromlist=["Spelling"]).Spelling(2, 1, ["lisbon"])
    guarded = [(None, "Read nots of Lisbon."), (None, "Read nots of Rome."), (4, "Read nots of Lisbon.")]
    out = correct.correct(spark.createDataFrame(guarded, "doc_id long, text string"), *frames(spark, {"": m})).collect()
    assert {r.text: r.candidates[0].decision for r in out} == {"Read nots of Lisbon.": "skipped:guarded", "Read nots of Rome.": "skipped:context-unavailable"}
    assert m.correct("Read nots of Lisbon.")[1][0].decision == "skipped:guarded"
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert correct.correct(empty, terms, spelled).collect() == []


def test_nothing_outside_spans_changes(spark):
    entry = "array<struct<start:int,end:int,text:string,match:string,decision:string,applied:string,reason:string>>"
    fine = spark.createDataFrame([("u", 1, "ab c", "aXX c", 1, "", [(1, 2, "b", "key", "applied", "XX", None)])], f"user_id string, doc_id long, text string, output string, n_candidates long, reason string, candidates {entry}")
    assert correct.checked(fine).count() == 1
    assert fine.select(correct.toggled(F.col("text"), F.col("candidates"), F.array(F.lit(1))).alias("t")).first().t == "ab c"
    with pytest.raises(Exception, match="outside its spans"):
        correct.checked(fine.withColumn("output", F.lit("aXX d"))).collect()


class Scripted:
    """Answers from a table: text -> decisions, or an exception."""

    def __init__(self, answers, available=True):
        self.answers, self.available = answers, available

    def judge(self, sentence, items):
        found = self.answers(sentence, items)
        if isinstance(found, Exception):
            raise found
        return Answer(found, "m", 10, 5)


def test_judge(spark):
    m = taught(("Kivi", 3), ("Maarit", 2))
    terms, spelled = frames(spark, {"u": m})
    texts = ["Tell them kivi is live.", "The Kivi demo fell while I ate a kiwi.", "we saw marit and kivi"]
    docs = spark.createDataFrame([("u", i, t) for i, t in enumerate(texts)], "user_id string, doc_id long, text string")
    decided = correct.decisions(docs, terms, spelled)
    asked = correct.judge_requests(docs, decided, terms).cache()
    hints = {r.doc_id: [i.hint for i in r["items"]] for r in asked.collect()}
    assert hints[0] == [""] and "Kivi" in hints[1][0] and len(hints[2]) == 2
    line = asked.where("doc_id = 1").select(prompt(F.col("sentence"), F.col("items")).alias("p")).first().p
    assert line.startswith("Text: The Kivi demo") and '#0 heard as {"text":"kiwi"}, may be Kivi [term]' in line

    def outputs(judge):
        verdicts = judged(asked, judge)
        return {r.doc_id: ([c.decision for c in r.candidates], r.output) for r in correct.correct(docs, terms, spelled, verdicts).collect()}

    yes = outputs(Scripted(lambda s, items: {i: {"index": i, "apply": True, "preferred": x["options"][0]["preferred"], "reason": "r"} for i, x in enumerate(items)}))
    assert yes[0] == (["applied"], "Tell them Kivi is live.") and yes[2][1] == "we saw Maarit and Kivi"
    no = outputs(Scripted(lambda s, items: {0: {"index": 0, "apply": False}}))
    assert no[0][0] == ["skipped:context"] and no[2][0] == ["skipped:context", "llm-error"]
    odd = outputs(Scripted(lambda s, items: {0: {"apply": "yes", "preferred": 3}, 1: {"apply": True, "preferred": "Other"}}))
    assert odd[2][0] == ["llm-error", "llm-error"] and odd[2][1] == texts[2]
    assert outputs(Scripted(lambda s, items: RuntimeError("down")))[0][0] == ["llm-error"]
    assert judged(asked, Scripted(None, available=False)).count() == 0


def test_answers_and_costs(spark):
    said = 'Sure: ```{"decisions": [{"index": "1", "apply": true, "preferred": "Kivi", "reason": "x"}]}``` done'
    assert parse(said)[1]["preferred"] == "Kivi"
    got = spark.createDataFrame([(said,), ("none",)], "a string").select(parsed(F.col("a")).alias("d")).collect()
    assert [tuple(x) for x in got[0].d] == [(1, True, "Kivi", "x")] and got[1].d is None
    with pytest.raises(ValueError):
        parse("no")
    calls = spark.createDataFrame([("m", 1000, 500), ("free", 9, 9)], "model string, input_tokens long, output_tokens long")
    prices = spark.createDataFrame([("m", 2.0, 4.0)], "model string, price_in double, price_out double")
    assert {r.model: r.cost for r in costs(calls, prices).collect()} == {"m": 0.004, "free": 0.0}


CASES = """
# made for this test
{"id": "learn", "category": "trajectory", "seed": [], "steps": [
  {"do": "run", "formatted": "Ask Joonas now.", "expect_output": "Ask Joonas now.", "expect_no_llm": true},
  {"do": "observe", "asr": "", "formatted": "Ask Joonas now.", "final": "Ask Jonas now.", "expect_learned": ["Jonas"]},
  {"do": "assert_term", "preferred": "jonas", "status": "watching"},
  {"do": "run", "formatted": "Ask Joonas now.", "expect_output": "Ask Joonas now.", "expect_decisions": {"joonas": "skipped:low"}},
  {"do": "observe", "asr": "", "formatted": "Joonas left.", "final": "Jonas left.", "expect_learned": ["Jonas"]},
  {"do": "run", "formatted": "Ask Joonas now.", "expect_output": "Ask Jonas now.", "expect_decisions": {"Joonas": "applied"}},
  {"do": "observe", "asr": "", "formatted": "Ask Joonas now.", "final": "Ask Joonas now.", "expect_reverted": ["Jonas"]},
  {"do": "delete", "preferred": "Jonas"}, {"do": "assert_absent", "preferred": "Jonas"},
  {"do": "observe", "asr": "", "formatted": "Ask Joonas now.", "final": "Ask Jonas now.", "expect_ignored": [{"new": "Jonas", "reason": "retired"}]}]}
{"id": "judged", "seed": "persona", "steps": [{"do": "run", "formatted": "Tell them kivi is live.", "expect_output": "Tell them Kivi is live."}]}
# forced
{"id": "quiet", "mode": "no-llm", "seed": "persona", "steps": [{"do": "run", "formatted": "Tell them kivi is live.", "expect_output_any": ["Tell them kivi is live."], "expect_no_llm": true}]}
{"id": "wrong", "seed": "persona", "steps": [{"do": "run", "formatted": "Tell Kivi.", "expect_output": "Tell Kiwi."}, {"do": "assert_absent", "preferred": "Kivi"}, {"do": "add", "preferred": "a-b"}]}
"""
PERSONAS = {"persona": [{"type": "add_term", "payload": {"preferred": "Kivi"}}]}


def test_cases(spark):
    yes = Scripted(lambda s, items: {i: {"index": i, "apply": True, "preferred": x["options"][0]["preferred"]} for i, x in enumerate(items)})
    records = {r["id"]: r for r in evaluate.run_cases(spark, parse_cases(CASES), PERSONAS, yes)}
    assert {k: r["passed"] for k, r in records.items()} == {"learn": True, "judged": True, "quiet": True, "wrong": False}
    assert len(records["wrong"]["failures"]) == 2
    counts = evaluate.summary(spark, list(records.values()))
    assert (counts["useful"], counts["missed"], counts["harmful"], counts["noop_expected"], counts["correction_expected"]) == (2, 1, 0, 3, 3)
    down = evaluate.run_cases(spark, parse_cases(CASES)[1:2], PERSONAS, Scripted(lambda s, items: RuntimeError("429")))
    assert not down[0]["passed"] and down[0]["degraded"]
    with pytest.raises(ValueError, match="expect_learnt"):
        evaluate.run_cases(spark, [{"id": "x", "seed": [], "steps": [{"do": "observe", "expect_learnt": []}]}])
    with pytest.raises(json.JSONDecodeError):
        parse_cases('{"id": 1')


def test_rates(spark):
    runs = spark.createDataFrame([(True, 10, 5, 0.25), (False, 0, 0, 0.0), (False, 0, 0, 0.0)], "called boolean, input_tokens long, output_tokens long, cost double")
    assert evaluate.call_rate(runs).first().asDict() == {"calls": 1, "call_rate": 33.3, "tokens": 15, "cost": 0.25}
    assert evaluate.call_rate(runs.limit(0)).first().call_rate == 0.0


def test_invariants(spark):
    """What has to hold whatever is said: made-up names, mishearings and junk."""
    r = random.Random(42)
    for _ in range(60):
        m, right = Memory(), generate.name(r)
        heard = generate.sentence(generate.misheard(right, r), r)
        assert m.correct(heard) == (heard, [])
        m.apply("observation", {"formatted": heard, "final": heard}, "1")
        assert not m.terms
        said = generate.sentence(right, random.Random(1))
        m.apply("observation", {"formatted": said.replace(right, generate.misheard(right, r)), "final": said}, "1")
        assert all(t.trust < 2 for t in m.terms.values())  # one sighting never makes a term active
        m.apply("add_term", {"preferred": right}, "2")
        once, spans = m.correct(heard)
        assert all(t.trust >= 2 for s in spans if s.applied for t in s.terms if t.preferred == s.applied) and m.correct(once)[0] == once
        junk = "".join(r.choice("ab \t\n.,@×é1☃'́") for _ in range(40))
        m.correct(junk)
        m.apply("observation", {"formatted": junk, "final": junk[::-1]}, "3")
    log = generate.observations(spark, 4, 8)
    first, again = (sorted(map(str, memory.replay(log).collect())) for _ in range(2))
    assert first == again
