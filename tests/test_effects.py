import json
import random

from lexifold.operators import effects, memory
from lexifold.sources.generate import misheard, name, sentence

EVENTS = "user_id string, seq long, ts string, type string, payload string"


def log_of(users, each, seed=0):
    """Lives of a few names: added, mistaken, put right, shown, kept, deleted, in sentences and in headings."""
    r, out = random.Random(seed), []
    common = ["Kiwi", "Notes", "Joy", "Sunny"]
    for u in range(users):
        names = [name(r) for _ in range(3)] + r.sample(common, 2) + ["Cold Plate", "Maarit"]
        for i in range(each):
            n = r.choice(names)
            kind = r.choices(["observation", "add_term", "delete_term", "set_trust"], [16, 2, 1, 1])[0]
            if kind == "observation":
                said = sentence(n, r) + r.choice(["", f" In week w{r.randrange(60)} of Lisbon.", " Then they came."])
                wrong = n.lower() if n in common else "ma arit" if n == "Maarit" and r.random() < 0.5 else misheard(n, r)
                heard = said.replace(n, wrong)
                payload = {"asr": "", "formatted": heard, "final": r.choice([said, said, heard, said.title()])}
                if r.random() < 0.4:
                    payload["presented"] = said
            else:
                payload = {"preferred": r.choice([n, n.upper()]), "trust": r.randrange(4)} | ({"kind": r.choice(["person", None]), "note": "n"} if r.random() < 0.5 else {})
            out.append((None if u == 0 else f"u{u}", i * 3 + 1, f"2026-01-{i:03d}", kind, json.dumps(payload)))
    # one word taken back again and again, beside other words each time, so that its guard is full
    out.append(("g", 1, "2026-01-001", "add_term", json.dumps({"preferred": "Kiwi"})))
    for i in range(60):
        heard = f"Tell Marit kiwi is live in w{i % 37} and x{i}."
        out.append(("g", i + 2, f"2026-01-{i:03d}", "observation", json.dumps({"formatted": heard, "final": heard, "presented": heard.replace("kiwi", "Kiwi")})))
    return out


def test_state_from_effects_is_what_replay_leaves(spark):
    log = spark.createDataFrame(log_of(40, 120), EVENTS).repartition(5).cache()
    state, of = memory.replay(log).cache(), effects.effects(log).cache()
    assert of.where("op = 'signal' AND size(guard) > 0").count() > 80 and of.where("op = 'delete'").count() > 100
    for kind in ("terms", "misspellings", "retired", "reports"):
        want = getattr(memory, kind)(state)
        got = getattr(effects, kind)(of).select(*want.columns)
        rows = [sorted(map(str, x.collect())) for x in (got, want)]
        assert rows[0] == rows[1] and len(rows[0]) > 20, kind


def test_effects_up_to_a_moment_are_the_memory_then(spark):
    log = spark.createDataFrame(log_of(3, 60, 1), EVENTS)
    of = effects.effects(log).cache()
    want = memory.terms(memory.replay(log.where("seq <= 90")))
    assert sorted(map(str, effects.terms(of.where("seq <= 90")).collect())) == sorted(map(str, want.collect()))


def test_an_empty_log(spark):
    of = effects.effects(spark.createDataFrame([], EVENTS))
    assert [x(of).collect() for x in (effects.terms, effects.misspellings, effects.retired, effects.reports)] == [[]] * 4


def test_batches_of_one_user(spark):
    """A log longer than an Arrow batch goes on where the batch before ended."""
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    log = spark.createDataFrame(log_of(2, 100, 2), EVENTS)
    want = sorted(map(str, effects.effects(log).collect()))
    try:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
        assert sorted(map(str, effects.effects(log).collect())) == want
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
