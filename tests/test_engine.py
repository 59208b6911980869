import json
import os

import pytest
from pyspark.sql import functions as F

from lexifold import cli
from lexifold.operators.engine import Conflict, Engine
from lexifold.sources import settings
from lexifold.sources.log import append_events, read_events, read_seed, read_takes, write_results, write_traces

SEED = [{"type": "add_term", "payload": {"preferred": "Kivi", "kind": "product"}}, {"type": "observation", "payload": {"formatted": "Ask Joonas.", "final": "Ask Jonas."}}]


def new(spark, *events):
    rows = [("u", i, kind, payload if isinstance(payload, str) else json.dumps(payload)) for i, (kind, payload) in enumerate(events)]
    return spark.createDataFrame(rows, "user_id string, ord int, type string, payload string").withColumn("ts", F.to_timestamp(F.lit("2026-01-01")))


def state(engine):
    return sorted(map(str, engine.state().drop("created", "updated").collect()))


def test_submit_is_all_or_nothing(spark, tmp_path):
    e = Engine(spark, str(tmp_path / "db"))
    edit = {"formatted": "Ask Joonas now.", "final": "Ask Jonas now."}
    said = e.submit(new(spark, ("add_term", {"preferred": " Maarit "}), ("observation", edit), ("add_term", {"preferred": "a-b"}), ("delete_term", {"preferred": "Nobody"}), ("observation", {"formatted": " ", "final": ""}), ("observation", edit), ("set_trust", {"preferred": "Nobody", "trust": 2})))
    reports = [json.loads(r.report) for r in said.collect()]
    assert "error" in reports[2] and reports[3] == {"deleted": False} and "error" in reports[6]
    assert [(r.seq, r.type) for r in e.events().orderBy("seq").collect()] == [(1, "add_term"), (2, "observation"), (6, "observation"), (7, "set_trust")]
    assert {r.preferred: r.status for r in e.terms().collect()} == {"Maarit": "trusted", "Jonas": "trusted"}
    before = state(e)
    for bad in (("observation", "{no json"), ("what", {}), ("observation", {"final": "x"})):
        with pytest.raises(Exception):
            e.submit(new(spark, ("add_term", {"preferred": "Other"}), bad))
    assert state(e) == before and e.events().count() == 4
    e.submit(new(spark, ("delete_term", {"preferred": "MAARIT"})))
    assert [r.seq for r in e.events().orderBy("seq").collect()] == [1, 2, 6, 7, 8] and e.terms().count() == 1
    before = state(e)
    assert e.replay() == 5 and state(e) == before
    e.compact()
    assert state(e) == before and e.events().count() == 5


def test_two_writers(spark, tmp_path):
    a, b = Engine(spark, str(tmp_path / "db")), Engine(spark, str(tmp_path / "db"))
    seen = b.manifest()
    a.add_term("u", "Maarit")
    b.manifest = lambda: seen
    with pytest.raises(Conflict):
        b.add_term("u", "Kivi")
    assert [r.preferred for r in a.terms().collect()] == ["Maarit"]


def test_reset_run_and_clear(spark, tmp_path):
    e = Engine(spark, str(tmp_path / "db"))
    assert e.reset(SEED, "u") == 2 and {r.name: r.n for r in e.counts().collect()} == {"events": 2, "terms": 2, "misspellings": 1, "retired": 0, "traces": 0}
    with pytest.raises(Exception):
        e.reset([{"type": "what", "payload": {}}], "u")
    assert e.terms().count() == 2
    docs = spark.createDataFrame([("u", 1, "Hand me the kivi demo"), ("u", 2, "nothing here"), ("v", 1, "Kivy runs")], "user_id string, doc_id int, text string")
    out = e.run(docs)
    assert {(r.user_id, r.doc_id): r.reason for r in out.collect()} == {("u", 1): "", ("u", 2): "no-candidates", ("v", 1): "no-candidates"}
    assert e.traces().count() == 3 and e.why(0).count() == 1 and len({r.trace_id for r in e.traces().collect()}) == 3
    e.clear_state()
    assert e.terms().count() == 0 and e.traces().count() == 3 and e.replay() == 2 and e.terms().count() == 2
    e.clear_all()
    assert {r.n for r in e.counts().collect()} == {0}


def test_command_line(spark, tmp_path, capsys):
    seed = tmp_path / "seed.jsonl"
    seed.write_text("# note\n\n" + "\n".join(map(json.dumps, SEED)))
    run = lambda *a: (cli.main(["--db", str(tmp_path / "db"), *a], spark), [json.loads(x) for x in capsys.readouterr().out.splitlines() if x.startswith("{")])
    assert run("reset", str(seed)) == (0, [{"events": 2}])
    assert run("add", "a-b")[0] == 1 and run("add", "Maarit", "--note", "x") == (0, [{"term": "Maarit", "status": "trusted"}])
    code, (r,) = run("run", "Ask Marit now.", "--no-llm")
    assert code == 0 and r["output"] == "Ask Maarit now." and r["candidates"][0]["decision"] == "applied"
    assert run("observe", "--formatted", "Ask Joonas.", "--final", "Ask Jonas.")[1][0]["learned"]
    assert [x["preferred"] for x in run("memory")[1]] == ["Jonas", "Kivi", "Maarit"]
    assert run("why", "-n", "1")[1][0]["output"] == "Ask Maarit now."
    assert run("delete", "Kivi")[0] == 0 and run("delete", "Kivi")[0] == 1


def test_sources(spark, tmp_path):
    path = str(tmp_path / "log")
    rows = spark.createDataFrame([("u", "b", "2"), ("u", "a", "1")], "user_id string, type string, payload string").withColumn("ts", F.to_timestamp(F.lit("2026-01-01")))
    append_events(rows, path)
    append_events(rows, path, spark.read.parquet(path))
    assert [(r.seq, r.type) for r in read_events(spark, path).collect()] == [(1, "a"), (2, "b"), (3, "a"), (4, "b")]
    (tmp_path / "seed").write_text('# x\n\n{"type": "add_term", "payload": {"preferred": "é"}}\n')
    assert read_seed(spark, str(tmp_path / "seed")).first().payload == '{"preferred": "é"}'
    (tmp_path / "bad").write_text("{")
    with pytest.raises(json.JSONDecodeError):
        read_seed(spark, str(tmp_path / "bad"))
    (tmp_path / "takes.json").write_text(json.dumps({"about": 1, "takes": [{"asr": "a", "formatted": "A."}, {"asr": "b", "formatted": "B.", "x": 1}]}, indent=1))
    assert [tuple(r) for r in read_takes(spark, str(tmp_path / "takes.json")).collect()] == [(0, "a", "A."), (1, "b", "B.")]
    traces = spark.createDataFrame([("u", 2, "i2", "o", "{}"), ("u", 1, "i1", "o", "{}")], "user_id string, doc_id int, input string, output string, data string")
    write_traces(traces, str(tmp_path / "traces"), 5)
    assert [(r.trace_id, r.input) for r in spark.read.parquet(str(tmp_path / "traces")).orderBy("trace_id").collect()] == [(5, "i1"), (6, "i2")]
    write_results(spark, [{"id": "x", "passed": True}], {"passed": 1}, str(tmp_path / "out"), "-det")
    assert json.loads(spark.read.text(str(tmp_path / "out/results-det")).first().value)["passed"]


def test_settings(tmp_path):
    (tmp_path / "env").write_text("# no\nA=1\n B = 'two words' \nC=\"x\"\nnothing\nD=\n=5\n")
    into = {"A": "kept"}
    settings.load(str(tmp_path / "env"), into)
    settings.load(str(tmp_path / "absent"), into)
    assert into == {"A": "kept", "B": "two words", "C": "x", "D": ""}
    os_ = {"n": " 3 ", "f": "2.5", "bad": "x", "blank": " "}
    assert (settings.number("n", 1, os_), settings.number("f", 1.0, os_), settings.number("bad", 7, os_), settings.number("blank", 7, os_), settings.number("none", 7, os_)) == (3, 2.5, 7, 7, 7)
    assert os.environ is not into
