"""Evaluation: cases run as users of one job, what an intervention was, rates, costs and percentiles."""

from __future__ import annotations

import json
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.lexicon import COMMON
from ..sources.shared import kept
from . import correct, memory
from .judge import Judge, judged

# The format of cases, what each kind of step may hold.
STEP_KEYS = {
    "run": {"formatted", "expect_output", "expect_output_any", "expect_decisions", "expect_no_llm"},
    "observe": {"asr", "formatted", "final", "presented", "expect_learned", "expect_confirmed", "expect_reverted", "expect_ignored"},
    "add": {"preferred", "kind", "note"}, "delete": {"preferred"}, "assert_term": {"preferred", "status"}, "assert_absent": {"preferred"},
}
LOOKS = ("run", "assert_term", "assert_absent")


def intervention(text: Column, output: Column, expected: Column, failed: Column) -> Column:
    """no-op, useful, missed or harmful, from the allowed outputs (an array) and whether the judge failed; null without any."""
    same, fine = output == text, F.array_contains(expected, output)
    return (F.when(F.size(expected) <= 0, None).when(F.array_contains(expected, text), F.when(same | fine, "no-op").when(failed, "missed").otherwise("harmful"))
            .when(fine, "useful").when(same | failed, "missed").otherwise("harmful"))


def intervention_counts(kinds: DataFrame) -> DataFrame:
    """One row of counts of (kind, wants): wants tells whether a correction was expected."""
    count = lambda k: F.count_if(F.col("kind") == k).alias(k)
    return kinds.agg(F.count("*").alias("runs"), count("useful"), count("missed"), count("harmful"), F.count_if((~F.col("wants")) & F.col("kind").isNotNull()).alias("noop_expected"), F.count_if(F.col("wants") & F.col("kind").isNotNull()).alias("correction_expected"))


def call_rate(runs: DataFrame) -> DataFrame:
    """Of runs (called, input_tokens, output_tokens, cost): calls, their share in per cent, tokens and cost."""
    n, calls = F.count("*"), F.count_if("called")
    return runs.agg(calls.alias("calls"), F.when(n > 0, F.round(100 * calls / n, 1)).otherwise(F.lit(0.0)).alias("call_rate"), F.coalesce(F.sum(F.col("input_tokens") + F.col("output_tokens")), F.lit(0)).alias("tokens"), F.round(F.coalesce(F.sum("cost"), F.lit(0.0)), 6).alias("cost"))


def exclusive_percentile(values: Column, q: int) -> Column:
    """The q-th percentile of a sorted array by the exclusive method; one value is itself, none is 0."""
    n = F.size(values)
    j = F.greatest(F.lit(1), F.least(F.floor(q * (n + 1) / 100).cast("int"), n - 1))
    d = q * (n + 1) - 100 * j
    between = (F.element_at(values, j) * (100 - d) + F.element_at(values, j + 1) * d) / 100
    return F.when(n == 0, 0.0).when(n == 1, F.element_at(values, 1)).otherwise(F.round(between, 2))


#: Ranges that the values of a group are counted in.
RANGES = 64


def percentiles(rows: DataFrame, by: str, value: str, qs: tuple[int, ...] = (50, 95)) -> DataFrame:
    """Percentiles by the exclusive method, p<q> for each group; nulls take no part.

    Equal values are counted together first. Then values are counted in ranges of each group, which tell in which range
    the two values of a percentile stand; only those ranges are sorted.
    """
    v = rows.where(F.col(value).isNotNull()).groupBy(by, F.col(value).alias("v")).agg(F.count("*").alias("c"))
    # kept, as two runs of the same sketch may cut elsewhere, and all that follows has to see the same ranges
    edges = kept(v.groupBy(by).agg(F.percentile_approx("v", [i / RANGES for i in range(1, RANGES)], 1000).alias("edges"), F.sum("c").alias("n")))
    ranged = v.alias("v").join(edges.alias("e"), F.col(f"v.{by}").eqNullSafe(F.col(f"e.{by}"))).select(F.col(f"v.{by}").alias("g"), "v", "c", "n", F.size(F.filter("edges", lambda x: x < F.col("v"))).alias("range"))
    sums = ranged.groupBy("g", "range", "n").agg(F.sum("c").alias("c"))
    past = F.coalesce(F.sum("c").over(Window.partitionBy("g").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = sums.withColumn("before", past)
    wanted = []
    for q in qs:
        at = F.col("n") + 1
        j = F.greatest(F.lit(1), F.least(F.floor(q * at / 100), F.col("n") - 1))
        wanted += [F.struct(F.lit(q).alias("q"), F.least(p, F.col("n")).alias("place"), w.alias("weight")) for p, w in ((j, 100 - (q * at - 100 * j)), (j + 1, q * at - 100 * j))]
    places = sums.select("g", "range", "n", "before", "c", F.explode(F.array(*wanted)).alias("w")).where("w.place > before AND w.place <= before + c").select("g", "range", "n", "before", "w.*")
    needed = ranged.join(places.select(F.col("g").alias("g2"), F.col("range").alias("r2")).distinct(), F.col("g").eqNullSafe(F.col("g2")) & (F.col("range") == F.col("r2"))).select("g", "range", "v", "c")
    own = Window.partitionBy("g", "range").orderBy("v")
    run = needed.withColumn("until", F.sum("c").over(own.rowsBetween(Window.unboundedPreceding, 0)))
    hit = places.alias("p").join(run.alias("r"), F.col("p.g").eqNullSafe(F.col("r.g")) & (F.col("p.range") == F.col("r.range"))).where("place > before + until - c AND place <= before + until")
    both = hit.select("p.g", "q", "n", (F.col("v") * F.col("weight")).alias("part"), "v").groupBy("g", "q").agg(F.when(F.max("n") == 1, F.max("v")).otherwise(F.round(F.sum("part") / 100, 2)).alias("p"))
    return both.groupBy(F.col("g").alias(by)).agg(*(F.max(F.when(F.col("q") == q, F.col("p"))).alias(f"p{q}") for q in qs))


def checked_steps(cases: Iterable[dict]) -> list[dict]:
    """The cases, each step with no other keys than it may have."""
    for case in (out := list(cases)):
        for step in case["steps"]:
            if step["do"] not in STEP_KEYS:
                raise ValueError(f"{case['id']}: no step {step['do']!r}")
            if unknown := set(step) - STEP_KEYS[step["do"]] - {"do"}:
                raise ValueError(f"{case['id']}: step {step['do']} may not have {', '.join(sorted(unknown))}")
    return out


def run_cases(spark: SparkSession, cases: Iterable[dict], personas: dict[str, list[dict]] | None = None, judge: Judge | None = None, words: frozenset[str] = COMMON) -> list[dict]:
    """Runs all cases in one job: each case is a user, each look at its memory a snapshot, and each snapshot a user to
    the correction. A case has id, category, seed (events, or the name of a persona), steps, and maybe mode "no-llm".

    Gives a record for each case: id, passed, degraded, failures, and its runs with output, decisions and kind.
    """
    cases = checked_steps(cases)
    log, looks = [], []
    for case in cases:
        seed = (personas or {})[case["seed"]] if isinstance(case["seed"], str) else case["seed"]
        events = [(e["type"], e["payload"]) for e in seed]
        for i, step in enumerate(case["steps"]):
            kind, body = step["do"], {k: v for k, v in step.items() if k != "do" and not k.startswith("expect")}
            if kind in LOOKS:
                events.append(("look", body))
                looks.append((case["id"], len(events), i, f"{case['id']}#{len(events)}", step.get("formatted")))
            else:
                events.append(({"observe": "observation", "add": "add_term", "delete": "delete_term"}[kind], body))
                looks.append((case["id"], len(events), i, None, None))
        log += [(case["id"], n + 1, "2000-01-01", kind, json.dumps(body, ensure_ascii=False)) for n, (kind, body) in enumerate(events)]
    state = memory.snapshots(spark.createDataFrame(log, "user_id string, seq long, ts string, type string, payload string"), words).cache()
    where = {(c, seq): (i, name) for c, seq, i, name, _ in looks}
    seen = state.where("part <> 'report'").withColumn("user_id", F.concat("user_id", F.lit("#"), F.col("seq").cast("string")))
    texts = [(name, i, t) for _, _, i, name, t in looks if t is not None]
    docs = spark.createDataFrame(texts, "user_id string, doc_id int, text string")
    known, spelled = memory.terms(seen).cache(), memory.misspellings(seen).cache()
    verdicts, calls = None, {}
    if judge is not None and judge.available:
        quiet = [c["id"] for c in cases if c.get("mode") == "no-llm"]
        asked = correct.judge_requests(docs, correct.decisions(docs, known, spelled, words=words), known)
        verdicts = judged(asked.where(~F.substring_index("user_id", "#", 1).isin(quiet)), judge).cache()
        calls = {(r.user_id, r.doc_id): r for r in verdicts.select("user_id", "doc_id", "input_tokens", "output_tokens", "cost").distinct().collect()}
    results = {(r.user_id, r.doc_id): r for r in correct.checked(correct.correct(docs, known, spelled, verdicts, words)).collect()}
    held: dict[str, dict[str, str]] = {}
    for r in known.select("user_id", "term", "status").collect():
        held.setdefault(r.user_id, {})[r.term] = r.status
    said = {(r.user_id, r.seq): json.loads(r.report) for r in memory.reports(state).collect()}
    at = {(c, i): (seq, name) for (c, seq), (i, name) in where.items()}
    out = []
    for case in cases:
        failures: list[str] = []
        runs = []
        for i, step in enumerate(case["steps"]):
            seq, name = at[case["id"], i]
            if step["do"] == "run":
                r = results[name, i]
                expected = [step["expect_output"]] if "expect_output" in step else step.get("expect_output_any", [])
                spans = r.candidates or []
                runs.append({"text": step["formatted"], "output": r.output, "expected": expected, "decisions": [(c.text, c.decision) for c in spans], "called": (name, i) in calls})
                if expected and r.output not in expected:
                    failures.append(f"output: {r.output!r}")
                for text, code in step.get("expect_decisions", {}).items():
                    got = next((c.decision for c in spans if c.text.casefold() == text.casefold()), None)
                    if got is None or not got.startswith(code):
                        failures.append(f"decision on {text!r}: {got}")
                if step.get("expect_no_llm") and (name, i) in calls:
                    failures.append("the judge was called")
            elif step["do"] == "observe":
                report = said[case["id"], seq]
                for part in ("learned", "confirmed", "reverted"):
                    failures += [f"not {part}: {x}" for x in step.get(f"expect_{part}", []) if all(e["preferred"] != x for e in report[part])]
                failures += [f"not ignored: {x}" for x in step.get("expect_ignored", []) if all((e["new"], e["reason"]) != (x["new"], x["reason"]) for e in report["ignored"])]
            elif step["do"] in ("assert_term", "assert_absent"):
                status = held.get(name, {}).get(memory.fold_name(step["preferred"]))
                if (status is None) != (step["do"] == "assert_absent") or (status is not None and step.get("status", status) != status):
                    failures.append(f"{step['preferred']}: {status}")
        down = any(d == "llm-error" for r in runs for _, d in r["decisions"])
        excused = bool(failures) and all(f.startswith("output: ") or f.endswith("llm-error") for f in failures)
        out.append({"id": case["id"], "category": case.get("category"), "passed": not failures, "degraded": down and excused, "failures": failures, "runs": runs})
    state.unpersist()
    return out


def summary(spark: SparkSession, records: list[dict]) -> dict:
    """Counts over the records of run_cases."""
    rows = [(r["text"], x["output"], x["expected"], any(d == "llm-error" for _, d in x["decisions"])) for r0 in records for x in r0["runs"] for r in [x]]
    kinds = spark.createDataFrame(rows, "text string, output string, expected array<string>, failed boolean").select(intervention(F.col("text"), F.col("output"), F.col("expected"), F.col("failed")).alias("kind"), (~F.array_contains("expected", F.col("text"))).alias("wants"))
    return {"cases": len(records), "passed": sum(r["passed"] for r in records), "degraded": sum(r["degraded"] for r in records)} | intervention_counts(kinds).first().asDict()
