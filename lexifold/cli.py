"""Command line: python -m lexifold.cli --db FOLDER run|observe|memory|why|add|delete|reset ..."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .operators import memory
from .operators.engine import Engine
from .operators.judge import HttpJudge


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="lexifold")
    p.add_argument("--db", default="lexifold-db", help="folder of the store")
    p.add_argument("--user", default="me")
    sub = p.add_subparsers(dest="command", required=True)
    run = sub.add_parser("run", help="correct a text")
    run.add_argument("text")
    run.add_argument("--asr", default="")
    run.add_argument("--no-llm", action="store_true")
    run.add_argument("--judge-url", default="")
    run.add_argument("--judge-model", default="")
    seen = sub.add_parser("observe", help="learn from an edit")
    for name in ("--asr", "--formatted", "--final"):
        seen.add_argument(name, required=name != "--asr", default="")
    seen.add_argument("--presented")
    sub.add_parser("memory", help="list terms")
    why = sub.add_parser("why", help="list traces")
    why.add_argument("-n", type=int, default=5)
    add = sub.add_parser("add", help="add a term")
    add.add_argument("preferred")
    add.add_argument("--kind")
    add.add_argument("--note")
    sub.add_parser("delete", help="delete a term").add_argument("preferred")
    sub.add_parser("reset", help="begin anew").add_argument("seed", nargs="?")
    return p


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = parser().parse_args(args)
    spark = spark or SparkSession.builder.appName("lexifold").getOrCreate()
    engine, show = Engine(spark, a.db), lambda x: print(json.dumps(x, ensure_ascii=False, default=str))
    if a.command == "run":
        docs = spark.createDataFrame([(a.user, 0, a.text)], "user_id string, doc_id int, text string")
        judge = HttpJudge(a.judge_url, a.judge_model) if a.judge_url and not a.no_llm else None
        r = engine.run(docs, judge).first()
        show({"asr": a.asr, "input": r.text, "output": r.output, "reason": r.reason, "candidates": [c.asDict() for c in r.candidates or []]})
    elif a.command == "observe":
        show(engine.observe(a.user, a.formatted, a.final, a.asr, a.presented))
    elif a.command == "memory":
        for r in memory.public(engine.terms()).where(F.col("user_id") == a.user).collect():
            show(r.asDict())
    elif a.command == "why":
        for r in engine.traces().orderBy("trace_id", ascending=False).limit(a.n).collect():
            show({k: v for k, v in r.asDict().items() if k != "data"} | json.loads(r.data))
    elif a.command == "add":
        report = engine.add_term(a.user, a.preferred, a.kind, a.note)
        show(report)
        return int("error" in report)
    elif a.command == "delete":
        report = engine.delete_term(a.user, a.preferred)
        show(report)
        return int(not report["deleted"])
    else:
        seed = []
        if a.seed:
            lines = [x.strip() for x in open(a.seed, encoding="utf8")]
            seed = [json.loads(x) for x in lines if x and not x.startswith("#")]
        show({"events": engine.reset(seed, a.user)})
    return 0


if __name__ == "__main__":
    sys.exit(main())
