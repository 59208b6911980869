"""A store of users' logs and memories in a folder that all executors see, changed by commits.

Each commit writes the new events and the new state of the users they touch into folders of its own, and last of all a
manifest that names what is valid; a reader only sees what the latest manifest names. Creating a manifest that exists
fails, so of two writers one has to begin anew, and a job that fails (as for a payload that can't be read) leaves nothing
that is seen. State is kept per commit for the users touched; a user's state is that of the latest commit that has it.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.lexicon import COMMON
from ..sources.log import EVENTS, numbered, row_counts, seed_events
from . import correct, memory
from .judge import Judge, judged

EMPTY = {"log": [], "state": [], "traces": []}
TRACE = "trace_id long, user_id string, ts timestamp, input string, output string, data string"


class Conflict(RuntimeError):
    """Another writer has committed in between."""


class Engine:
    def __init__(self, spark: SparkSession, folder: str, words: frozenset[str] = COMMON):
        self.spark, self.folder, self.words = spark, folder, words
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(folder).getFileSystem(spark._jsc.hadoopConfiguration())

    # -- manifests ----------------------------------------------------------------------------------------------
    def _commits(self) -> list[int]:
        at = self._path(f"{self.folder}/commits")
        return sorted(int(f.getPath().getName()) for f in self._fs.listStatus(at)) if self._fs.exists(at) else []

    def manifest(self) -> tuple[int, dict]:
        done = self._commits()
        if not done:
            return 0, {k: list(v) for k, v in EMPTY.items()}
        stream = self._fs.open(self._path(f"{self.folder}/commits/{done[-1]:09d}"))
        try:
            text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return done[-1], EMPTY | json.loads(text)

    def _commit(self, after: int, manifest: dict) -> None:
        try:
            out = self._fs.create(self._path(f"{self.folder}/commits/{after + 1:09d}"), False)
        except Exception as e:
            raise Conflict(f"commit {after + 1} is taken") from e
        try:
            out.write(json.dumps(manifest).encode())
        finally:
            out.close()

    def _written(self, table: DataFrame, kind: str) -> str:
        name = f"{kind}/{uuid.uuid4().hex}"
        table.write.parquet(f"{self.folder}/{name}")
        return name

    def _read(self, names: list[str], schema: str) -> DataFrame:
        """The tables of a manifest, with the place of each in it."""
        whole = None
        for i, n in enumerate(names):
            one = self.spark.read.schema(schema).parquet(f"{self.folder}/{n}").withColumn("commit", F.lit(i))
            whole = one if whole is None else whole.union(one)
        return self.spark.createDataFrame([], f"{schema}, commit int") if whole is None else whole

    # -- reading ------------------------------------------------------------------------------------------------
    def events(self) -> DataFrame:
        return self._read(self.manifest()[1]["log"], EVENTS).drop("commit")

    def state(self, names: list[str] | None = None) -> DataFrame:
        rows = self._read(self.manifest()[1]["state"] if names is None else names, memory.STATE)
        last = rows.groupBy("user_id").agg(F.max("commit").alias("commit"))
        return rows.join(last, ["user_id", "commit"]).drop("commit").where("part <> 'user'")

    def terms(self) -> DataFrame:
        return memory.terms(self.state())

    def counts(self) -> DataFrame:
        state = self.state()
        return row_counts({"events": self.events(), "terms": memory.terms(state), "misspellings": memory.misspellings(state), "retired": memory.retired(state), "traces": self.traces()})

    def traces(self) -> DataFrame:
        return self._read(self.manifest()[1]["traces"], TRACE).drop("commit")

    def why(self, n: int = 20) -> DataFrame:
        return memory.top_traces(self.traces(), n)

    # -- writing ------------------------------------------------------------------------------------------------
    def submit(self, new: DataFrame) -> DataFrame:
        """Folds and logs new events (user_id, ts, type, payload, ord), all or none; gives (user_id, seq, report).

        Terms that can't be kept, deletes of terms that aren't there and blank observations are reported, not logged.
        """
        after, manifest = self.manifest()
        events = numbered(new, self._read(manifest["log"], EVENTS).drop("commit"))
        held = self._written(events, "staged")
        events = self.spark.read.schema(EVENTS).parquet(f"{self.folder}/{held}")
        folded = self._written(memory.fold_onto(self.state(manifest["state"]), events, self.words), "folded")
        folded = self.spark.read.schema(memory.STATE).parquet(f"{self.folder}/{folded}")
        logged = folded.where("part = 'logged'").select("user_id", "seq", F.col("report").alias("kept"))
        mark = events.select("user_id").distinct().selectExpr("user_id", "'user' AS part")
        state = folded.where("part IN ('term', 'misspelling', 'retired')").unionByName(mark, allowMissingColumns=True)
        log = self._written(events.join(logged, ["user_id", "seq"]).withColumn("payload", F.col("kept")).select(*(c.split()[0] for c in EVENTS.split(", "))), "log")
        self._commit(after, manifest | {"log": [*manifest["log"], log], "state": [*manifest["state"], self._written(state, "state")]})
        return folded.where("part IN ('report', 'refused')").select("user_id", "seq", "report").orderBy("user_id", "seq")

    def _one(self, user: str, kind: str, payload: dict) -> dict:
        new = seed_events(self.spark, [{"type": kind, "payload": payload}], user).withColumn("ord", F.lit(0))
        return json.loads(self.submit(new).first().report)

    def observe(self, user: str, formatted: str, final: str, asr: str = "", presented: str | None = None) -> dict:
        return self._one(user, "observation", {"asr": asr, "formatted": formatted, "final": final} | ({"presented": presented} if presented else {}))

    def add_term(self, user: str, preferred: str, kind: str | None = None, note: str | None = None) -> dict:
        return self._one(user, "add_term", {"preferred": preferred, "kind": kind, "note": note})

    def set_trust(self, user: str, preferred: str, trust: int) -> dict:
        return self._one(user, "set_trust", {"preferred": preferred, "trust": trust})

    def delete_term(self, user: str, preferred: str) -> dict:
        return self._one(user, "delete_term", {"preferred": preferred})

    def replay(self) -> int:
        """Folds the whole log anew in place of the state; gives the number of events."""
        after, manifest = self.manifest()
        events = self._read(manifest["log"], EVENTS).drop("commit")
        state = memory.replay(events, self.words).where("part <> 'report'")
        self._commit(after, manifest | {"state": [self._written(state, "state")]})
        return events.count()

    def reset(self, seed: list[dict] = (), user: str = "seed") -> int:
        """Begins anew with the events of a seed; what can't be folded leaves everything as it was."""
        after, _ = self.manifest()
        events = numbered(seed_events(self.spark, list(seed), user).withColumn("ord", F.col("seq")))
        log = self._written(events, "log")
        state = self._written(memory.replay(events, self.words).where("part <> 'report'"), "state")
        self._commit(after, EMPTY | {"log": [log], "state": [state]})
        return len(seed)

    def clear_state(self) -> None:
        """Forgets what was folded; the log and the traces stay."""
        after, manifest = self.manifest()
        self._commit(after, manifest | {"state": []})

    def clear_all(self) -> None:
        self._commit(self.manifest()[0], dict(EMPTY))

    def compact(self) -> None:
        """Writes log, state and traces into one table each. Tables of an older schema get its new columns as nulls."""
        after, manifest = self.manifest()
        keep = {"log": self.events(), "state": self.state(), "traces": self.traces()}
        self._commit(after, {k: [self._written(v, k)] for k, v in keep.items()})
        del manifest

    # -- correction ---------------------------------------------------------------------------------------------
    def run(self, docs: DataFrame, judge: Judge | None = None, trace: bool = True) -> DataFrame:
        """Corrects docs (user_id, doc_id, text) against the memories of their users, and keeps a trace of each."""
        state = self.state()
        terms, spelled = memory.terms(state), memory.misspellings(state)
        verdicts = None
        if judge is not None and judge.available:
            verdicts = judged(correct.judge_requests(docs, correct.decisions(docs, terms, spelled, words=self.words), terms), judge)
            verdicts = self.spark.read.parquet(f"{self.folder}/{self._written(verdicts, 'verdicts')}")
        result = correct.checked(correct.correct(docs, terms, spelled, verdicts, self.words))
        result = self.spark.read.schema(result.schema).parquet(f"{self.folder}/{self._written(result, 'results')}")
        if trace:
            after, manifest = self.manifest()
            last = self.traces().agg(F.coalesce(F.max("trace_id"), F.lit(0))).first()[0]
            rows = correct.traces(result).withColumn("ts", F.date_trunc("second", F.current_timestamp())).withColumn("trace_id", F.monotonically_increasing_id() + last + 1)
            name = self._written(rows.select(*(c.split()[0] for c in TRACE.split(", "))), "traces")
            self._commit(after, manifest | {"traces": [*manifest["traces"], name]})
        return result
