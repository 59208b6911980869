"""Folding an event log into a memory: events(user_id, seq, ts, type, payload JSON) to terms, misspellings, retired, reports.

The fold is one grouped pass over the log by user, in the order of seq, as each observation is scored against what the
earlier ones left; what can be told without order, or composes, is DataFrame operations. Payloads are read and checked by
Spark before the fold (sources.log.typed): one that isn't valid or an unknown type fails the job, and so nothing is written.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions import text as T
from ..functions.lexicon import COMMON
from ..sources.log import as_logged, plain, typed
from .kernel import Memory, Spelling, Term
from .rules import ACTIVE, GUARD_WORDS, check_term, fold_name, phrase_key

STATE = """user_id string, part string, term string, preferred string, kind string, note string, trust int, source string, created string,
updated string, misspelling string, seen int, vetoes int, guard array<string>, key string, seq long, report string"""
COLUMNS = [c.split()[0] for c in STATE.replace("\n", " ").split(", ")]
_KINDS = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "array<string>": pa.list_(pa.string())}
_ARROW = pa.schema([(c.split()[0], _KINDS[c.split()[1]]) for c in STATE.replace("\n", " ").split(", ")])
#: Rows that are handed out together.
OUT = 4096


def parts(user: str, memory: Memory, reports: Iterable[tuple[int, dict]] = (), mark: int | None = None) -> list[dict]:
    """The parts of a memory as rows of STATE; seq is `mark` for all but reports."""
    out: list[dict] = []
    for cf, t in sorted(memory.terms.items()):
        base = {"user_id": user, "term": cf, "preferred": t.preferred, "seq": mark}
        out.append(base | {"part": "term", "kind": t.kind, "note": t.note, "trust": t.trust, "source": t.source, "created": t.created, "updated": t.updated, "key": phrase_key(t.preferred)})
        out += [base | {"part": "misspelling", "misspelling": m, "seen": s.seen, "vetoes": s.vetoes, "guard": s.guard, "updated": s.last, "key": phrase_key(m)} for m, s in sorted(t.spellings.items())]
    out += [{"user_id": user, "part": "retired", "term": cf, "preferred": p, "key": k, "updated": ts, "seq": mark} for cf, (p, k, ts) in sorted(memory.retired.items())]
    out += [{"user_id": user, "part": "report", "seq": n, "report": json.dumps(r, ensure_ascii=False)} for n, r in reports]
    return out


def rows(user: str, memory: Memory, reports: Iterable[tuple[int, dict]] = (), mark: int | None = None) -> pd.DataFrame:
    """The same as a frame."""
    frame = pd.DataFrame(parts(user, memory, reports, mark), columns=COLUMNS)
    for c in ("trust", "seen", "vetoes", "seq"):
        frame[c] = frame[c].astype("Int64")
    return frame.astype(object).where(frame.notna(), None)


def remembered(state: Iterable[dict], common: frozenset[str] = COMMON) -> Memory:
    """A memory from its rows."""
    memory, children = Memory(common), []
    for r in state:
        if r["part"] == "term":
            memory.put(r["term"], Term(r["preferred"], int(r["trust"]), r["source"], r["created"], r["updated"], r["kind"], r["note"]))
        elif r["part"] == "misspelling":
            children.append(r)
        elif r["part"] == "retired":
            memory.retire(r["term"], r["preferred"], r["key"], r["updated"])
    for r in children:
        memory.spell(memory.terms[r["term"]], r["misspelling"], Spelling(int(r["seen"]), int(r["vetoes"]), [*r["guard"]], r["updated"]))
    return memory


def played(memory: Memory, log: pd.DataFrame) -> Iterator[tuple[int, dict]]:
    for e in log.sort_values("seq").itertuples():
        yield e.seq, memory.apply(e.type, plain(e.payload), str(e.ts))


def keyed(events: DataFrame, others: tuple[str, ...] = ()) -> DataFrame:
    """Events by a user_id that isn't null, with their payload as a struct; of `others`, types that are no events, too."""
    return events.select(F.coalesce(F.col("user_id").cast("string"), F.lit("")).alias("user_id"), "seq", F.col("ts").cast("string"), "type", typed(others=others).alias("payload"))


def by_user(rows_: DataFrame) -> DataFrame:
    """Rows dealt by user to as many parts as a shuffle has. The number is given, as Spark would else join parts of few
    bytes, and so run a fold, which takes long for its bytes, in a few tasks."""
    user = F.coalesce(F.col("user_id").cast("string"), F.lit(""))
    return rows_.repartition(int(rows_.sparkSession.conf.get("spark.sql.shuffle.partitions")), user)


def replay(events: DataFrame, words: frozenset[str] = COMMON) -> DataFrame:
    """Every part of the state after the last event, by user; and a report for each event."""

    def fold(log: pd.DataFrame) -> pd.DataFrame:
        memory = Memory(words)
        reports = list(played(memory, log))
        return rows(str(log["user_id"].iloc[0]), memory, reports)

    return keyed(events).groupBy("user_id").applyInPandas(fold, STATE)


def snapshots(events: DataFrame, words: frozenset[str] = COMMON) -> DataFrame:
    """The state before each event of type "look", its seq in all rows of it; and reports of all other events."""

    def fold(log: pd.DataFrame) -> pd.DataFrame:
        memory, out, reports, user = Memory(words), [], [], str(log["user_id"].iloc[0])
        for e in log.sort_values("seq").itertuples():
            if e.type == "look":
                out.append(rows(user, memory, mark=e.seq))
                continue
            payload, refused = memory.admit(e.type, plain(e.payload))
            reports.append((e.seq, refused if refused is not None else memory.apply(e.type, payload, str(e.ts))))
        return pd.concat([*out, rows(user, Memory(words), reports)])

    return keyed(events, ("look",)).groupBy("user_id").applyInPandas(fold, STATE)


def fold_onto(state: DataFrame, events: DataFrame, words: frozenset[str] = COMMON) -> DataFrame:
    """The state of the users that have new events, with a report for each event; events that aren't to be logged have a
    report of part "refused", all others their payload as it is logged, of part "logged".

    A user's state and then new events, in order, go through a task as a stream of batches, in as many tasks as a shuffle
    has parts: events are small, but each takes its time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[dict] = []
        user, before, memory = None, [], None

        def batch() -> pa.RecordBatch:
            made = pa.RecordBatch.from_pylist(out, schema=_ARROW)
            out.clear()
            return made

        for rows_ in batches:
            for of, seq, ts, kind, payload, was in zip(*(c.to_pylist() for c in rows_.columns), strict=True):
                if of != user:
                    out += parts(user, memory) if memory else []
                    user, before, memory = of, [], None
                if was is not None:
                    before.append(was)
                    continue
                if memory is None:
                    memory = remembered(before, words)
                payload, refusal = memory.admit(kind, payload)
                said = {"refused": refusal} if refusal is not None else {"report": memory.apply(kind, payload, str(ts)), "logged": as_logged(kind, payload)}
                out += [{"user_id": user, "part": part, "seq": seq, "report": json.dumps(x, ensure_ascii=False)} for part, x in said.items()]
                if len(out) >= OUT:
                    yield batch()
        out += parts(user, memory) if memory else []
        yield batch()

    new = events.select(F.coalesce(F.col("user_id").cast("string"), F.lit("")).alias("user_id"), "seq", F.col("ts").cast("string"), "type", "payload")
    types = dict(new.dtypes)
    old = state.select("user_id", F.struct(*COLUMNS).alias("was")).select("user_id", *(F.lit(None).cast(types[c]).alias(c) for c in new.columns[1:]), "was")
    both = old.union(new.withColumn("was", F.lit(None).cast(old.schema["was"].dataType)))
    # payloads are read once they are dealt: a table of few files would have few tasks for it
    dealt = by_user(both).withColumn("payload", F.when(F.col("was").isNull(), typed())).sortWithinPartitions("user_id", F.col("was").isNull(), "seq", "type", "payload")
    return dealt.mapInArrow(run, STATE)


def terms(state: DataFrame) -> DataFrame:
    return state.where("part = 'term'").select("user_id", "term", "preferred", "kind", "note", "trust", status(F.col("trust")).alias("status"), "source", "created", "updated", "key")


def public(terms_: DataFrame) -> DataFrame:
    """What users see of their terms, in order."""
    return terms_.select("user_id", "preferred", "kind", "note", "trust", "status", "source", "updated", "term").orderBy("user_id", "term").drop("term")


def lookup(terms_: DataFrame, user: str, preferred: str) -> DataFrame:
    return terms_.where((F.col("user_id") == user) & (F.col("term") == fold_name(preferred)))


@F.arrow_udf(StringType())
def folded_name(name: pa.Array) -> pa.Array:
    """rules.fold_name of a column: composed (NFC), then case-folded, of all of Unicode; Spark has no function for either."""
    return pa.array([None if x is None else fold_name(x) for x in name.to_pylist()], pa.string())


def found(names: DataFrame, terms_: DataFrame) -> DataFrame:
    """Names (user_id, name, ...) with the terms of their users that have the same folded name, however their accents are
    written; null where there's none, as for a name that is null."""
    return names.withColumn("term", folded_name("name")).join(terms_.select("user_id", "term", "preferred"), ["user_id", "term"], "left")


def first_by_key(terms_: DataFrame) -> DataFrame:
    """For each user and key the first term, by its folded name, whose preferred spelling has the key."""
    return terms_.groupBy("user_id", "key").agg(F.min_by("preferred", "term").alias("preferred"))


def misspellings(state: DataFrame) -> DataFrame:
    return state.where("part = 'misspelling'").select("user_id", "term", "misspelling", "seen", "vetoes", "guard", F.col("updated").alias("last_ts"), "key")


def retired(state: DataFrame) -> DataFrame:
    return state.where("part = 'retired'").select("user_id", "term", "preferred", "key", F.col("updated").alias("ts"))


def reports(state: DataFrame) -> DataFrame:
    return state.where("part = 'report'").select("user_id", "seq", "report")


def status(trust: Column) -> Column:
    return F.when(trust >= ACTIVE, "trusted").when(trust > 0, "watching").otherwise("muted")


def hydrate(terms_: DataFrame, misspellings_: DataFrame) -> DataFrame:
    """Each term with a map of its misspellings."""
    entry = F.struct("misspelling", F.struct("seen", "vetoes", "guard"))
    children = misspellings_.groupBy("user_id", "term").agg(F.map_from_entries(F.array_sort(F.collect_list(entry))).alias("misspellings"))
    return terms_.join(children, ["user_id", "term"], "left")


def accepted(names: DataFrame) -> DataFrame:
    """preferred to (preferred as kept, error): the checks that a new term passes before its event is logged."""
    kind = "preferred string, error string"

    def check(batches: Iterable[pd.DataFrame]) -> Iterable[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame([check_term(x or "") for x in b["preferred"]], columns=["preferred", "error"])

    return names.select("preferred").mapInPandas(check, kind)


def said_something(observations: DataFrame) -> DataFrame:
    """Observations (formatted, final) that aren't blank on both sides; only these are logged."""
    said = lambda c: F.coalesce(F.col(c), F.lit("")).rlike(T.NO_SPACE)
    return observations.where(said("formatted") | said("final"))


#: Ops that are folded together before blocks are put in order.
BLOCK = 256


def _steps() -> Callable[[Column, Column], Column]:
    """A run of ops (new is a term of trust 0 where there is none) as one function of the trust before: `none` is its value where there was no term, else it is
    greatest(x + shift, floor), parts that are null being left out, and no term if both are. Runs compose."""
    def then(f: Column, g: Column) -> Column:
        at = lambda x: F.greatest(x + g["shift"], g["floor"])
        gone = f["shift"].isNull() & f["floor"].isNull()
        return F.struct(
            F.when(f["none"].isNull(), g["none"]).otherwise(at(f["none"])).alias("none"),
            F.when(~gone, f["shift"] + g["shift"]).alias("shift"),
            F.when(gone, g["none"]).otherwise(F.greatest(f["floor"] + g["shift"], g["floor"])).alias("floor"))

    return then


def _step(op: Column, value: Column) -> Column:
    number = value.cast("long")
    return F.struct(
        F.when(op == "add", F.lit(ACTIVE)).when(op == "new", 0).cast("long").alias("none"),
        F.when(op.isin("add", "new"), F.lit(0).cast("long")).when(op == "bump", number).alias("shift"),
        F.when(op == "add", F.lit(ACTIVE).cast("long")).when(op == "set", number).alias("floor"))


def _nothing(of: str) -> Column:
    """No ops, before those of an array; its fields may be null, as a literal's may not."""
    return F.struct(F.lit(None).cast("long").alias("none"), F.when(F.size(of) >= 0, F.lit(0).cast("long")).alias("shift"), F.lit(None).cast("long").alias("floor"))


def _blocks(ops: DataFrame, keys: list[str], span: int) -> DataFrame:
    """Ops by blocks of seq: the function of each block and its ordered items; n orders ops of one seq, if there."""
    item = F.struct("seq", *["n"] * ("n" in ops.columns), "op", "value", _step(F.col("op"), F.col("value")).alias("f"))
    blocks = ops.withColumn("block", F.floor(F.col("seq") / span)).groupBy(*keys, "block").agg(F.array_sort(F.collect_list(item)).alias("items"))
    return blocks.withColumn("f", F.aggregate("items", _nothing("items"), lambda a, x: _steps()(a, x["f"])))


def trust_fold(ops: DataFrame, keys: tuple[str, ...] = ("user_id",), span: int = BLOCK) -> DataFrame:
    """Final trust of (keys, seq, op, value), op being add, set, bump or delete; no row for what ends deleted.

    Ops compose, so a key's log is folded by blocks of `span` numbers of seq, and then block by block; ties in seq go by
    n, if there is such a column, then by op and value.
    """
    names = list(keys)
    parts = _blocks(ops, names, span).groupBy(*names).agg(F.array_sort(F.collect_list(F.struct("block", "f"))).alias("parts"))
    return parts.select(*names, F.aggregate("parts", _nothing("parts"), lambda a, x: _steps()(a, x["f"]))["none"].alias("trust")).where("trust IS NOT NULL")


def history(ops: DataFrame, keys: tuple[str, ...] = ("user_id",), span: int = BLOCK) -> DataFrame:
    """Trust after each op, null where there is no term; blocks begin with what those before them left."""
    names = list(keys)
    blocks = _blocks(ops, names, span)
    parts = blocks.groupBy(*names).agg(F.array_sort(F.collect_list(F.struct("block", "f"))).alias("parts"))
    first = F.struct(_nothing("parts").alias("f"), F.expr("CAST(array() AS array<struct<block:bigint,start:bigint>>)").alias("starts"))
    walked = F.aggregate("parts", first, lambda a, x: F.struct(_steps()(a["f"], x["f"]).alias("f"), F.array_append(a["starts"], F.struct(x["block"].alias("block"), a["f"]["none"].alias("start"))).alias("starts")))
    starts = parts.select(*names, F.explode(walked["starts"]).alias("s")).select(*names, "s.block", "s.start")
    then = lambda x, f: F.when(x.isNull(), f["none"]).otherwise(F.greatest(x + f["shift"], f["floor"]))
    init = F.struct(F.col("start").alias("x"), F.expr("CAST(array() AS array<struct<seq:bigint,trust:bigint>>)").alias("seen"))
    steps = F.aggregate("items", init, lambda a, e: F.struct(then(a["x"], e["f"]).alias("x"), F.array_append(a["seen"], F.struct(e["seq"].cast("long").alias("seq"), then(a["x"], e["f"]).alias("trust"))).alias("seen")))
    return blocks.join(starts, [*names, "block"]).select(*names, F.explode(steps["seen"]).alias("s")).select(*names, "s.seq", "s.trust")


def counters(effects: DataFrame) -> DataFrame:
    """Sums of d_seen and d_veto with the time of the last signal, for each term and misspelling."""
    return effects.groupBy("user_id", "term", "misspelling").agg(F.sum("d_seen").alias("seen"), F.sum("d_veto").alias("vetoes"), F.max_by("ts", "seq").alias("last_ts"))


def guard_merge(fresh: Column, old: Column, most: int = GUARD_WORDS) -> Column:
    return F.slice(F.concat(F.array_sort(fresh), F.array_except(old, fresh)), 1, most)


def unretire(gone: DataFrame, added: DataFrame) -> DataFrame:
    """Retired rows that no added name lifts, by its folded name or by its key."""
    one = gone.join(added.select("user_id", "term").distinct(), ["user_id", "term"], "left_anti")
    return one.join(added.select("user_id", "key").distinct(), ["user_id", "key"], "left_anti").select(*gone.columns)


def cascade(children: DataFrame, deleted: DataFrame) -> DataFrame:
    return children.join(deleted.select("user_id", "term").distinct(), ["user_id", "term"], "left_anti")


def top_traces(traces: DataFrame, n: int = 20) -> DataFrame:
    return traces.orderBy(F.desc("trace_id")).limit(max(1, min(200, n)))


def growth(before: DataFrame, after: DataFrame) -> DataFrame:
    """Counts (name, n) after less before."""
    return after.join(before.withColumnRenamed("n", "was"), "name", "left").select("name", (F.col("n") - F.coalesce("was", F.lit(0))).alias("grown"))


__all__ = ["accepted", "cascade", "counters", "fold_name", "first_by_key", "fold_onto", "found", "growth", "guard_merge", "history", "hydrate", "lookup", "misspellings", "played", "public", "remembered", "replay", "reports", "retired", "rows", "said_something", "snapshots", "status", "terms", "top_traces", "trust_fold", "unretire"]
