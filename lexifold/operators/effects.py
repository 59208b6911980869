"""The fold as rows: what each event does to each term, and the memory as aggregates over these rows.

Only what an observation means depends on the memory before it, so the fold hands out effects, and everything after it
is Spark's: trust composes (memory.trust_fold), counters are sums, a guard is the words last used against a spelling, and
a term that was deleted is what its effects since then say. Effects append like a log, so a table of them, kept by day or
by user, answers for any moment without another fold.

Each user's events come in the order of seq (then of type and payload) and go through a task as a stream: a task holds
the memory of one user and a batch of events, never a user's whole log. Events without a user are those of the user ''.
An empty log has no effects; repeated events each count; columns of the log other than those of EVENTS are left out.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.lexicon import COMMON
from ..sources.shared import kept
from .kernel import Effect, Memory
from .memory import by_user, keyed, status, trust_fold
from .rules import GUARD_WORDS

EFFECTS = """user_id string, seq long, n int, ts string, op string, term string, preferred string, kind string, note string, misspelling string,
value int, seen int, vetoes int, guard array<string>, key string, report string"""
_KINDS = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "array<string>": pa.list_(pa.string())}
_ARROW = pa.schema([(c.split()[0], _KINDS[c.split()[1]]) for c in EFFECTS.replace("\n", " ").split(", ")])


def effect_rows(user: str, seq: int, ts: str, found: list[Effect], report: dict) -> list[tuple]:
    """Rows of EFFECTS of one event."""
    out = [(user, seq, n, ts, *e, None) for n, e in enumerate(found)]
    return [*out, (user, seq, len(out), ts, *Effect("report", None), json.dumps(report, ensure_ascii=False))]


def effects(events: DataFrame, words: frozenset[str] = COMMON) -> DataFrame:
    """EFFECTS of a log (user_id, seq, ts, type, payload): n numbers those of an event, the last of which, of op "report",
    has its report."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        user, memory = None, Memory(words)
        for batch in batches:
            out: list[tuple] = []
            for of, seq, ts, kind, payload in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if of != user:
                    user, memory = of, Memory(words)
                report = memory.apply(kind, payload, str(ts))
                out += effect_rows(user, seq, ts, memory.effects, report)
            columns = zip(*out, strict=True) if out else [[]] * len(_ARROW)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _ARROW.types, strict=True)], schema=_ARROW)

    return keyed(by_user(events)).sortWithinPartitions("user_id", "seq", "type", "payload").mapInArrow(run, EFFECTS)


_TERM = ["user_id", "term"]


def _place() -> Column:
    return F.struct("seq", "n")


def held(of: DataFrame, ops: tuple[str, ...], *columns: str) -> DataFrame:
    """Effects of some ops, kept: they are read several times, and each time would be another fold of the log."""
    return kept(of.where(F.col("op").isin(*ops)).select(*_TERM, "seq", "n", "ts", "op", *columns))


def living(of: DataFrame) -> DataFrame:
    """Effects on terms since each was last deleted."""
    gone = of.where("op = 'delete'").groupBy(*_TERM).agg(F.max(_place()).alias("gone"))
    return of.where("op NOT IN ('delete', 'report')").join(gone, _TERM, "left").where(F.col("gone").isNull() | (_place() > F.col("gone"))).drop("gone")


def _last(column: str) -> Column:
    """The last value that isn't null."""
    return F.max_by(column, F.when(F.col(column).isNotNull(), _place())).alias(column)


def terms(of: DataFrame) -> DataFrame:
    """Columns as memory.terms has them."""
    of = held(of, ("add", "new", "set", "bump", "delete"), "preferred", "kind", "note", "key", "value")
    alive = living(of)
    about = alive.groupBy(*_TERM).agg(
        _last("preferred"), _last("kind"), _last("note"), _last("key"), F.min_by("op", _place()).alias("first"), F.min_by("ts", _place()).alias("created"), F.max_by("ts", _place()).alias("updated"))
    trust = trust_fold(alive.select(*_TERM, "seq", "n", "op", "value"), tuple(_TERM))
    source = F.when(F.col("first") == "add", "added").otherwise("learned").alias("source")
    return about.join(trust, _TERM).select("user_id", "term", "preferred", "kind", "note", F.col("trust").cast("int").alias("trust"), status(F.col("trust")).alias("status"), source, "created", "updated", "key")


def misspellings(of: DataFrame) -> DataFrame:
    """Columns as memory.misspellings has them. A guard is the words of the latest vetoes, GUARD_WORDS at most."""
    spelled = [*_TERM, "misspelling"]
    of = held(of, ("signal", "delete"), "misspelling", "seen", "vetoes", "guard", "key")
    signals = living(of)
    counts = signals.groupBy(*spelled).agg(F.sum("seen").cast("int").alias("seen"), F.sum("vetoes").cast("int").alias("vetoes"), F.max_by("ts", _place()).alias("last_ts"), F.first("key").alias("key"))
    words = signals.select(*spelled, "seq", "n", F.explode("guard").alias("word")).groupBy(*spelled, "word").agg(F.max(_place()).alias("at"))
    latest = F.slice(F.array_sort(F.collect_list(F.struct((-F.col("at.seq")).alias("s"), (-F.col("at.n")).alias("n"), "word"))), 1, GUARD_WORDS)
    guards = words.groupBy(*spelled).agg(F.transform(latest, lambda x: x["word"]).alias("guard"))
    none = F.expr("CAST(array() AS array<string>)")
    return counts.join(guards, spelled, "left").select(*spelled, "seen", "vetoes", F.coalesce("guard", none).alias("guard"), "last_ts", "key")


def retired(of: DataFrame) -> DataFrame:
    """Columns as memory.retired has them: terms deleted that no later add lifts, by name or by key."""
    of = held(of, ("add", "delete"), "preferred", "key")
    gone = of.where("op = 'delete'").groupBy(*_TERM).agg(F.max_by(F.struct("preferred", "key", "ts"), _place()).alias("was"), F.max(_place()).alias("at")).select(*_TERM, "was.*", "at")
    added = of.where("op = 'add'")
    by_name, by_key = (added.groupBy("user_id", c).agg(F.max(_place()).alias(f"by_{c}")) for c in ("term", "key"))
    still = gone.join(by_name, _TERM, "left").join(by_key, ["user_id", "key"], "left")
    later = lambda c: F.coalesce(F.col(c) > F.col("at"), F.lit(False))
    return still.where(~later("by_term") & ~later("by_key")).select("user_id", "term", "preferred", "key", "ts")


def reports(of: DataFrame) -> DataFrame:
    return of.where("op = 'report'").select("user_id", "seq", "report")
