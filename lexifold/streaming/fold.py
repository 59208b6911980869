"""The fold as a stream: each user's memory is state on disk, and each event changes it once, in the order of seq.

State is one row for each term, spelling and retired name, so a batch writes what it changed, not the whole memory. Events
may come in any order and more than once: one that isn't next by seq (each user's numbers go up by one, from 1) waits in
state. With `patience`, a timer has the rest go on without it when nothing has filled the gap for so many milliseconds;
what then comes after all is told (late) and changes nothing. What comes again is passed over. State never expires.
Spark runs batches without data while timers may be set: a query with patience and an availableNow trigger ends only where
spark.sql.streaming.noDataMicroBatches.enabled is false, and its timers go off with the next batch that has data.

The state store has to be RocksDB's: a session that has set no provider gets it. A null user is the user ''; a payload
that isn't valid fails the batch, and so nothing of it is kept. A stream without rows emits none.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions.lexicon import COMMON
from ..operators.effects import EFFECTS, effect_rows
from ..operators.kernel import Effect, Memory, Spelling, Term
from ..operators.memory import STATE, keyed, rows
from ..sources.log import PAYLOAD, plain

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_EVENT = "ts string, type string, " + ", ".join(f"{name} {kind}" for name, kind in PAYLOAD.items())
_TERM = "preferred string, kind string, note string, trust int, source string, created string, updated string"
#: What was done: seq, ts, effects and report of each event.
Done = list[tuple[int, str, list[Effect], dict]]


class Fold(StatefulProcessor):
    def __init__(self, emit: Callable[[str, Memory, Done, list[int]], pd.DataFrame], words: frozenset[str], patience: int | None):
        self.emit, self.words, self.patience = emit, words, patience

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "seq long")
        self.terms = handle.getMapState("terms", "term string", _TERM)
        self.spellings = handle.getMapState("spellings", "term string, misspelling string", "seen int, vetoes int, guard array<string>, last string")
        self.retired = handle.getMapState("retired", "term string", "preferred string, key string, ts string")
        self.waiting = handle.getMapState("waiting", "seq long", _EVENT)
        self.skipped = handle.getMapState("skipped", "first long", "last long")

    def close(self) -> None:
        pass

    # -- state --------------------------------------------------------------------------------------------------
    def remembered(self) -> Memory:
        memory = Memory(self.words)
        for (name,), (preferred, kind, note, trust, source, created, updated) in self.terms.iterator():
            memory.put(name, Term(preferred, trust, source, created, updated, kind, note))
        for (name, spelling), (seen, vetoes, guard, last) in self.spellings.iterator():
            memory.spell(memory.terms[name], spelling, Spelling(seen, vetoes, [*guard], last))
        for (name,), (preferred, key, ts) in self.retired.iterator():
            memory.retire(name, preferred, key, ts)
        return memory

    def keep(self, memory: Memory, done: Done, before: set[str]) -> None:
        """Writes what the effects have touched."""
        touched = {e.term for _, _, effects, _ in done for e in effects}
        gone = {e.term for _, _, effects, _ in done for e in effects if e.op == "delete"}
        spelled = {(e.term, e.misspelling) for _, _, effects, _ in done for e in effects if e.op == "signal"}
        for name in gone:
            for key in [k for k, _ in self.spellings.iterator() if k[0] == name] if self.spellings.exists() else []:
                self.spellings.removeKey(key)
        for name in touched:
            if t := memory.terms.get(name):
                self.terms.updateValue((name,), (t.preferred, t.kind, t.note, t.trust, t.source, t.created, t.updated))
            elif self.terms.containsKey((name,)):
                self.terms.removeKey((name,))
        for name, spelling in spelled:
            if (t := memory.terms.get(name)) and (s := t.spellings.get(spelling)):
                self.spellings.updateValue((name, spelling), (s.seen, s.vetoes, s.guard, s.last))
        for name in before - set(memory.retired):
            self.retired.removeKey((name,))
        for name in gone & set(memory.retired):
            self.retired.updateValue((name,), memory.retired[name])

    # -- events -------------------------------------------------------------------------------------------------
    def go_on(self, user: str, over_gaps: bool, late: list[int]) -> pd.DataFrame | None:
        """Folds what waits, as far as it follows on; over gaps, too, if the time is up."""
        last = self.last.get()[0] if self.last.exists() else 0
        held = {k[0]: v for k, v in self.waiting.iterator()} if self.waiting.exists() else {}
        ready = []
        for seq in sorted(held):
            if seq > last + 1:
                if not over_gaps:
                    break
                self.skipped.updateValue((last + 1,), (seq - 1,))
            ready.append(seq)
            last = seq
        done: Done = []
        memory = Memory(self.words)
        if ready:
            memory = self.remembered()
            before = set(memory.retired)
            for seq in ready:
                ts, kind, *payload = held[seq]
                report = memory.apply(kind, dict(zip(PAYLOAD, payload, strict=True)), ts)
                done.append((seq, ts, memory.effects, report))
                self.waiting.removeKey((seq,))
            self.keep(memory, done, before)
            self.last.update((last,))
        return self.emit(user, memory, done, late) if done or late else None

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        last = self.last.get()[0] if self.last.exists() else 0
        late = []
        for batch in rows:
            for e in batch.itertuples():
                if e.seq > last:
                    self.waiting.updateValue((int(e.seq),), (e.ts, e.type, *plain(e.payload).values()))
                elif self.skipped.exists() and any(first <= e.seq <= until for (first,), (until,) in self.skipped.iterator()):
                    late.append(int(e.seq))
        if (out := self.go_on(key[0], False, late)) is not None:
            yield out
        if self.patience is None:
            return
        for at in list(self.handle.listTimers()):
            self.handle.deleteTimer(at)
        if self.waiting.exists():
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.patience)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if (out := self.go_on(key[0], True, [])) is not None:
            yield out


def _state(user: str, memory: Memory, done: Done, late: list[int]) -> pd.DataFrame:
    out = rows(user, memory, [(seq, report) for seq, _, _, report in done])
    told = rows(user, Memory(), [(seq, {}) for seq in late]).assign(part="late", report=None)
    return pd.concat([out, told]) if late else out


def _effects(user: str, memory: Memory, done: Done, late: list[int]) -> pd.DataFrame:
    found = [r for seq, ts, effects, report in done for r in effect_rows(user, seq, ts, effects, report)]
    found += [(user, seq, 0, None, *Effect("late", None), None) for seq in late]
    frame = pd.DataFrame(found, columns=[c.split()[0] for c in EFFECTS.replace("\n", " ").split(", ")], dtype=object)
    return frame.assign(guard=frame["guard"].map(list))


def _on_disk(spark: SparkSession) -> None:
    default = "org.apache.spark.sql.execution.streaming.state.HDFSBackedStateStoreProvider"
    if spark.conf.get(_PROVIDER, default) == default:
        spark.conf.set(_PROVIDER, default.replace("HDFSBacked", "RocksDB"))


def _folded(events: DataFrame, emit: Callable, schema: str, words: frozenset[str], patience: int | None) -> DataFrame:
    _on_disk(events.sparkSession)
    return keyed(events).groupBy("user_id").transformWithStateInPandas(Fold(emit, words, patience), schema, "Update", "None" if patience is None else "ProcessingTime")


def fold_stream(events: DataFrame, words: frozenset[str] = COMMON, patience: int | None = None) -> DataFrame:
    """A stream of events to each touched user's whole state after a batch (memory.STATE, update mode), with a report for
    each event folded, and a row of part "late" for each that came after its gap was given up."""
    return _folded(events, _state, STATE, words, patience)


def effect_stream(events: DataFrame, words: frozenset[str] = COMMON, patience: int | None = None) -> DataFrame:
    """A stream of events to effects (effects.EFFECTS), each once, to be appended to a table; with rows of op "late"."""
    return _folded(events, _effects, EFFECTS, words, patience)
