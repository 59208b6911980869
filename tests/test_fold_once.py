import random

from pyspark.sql import functions as F

from lexifold.operators import effects, memory
from lexifold.operators.kernel import Comparison

EVENTS = "user_id string, seq long, ts string, type string, payload string"


def log_of(spark, tmp_path):
    rows = [("u", 1, "1", "add_term", '{"preferred": "Jonas"}'), ("u", 2, "2", "observation", '{"formatted": "Ask Joonas now.", "final": "Ask Jonas now."}'), ("u", 3, "3", "delete_term", '{"preferred": "Jonas"}'),
            ("u", 4, "4", "add_term", '{"preferred": "Maarit"}'), ("v", 1, "1", "observation", '{"formatted": "Ask Joonas now.", "final": "Ask Jonas now."}'), ("v", 2, "2", "set_trust", '{"preferred": "Jonas", "trust": 3}')]
    return spark.createDataFrame(rows, EVENTS)


def test_a_log_is_folded_once(spark, tmp_path):
    """What reads effects several times does so from what one fold left."""
    of = effects.effects(log_of(spark, tmp_path))
    for made, rows in ((effects.terms(of), 2), (effects.misspellings(of), 1), (effects.retired(of), 1)):
        assert made.count() == rows
        assert "MapInArrow" not in made._jdf.queryExecution().optimizedPlan().toString()


def test_a_fold_runs_in_as_many_tasks_as_a_shuffle_has_parts(spark, tmp_path):
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    log = spark.createDataFrame([(f"u{i}", 1, "1", "add_term", '{"preferred": "Jonas"}') for i in range(64)], EVENTS)
    none = spark.createDataFrame([], memory.STATE)
    for made in (effects.effects(log), memory.fold_onto(none, log)):
        tasks = made.select(F.spark_partition_id().alias("p")).distinct().count()
        assert tasks == n


def test_folds_onto_a_state_are_one_fold(spark, tmp_path):
    log, none = log_of(spark, tmp_path), spark.createDataFrame([], memory.STATE)
    whole = memory.fold_onto(none, log)
    first = memory.fold_onto(none, log.where("seq <= 1")).where("part NOT IN ('report', 'refused', 'logged')")
    first = spark.createDataFrame(first.collect(), memory.STATE)
    second = memory.fold_onto(first, log.where("seq > 1"))
    kept = lambda df: sorted(map(str, df.where("part IN ('term', 'misspelling', 'retired')").collect()))
    assert kept(whole) == kept(second) and len(kept(whole)) == 4
    replayed = memory.replay(log)
    assert kept(whole) == kept(replayed)
    # without new events a user isn't in the answer
    assert {r.user_id for r in memory.fold_onto(first, log.where("user_id = 'u' AND seq > 1")).collect()} == {"u"}


def test_equal_texts_are_compared_as_others_are():
    r = random.Random(2)
    for _ in range(200):
        a = " ".join(r.choice(("Ask", "ask", "now", "NOW")) for _ in range(r.randrange(6)))
        c = Comparison(a, a.upper())
        n = len(a.split())
        assert c.runs == ([(range(n), range(n), True)] if n else [])
