import random

from lexifold.operators import effects, memory
from lexifold.streaming.fold import effect_stream
from tests.test_effects import EVENTS, log_of


def dense(log):
    """Each user's events numbered from 1."""
    out, seen = [], {}
    for user, _, *rest in log:
        seen[user] = seen.get(user, 0) + 1
        out.append((user, seen[user], *rest))
    return out


def streamed(spark, folder, batches, **more):
    """Effects of a stream started anew for each batch on one checkpoint."""
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")
    for some in batches:
        spark.createDataFrame(some, EVENTS).coalesce(1).write.mode("append").parquet(f"{folder}/log")
        stream = effect_stream(spark.readStream.schema(EVENTS).parquet(f"{folder}/log"), **more)

        def put(changed, number):
            changed.write.mode("overwrite").parquet(f"{folder}/effects/batch={number}")

        query = stream.writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
        try:
            assert query.awaitTermination(90)
        finally:
            query.stop()
    spark.conf.unset("spark.sql.streaming.noDataMicroBatches.enabled")
    return spark.read.parquet(f"{folder}/effects")


def test_events_in_any_order_and_twice(spark, tmp_path):
    log = dense(log_of(3, 25))
    r = random.Random(0)
    mixed = log + r.sample(log, 40)
    r.shuffle(mixed)
    of = streamed(spark, str(tmp_path), [mixed[i::3] for i in range(3)]).cache()
    whole = effects.effects(spark.createDataFrame(log, EVENTS))
    columns = whole.columns
    assert sorted(map(str, of.select(columns).collect())) == sorted(map(str, whole.collect()))
    state = memory.replay(spark.createDataFrame(log, EVENTS))
    for kind in ("terms", "misspellings", "retired"):
        want = getattr(memory, kind)(state)
        assert sorted(map(str, getattr(effects, kind)(of).select(*want.columns).collect())) == sorted(map(str, want.collect())), kind


def test_a_gap_is_given_up_and_what_fills_it_later_is_told(spark, tmp_path):
    log = [e for e in dense(log_of(2, 12)) if e[0] == "u1"]
    batches = [[e for e in log if e[1] not in (4, 5)], [("u9", 1, *log[0][2:])], [log[3], log[0]], [log[4]]]
    of = streamed(spark, str(tmp_path), batches, patience=1).cache()
    want = effects.effects(spark.createDataFrame(batches[0], EVENTS))
    assert sorted(map(str, of.where("user_id = 'u1' AND op <> 'late'").select(want.columns).collect())) == sorted(map(str, want.collect()))
    assert [tuple(x) for x in of.where("op = 'late'").select("user_id", "seq").orderBy("seq").collect()] == [("u1", 4), ("u1", 5)]
