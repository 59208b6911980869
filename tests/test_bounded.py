import random

import pyarrow as pa
from pyspark.sql import functions as F

from lexifold.operators import align, evaluate


def test_percentiles_see_one_set_of_ranges(spark):
    """The sketch of a group's values depends on the order of its input, here another one in each run."""

    def shuffled(batches):
        for b in batches:
            order = list(range(b.num_rows))
            random.SystemRandom().shuffle(order)
            yield b.take(pa.array(order))

    n = 60000
    rows = spark.range(n, numPartitions=4).select(F.lit("a").alias("g"), F.col("id").cast("double").alias("v")).mapInArrow(shuffled, "g string, v double")
    made = evaluate.percentiles(rows, "g", "v")
    assert "percentile_approx" not in made._jdf.queryExecution().optimizedPlan().toString()
    assert [tuple(r) for r in made.collect()] == [("a", (n - 1) / 2, round(95 * (n + 1) / 100 - 1, 2))]


def test_edits_are_handed_out_in_small_batches(spark):
    """A batch of texts has many more edits than rows, which are never held together."""
    words = " ".join(["one two three four"] * 50)
    texts = spark.range(400, numPartitions=1).select("id", F.lit(words).alias("formatted"), F.initcap(F.lit(words)).alias("final"))

    def counted(batches):
        for b in batches:
            yield pa.RecordBatch.from_pydict({"n": pa.array([b.num_rows], pa.int64())})

    pairs = align.edit_pairs(texts, "id")
    sizes = [r.n for r in pairs.mapInArrow(counted, "n long").collect()]
    assert sum(sizes) == 400 * 200 and max(sizes) <= 10000
    rows = texts.collect()
    batch = pa.RecordBatch.from_pydict({"key": [r.id for r in rows], "before": [r.formatted for r in rows], "after": [r.final for r in rows]})
    held = [b.num_rows for b in align.edits_of(iter([batch]))]
    assert sum(held) == 400 * 200 and max(held) < align.OUT + 200
