import random

from pyspark.sql import functions as F

from lexifold.operators import correct
from lexifold.plans import catalog


def test_texts_are_searched_once_for_both_decisions(spark, tmp_path):
    r = random.Random(4)
    words = ("Tion", "thtion", "Erst", "erst", "eerst", "erstth", "erntth", "with", "inntti", "Eres", "cold widgit", "hot plate", "blue")
    texts = [" ".join(r.choice(words) for _ in range(r.randrange(30))) for _ in range(60)]
    spark.createDataFrame([*enumerate(texts), (99, None)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    made = catalog.verdict_merge(spark, str(tmp_path))
    plan = made._jdf.queryExecution()
    # what the search found is read, and its verdicts are no table that the driver gathers
    assert "MapInArrow" not in plan.optimizedPlan().toString() and "Broadcast" not in plan.sparkPlan().toString()
    d = catalog.docs(spark, str(tmp_path))
    each = correct.decisions(d, *catalog.dictionary(spark)).withColumn("rest", F.col("start") % 4)
    want = F.when(~F.col("pending"), F.col("decision")).when(F.col("rest") == 0, "applied").when(F.col("rest") == 1, "skipped:context").when(F.col("rest") == 2, "llm-error").otherwise(F.col("decision"))
    counts = lambda df: {(x[0], x[1]) for x in df.collect()}
    assert counts(made) == counts(each.groupBy(want).count()) and made.count() > 5
