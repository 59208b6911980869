import json
import unicodedata

import pytest
from pyspark.sql import functions as F

from lexifold.operators import memory
from lexifold.sources.log import PAYLOAD, as_logged, typed, write_traces

LOG = "user_id string, seq long, ts string, type string, payload string"


def log(spark, *events):
    return spark.createDataFrame([("u", i + 1, "2026-01-01", kind, payload) for i, (kind, payload) in enumerate(events)], LOG)


def test_fields_of_each_type(spark):
    said = {"formatted": "Älä \"x\"\n", "final": None, "asr": "", "more": [1, {"a": 2}]}
    got = log(spark, ("observation", json.dumps(said)), ("add_term", '{"preferred": "Kivi", "note": "n", "trust": 9}'), ("set_trust", '{"preferred": "Kivi", "trust": -3}')).select(typed().alias("p")).select("p.*")
    none = dict.fromkeys(PAYLOAD)
    rows = [r.asDict() for r in got.collect()]
    assert rows == [none | {"formatted": "Älä \"x\"\n", "asr": ""}, none | {"preferred": "Kivi", "note": "n"}, none | {"preferred": "Kivi", "trust": -3}]
    assert as_logged("add_term", rows[1]) == {"preferred": "Kivi", "note": "n"} and as_logged("observation", rows[0]) == {"formatted": "Älä \"x\"\n", "final": None, "asr": ""}


BAD = [
    ("add_term", '{"preferred"'), ("add_term", "{}"), ("add_term", '{"preferred": 5}'), ("add_term", '{"preferred": "a", "kind": true}'), ("add_term", '["preferred"]'),
    ("add_term", '{"preferred": "a", "preferred": "b"}'), ("add_term", None), ("set_trust", '{"preferred": "a", "trust": "1"}'), ("set_trust", '{"preferred": "a", "trust": 1.5}'),
    ("set_trust", '{"preferred": "a"}'), ("observation", '{"formatted": "a"}'), ("rename", "{}"), ("look", "{}"), (None, "{}")]


@pytest.mark.parametrize("bad", BAD)
def test_bad_payload_fails_in_spark(spark, bad):
    with pytest.raises(Exception, match="MALFORMED_RECORD|not a valid payload"):
        memory.keyed(log(spark, ("add_term", '{"preferred": "Kivi"}'), bad)).collect()


def test_others_and_empty(spark):
    assert memory.keyed(log(spark, ("look", "{}")), ("look",)).first().payload == tuple([None] * len(PAYLOAD))
    assert memory.replay(log(spark)).collect() == []


def test_found_however_accents_are_written(spark):
    names = ["Émile", "Zoë", "Straße", "Nguyễn", "Ǖber", "plain"]
    known = spark.createDataFrame([("u", unicodedata.normalize("NFC", n).casefold(), n) for n in names], "user_id string, term string, preferred string")
    asked = [(f(unicodedata.normalize(form, n)), n) for n in names for form in ("NFC", "NFD") for f in (str, str.upper, str.title)]
    rows = spark.createDataFrame([("u", n, want) for n, want in asked] + [("u", None, None), ("u", "Emile", None), ("v", "plain", None)], "user_id string, name string, want string")
    assert memory.found(rows, known).where("NOT preferred <=> want").collect() == [] and memory.found(rows, known).count() == len(asked) + 3


def test_traces_are_numbered_in_order(spark, tmp_path):
    made = spark.range(500).select((F.col("id") % 7).cast("string").alias("user_id"), (F.col("id") * 37 % 500).alias("doc_id"), F.format_string("%03d", F.col("id") * 37 % 500).alias("input"), F.lit("y").alias("output"), F.lit("{}").alias("data")).repartition(6)
    write_traces(made, str(tmp_path / "t"), 5)
    got = spark.read.parquet(str(tmp_path / "t")).orderBy("trace_id").collect()
    assert [(r.user_id, r.input) for r in got] == sorted((r.user_id, r.input) for r in got) and [r.trace_id for r in got] == list(range(5, 505))
    write_traces(made.limit(0), str(tmp_path / "none"))
    assert spark.read.parquet(str(tmp_path / "none")).count() == 0
