"""Event logs, seeds, cases, takes, traces and results: reading and writing."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import kept

EVENTS = "user_id string, seq long, ts timestamp, type string, payload string"
# Fixed format: the fields of each type of event and the kinds of value that each may have; one that may be missing has None.
TEXT, WHOLE = ("STRING", "VOID"), ("BIGINT",)
FIELDS = {
    "observation": {"formatted": TEXT, "final": TEXT, "presented": (*TEXT, None), "asr": (*TEXT, None)},
    "add_term": {"preferred": TEXT, "kind": (*TEXT, None), "note": (*TEXT, None)},
    "delete_term": {"preferred": TEXT},
    "set_trust": {"preferred": TEXT, "trust": WHOLE},
}
PAYLOAD = {name: "long" if kinds is WHOLE else "string" for fields in FIELDS.values() for name, kinds in fields.items()}
TRACES = "trace_id long, user_id string, ts timestamp, input string, output string, data string"


def read_events(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(EVENTS).parquet(path).orderBy("user_id", "seq")


def numbered(new: DataFrame, last: DataFrame | None = None) -> DataFrame:
    """Each user's new events (user_id, ts, type, payload and, if there, ord) with the numbers after the last one.

    Order is by ts, then ord, then type and payload, so that a rerun numbers them alike.
    """
    by = [F.col("ts"), *([F.col("ord")] if "ord" in new.columns else []), F.col("type"), F.col("payload")]
    rows = new.withColumn("seq", F.row_number().over(Window.partitionBy("user_id").orderBy(*by)).cast("long"))
    if last is not None:
        top = last.groupBy("user_id").agg(F.max("seq").alias("top"))
        rows = rows.join(top, "user_id", "left").withColumn("seq", F.col("seq") + F.coalesce("top", F.lit(0))).drop("top")
    return rows.select("user_id", "seq", "ts", "type", "payload")


def typed(payload: str = "payload", type_: str = "type", others: tuple[str, ...] = ()) -> Column:
    """The payload (JSON text) as a struct of PAYLOAD, null where its type has no such field.

    The job fails at a payload that is no JSON object or null, lacks a field, has a value of another kind or a key twice,
    and at a type other than those of FIELDS and `others`, which carry nothing; further fields are left out.
    """
    # by way of a variant each payload is parsed once, and a value keeps its kind
    whole = F.parse_json(payload)
    kind = lambda f: F.schema_of_variant(F.variant_get(whole, f"$.{f}", "variant"))
    may = lambda f, kinds: F.coalesce(kind(f).isin(*filter(None, kinds)), F.lit(None in kinds))
    fine = F.lit(False)
    for name, fields in FIELDS.items():
        fits = F.schema_of_variant(whole).startswith("OBJECT")
        for f, kinds in fields.items():
            fits = fits & may(f, kinds)
        fine = F.when(F.col(type_) == name, fits).otherwise(fine)
    fine = F.coalesce(fine | F.col(type_).isin(*others) if others else fine, F.lit(False))
    has = lambda f: F.col(type_).isin(*(name for name, fields in FIELDS.items() if f in fields))
    read = F.struct(*(F.when(has(f), F.variant_get(whole, f"$.{f}", of)).alias(f) for f, of in PAYLOAD.items()))
    why = F.concat(F.lit("not a valid payload of an event "), F.coalesce(F.col(type_), F.lit("without a type")), F.lit(": "), F.coalesce(F.col(payload), F.lit("null")))
    return F.when(fine, read).otherwise(F.raise_error(why))


def plain(payload: dict) -> dict:
    """A payload that came by way of pandas, which makes whole numbers beside nulls floats."""
    return {f: (None if v is None or v != v else int(v)) if PAYLOAD[f] == "long" else v for f, v in payload.items()}


def as_logged(kind: str, payload: dict) -> dict:
    """A payload as `typed` gives it with the fields of its type; what may be missing and is null is left out."""
    return {f: payload[f] for f, kinds in FIELDS[kind].items() if None not in kinds or payload[f] is not None}


def append_events(new: DataFrame, path: str, last: DataFrame | None = None) -> None:
    """Appends new events to a log with one writer; operators/engine.py is for more."""
    numbered(new, last).write.mode("append").parquet(path)


def read_seed(spark: SparkSession, path: str, user: str = "seed") -> DataFrame:
    """Events of a JSON-lines file; blank lines and those with # are left out, a bad line fails before anything is done."""
    lines = [x.value.strip() for x in spark.read.text(path).collect()]
    return seed_events(spark, [json.loads(x) for x in lines if x and not x.startswith("#")], user)


def seed_events(spark: SparkSession, found: list[dict], user: str = "seed") -> DataFrame:
    rows = [(user, i + 1, e["type"], json.dumps(e["payload"], ensure_ascii=False)) for i, e in enumerate(found)]
    return spark.createDataFrame(rows, "user_id string, seq long, type string, payload string").withColumn("ts", F.date_trunc("second", F.current_timestamp()))


def parse_cases(text: str) -> list[dict]:
    """JSON objects that may run over lines, with comment lines between them."""
    decoder, out, at = json.JSONDecoder(), [], 0
    while at < len(text):
        if text[at].isspace():
            at += 1
        elif text[at] == "#":
            at = (text + "\n").index("\n", at)
        else:
            case, at = decoder.raw_decode(text, at)
            out.append(case)
    return out


def read_takes(spark: SparkSession, path: str) -> DataFrame:
    """(pos, asr, formatted) of a JSON document with a list `takes`."""
    whole = spark.read.schema("takes array<struct<asr:string,formatted:string>>").json(path, multiLine=True)
    return whole.select(F.posexplode("takes").alias("pos", "t")).select("pos", "t.asr", "t.formatted")


def row_counts(tables: dict[str, DataFrame]) -> DataFrame:
    whole = None
    for name, df in tables.items():
        one = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n")
        whole = one if whole is None else whole.union(one)
    return whole


def write_traces(traces: DataFrame, path: str, first: int = 1) -> None:
    """Appends traces (user_id, doc_id, input, output, data), numbered from `first` on in the order of user and document."""
    names = ("user_id", "doc_id", "input", "output", "data")
    # kept, as another run of the sort may cut its ranges elsewhere; there is one count for each range
    placed = kept(traces.select(*names).orderBy("user_id", "doc_id", "input").withColumn("part", F.spark_partition_id()).withColumn("row", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)))
    counts = placed.groupBy("part").agg(F.count("*").alias("n"))
    before = counts.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    rows = placed.join(before, "part").withColumn("trace_id", F.col("row") + F.col("before") + first)
    rows.withColumn("ts", F.date_trunc("second", F.current_timestamp())).select(*(c.split()[0] for c in TRACES.split(", "))).write.mode("append").parquet(path)


def write_results(spark: SparkSession, records: list[dict], counts: dict, folder: str, suffix: str = "") -> None:
    """The records as JSON lines in results<suffix>, the counts as a table in text in summary<suffix>."""
    lines = spark.createDataFrame([(json.dumps(r, ensure_ascii=False),) for r in records], "value string")
    lines.coalesce(1).write.mode("overwrite").text(f"{folder}/results{suffix}")
    table = ["| what | n |", "|---|---|", *(f"| {k} | {v} |" for k, v in counts.items())]
    spark.createDataFrame([("\n".join(table),)], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/summary{suffix}")
