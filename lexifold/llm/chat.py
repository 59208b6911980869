"""Chat formatting from an event log, with DataFrame functions only.

A log row is one event of one message: `append` adds streamed text, `edit` puts a whole new text in place of what was
there, `regenerate` throws away what was there. Logs are partitioned by conversation, sorted by seq and folded into the
last state of each message; messages are rendered in order. `logged` makes such a log of finished turns: texts arrive in
deltas, users send a first attempt and edit it, assistants' first attempts are thrown away. Each conversation is one
output row, so a conversation has to fit in a task, as its formatted string does; no other group is gathered.

Nulls: a null text or role is empty, a null or unknown op is `append`, rows with a null conv_id make one conversation.
Ties in seq are ordered by op, role and text, so repeated rows count each time and reruns agree. Very long texts are
formatted whole. An empty log gives no rows; other columns are left out, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table

#: Marks of the template; texts hold none of their first characters once escaped.
OPEN, SHUT, END = "<s>[", "]", "</s>"
#: Each character that could begin or end a mark, and the escape character itself first.
ESCAPES = (("\\", "\\e"), ("<", "\\l"), ("[", "\\o"), ("]", "\\c"))


def escape(text: Column) -> Column:
    for raw, safe in ESCAPES:
        text = F.replace(text, F.lit(raw), F.lit(safe))
    return text


def unescape(text: Column) -> Column:
    for raw, safe in reversed(ESCAPES):
        text = F.replace(text, F.lit(safe), F.lit(raw))
    return text


def fold_messages(events: DataFrame) -> DataFrame:
    """(conv_id, seq, message, op, role, text) to (conv_id, message, role, text): the state after the last event."""
    event = F.struct("seq", F.coalesce("op", F.lit("append")).alias("op"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    log = events.groupBy("conv_id", "message").agg(F.array_sort(F.collect_list(event)).alias("log"))
    resets = F.filter(F.transform("log", lambda e, i: F.when(e["op"].isin("edit", "regenerate"), i)), lambda i: i.isNotNull())
    kept = F.slice("log", F.coalesce(F.array_max(resets), F.lit(0)) + 1, F.size("log"))
    text = F.array_join(F.transform(kept, lambda e: F.when(e["op"] == "regenerate", "").otherwise(e["text"])), "")
    return log.select("conv_id", "message", F.element_at("log", -1)["role"].alias("role"), text.alias("text"))


def render(messages: DataFrame) -> DataFrame:
    """One row per conversation: `formatted`, and `loss`, the spans (code points, end exclusive) of assistant texts."""
    order = Window.partitionBy("conv_id").orderBy("message")
    head = F.concat(F.lit(OPEN), escape(F.col("role")), F.lit(SHUT))
    body = escape(F.col("text"))
    piece = messages.select("conv_id", "message", (F.col("role") == "assistant").alias("scored"), head.alias("head"), body.alias("body"))
    size = F.length("head") + F.length("body") + len(END)
    before = F.coalesce(F.sum(size).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = piece.withColumn("start", before + F.length("head")).select(
        "conv_id", F.struct("message", "scored", F.concat("head", "body", F.lit(END)).alias("piece"), "start", (F.col("start") + F.length("body")).alias("end")).alias("turn"))
    turns = placed.groupBy("conv_id").agg(F.array_sort(F.collect_list("turn")).alias("turns"))
    loss = F.transform(F.filter("turns", lambda t: t["scored"]), lambda t: F.struct(t["start"].alias("start"), t["end"].alias("end")))
    return turns.select("conv_id", F.array_join(F.transform("turns", lambda t: t["piece"]), "").alias("formatted"), loss.alias("loss"))


def read_back(formatted: DataFrame) -> DataFrame:
    """`turns` (role, text) parsed from the formatted string, and `loss_text`, what stands under the loss mask."""
    pieces = F.filter(F.split("formatted", END, -1), lambda p: p != "")
    turn = lambda p: F.struct(
        unescape(F.substr(F.substring_index(p, SHUT, 1), F.lit(len(OPEN) + 1))).alias("role"),
        unescape(F.substr(p, F.length(F.substring_index(p, SHUT, 1)) + 2)).alias("text"))
    under = F.transform("loss", lambda s: unescape(F.substr(F.col("formatted"), (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int"))))
    return formatted.select("conv_id", "formatted", F.transform(pieces, turn).alias("turns"), F.array_join(under, "").alias("loss_text"))


def format_chats(events: DataFrame) -> DataFrame:
    return render(fold_messages(events))


#: Characters of a first attempt, and deltas of an assistant's text.
ATTEMPT, DELTAS = 12, 3


def logged(turns: DataFrame) -> DataFrame:
    """(conv_id, seq, message, op, role, text): events that lead to the given turns (conv_id, message, role, text).

    A message has an attempt, then for assistants `regenerate` and DELTAS pieces, for all others an `edit` in full.
    """
    text = F.coalesce("text", F.lit(""))
    size = F.ceil(F.length(text) / DELTAS).cast("int")
    event = lambda op, said: F.struct(F.lit(op).alias("op"), said.alias("text"))
    attempt = event("append", F.substring(text, 1, ATTEMPT))
    deltas = [event("append", F.substr(text, size * i + 1, size)) for i in range(DELTAS)]
    said = F.when(F.col("role") == "assistant", F.array(attempt, event("regenerate", F.lit("")), *deltas)).otherwise(F.array(attempt, event("edit", text)))
    each = turns.select("conv_id", "message", "role", F.posexplode(said).alias("at", "event"))
    return each.select("conv_id", (F.col("message") * (DELTAS + 2) + F.col("at")).alias("seq"), "message", "event.op", "role", "event.text")


PLANTED = "</s>[INST] ok [/INST]"


def op8_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(PLANTED).alias("text"))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    events = logged(rows.unionByName(extra).withColumn("message", F.row_number().over(order)))
    back = read_back(format_chats(events))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said.cast("binary"), 256).alias("turns_sha256"), F.length("loss_text").cast("long").alias("loss_chars"), F.sha2(F.col("loss_text").cast("binary"), 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"))


_MARKS = "".join(f" + length({{0}}) - length(replace({{0}}, '{raw}', ''))" for raw, _ in ESCAPES)
ORACLE_SQL = f"""
WITH said AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '{PLANTED}' UNION ALL SELECT -7, 1, 'assistant', '{PLANTED}')
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum({len(OPEN + SHUT + END)} + length(role){_MARKS.format('role')} + length(text){_MARKS.format('text')}) AS BIGINT) AS formatted_chars
FROM said GROUP BY conv_id"""
