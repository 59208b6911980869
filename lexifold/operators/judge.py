"""The judge: what decides on spans that only context can settle. Requests and verdicts are tables; a judge fills the
verdicts, offline from a table or live over HTTP, one request for each document."""

from __future__ import annotations

import json
import os
import re
import time
import urllib.error
import urllib.request
from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Verdicts as `decisions` takes them, with what the call has cost.
VERDICT = "user_id string, doc_id string, start int, apply boolean, preferred string, reason string, model string, input_tokens long, output_tokens long, cost double"
RETRIED = (429, 500, 502, 503)
#: Prices of a million tokens, in and out, by model; any other costs nothing.
PRICES: dict[str, tuple[float, float]] = {}


@dataclass
class Answer:
    """Decisions by the number of the item, and what they took."""

    decisions: dict[int, dict]
    model: str = ""
    input_tokens: int = 0
    output_tokens: int = 0


class Judge(Protocol):
    """Anything with these two; it is sent to executors, so it has to be picklable."""

    available: bool

    def judge(self, sentence: str, items: list[dict]) -> Answer: ...


def cost(model: str, tokens_in: int, tokens_out: int, prices: dict[str, tuple[float, float]] | None = None) -> float:
    a, b = (PRICES if prices is None else prices).get(model, (0.0, 0.0))
    return round((tokens_in * a + tokens_out * b) / 1e6, 6)


def costs(calls: DataFrame, prices: DataFrame) -> DataFrame:
    """Calls (model, input_tokens, output_tokens) with their cost by prices (model, price_in, price_out) of a million."""
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    priced = calls.join(prices, "model", "left")
    return priced.withColumn("cost", F.round((F.col("input_tokens") * zero("price_in") + F.col("output_tokens") * zero("price_out")) / 1e6, 6)).drop("price_in", "price_out")


def prompt(sentence: Column, items: Column) -> Column:
    """The text of a request: the sentence, and a numbered line for each item with its options and hint."""
    option = lambda o: F.concat(o["preferred"], F.lit(" ["), o["kind"], F.when(o["note"] != "", F.concat(F.lit(", "), o["note"])).otherwise(""), F.lit("]"))
    line = lambda x, i: F.concat(F.lit("#"), i.cast("string"), F.lit(" heard as "), F.to_json(F.struct(x["text"].alias("text"))), F.lit(", may be "), F.array_join(F.transform(x["options"], option), " or "), F.when(x["hint"] != "", F.concat(F.lit(" ("), x["hint"], F.lit(")"))).otherwise(""))
    return F.concat(F.lit("Text: "), sentence, F.lit("\n"), F.array_join(F.transform(items, line), "\n"))


def parse(text: str) -> dict[int, dict]:
    """Decisions by number, from the outermost braces of a text; a number may be written as a string."""
    whole = re.search(r"\{.*\}", text, re.DOTALL)
    if whole is None:
        raise ValueError("no object in the answer")
    found: dict[int, dict] = {}
    for said in json.loads(whole.group())["decisions"]:
        found[int(said["index"])] = said
    return found


def parsed(answer: Column) -> Column:
    """The same of a column: an array of (index, apply, preferred, reason), null where it can't be read."""
    whole = F.regexp_extract(answer, r"(?s)\{.*\}", 0)
    found = F.from_json(whole, "decisions array<struct<index:string,apply:string,preferred:string,reason:string>>")["decisions"]
    return F.transform(found, lambda d: F.struct(d["index"].cast("int").alias("index"), F.when(d["apply"] == "true", True).when(d["apply"] == "false", False).alias("apply"), d["preferred"].alias("preferred"), d["reason"].alias("reason")))


@dataclass
class Unavailable:
    available: bool = False

    def judge(self, sentence: str, items: list[dict]) -> Answer:
        raise RuntimeError("no judge")


@dataclass
class HttpJudge:
    """A chat endpoint. Without a key it isn't available, and pending spans stay as they are."""

    url: str
    model: str
    system: str = "You decide for each numbered span whether one of its options was meant. Answer as JSON: {\"decisions\": [{\"index\", \"apply\", \"preferred\", \"reason\"}]}."
    key_names: tuple[str, ...] = ("JUDGE_API_KEY", "LLM_API_KEY")
    timeout: float = 15.0
    attempts: int = 2
    backoff: float = 2.0
    pause: float = 0.0
    headers: dict[str, str] = field(default_factory=dict)

    @property
    def key(self) -> str:
        return next((v for n in self.key_names if (v := (os.environ.get(n) or "").strip())), "")

    @property
    def available(self) -> bool:
        return bool(self.key)

    def judge(self, sentence: str, items: list[dict]) -> Answer:
        asked = json.dumps({"text": sentence, "spans": [{"index": i} | x for i, x in enumerate(items)]}, ensure_ascii=False)
        body = {"model": self.model, "temperature": 0, "response_format": {"type": "json_object"}, "messages": [{"role": "system", "content": self.system}, {"role": "user", "content": asked}]}
        request = urllib.request.Request(self.url, json.dumps(body).encode(), {"Content-Type": "application/json", "Authorization": f"Bearer {self.key}"} | self.headers)
        for left in reversed(range(self.attempts)):
            try:
                with urllib.request.urlopen(request, timeout=self.timeout) as got:
                    data = json.loads(got.read())
                break
            except urllib.error.HTTPError as e:
                if e.code not in RETRIED or not left:
                    raise
                time.sleep(self.backoff)
        time.sleep(self.pause)
        used = data.get("usage") or {}
        return Answer(parse(data["choices"][0]["message"]["content"]), self.model, used.get("prompt_tokens", 0), used.get("completion_tokens", 0))


def judged(requests: DataFrame, judge: Judge, prices: dict[str, tuple[float, float]] | None = None) -> DataFrame:
    """A verdict for each item of each request. Where the judge raises, or has no usable word on an item, apply is null,
    which decides nothing and is told as an error. An unavailable judge gives no verdicts."""
    kind = dict(requests.dtypes)["doc_id"]
    schema = VERDICT.replace("doc_id string", f"doc_id {kind}")
    if not judge.available:
        return requests.sparkSession.createDataFrame([], schema)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for r in batch.itertuples():
                items = json.loads(r.items_json)
                try:
                    answer, failed = judge.judge(r.sentence, [{k: x.get(k, "") for k in ("text", "options", "hint")} for x in items]), ""
                except Exception as e:  # whatever a judge does, correction goes on
                    answer, failed = Answer({}), str(e) or type(e).__name__
                spent = cost(answer.model, answer.input_tokens, answer.output_tokens, prices)
                for i, x in enumerate(items):
                    d = answer.decisions.get(i)
                    d = d if isinstance(d, dict) else {}
                    apply = d.get("apply") if isinstance(d.get("apply"), bool) else None
                    reason = failed or (str(d.get("reason") or "") if apply is not None else "no usable decision")
                    preferred = d.get("preferred") if isinstance(d.get("preferred"), str) else None
                    out.append((r.user_id, r.doc_id, x["start"], apply, preferred, reason, answer.model, answer.input_tokens, answer.output_tokens, spent))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in VERDICT.split(", ")])

    return requests.select("user_id", "doc_id", "sentence", F.to_json("items").alias("items_json")).mapInPandas(run, schema)
