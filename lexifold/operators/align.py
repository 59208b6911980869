"""Edits as rows: what words of a text stand where others stood, and where what was corrected lies in the output.

Texts are compared word by word in Arrow batches, each pair in a row's memory; a null text is an empty one. Repeated rows
each give their edits, and rows without an edit give none. Columns other than the id and the two texts are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .kernel import Comparison

#: Edits that are handed out together.
OUT = 2048
PAIRS = "n int, old string, new string, start int"


def edits_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edits of batches (key, before, after), handed out as they come: texts may have many times their rows of them."""
    for b in batches:
        at, out = [], []
        for row in range(b.num_rows):
            found = list(Comparison(b.column(1)[row].as_py(), b.column(2)[row].as_py()).edits())
            at += [row] * len(found)
            out += [(n, *e) for n, e in enumerate(found)]
            if out and (len(out) >= OUT or row + 1 == b.num_rows):
                columns = [b.column(0).take(pa.array(at)), *(pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int32(), pa.string(), pa.string(), pa.int32()), strict=True))]
                yield pa.RecordBatch.from_arrays(columns, names=["key", "n", "old", "new", "start"])
                at, out = [], []


def edit_pairs(texts: DataFrame, key: str, before: str = "formatted", after: str = "final") -> DataFrame:
    """key, n (from 0 in each row), old, new and start: words of the text before and the one word in their place, and where
    that begins. Words changed one for one, be it in case, and two words made one; longer changes say nothing of words."""
    either = [F.coalesce(c, F.lit("")).alias(n) for c, n in ((before, "before"), (after, "after"))]
    differ = texts.select(F.col(key).alias("key"), *either).where("before <> after")
    return differ.mapInArrow(edits_of, f"key {dict(texts.dtypes)[key]}, {PAIRS}").withColumnRenamed("key", key)


def placed(spans: DataFrame, by: list[str], start: str = "start", end: str = "end", applied: str = "applied") -> DataFrame:
    """Spans that are applied, with out_start and out_end: where each lies in the output, from what those before it have
    added or taken."""
    before = Window.partitionBy(*by).orderBy(start).rowsBetween(Window.unboundedPreceding, -1)
    kept = spans.where(F.col(applied).isNotNull())
    moved = F.coalesce(F.sum(F.length(applied) - (F.col(end) - F.col(start))).over(before), F.lit(0))
    return kept.withColumn("out_start", (F.col(start) + moved).cast("int")).withColumn("out_end", F.col("out_start") + F.length(applied))


def capitals(first: Column) -> Column:
    """Whether a character is a capital."""
    return (first != F.lower(first)) & (first == F.upper(first))


def headings(texts: DataFrame, key: str) -> DataFrame:
    """key, heading: whether capitals say nothing in a text, as every word of several has one, or half of those (three at
    least) that open no sentence. A text is read as arrays in its row; one without words is no heading."""
    words, gaps = F.regexp_extract_all("text", F.lit(T.TOKEN), F.lit(0)), F.split("text", T.TOKEN, -1)
    cut = texts.select(key, words.alias("words"), F.transform(gaps, lambda g: F.regexp_extract(g, f"(?s)^(.*?)[{T.OPENERS}]*\\z", 1)).alias("heads"))
    opens = lambda i: F.when(F.element_at("heads", i + 1) == "", i == 0).otherwise(F.right(F.element_at("heads", i + 1), F.lit(1)).isin(*T.ENDERS))
    one = lambda w, i: F.struct(capitals(F.left(w, F.lit(1))).alias("capital"), F.left(w, F.lit(1)).rlike("[^0-9×÷]").alias("letter"), opens(i).alias("opens"))
    told = cut.select(key, F.transform("words", one).alias("t"))
    count = lambda f: F.size(F.filter("t", f))
    lettered, inner = count(lambda x: x["letter"]), count(lambda x: ~x["opens"])
    every = (F.size("t") > 1) & (lettered > 0) & (count(lambda x: x["letter"] & x["capital"]) == lettered)
    half = (inner > 2) & (2 * count(lambda x: ~x["opens"] & x["capital"]) >= inner)
    return told.select(key, F.coalesce(every | half, F.lit(False)).alias("heading"))


def proper(pairs: DataFrame, texts: DataFrame, key: str, final: str = "final") -> DataFrame:
    """Edits (key, old, new, start) with `proper`: whether the new word is a name by its capital, which it has where the
    old one had none, no sentence begins and the text is no heading. One text for each key."""
    known = texts.select(key, F.col(final).alias("text"))
    both = pairs.join(known, key).join(headings(known, key), key)
    head = F.regexp_extract(F.left("text", F.col("start")), f"(?s)^(.*?)[{T.OPENERS}]*\\z", 1)
    opens = (head == "") | F.right(head, F.lit(1)).isin(*T.ENDERS)
    small = lambda c: (c != F.upper(c)) & (c == F.lower(c))
    named = capitals(F.left("new", F.lit(1))) & small(F.left("old", F.lit(1))) & ~opens & ~F.col("heading")
    return both.select(*pairs.columns, named.alias("proper"))
