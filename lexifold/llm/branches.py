"""Three-way merge of two branches of a table of texts, by rows, columns, lines and gaps between lines.

base, left and right are tables of (id, columns..., line_ids, slots, lines). A line's id is its number in base and never
changes; slot 0 is that line, and slots from 1 are lines that a branch put after it (an id that base lacks stands before
the first line). A line that is null reads as base has it, so a branch holds what it changed and the ids of the rest.
The three are joined by id, full outer, and each triple of rows is merged in a pandas function over Arrow batches:

* a row that base lacks counts as a whole, by its values; equal or one-sided is clean, else it is an insert-insert conflict;
* a row that one branch drops is an edit-delete conflict if the other one changed anything in it, else a clean drop;
* else columns, lines, and gaps after lines (dropped ones too) merge each by itself: a change on one side, or the same on
  both, is clean; two edits, an edit and a drop, or two insertions that differ are conflicts, and base's state stays.

Nulls in columns and texts count as empty. Rows that have no id are one row; of rows with one id in a table, the one whose
values have the smallest hash counts. A text is a row's memory; a table of any size goes through joins by id alone, and
empty tables are tables. Columns other than those named are left out, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import lean, table

LINES = ("line_ids", "slots", "lines")
COUNTS = ("n_clean", "n_edit_edit", "n_edit_delete", "n_insert_insert")
_GONE = object()


def name_of(row_id: Column) -> Column:
    """An id as a string; a null is empty."""
    return F.coalesce(row_id.cast("string"), F.lit(""))


def unique(rows: DataFrame, id_column: str) -> DataFrame:
    """One row for each id. Only ids are looked at, unless some repeat."""
    key = name_of(F.col(id_column))
    if rows.groupBy(key.alias("key")).agg(F.count("*").alias("n")).where("n > 1").isEmpty():
        return rows
    order = Window.partitionBy(key).orderBy(F.xxhash64(*rows.columns))
    return rows.withColumn("_copy", F.row_number().over(order)).where("_copy = 1").drop("_copy")


def base_table(docs: DataFrame, columns: Sequence[str] = ("lang", "source"), id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """Texts cut at newlines; lines are named by their numbers from 0."""
    lines = F.split(F.coalesce(text, F.lit("")), "\n", -1)
    rows = unique(docs.select(id_column, *columns, text), id_column)
    return rows.select(F.col(id_column).alias("id"), *(F.coalesce(c, F.lit("")).alias(c) for c in columns), F.transform(F.sequence(F.lit(0), F.size(lines) - 1), lambda i: i.cast("long")).alias("line_ids"), F.transform(lines, lambda _: F.lit(0)).alias("slots"), lines.alias("lines"))


def _merged(b: tuple | None, left: tuple | None, right: tuple | None) -> tuple[tuple | None, list[int]]:
    """The row as it is after the merge, (columns, text), or None; and COUNTS. A row is (columns, line_ids, slots, lines)."""
    counts = [0, 0, 0, 0]

    def settle(was, x, y, conflict):
        """One unit: what it becomes."""
        if x == y or y == was:
            counts[0] += x != was
            return x
        if x == was:
            counts[0] += 1
            return y
        counts[conflict] += 1
        return was

    text = lambda lines: "\n".join(lines)
    if b is None:
        whole = [None if side is None else (side[0], text("" if t is None else t for t in side[3])) for side in (left, right)]
        return (settle(None, *whole, 3) if None not in whole else settle(None, *whole, 0)), counts
    was = dict(zip(b[1], b[3], strict=True))
    sides = []
    for side in (left, right):
        if side is None:
            sides.append(None)
            continue
        own, gaps = {}, {}
        for i, slot, t in zip(side[1], side[2], side[3], strict=True):
            if slot == 0 and i in was:
                own[i] = was[i] if t is None else t
            else:
                gaps[i] = (*gaps.get(i, ()), "" if t is None else t)
        sides.append((side[0], own, gaps))
    base = b[0], text(b[3])
    if None in sides:
        other = sides[0] or sides[1]
        touched = other is not None and (other[0] != b[0] or other[1] != was or bool(other[2]))
        counts[2 if touched else 0] += 1
        return (base if touched else None), counts
    (lc, lo, lg), (rc, ro, rg) = sides
    columns = tuple(settle(was_, x, y, 1) for was_, x, y in zip(b[0], lc, rc, strict=True))
    out = []
    for i in [*sorted({*lg, *rg} - was.keys()), *was]:
        if i in was:
            x, y = lo.get(i, _GONE), ro.get(i, _GONE)
            t = settle(was[i], x, y, 2 if x is _GONE or y is _GONE else 1)
            if t is not _GONE:
                out.append(t)
        if i in lg or i in rg:
            out += settle((), lg.get(i, ()), rg.get(i, ()), 3)
    return (columns, text(out)), counts


def merge(base: DataFrame, left: DataFrame, right: DataFrame, columns: Sequence[str] = ("lang", "source")) -> DataFrame:
    """id, the columns, text (all null where the row is gone) and COUNTS, for every id that any of the three has."""
    columns = [*columns]
    sides = []
    for name, rows in (("b", base), ("l", left), ("r", right)):
        of = unique(rows.select("id", *columns, *LINES), "id")
        sides.append(of.select(name_of(F.col("id")).alias("key"), F.struct("id", *columns, *LINES).alias(name)))
    b, le, ri = sides
    # the branches meet first, as they hold little but what they changed
    triples = le.join(ri, "key", "full_outer").join(b, "key", "full_outer")
    flat = [F.coalesce("b.id", "l.id", "r.id").alias("id")]
    for s in "blr":
        flat += [F.col(s).isNotNull().alias(f"{s}_has"), *(F.coalesce(f"{s}.{c}", F.lit("")).alias(f"{s}_c{i}") for i, c in enumerate(columns)), *(F.col(f"{s}.{c}").alias(f"{s}_{c}") for c in LINES)]
    kind = dict(base.dtypes)["id"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for s in "blr":
                cells = [batch[f"{s}_c{i}"] for i in range(len(columns))]
                values = zip(*cells, strict=True) if cells else [()] * len(batch)
                rows.append([(v, i.tolist(), n.tolist(), t.tolist()) if has else None for has, v, i, n, t in zip(batch[f"{s}_has"], values, *(batch[f"{s}_{c}"] for c in LINES), strict=True)])
            found = [_merged(*triple) for triple in zip(*rows, strict=True)]
            out = pd.DataFrame({"id": batch["id"]})
            for i, c in enumerate(columns):
                out[f"c{i}"] = [None if row is None else row[0][i] for row, _ in found]
            out["text"] = [None if row is None else row[1] for row, _ in found]
            for i, c in enumerate(COUNTS):
                out[c] = [counts[i] for _, counts in found]
            yield out

    schema = f"id {kind}, " + "".join(f"c{i} string, " for i in range(len(columns))) + "text string, " + ", ".join(f"{c} long" for c in COUNTS)
    merged = lean(triples.select(*flat)).mapInPandas(run, schema)
    return merged.select("id", *(F.col(f"c{i}").alias(c) for i, c in enumerate(columns)), "text", *COUNTS)


def branch(base: DataFrame, name: str, columns: Sequence[str] = ("lang", "source")) -> DataFrame:
    """A branch of base whose changes follow from CRC-32 codes of (branch, id, what is changed) modulo 11: 0 drops (of a
    column, empties), 1 and 2 append a mark, 3 and 4 add a line after the line, or a row of that mark beside the row."""
    key = name_of(F.col("id"))
    code = lambda what: F.crc32(F.concat(F.lit(f"{name}:"), key, F.lit(":"), what).cast("binary")) % 11
    mark = lambda c: F.when((c == 1) | (c == 3), "!").otherwise("?")
    edited = lambda value, c: F.when(c == 0, "").when(c.isin(1, 2), F.concat(value, mark(c))).otherwise(value)
    kind = "array<struct<line_id:bigint,slot:int,line:string>>"
    entry = lambda i, slot, t: F.struct(i.alias("line_id"), F.lit(slot).alias("slot"), t.alias("line"))
    coded = F.transform("lines", lambda t, i: F.struct(t.alias("t"), i.cast("long").alias("i"), code(i.cast("string")).alias("c")))
    own = lambda x: F.when(x["c"] != 0, entry(x["i"], 0, F.when(x["c"].isin(1, 2), F.concat(x["t"], mark(x["c"])))))
    put = lambda x: F.when(x["c"].isin(3, 4), entry(x["i"], 1, mark(x["c"])))
    entries = F.filter(F.flatten(F.transform(coded, lambda x: F.array(own(x), put(x)))), lambda e: e.isNotNull()).cast(kind)
    lone = F.array(entry(F.lit(0).cast("long"), 0, mark(F.col("row_code")))).cast(kind)
    shift = {"L": -1, "R": -2}[name]
    kept = F.struct("id", *(edited(F.col(c), code(F.lit(c))).alias(c) for c in columns), entries.alias("entries"))
    added = F.struct((F.lit(shift) - F.col("id")).alias("id"), *columns, lone.alias("entries"))
    rows = base.withColumn("row_code", code(F.lit("row")))
    both = F.array(F.when(F.col("row_code") != 0, kept), F.when(F.col("row_code").isin(3, 4) & F.col("id").isNotNull(), added))
    rows = rows.select(F.explode(both).alias("x")).where("x IS NOT NULL").select("x.*")
    return rows.select("id", *columns, F.col("entries.line_id").alias("line_ids"), F.col("entries.slot").alias("slots"), F.col("entries.line").alias("lines"))


def op12_branch_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = base_table(table(spark, sf_dir, "documents"))
    merged = merge(base, branch(base, "L"), branch(base, "R"))
    return merged.select(F.col("id").alias("doc_id"), "lang", "source", F.sha2("text", 256).alias("text_sha256"), *COUNTS)
