import hashlib
import random
from zlib import crc32

import pytest

from lexifold.llm import branches

MARKS = {1: "!", 2: "?", 3: "!", 4: "?"}


def plainly(docs):
    """The contract, row by row: each branch as a dictionary of what it changed, then unit by unit."""
    def code(branch, i, name):
        return crc32(f"{branch}:{'' if i is None else i}:{name}".encode()) % 11

    docs = [(i, lang or "", source or "", text or "") for i, text, lang, source in docs]
    added, out = {}, {}
    for i, lang, source, text in docs:
        for branch, shift in (("L", -1), ("R", -2)):
            if (c := code(branch, i, "row")) in (3, 4):
                added.setdefault(shift - i, {})[branch] = (MARKS[c], lang, source)
    for i, both in added.items():
        values = set(both.values())
        row = None if len(values) > 1 else values.pop()
        out[i] = (row, [int(row is not None), 0, 0, int(row is None)])
    for i, lang, source, text in docs:
        lines = text.split("\n")
        units = [("lang", lang), ("source", source), *((str(n), line) for n, line in enumerate(lines))]
        states = {}
        for branch in "LR":
            state = {}
            for name, value in units:
                c = code(branch, i, name)
                is_line = name.isdigit()
                state[name] = (None if is_line else "") if c == 0 else value + MARKS[c] if c in (1, 2) else value
                if is_line:
                    state[name, "gap"] = MARKS[c] if c in (3, 4) else None
            states[branch] = None if code(branch, i, "row") == 0 else state
        base = dict(units) | {(name, "gap"): None for name, _ in units if name.isdigit()}
        counts = [0, 0, 0, 0]
        dropped = [b for b in "LR" if states[b] is None]
        if dropped:
            rest = [states[b] for b in "LR" if states[b] is not None]
            conflict = bool(rest) and rest[0] != base
            counts[2 if conflict else 0] = 1
            out[i] = ((text, lang, source) if conflict else None, counts)
            continue
        now = {}
        for name, was in base.items():
            x, y = states["L"][name], states["R"][name]
            changed = {v for v in (x, y) if v != was}
            if len(changed) == 2:
                kind = 3 if isinstance(name, tuple) else 2 if None in changed else 1
                counts[kind] += 1
                now[name] = was
            else:
                counts[0] += len(changed)
                now[name] = changed.pop() if changed else was
        kept = [v for n in range(len(lines)) for v in (now[str(n)], now[str(n), "gap"]) if v is not None]
        out[i] = (("\n".join(kept), now["lang"], now["source"]), counts)
    return {(i, *((None, None, None) if row is None else (row[1], row[2], hashlib.sha256(row[0].encode()).hexdigest())), *counts) for i, (row, counts) in out.items()}


def merged(spark, docs, schema="doc_id long, text string, lang string, source string"):
    base = branches.base_table(spark.createDataFrame(docs, schema))
    rows = branches.merge(base, branches.branch(base, "L"), branches.branch(base, "R")).collect()
    assert len({r["id"] for r in rows}) == len(rows)
    return {(r["id"], r["lang"], r["source"], r["text"] if r["text"] is None else hashlib.sha256(r["text"].encode()).hexdigest(), *(r[c] for c in branches.COUNTS)) for r in rows}


def test_by_the_contract(spark):
    r = random.Random(0)
    line = lambda: r.choice(["", "", "a", "é\r", "some words here", "!", "?"])
    docs = [(i, r.choice([None, "", "\n", "\n".join(line() for _ in range(r.randrange(40)))]), r.choice([None, "", "en", "xx"]), r.choice([None, "a", "b"])) for i in range(3000)]
    docs[7] = (7, "\n".join(f"line {i}" for i in range(30_000)), "en", "a")
    want = plainly(docs)
    assert merged(spark, docs) == want
    assert sum(w[7] for w in want) > 20 and sum(w[6] for w in want) > 100 and sum(w[5] for w in want) > 100


def test_the_query(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang", "source").collect()
    got = {tuple(r[c] for c in ("doc_id", "lang", "source", "text_sha256", *branches.COUNTS)) for r in branches.op12_branch_merge(spark, "/root/testdata/sf0.001").collect()}
    assert got == plainly(docs)


@pytest.mark.parametrize("docs", [[], [(None, "a\nb", None, "s"), (None, "c", "en", "s")], [(3, "a", "en", "s")] * 50, [(3, "a", "en", "s"), (3, "b", "en", "s"), (4, "c", "", "")], [(0, "a", "e", "s"), (-1, "b", "e", "s"), (-2, "c", "e", "s")]])
def test_odd_tables(spark, docs):
    got = merged(spark, docs)
    assert {d[0] for d in docs} <= {g[0] for g in got}


def test_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "a", "en", "s", 1, 2, 3)], "doc_id long, text string, lang string, source string, id int, key int, lines int")
    base = branches.base_table(docs)
    assert branches.merge(base, base, base).collect()[0]["text"] == "a"


KIND = "id long, kind string, line_ids array<long>, slots array<int>, lines array<string>"


def test_branches_of_any_make(spark):
    """Insertions before the first line and of several lines, the same change on both sides, and rows without lines."""
    base = [(1, "x", [0, 1, 2], [0, 0, 0], ["a", "b", "c"]), (2, "x", [], [], []), (4, "x", [0], [0], ["gone"])]
    left = [(1, "y", [-1, 0, 0, 0, 2], [1, 0, 1, 2, 0], ["top", None, "p", "q", "C"]), (2, "x", [], [], []), (3, "n", [0, 0], [0, 1], ["new", "row"])]
    right = [(1, "y", [0, 1, 1, 2], [0, 0, 1, 0], ["A", None, "r", "C"]), (2, None, [], [], []), (3, "n", [0], [0], ["new\nrow"]), (4, "x", [0], [0], [None])]
    frame = lambda rows: spark.createDataFrame(rows, KIND)
    got = {r["id"]: (r["kind"], r["text"], r["n_clean"], r["n_edit_edit"], r["n_edit_delete"], r["n_insert_insert"]) for r in branches.merge(frame(base), frame(left), frame(right), ["kind"]).collect()}
    assert got == {1: ("y", "top\nA\np\nq\nr\nC", 7, 0, 0, 0), 2: ("", "", 1, 0, 0, 0), 3: ("n", "new\nrow", 1, 0, 0, 0), 4: (None, None, 1, 0, 0, 0)}
