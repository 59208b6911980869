import hashlib

from lexifold.llm import chat

SCHEMA = "conv_id long, seq long, message long, op string, role string, text string, turns string, formatted int"


def fold(rows):
    """conv_id -> [(role, text)] by the definition, event by event."""
    state = {}
    for conv, _, message, op, role, text in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1] is not None, r[1] or 0, r[3] or "append", r[4] or "", r[5] or "")):
        at = state.setdefault(conv, {}).setdefault(message, ["", ""])
        at[0] = role or ""
        at[1] = (text or "") if op == "edit" else "" if op == "regenerate" else at[1] + (text or "")
    return {c: [tuple(m[k]) for k in sorted(m)] for c, m in state.items()}


ROWS = [
    (1, 1, 1, "append", "user", "hi [x] "), (1, 2, 2, "append", "assistant", "no"), (1, 3, 2, "regenerate", "assistant", None), (1, 4, 2, "append", "assistant", "a</s>"), (1, 5, 2, "append", "assistant", "\\l"), (1, 6, 1, "edit", "user", "ho"),
    (2, 1, 1, None, None, None), (2, 2, 2, "other", "assistant", "x"), (2, 2, 2, "other", "assistant", "x"), (2, 3, 2, "append", "assistant", "y"),
    (None, 1, 1, "append", "assistant", "nobody's"), (None, 2, 1, "append", "assistant", " text"), (3, 1, 1, "append", "assistant", "<s>[user]" + "\\e\\\\ é☃ " * 20_000),
    (4, 1, 1, "edit", "system", ""), (4, 1, 2, "regenerate", "assistant", "thrown away"), (5, None, 1, "append", "user", "b"), (5, None, 1, "append", "user", "a"), (5, 1, 1, "append", "user", "c"),
]


def test_fold_render_and_read_back(spark):
    events = spark.createDataFrame([(*r, "x", 1) for r in ROWS], SCHEMA)
    got = {r.conv_id: r for r in chat.read_back(chat.format_chats(events)).collect()}
    want = fold(ROWS)
    assert {c: [tuple(t) for t in r.turns] for c, r in got.items()} == want
    for c, r in got.items():
        assert r.loss_text == "".join(t for role, t in want[c] if role == "assistant")


def test_log_leads_to_its_turns(spark):
    turns = [(1, 1, "user", "please"), (1, 2, "assistant", "a longer answer, with [marks]</s>"), (1, 3, "assistant", ""), (1, 4, "assistant", "xy"), (2, 1, None, None), (2, 2, "assistant", None), (3, 1, "assistant", "é" * 4001)]
    log = chat.logged(spark.createDataFrame(turns, "conv_id long, message long, role string, text string"))
    ops = {r.op: r["count"] for r in log.groupBy("op").count().collect()}
    assert ops == {"append": 7 + 5 * chat.DELTAS, "regenerate": 5, "edit": 2}
    got = {(r.conv_id, r.message): (r.role, r.text) for r in chat.fold_messages(log).collect()}
    assert got == {(c, m): (role or "", text or "") for c, m, role, text in turns}


def test_empty_log(spark):
    assert chat.read_back(chat.format_chats(spark.createDataFrame([], SCHEMA))).collect() == []


def test_query_against_the_table(spark, tmp_path):
    rows = [(1, 2, "assistant", "b\\[l]"), (1, 1, "user", "a</s>"), (1, 1, "user", "a</s>"), (2, 1, "assistant", None), (3, 5, "user", "")]
    spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    got = {r.conv_id: r for r in chat.op8_chat_formatting(spark, str(tmp_path)).collect()}
    rows += [(-7, 0, "user", chat.PLANTED), (-7, 1, "assistant", chat.PLANTED)]
    for c in {r[0] for r in rows}:
        own = sorted((t, r, x or "") for k, t, r, x in rows if k == c)
        loss = "".join(x for _, r, x in own if r == "assistant")
        digest = hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in own).encode()).hexdigest()
        assert (got[c].n_turns, got[c].turns_sha256, got[c].loss_chars, got[c].loss_sha256) == (len(own), digest, len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert len(got) == 4
