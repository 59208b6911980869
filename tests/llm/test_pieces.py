import numpy as np
import sentencepiece

from lexifold.llm import pieces

TEXTS = [
    "if x:\n   foo  bar", "    a", "a     ", " " * 40, "", "a b  c   d    e", "▁  ▁ x", "é☃ naïve 東京 \U0001f600 text", "tab\tand\nline", "<s> </s> <0x41> <unk>", "the quick brown fox jumps over the lazy dog " * 3,
    "x" * 300, "\x00\x7f\ud7ff", "¿Qué tal? Straße", "1234567890 3.14", " leading and trailing ", "\U0010fffe" * 3,
]


def vocabulary():
    sp = sentencepiece.SentencePieceProcessor(model_file=pieces.model_path())
    plain, byte = {}, {}
    for i in range(len(sp)):
        if sp.is_byte(i):
            byte[int(sp.id_to_piece(i)[3:5], 16)] = i
        elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
            plain[sp.id_to_piece(i)] = (sp.get_score(i), i)
    return sp, plain, byte


def best_score(text, plain, unknown):
    """The best sum over all ways to cut the whole text, by trying every piece at every place."""
    text = (" " + text).replace("▁", "\U0010ffff").replace(" ", "▁")
    best = [0.0] + [-np.inf] * len(text)
    longest = max(map(len, plain))
    for end in range(1, len(text) + 1):
        for start in range(max(0, end - longest), end):
            if (p := plain.get(text[start:end])) is not None:
                best[end] = max(best[end], best[start] + p[0])
        if text[end - 1] not in plain:
            best[end] = max(best[end], best[end - 1] + unknown)
    return best[-1]


def test_whole_texts_by_brute_force():
    sp, plain, byte = vocabulary()
    c = pieces.codec(pieces.model_path())
    r = np.random.default_rng(0)
    letters = list("abcdeio stnr") + ["é", "☃", "\n", "東", "  "]
    for t in [*TEXTS, *("".join(r.choice(letters, 60)) for _ in range(60))]:
        ids = c.encode(t).tolist()
        assert c.decode(np.array(ids, np.int32)) == t
        score, pending = 0.0, b""
        for i in ids:  # byte pieces that make one character cost what an unknown character costs
            if sp.is_byte(i):
                pending += bytes([int(sp.id_to_piece(i)[3:5], 16)])
                try:
                    pending.decode()
                except UnicodeDecodeError:
                    continue
                score, pending = score + c.unknown, b""
            else:
                score += sp.get_score(i)
        assert score == best_score(t, plain, c.unknown)


def test_units_change_nothing():
    c = pieces.codec(pieces.model_path())
    for t in TEXTS:
        whole = (" " + t).replace("▁", pieces.STAND_IN).replace(" ", "▁")
        assert c.encode(t).tolist() == c.best(whole, " " + t)
    assert len(c.encode("a" + " " * 16)) < 4


def test_rows(spark):
    rows = [*enumerate(TEXTS), (0, TEXTS[0]), (None, "no id"), (100, None), (101, "word " * 30_000)]
    docs = spark.createDataFrame([(d, t, [1], True) for d, t in rows], "doc_id long, text string, ids array<int>, exact boolean")
    made = pieces.encode(docs).cache()
    assert made.count() == len(rows) and made.where("NOT exact AND text_sha256 IS NOT NULL").isEmpty()
    found = {r.doc_id: r.text for r in pieces.decode(made).collect()}
    assert all(found[d] == t for d, t in rows)


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert pieces.encode(docs).collect() == [] and pieces.decode(pieces.encode(docs)).collect() == []
