"""Text functions as SQL expressions; each is given for Spark ("spark") or for DuckDB ("duckdb")."""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column, DataFrame, SparkSession, Window, WindowSpec
from pyspark.sql import functions as F

TOKEN = "[A-Za-zÀ-ɏ0-9]+"
# Spellings that sound alike, applied in this order.
EQUIVALENCES = (
    ("ksh", "x"), ("ph", "f"), ("th", "t"), ("dh", "d"), ("bh", "b"), ("gh", "g"), ("kh", "k"), ("jh", "j"), ("zh", "j"), ("sh", "s"),
    ("ch", "c"), ("ck", "k"), ("ee", "i"), ("oo", "u"), ("ou", "au"), ("w", "v"), ("z", "s"), ("q", "k"), ("c", "k"))
LETTERS = "abcdefghijklmnopqrstuvwxyz"
# Characters stepped over on the way back to what ends a sentence, and what does; marks of an identifier,
# and what is cut from its ends.
OPENERS, ENDERS = " \t\"'‘’“”(", ".!?:;-–—\n"
#: All white space, and a class of it for regular expressions of either engine.
SPACES = "".join(c for c in map(chr, range(0x3001)) if c.isspace())
SPACE, NO_SPACE = f"[{SPACES}]", f"[^{SPACES}]"
IDENTIFIER_MARKS, EDGES = "@/\\_:#$%=&~+", ".,;!?\"'“”‘’"


def plain(word: str) -> str:
    """Lower-case letters and digits of a word without its accents."""
    bare = "".join(c for c in unicodedata.normalize("NFKD", word) if not unicodedata.combining(c))
    return "".join(c for c in bare.casefold() if c in LETTERS or c in "0123456789")


def _folds() -> tuple[str, str, list[tuple[str, str]]]:
    """How the letters of TOKEN beyond ASCII are made plain: one for one, dropped, or one for many."""
    one, to, gone, many = "", "", "", []
    for c in map(chr, range(0xC0, 0x250)):
        p = plain(c)
        if len(p) == 1:
            one, to = one + c, to + p
        elif p:
            many.append((c, p))
        else:
            gone += c
    return one + gone, to, many


FROM, TO, EXPANSIONS = _folds()


def quoted(text: str, engine: str = "spark") -> str:
    text = text.replace("'", "''") if engine == "duckdb" else text.replace("\\", "\\\\").replace("'", "\\'")
    return f"'{text}'"


def key(x: str, engine: str = "spark") -> str:
    """The phonetic key of a word."""
    x = f"translate({x}, '{FROM}', '{TO}')"
    for c, p in EXPANSIONS:
        x = f"replace({x}, '{c}', '{p}')"
    x = f"regexp_replace(lower({x}), '[^a-z0-9]+', ''{', ' + chr(39) + 'g' + chr(39) if engine == 'duckdb' else ''})"
    for a, b in EQUIVALENCES:
        x = f"replace({x}, '{a}', '{b}')"
    if engine == "spark":
        return f"regexp_replace({x}, '([a-z])\\\\1+', '$1')"
    for c in LETTERS:  # no back-references there
        x = f"regexp_replace({x}, '{c}{c}+', '{c}', 'g')"
    return x


def phrase_key(x: str, engine: str = "spark") -> str:
    """Keys of the words between white space, the empty ones dropped, joined by a space."""
    if engine == "duckdb":
        return f"array_to_string(list_filter(list_transform(regexp_split_to_array({x}, '{SPACE}+'), lambda w: {key('w', engine)}), lambda w: w <> ''), ' ')"
    return f"array_join(filter(transform(split({x}, '{SPACE}+'), w -> {key('w')}), w -> w <> ''), ' ')"


def casefold(x: str) -> str:
    """Lower case with the four letters of TOKEN whose case folding is longer."""
    return f"replace(replace(replace(replace(lower({x}), 'ß', 'ss'), 'ŉ', 'ʼn'), 'ſ', 's'), 'ǰ', 'ǰ')"


def folded(x: Column) -> Column:
    """The same of a column."""
    out = F.lower(x)
    for a, b in (("ß", "ss"), ("ŉ", "ʼn"), ("ſ", "s"), ("\u01f0", "j\u030c")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def near(a: str, b: str, engine: str = "spark") -> str:
    """One edit at most: a letter put in, left out or changed, or two neighbours swapped."""
    if engine == "duckdb":
        return f"damerau_levenshtein({a}, {b}) <= 1"
    swap = f"concat(substring({a}, 1, i - 1), substring({a}, i + 1, 1), substring({a}, i, 1), substring({a}, i + 2)) = {b}"
    return f"(levenshtein({a}, {b}, 1) >= 0 OR (length({a}) = length({b}) AND exists(sequence(1, greatest(length({a}) - 1, 1)), i -> {swap})))"


def sounds_alike(a: str, b: str, engine: str = "spark") -> str:
    x, y = key(a, engine), key(b, engine)
    return f"({x} <> '' AND {y} <> '' AND ({x} = {y} OR (length({x}) >= 4 AND length({y}) >= 4 AND {near(x, y, engine)})))"


def common(x: str, words: str) -> str:
    """Whether a word, or it without a final s or es, is among a quoted list of common words."""
    w = casefold(x)
    return f"({w} IN ({words}) OR ({w} LIKE '%s' AND left({w}, length({w}) - 1) IN ({words})) OR ({w} LIKE '%es' AND left({w}, length({w}) - 2) IN ({words})))"


def identifier(chunk: str, engine: str = "spark") -> str:
    """Whether a run without white space, its edge punctuation cut, has a mark of an identifier or a dot."""
    cut = f"trim(BOTH {quoted(EDGES)} FROM {chunk})" if engine == "spark" else f"trim({chunk}, {quoted(EDGES, engine)})"
    return f"(translate({cut}, {quoted(IDENTIFIER_MARKS + '.', engine)}, '') <> {cut})"


#: What tells a text apart: whose it is, its id as a string (empty for none, so that joins find it), and a hash of it, so
#: that rows with one id (or none) stay apart.
DOC = ("user_id", "doc", "version")


def owned(docs: DataFrame) -> DataFrame:
    """Adds doc and version, and an empty user_id where there is none: not a constant, as the optimizer takes those out of the
    keys of a join, which then asks for another deal of texts than `dealt` gives."""
    user = F.col("user_id").cast("string") if "user_id" in docs.columns else F.left(doc_key(F.col("doc_id")), F.lit(0))
    return docs.select(user.alias("user_id"), "doc_id", doc_key(F.col("doc_id")).alias("doc"), F.xxhash64("text").alias("version"), "text")


def doc_key(doc_id: Column) -> Column:
    return F.coalesce(F.concat(F.lit("="), doc_id.cast("string")), F.lit(""))


def with_id(rows: DataFrame, docs: DataFrame) -> DataFrame:
    """Adds doc_id, as docs has it, to rows that have doc."""
    return rows.withColumn("doc_id", F.when(F.col("doc") != "", F.substring("doc", 2, 1 << 30)).cast(docs.schema["doc_id"].dataType))


def dealt(docs: DataFrame) -> DataFrame:
    """Texts (as `owned` gives them) by DOC: what reads them again by DOC finds them where they are."""
    return owned(docs).repartition(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), *DOC)


def spread(docs: DataFrame) -> DataFrame:
    """Rows as they are where they are read in as many parts as a shuffle has, else dealt to so many."""
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return docs if docs.rdd.getNumPartitions() >= parts else docs.repartition(parts)


#: A row of a table, and the order of its tokens. What leads differs most, as sorting asks it first.
ROW = ("hash", *DOC, "copy")


def in_text() -> WindowSpec:
    return Window.partitionBy(*ROW).orderBy("pos")


def tokens(docs: DataFrame, only: DataFrame | None = None, identifiers: bool = False) -> DataFrame:
    """One row per token: doc_id, ROW, pos, start and end (code points), word, the gap before it, and where wanted
    `ident`, whether the run without white space that it is in is an identifier.

    Texts are dealt before they are cut, so that the windows over tokens need no exchange of tokens; of texts that aren't
    in `only` (DOC), no token is cut. Each row has its own tokens, those of repeated rows are told apart by `copy`. A null
    text has no tokens.
    """
    rows = dealt(docs)
    if only is not None:
        rows = rows.join(only.select(*DOC).distinct().hint("shuffle_hash"), list(DOC), "left_semi")
    rows = rows.where("text IS NOT NULL").withColumn("hash", F.xxhash64(*DOC)).withColumn("copy", F.monotonically_increasing_id())
    words = F.regexp_extract_all("text", F.lit(TOKEN), F.lit(0))
    parts = [F.split("text", TOKEN, -1).alias("gap"), words.alias("word")]
    if identifiers:
        # tokens have no white space, so the runs' own tokens are the text's, run by run
        run = lambda c: F.array_repeat(marked(c), F.size(F.regexp_extract_all(c, F.lit(TOKEN), F.lit(0))))
        some = F.col("text").rlike(f"[{re.escape(IDENTIFIER_MARKS)}]|[.]{NO_SPACE}")
        parts.append(F.when(some, F.flatten(F.transform(F.split("text", f"{SPACE}+"), run))).alias("ident"))
    split = rows.select("doc_id", *ROW, *parts)
    zipped = F.arrays_zip("gap", "word", *[F.coalesce("ident", F.expr("CAST(array() AS array<boolean>)")).alias("ident")] * identifiers)
    cut = split.select("doc_id", *ROW, F.posexplode(zipped).alias("pos", "t")).where("t.word IS NOT NULL")
    cut = cut.select("doc_id", *ROW, "pos", "t.gap", "t.word", *[F.coalesce("t.ident", F.lit(False)).alias("ident")] * identifiers)
    before = F.sum(F.length("gap") + F.length("word")).over(in_text())
    return cut.withColumn("end", before.cast("int")).withColumn("start", (F.col("end") - F.length("word")).cast("int"))


def marked(chunk: Column) -> Column:
    """`identifier` of a column."""
    core = F.btrim(chunk, F.lit(EDGES))
    return F.translate(core, IDENTIFIER_MARKS + ".", "") != core


def keyed(rows: DataFrame, word: Column, name: str = "key") -> DataFrame:
    """Adds the key of a word, in steps that leave out what most words don't need: letters beyond ASCII, an h, a letter
    twice. The same as `key` says."""
    h = [(a, b) for a, b in EQUIVALENCES if "h" in a]
    rest = [(a, b) for a, b in EQUIVALENCES if "h" not in a]
    if EQUIVALENCES != (*h, *rest):
        raise ValueError("spellings with an h come first")

    def replaced(x: str, pairs: list[tuple[str, str]]) -> str:
        for a, b in pairs:
            x = f"replace({x}, '{a}', '{b}')"
        return x

    full = f"translate(_w, '{FROM}', '{TO}')"
    full = f"regexp_replace(lower({replaced(full, EXPANSIONS)}), '[^a-z0-9]+', '')"
    out = rows.withColumn("_w", word).withColumn("_w", F.expr(f"CASE WHEN octet_length(_w) = length(_w) THEN lower(_w) ELSE {full} END"))
    out = out.withColumn("_w", F.expr(f"CASE WHEN contains(_w, 'h') THEN {replaced('_w', h)} ELSE _w END")).withColumn("_w", F.expr(replaced("_w", rest)))
    return out.withColumn(name, F.expr("CASE WHEN _w RLIKE '([a-z])\\\\1' THEN regexp_replace(_w, '([a-z])\\\\1+', '$1') ELSE _w END")).drop("_w")


def sentence_initial() -> Column:
    """Of a token with its gap: whether it opens a sentence."""
    g = F.expr(f"trim(TRAILING {quoted(OPENERS)} FROM gap)")
    return F.when(g == "", F.col("pos") == 0).otherwise(F.right(g, F.lit(1)).isin(*ENDERS))


def register(spark: SparkSession) -> None:
    """Temporary SQL functions of the same names."""
    for name, args, body in (
        ("phonetic_key", "w STRING", key("w")), ("phrase_key", "w STRING", phrase_key("w")), ("fold_case", "w STRING", casefold("w")),
        ("one_edit", "a STRING, b STRING", near("a", "b")), ("sounds_alike", "a STRING, b STRING", sounds_alike("a", "b")),
    ):
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({args}) RETURN {body}")
