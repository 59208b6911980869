"""Correcting documents against memories, as DataFrame operations.

docs([user_id,] doc_id, text); terms([user_id,] term, preferred, kind, note, trust); misspellings([user_id,] term,
misspelling, seen, vetoes, guard). A document meets the memory of its user; without a user_id column all share one.
Keys that the memory has, and all ways of leaving out one letter of those of one word, make a table and a sieve. Runs of
tokens that pass the sieve are found where the texts are (runs.py) and meet that table in an equi-join (and a check, for those
one edit from a key); so no token becomes a row that is shuffled or sorted. Texts are shuffled once: what was found is joined
to the same exchange of them.
Spans are settled longest first within each document, then each one gets a decision. A verdicts table ([user_id,] doc_id,
start, apply, preferred, reason) stands in for a judge. The memory's side of a join is broadcast by the planner only if it
is small.

Rows with one doc_id (or a null one) and different texts are documents of their own, repeated rows each give their row in
the output; verdicts hold for every text of their doc_id. A null text has no candidates and stays null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.lexicon import COMMON, GLUE, listed
from ..functions.text import DOC
from ..sources.shared import kept
from .rules import ACTIVE, FUZZY_LENGTH
from .runs import CUT, runs, sieve


def of_user(table: DataFrame) -> DataFrame:
    """The table with a user_id, the empty one where it has none (no constant, as in T.owned)."""
    user = F.col("user_id").cast("string") if "user_id" in table.columns else F.left(F.coalesce(F.col(f"`{table.columns[0]}`").cast("string"), F.lit("")), F.lit(0))
    return table.withColumn("user_id", user)


def term_keys(terms: DataFrame, misspellings: DataFrame) -> DataFrame:
    """(user_id, key, term): keys of the preferred spelling and of every spelling seen, vetoed ones too."""
    spelled = of_user(terms).select("user_id", "term", F.col("preferred").alias("s")).union(of_user(misspellings).select("user_id", "term", F.col("misspelling").alias("s")))
    return spelled.select("user_id", F.expr(T.phrase_key("s")).alias("key"), "term").where("key <> ''").distinct()


def shortened(k: str) -> str:
    """The key and every way of leaving out one letter of it."""
    return f"array_distinct(array_append(transform(sequence(1, length({k})), i -> concat(substring({k}, 1, i - 1), substring({k}, i + 1))), {k}))"


def with_cuts(rows: DataFrame, k: str) -> DataFrame:
    """A row for each `shortened` of a key, as `cut`."""
    return rows.withColumn("_i", F.explode(F.expr(f"sequence(0, length({k}))"))).withColumn("cut", F.expr(f"CASE WHEN _i = 0 THEN {k} ELSE concat(substring({k}, 1, _i - 1), substring({k}, _i + 1)) END")).drop("_i")


def memory_keys(terms: DataFrame, misspellings: DataFrame) -> DataFrame:
    """(user_id, ask, k, names, spelled, reach): terms that memory has for a key k, and how they are spelled; `ask` is "=" and
    the key, and for keys of one word also CUT and each `with_cuts` of it. A key whose term is gone has no names."""
    keys = term_keys(terms, misspellings).join(of_user(terms).select("user_id", "term", "preferred", F.col("term").alias("name")), ["user_id", "term"], "left")
    known = keys.groupBy("user_id", F.col("key").alias("k")).agg(F.array_sort(F.collect_set("name")).alias("names"), F.collect_set("preferred").alias("spelled")).join(longest_terms(terms), "user_id")
    near = with_cuts(known.where("k NOT LIKE '% %'"), "k").select("user_id", F.concat(F.lit(CUT), "cut").alias("ask"), "k", "names", "spelled", "reach").dropDuplicates(["user_id", "ask", "k"])
    return known.select("user_id", F.concat(F.lit("="), "k").alias("ask"), "k", "names", "spelled", "reach").union(near)


def longest_terms(terms: DataFrame) -> DataFrame:
    """(user_id, reach): how many words the longest term of each user has, and a run of tokens may have."""
    return of_user(terms).groupBy("user_id").agg(F.max(F.size(F.split("preferred", " "))).alias("reach"))


def marked_tokens(docs: DataFrame, words: frozenset[str] = COMMON) -> DataFrame:
    """Tokens with their key and what their neighbourhood says: capitalised phrases and identifiers."""
    t = T.keyed(T.tokens(docs, identifiers=True), F.col("word")).withColumn("common", F.expr(T.common("word", listed(words)))).withColumn("opens", T.sentence_initial())
    upper = (F.left("word", F.lit(1)) != F.lower(F.left("word", F.lit(1)))) & F.col("word").rlike("^[^0-9]")
    seen = F.when(~F.col("word").rlike("^[0-9]+$") & (F.lower("word") != "s"), F.struct(upper.alias("upper"), "opens"))
    beside = "(PARTITION BY " + ", ".join(T.ROW) + " ORDER BY pos)"
    t = t.withColumn("seen", seen).withColumn("after", F.expr(f"lead(seen, 1) IGNORE NULLS OVER {beside}")).withColumn("before", F.expr(f"lag(seen, 1) IGNORE NULLS OVER {beside}"))
    number = F.coalesce(F.lead("word").over(T.in_text()).rlike("^[0-9]+$"), F.lit(False))
    phrase = number | F.coalesce(F.col("after.upper"), F.lit(False)) | F.coalesce(F.col("before.upper") & ~F.col("before.opens"), F.lit(False))
    return t.withColumn("in_phrase", phrase).drop("seen", "after", "before")


#: Words of a run that are read off beside each token; longer runs are looked for only where one may begin.
INLINE = 3


def windows(tokens: DataFrame, longest: int) -> DataFrame:
    """Runs of 1 to `longest` tokens with one space between neighbours: start, end, n, key, text, all_common, and as
    match "key"; two such neighbours read as one word have the match "join"."""
    step = tokens
    for i in range(1, max(longest, 2)):
        step = step.withColumn(f"_{i}", F.lead(F.struct("gap", "word", "key", "end", "common", "ident"), i).over(T.in_text()))
    near = lambda r: F.coalesce(r["gap"] == " ", F.lit(False)) & ~r["ident"]
    two = ~F.col("ident") & near(F.col("_1")) & ~(F.lower("word").isin("a", "an", "the") & F.col("_1.common"))
    step = T.keyed(step, F.when(two, F.concat("word", "_1.word")), "both")
    kinds, run, whole = [], [F.struct("gap", "word", "key", "end", "common", "ident")], ~F.col("ident")
    for n in range(1, longest + 1):
        if n > 1:
            run.append(F.col(f"_{n - 1}"))
            whole = whole & near(run[-1])
        keys = F.array_join(F.filter(F.array(*(r["key"] for r in run)), lambda k: k != ""), " ") if n > 1 else F.col("key")
        common = F.col("common") if n == 1 else F.forall(F.array(*(r["common"] for r in run)), lambda c: c)
        kinds.append(F.when(whole & (keys != ""), F.struct(F.lit("key").alias("match"), F.lit(n).alias("n"), run[-1]["end"].alias("end"), keys.alias("key"), F.concat_ws(" ", *(r["word"] for r in run)).alias("text"), common.alias("all_common"))))
    kinds.append(F.when(two & (F.col("both") != ""), F.struct(F.lit("join").alias("match"), F.lit(2).alias("n"), F.col("_1.end").alias("end"), F.col("both").alias("key"), F.concat("word", F.lit(" "), "_1.word").alias("text"), (F.col("common") & F.col("_1.common")).alias("all_common"))))
    return step.select(*DOC, "start", "in_phrase", F.explode(F.filter(F.array(*kinds), lambda k: k.isNotNull())).alias("w")).select(*DOC, "start", "in_phrase", "w.*")


def long_runs(tokens: DataFrame, begun: DataFrame) -> DataFrame:
    """Runs of more than INLINE tokens, as `windows` has them, for users with terms of so many words: from a token where a
    key of the user's begins (or one without a key, which may begin any), the tokens from there on meet it by their places.
    So a long term costs rows where it may begin, and nothing in the texts of other users."""
    place = [c for c in T.ROW if c != "user_id"]
    may = tokens.where("NOT ident").select("user_id", *place, "pos", "key")
    heads = may.join(begun, F.expr("user_id = of_user AND key = first")).select(*T.ROW, F.col("pos").alias("head"), "reach")
    wanted = heads.withColumn("pos", F.explode(F.expr("sequence(head, head + reach - 1)")))
    run = wanted.join(tokens, [*T.ROW, "pos"])
    order = Window.partitionBy(*T.ROW, "head").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    whole = F.min((F.col("pos") == F.col("head")) | ((F.col("gap") == " ") & ~F.col("ident"))).over(order)
    grown = run.select(
        *DOC, F.first("start").over(order).alias("start"), F.first("in_phrase").over(order).alias("in_phrase"), F.lit("key").alias("match"), (F.col("pos") - F.col("head") + 1).alias("n"), "end",
        F.array_join(F.filter(F.collect_list("key").over(order), lambda k: k != ""), " ").alias("key"), F.array_join(F.collect_list("word").over(order), " ").alias("text"), F.min("common").over(order).alias("all_common"), whole.alias("whole"))
    return grown.where(F.col("whole") & (F.col("n") > INLINE) & (F.col("key") != "")).drop("whole")


def beginnings(terms: DataFrame, misspellings: DataFrame) -> DataFrame:
    """(of_user, first, reach) of users whose longest term has more than INLINE words: first words of their keys, and the
    empty one, with the words of that term."""
    longest = longest_terms(terms).where(F.col("reach") > INLINE)
    keys = term_keys(terms, misspellings).where("key LIKE '% %'").select("user_id", F.explode(F.array(F.substring_index("key", " ", 1), F.lit(""))).alias("first")).distinct()
    return keys.join(longest, "user_id").select(F.col("user_id").alias("of_user"), "first", "reach")


def candidates(docs: DataFrame, terms: DataFrame, misspellings: DataFrame, words: frozenset[str] = COMMON) -> DataFrame:
    """Settled spans: user_id, doc, version, start, end, text, match, all_common, in_phrase, terms (array of names), context
    (words that may guard, where the text of a span may be held back)."""
    # kept, so that the planner knows its size
    known = kept(memory_keys(terms, misspellings))
    longest = terms.agg(F.max(F.size(F.split("preferred", " ")))).first()[0] or 1
    keys = known.where("ask LIKE '=%'").select("user_id", F.col("k").alias("key"))
    asked = runs(docs, sieve(keys, of_user(misspellings)), longest, words).withColumn("ask", F.explode("asks")).drop("asks")
    exact = F.col("ask").startswith("=")
    found = asked.join(known, ["user_id", "ask"]).where((exact & F.expr("match = 'join' OR n <= reach")) | (~exact & F.expr(T.near("key", "k"))))
    # a word that has a key of the memory is no edit from another
    place = [*DOC, "start", "end", "match"]
    found = found.select(*place, F.struct("text", "all_common", "in_phrase", "context").alias("run"), F.struct(exact.alias("exact"), "names", "spelled").alias("met"))
    each = found.repartition(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), *DOC).groupBy(*place).agg(F.max("run").alias("run"), F.max("met.exact").alias("exact"), F.collect_list("met").alias("met"))
    each = each.withColumn("met", F.filter("met", lambda m: m["exact"] == F.col("exact")))
    every = lambda part: F.array_distinct(F.flatten(F.transform("met", lambda m: m[part])))
    each = each.select(*DOC, "start", "end", "run.*", F.when(F.col("exact"), F.col("match")).otherwise("fuzzy").alias("match"), F.array_sort(every("names")).alias("terms"), every("spelled").alias("spelled"))
    return settled(each.where("size(terms) > 0").withColumn("said", F.array_contains("spelled", F.col("text"))).drop("spelled"))


def settled(found: DataFrame) -> DataFrame:
    """Longest first, then leftmost: a span that overlaps one already taken goes. One that reads as its term does holds
    its place but is no candidate. Work is by cluster of overlapping spans, so a long document is no long list."""
    order = Window.partitionBy(*DOC).orderBy("start", F.desc("end"))
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    spans = found.withColumn("new", F.when(F.coalesce(F.col("start") >= reach, F.lit(True)), 1).otherwise(0))
    spans = spans.withColumn("cluster", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    rank = F.when(F.col("match") == "join", 1).otherwise(0)
    item = F.struct((F.col("start") - F.col("end")).alias("o"), "start", rank.alias("rank"), "end", "text", "match", "all_common", "in_phrase", "terms", "said", "context")
    # repeated rows have the same spans: they count once
    lists = spans.groupBy(*DOC, "cluster").agg(F.array_sort(F.collect_set(item)).alias("items"))
    free = lambda taken, s: ~F.exists(taken, lambda t: (t["start"] < s["end"]) & (s["start"] < t["end"]))
    taken = F.aggregate("items", F.slice("items", 1, 0), lambda a, s: F.when(free(a, s), F.array_append(a, s)).otherwise(a))
    kept = lists.select(*DOC, F.explode(taken).alias("s")).where("NOT s.said")
    return kept.select(*DOC, "s.start", "s.end", "s.text", "s.match", "s.all_common", "s.in_phrase", "s.terms", "s.context")


def context_words(owned: DataFrame) -> DataFrame:
    """Texts (as T.owned gives them) with `context`: folded tokens of three letters or more that are no glue."""
    folded = F.transform(F.regexp_extract_all("text", F.lit(T.TOKEN), F.lit(0)), lambda w: T.folded(w))
    lower = F.filter(folded, lambda w: (F.length(w) >= 3) & ~w.isin(*sorted(GLUE)))
    return owned.select("doc_id", *DOC, F.array_distinct(lower).alias("context"))


def weighed(docs: DataFrame, terms: DataFrame, misspellings: DataFrame, words: frozenset[str] = COMMON) -> DataFrame:
    """Each candidate span with what memory says of it, all that a decision needs but verdicts: n_trusted, first (the first
    trusted term), trust, held (why it is held back, if so), seen, options."""
    spans = candidates(docs, terms, misspellings, words)
    terms, misspellings = of_user(terms), of_user(misspellings)
    each = spans.withColumn("name", F.expr(T.casefold("text"))).withColumn("term", F.explode("terms")).join(terms.select("user_id", "term", "preferred", "trust"), ["user_id", "term"])
    spelled = misspellings.select("user_id", "term", F.col("misspelling").alias("name"), "seen", "vetoes", "guard")
    each = each.join(spelled, ["user_id", "term", "name"], "left")
    trusted = F.col("trust") >= ACTIVE
    held = F.when(trusted & (F.coalesce("vetoes", F.lit(0)) > 0), F.when(F.size("guard") == 0, "skipped:vetoed").when(F.arrays_overlap("guard", "context"), "skipped:guarded"))
    each = each.withColumn("held", held)
    return each.groupBy(*DOC, "start", "end", "text", "match", "all_common", "in_phrase", "terms").agg(
        F.count_if(trusted).alias("n_trusted"), F.min(F.when(trusted, F.struct("term", "preferred"))).alias("first"), F.max("trust").alias("trust"),
        F.min(F.when(F.col("held").isNotNull(), F.struct("term", "held")))["held"].alias("held"), F.coalesce(F.max(F.when(trusted, F.col("seen"))), F.lit(0)).alias("seen"),
        F.collect_set(F.when(trusted, F.col("preferred"))).alias("options"))


def decisions(docs: DataFrame, terms: DataFrame, misspellings: DataFrame, verdicts: DataFrame | None = None, words: frozenset[str] = COMMON) -> DataFrame:
    """Each candidate span with its decision and, where applied, the new text."""
    return ruled(weighed(docs, terms, misspellings, words), docs, verdicts)


def ruled(back: DataFrame, docs: DataFrame, verdicts: DataFrame | None = None) -> DataFrame:
    """`decisions` of spans as `weighed` has them. Who decides before a judge is asked and again after keeps those, so that
    texts are searched once."""
    letters = ~F.col("text").rlike("[0-9 ×÷]")
    unproven = (F.col("match") == "key") & letters & (F.col("in_phrase") | ((F.col("seen") == 0) & (F.lower("text") == F.col("text"))))
    pending = (F.col("n_trusted") > 1) | (F.col("match") == "fuzzy") | F.col("all_common") | unproven
    if verdicts is None:
        answer, chosen, reason = F.lit(None).cast("string"), F.lit(None).cast("string"), F.lit(None).cast("string")
    else:
        v = of_user(verdicts).select("user_id", T.doc_key(F.col("doc_id")).alias("doc"), "start", F.col("apply").alias("v_apply"), F.col("preferred").alias("v_preferred"), F.col("reason").alias("v_reason"), F.lit(True).alias("judged"))
        back = back.join(v, ["user_id", "doc", "start"], "left")
        fine = F.col("v_apply") & F.array_contains("options", F.col("v_preferred"))
        answer = F.when(F.coalesce(fine, F.lit(False)), "applied").when(~F.coalesce(F.col("v_apply"), F.lit(True)), "skipped:context").when(F.col("judged"), "llm-error")
        chosen, reason = F.col("v_preferred"), F.col("v_reason")
    fallback = F.when(F.col("n_trusted") > 1, "skipped:conflict").otherwise("skipped:context-unavailable")
    decision = F.when(F.col("n_trusted") == 0, "skipped:low-trust").when(F.col("held").isNotNull(), F.col("held")).when(pending, F.coalesce(answer, fallback)).otherwise("applied")
    word = F.when(pending, chosen).otherwise(F.col("first.preferred"))
    shout = (F.length("text") > 1) & (F.upper("text") == F.col("text")) & (F.lower("text") != F.col("text")) & (F.upper(word) != word) & (F.length(F.upper(word)) == F.length(word))
    out = back.withColumn("decision", decision).withColumn("pending", pending & (F.col("n_trusted") > 0) & F.col("held").isNull())
    out = out.withColumn("applied", F.when(F.col("decision") == "applied", F.when(shout, F.upper(word)).otherwise(word))).withColumn("reason", reason)
    return T.with_id(out.drop("first", "held", "seen"), docs)


def rebuilt(text: Column, cuts: Column) -> Column:
    """The text with spans (start, end, applied), ordered and apart from each other, replaced."""
    end = lambda i: F.when(i == 0, 0).otherwise(F.element_at(cuts, F.greatest(i, F.lit(1)))["end"])
    parts = F.transform(cuts, lambda s, i: F.concat(F.substr(text, end(i) + 1, s["start"] - end(i)), s["applied"]))
    return F.concat(F.array_join(parts, ""), F.substr(text, F.coalesce(F.array_max(F.transform(cuts, lambda s: s["end"])), F.lit(0)) + 1))


def spliced(docs: DataFrame, decided: DataFrame) -> DataFrame:
    """One row for each row of docs: user_id, doc_id, text, output, n_candidates, reason and candidates.

    Every applied span is replaced; a document without candidates stays as it was.
    """
    entry = F.struct("start", "end", "text", "match", "decision", "applied", "reason")
    spans = decided.groupBy(*DOC).agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.when(F.col("decision") == "applied", F.struct("start", "end", "applied")))).alias("cuts"), F.array_sort(F.collect_list(entry)).alias("candidates"))
    # texts stream past the spans of their part, so they need no order
    both = T.dealt(docs).join(spans.hint("shuffle_hash"), list(DOC), "left")
    out = F.when(F.col("n").isNull(), F.col("text")).otherwise(rebuilt(F.col("text"), F.col("cuts")))
    return both.select("user_id", "doc_id", "text", out.alias("output"), F.coalesce("n", F.lit(0)).alias("n_candidates"), F.when(F.col("n").isNull(), "no-candidates").otherwise("").alias("reason"), "candidates")


def checked(result: DataFrame) -> DataFrame:
    """The result of a correction, as it is if nothing outside its applied spans has changed; else the job fails."""
    applied = F.filter("candidates", lambda c: c["decision"] == "applied")
    kept = F.aggregate(applied, F.struct(F.lit(0).alias("a"), F.lit(0).alias("b"), F.lit(True).alias("ok")), lambda s, c: F.struct(
        c["end"].alias("a"), (s["b"] + c["start"] - s["a"] + F.length(c["applied"])).alias("b"),
        (s["ok"] & (F.substr("text", s["a"] + 1, c["start"] - s["a"]) == F.substr("output", s["b"] + 1, c["start"] - s["a"])) & (F.substr("output", s["b"] + c["start"] - s["a"] + 1, F.length(c["applied"])) == c["applied"])).alias("ok")))
    fine = F.col("n_candidates") == 0
    fine = F.when(fine, F.col("text").eqNullSafe(F.col("output"))).otherwise(kept["ok"] & (F.substr("text", kept["a"] + 1) == F.substr("output", kept["b"] + 1)))
    return result.where(F.assert_true(fine, F.lit("a correction changed text outside its spans")).isNull())


def toggled(text: Column, candidates: Column, undone: Column) -> Column:
    """The text with all applied spans but those whose starts are undone."""
    return rebuilt(text, F.filter(candidates, lambda c: (c["decision"] == "applied") & ~F.array_contains(undone, c["start"])))


def correct(docs: DataFrame, terms: DataFrame, misspellings: DataFrame, verdicts: DataFrame | None = None, words: frozenset[str] = COMMON) -> DataFrame:
    return spliced(docs, decisions(docs, terms, misspellings, verdicts, words))


def traces(result: DataFrame) -> DataFrame:
    """(user_id, doc_id, input, output, data): a row to keep of each correction, those without candidates too."""
    data = F.to_json(F.struct("reason", F.coalesce("candidates", F.array()).alias("candidates")))
    return result.select("user_id", "doc_id", F.col("text").alias("input"), "output", data.alias("data"))


def asked(spans: DataFrame, docs: DataFrame, terms: DataFrame) -> DataFrame:
    """One row for each text with spans: user_id, doc_id, DOC, text, and `spans` as they are with `of`, their terms that are
    in the table, and `elsewhere`, the first of these that the text has as it is preferred, outside the span. Of each term
    that a text is asked for it tells where the first place ends and the last one begins; the text is read once."""
    about = of_user(terms).select("user_id", "term", F.struct("term", "preferred", F.coalesce("kind", F.lit("term")).alias("kind"), F.coalesce("note", F.lit("")).alias("note"), F.regexp_extract_all("preferred", F.lit(T.TOKEN), F.lit(0)).alias("seq")).alias("of"))
    span = F.struct(*(c for c in spans.columns if c not in DOC))
    each = spans.select(*DOC, span.alias("span"), F.explode_outer("terms").alias("term")).join(about, ["user_id", "term"], "left")
    lists = each.groupBy(*DOC, "span").agg(F.collect_list("of").alias("of")).groupBy(*DOC).agg(F.collect_list(F.struct("span.*", "of")).alias("spans"))
    apart, inside = T.TOKEN.replace("[", "[^"), T.TOKEN.removesuffix("+")
    first = lambda p: F.length(F.call_function("regexp_extract", F.col("text"), p, F.lit(1)))
    words = lambda x: F.concat(F.lit(f"(?<!{inside})"), F.array_join(x["seq"], apart), F.lit(f"(?!{inside})"))
    until = lambda x: first(F.concat(F.lit("(?s)^(.*?"), words(x), F.lit(")")))
    at = lambda x: first(F.concat(F.lit("(?s)^(.*)"), words(x)))
    wanted = F.filter(F.array_distinct(F.flatten(F.transform("spans", lambda s: s["of"]))), lambda x: (F.size(x["seq"]) > 0) & F.contains(F.col("text"), F.get(x["seq"], F.lit(0))))
    places = F.filter(F.transform(wanted, lambda x: F.struct(x["term"].alias("term"), x["preferred"].alias("preferred"), until(x).alias("until"), at(x).alias("at"))), lambda x: x["until"] > 0)
    apart_from = lambda s, x: F.exists(s["of"], lambda o: o["term"] == x["term"]) & ((x["until"] <= s["start"]) | (x["at"] >= s["end"]))
    # the places as an array of one, so that they are looked for once for all spans
    told = F.transform(F.array(places), lambda p: F.transform("spans", lambda s: s.withField("elsewhere", F.array_min(F.filter(p, lambda x: apart_from(s, x)))["preferred"])))
    own = T.dealt(docs).join(lists.hint("shuffle_hash"), list(DOC)).dropDuplicates(list(DOC))
    return own.select("user_id", "doc_id", "doc", "version", "text", F.element_at(told, 1).alias("spans"))


def elsewhere(spans: DataFrame, docs: DataFrame, terms: DataFrame) -> DataFrame:
    """Spans with `elsewhere`, as `asked` has them."""
    return asked(spans, docs, terms).select(*DOC, F.explode("spans").alias("s")).select(*DOC, "s.*").drop("of")


JOIN_HINT = "two words that sound like one term together"


def judge_requests(docs: DataFrame, decided: DataFrame, terms: DataFrame) -> DataFrame:
    """One request for each document with pending spans: user_id, doc_id, version, sentence, and items (start, text,
    options with their kind and note, hint) in the order of the text."""
    texts = asked(decided.where("pending").select(*DOC, "start", "end", "text", "match", "terms"), docs, terms.where(F.col("trust") >= ACTIVE))
    hint = lambda s: F.array_join(F.filter(F.array(F.when(s["elsewhere"].isNotNull(), F.concat(F.lit("the text also has "), s["elsewhere"], F.lit(" as it is spelled"))), F.when(s["match"] == "join", F.lit(JOIN_HINT))), lambda h: h.isNotNull()), "; ")
    options = lambda s: F.array_sort(F.transform(s["of"], lambda o: F.struct(o["preferred"].alias("preferred"), o["kind"].alias("kind"), o["note"].alias("note"))))
    items = F.transform("spans", lambda s: F.struct(s["start"].alias("start"), s["text"].alias("text"), options(s).alias("options"), hint(s).alias("hint")))
    return texts.select("user_id", "doc_id", "version", F.col("text").alias("sentence"), F.array_sort(items).alias("items"))
