"""Queries over what a memory needs beside correction and the fold, and their SQL: names, keys, retired terms, guards,
requests and verdicts of a judge, costs, and counts of an evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import align, correct, evaluate, judge, memory
from ..operators.rules import GUARD_WORDS, LONGEST, REFUSALS
from ..sources.log import numbered
from . import oracle
from .catalog import SPELLINGS, TERMS, dictionary, docs, table


def part_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select(F.lit("").alias("user_id"), F.col("p_name").alias("preferred")).distinct()
    return p.withColumn("term", F.expr(T.casefold("preferred"))).withColumn("key", F.expr(T.phrase_key("preferred")))


def term_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names in capitals, some with another ending, looked up by their folded form."""
    name = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.upper("p_name"), F.lit("X"))).otherwise(F.upper("p_name"))
    names = table(spark, sf_dir, "part").select(F.lit("").alias("user_id"), "p_partkey", name.alias("name"))
    return memory.found(names, part_terms(spark, sf_dir)).select("p_partkey", "name", "preferred")


#: Letters that have an accent in the terms of `composed_lookup`.
BARE, ACCENTED, ACCENTS = "aeo", "áéö", "\u0301\u0301\u0308"


def composed_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names in capitals whose accents are characters of their own, some without them, looked up among terms written with
    letters that have them."""
    p = table(spark, sf_dir, "part")
    name = F.upper("p_name")
    for a, accent in zip(BARE.upper(), ACCENTS, strict=True):
        name = F.when(F.col("p_partkey") % 3 == 0, name).otherwise(F.replace(name, F.lit(a), F.lit(a + accent)))
    preferred = F.translate("p_name", BARE, ACCENTED)
    known = p.select(F.lit("").alias("user_id"), preferred.alias("preferred")).distinct().withColumn("term", memory.folded_name("preferred"))
    names = p.select(F.lit("").alias("user_id"), "p_partkey", name.alias("name"))
    return memory.found(names, known).select("p_partkey", "name", "preferred")


def key_owner(spark: SparkSession, sf_dir: str) -> DataFrame:
    return memory.first_by_key(part_terms(spark, sf_dir)).select("key", "preferred")


def children(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    one = e.select(F.col("user_id").cast("string").alias("user_id"), F.col("event_type").alias("term"), F.concat(F.lit("m"), F.col("event_id") % 7).alias("misspelling"), F.lit(1).alias("d_seen"), (F.col("event_id") % 5 == 0).cast("int").alias("d_veto"), F.col("event_id").alias("ts"), F.col("event_id").alias("seq"))
    return memory.counters(one).withColumn("guard", F.array("term"))


def hydrated_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("user_id"), F.col("event_type").alias("term")).distinct()
    own = memory.hydrate(e, children(spark, sf_dir).where("misspelling <> 'm0'"))
    entry = lambda x: F.concat_ws(":", x["key"], x["value"]["seen"].cast("string"), x["value"]["vetoes"].cast("string"), F.array_join(x["value"]["guard"], "+"))
    return own.select("user_id", "term", F.array_join(F.transform(F.array_sort(F.map_entries("misspellings")), entry), ",").alias("spellings"))


def cascaded(spark: SparkSession, sf_dir: str) -> DataFrame:
    gone = table(spark, sf_dir, "events").where("event_id % 11 = 0").select(F.col("user_id").cast("string").alias("user_id"), F.col("event_type").alias("term"))
    return memory.cascade(children(spark, sf_dir), gone).select("user_id", "term", "misspelling", F.col("seen").cast("long").alias("seen"))


def retired_left(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("user_id"), "event_type", "event_id", F.concat(F.lit("t"), F.col("event_id") % 40).alias("term"), F.concat(F.lit("k"), F.col("event_id") % 15).alias("key"))
    gone, added = e.where("event_type = 'error'"), e.where("event_type = 'signup' AND event_id % 3 = 0")
    return memory.unretire(gone.select("user_id", "term", "key", "event_id"), added).select("user_id", "term", "key", "event_id")


def guards(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = F.array_distinct(F.regexp_extract_all("text", F.lit(T.TOKEN), F.lit(0)))
    fresh, old = F.filter("w", lambda x: F.length(x) == 5), F.sort_array(F.filter("w", lambda x: F.length(x).isin(5, 6)), asc=False)
    made = docs(spark, sf_dir).withColumn("w", words).withColumn("old", F.filter(old, lambda x: ~x.rlike("^[a-m]")))
    return made.select("doc_id", F.array_join(memory.guard_merge(fresh, F.col("old")), ",").alias("guard"))


def checked_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, p = F.col("p_partkey") % 6, F.col("p_name")
    name = F.when(n == 0, F.concat(F.lit("  "), p, F.lit(" "))).when(n == 1, F.replace(p, F.lit(" "), F.lit(" \t "))).when(n == 2, F.concat(p, F.lit("-x"))).when(n == 3, F.repeat(F.concat(p, F.lit(" ")), F.lit(9))).when(n == 4, F.col("p_partkey").cast("string")).otherwise(p)
    out = memory.accepted(table(spark, sf_dir, "part").select(name.alias("preferred")))
    return out.groupBy("preferred", "error").agg(F.count("*").alias("n"))


def logged_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").select("conv_id", F.when(F.col("turn") % 3 == 0, T.SPACES).when(F.col("turn") % 3 == 1, F.col("text")).alias("formatted"), F.when(F.col("turn") % 2 == 0, F.col("role")).otherwise("").alias("final"))
    return memory.said_something(c).groupBy("conv_id").agg(F.count("*").alias("n"))


def refused_deletes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deletes of a term that isn't there are refused, all else is logged."""
    e = table(spark, sf_dir, "events").where("event_type IN ('signup', 'error')")
    kind = F.when(F.col("event_type") == "signup", "add_term").otherwise("delete_term")
    log = e.select("user_id", F.col("event_id").alias("seq"), "ts", kind.alias("type"), F.lit('{"preferred": "Jonas"}').alias("payload"))
    none = spark.createDataFrame([], memory.STATE)
    return memory.fold_onto(none, log).where("part = 'refused'").select("user_id", "seq")


def spaced_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Correction of texts where white space of every kind stands between words and identifiers."""
    one = F.substr(F.lit(T.SPACES), F.col("doc_id") % len(T.SPACES) + 1, F.lit(1))
    text = F.replace(F.replace("text", F.lit(" t"), F.concat(F.lit(".x"), one, F.lit("t"))), F.lit("on "), F.concat(F.lit("on"), one))
    r = correct.correct(docs(spark, sf_dir).withColumn("text", text), *dictionary(spark))
    return r.select("doc_id", F.md5("output").alias("output"), F.col("n_candidates").cast("long").alias("n_candidates"))


def edited_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of conversations, edited: the first word in capitals or another, or the first two made one. Texts of fewer
    than six words, or whose third word comes again, stay as they are (what stands for what would be open)."""
    words = F.regexp_extract_all("text", F.lit(T.TOKEN), F.lit(0))
    c = table(spark, sf_dir, "conversations").withColumn("w", words).withColumn("low", F.transform("w", lambda x: F.lower(x)))
    at = F.length(F.element_at(F.split("text", T.TOKEN, 2), 1))
    gap = F.length(F.element_at(F.split("text", T.TOKEN, 3), 2))
    c = c.withColumn("at", at).withColumn("gap", gap).withColumn("a", F.get("w", F.lit(0))).withColumn("b", F.get("w", F.lit(1)))
    clear = (F.size("w") >= 6) & (F.size(F.filter("low", lambda x: x == F.get("low", F.lit(2)))) == 1) & ~F.array_contains("low", F.lower(F.concat("a", "b"))) & ~F.array_contains("low", F.concat(F.lower("a"), F.lit("x")))
    kind = (F.col("conv_id") + F.col("turn")) % 3
    new = F.when(kind == 0, F.translate("a", T.LETTERS, T.LETTERS.upper())).when(kind == 1, F.concat("a", F.lit("x"))).otherwise(F.concat("a", "b"))
    rest = F.col("at") + F.length("a") + F.when(kind == 2, F.col("gap") + F.length("b")).otherwise(0)
    final = F.concat(F.left("text", F.col("at")), new, F.substr("text", rest + 1))
    return c.select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.col("text").alias("formatted"), F.when(clear, final).otherwise(F.col("text")).alias("final"))


def observation_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.edit_pairs(edited_turns(spark, sf_dir), "id").select("id", "old", "new", F.col("start").cast("long").alias("start"))


def applied_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where corrections lie in the output, and what stands there."""
    r = correct.correct(docs(spark, sf_dir), *dictionary(spark)).select("doc_id", "output", "candidates")
    spans = r.select("doc_id", "output", F.explode("candidates").alias("c")).select("doc_id", "output", "c.start", "c.end", "c.applied")
    out = align.placed(spans, ["doc_id"])
    return out.select("doc_id", F.col("out_start").cast("long").alias("out_start"), F.substr("output", F.col("out_start") + 1, F.col("out_end") - F.col("out_start")).alias("word"))


def titled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of conversations, a third with a capital for every word and a third with one for every other."""
    n = (F.col("conv_id") + F.col("turn")) % 3
    every = F.array_join(F.transform(F.split("text", " "), lambda w: F.concat(F.translate(F.left(w, F.lit(1)), T.LETTERS, T.LETTERS.upper()), F.lower(F.substr(w, F.lit(2))))), " ")
    other = F.array_join(F.transform(F.split("text", " "), lambda w, i: F.when(i % 2 == 1, F.concat(F.translate(F.left(w, F.lit(1)), T.LETTERS, T.LETTERS.upper()), F.substr(w, F.lit(2)))).otherwise(w)), " ")
    return table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.when(n == 0, every).when(n == 1, other).otherwise(F.col("text")).alias("text"))


def headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.headings(titled(spark, sf_dir), "id")


def proper_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that got a capital: names, but for those that open a sentence or stand in a heading."""
    t = titled(spark, sf_dir).withColumnRenamed("text", "final")
    t = t.withColumn("formatted", F.lower("final"))
    return align.proper(align.edit_pairs(t, "id"), t, "id").groupBy("id").agg(F.count("*").alias("n"), F.count_if("proper").alias("n_proper"))


def numbered_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers after an older log, in the order of whole seconds, then of type and payload."""
    e = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("user_id"), "event_id", F.date_trunc("hour", "ts").alias("ts"), F.col("event_type").alias("type"), F.format_string("%09d", "event_id").alias("payload"))
    old = e.where("event_id % 4 = 0").select("user_id", F.lit(1000).cast("long").alias("seq"))
    return numbered(e.where("event_id % 4 <> 0").drop("event_id"), old).select("user_id", "seq", "payload")


def undone_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Corrections at odd places are taken back."""
    d = docs(spark, sf_dir)
    r = correct.correct(d, *dictionary(spark))
    odd = F.transform(F.filter("candidates", lambda c: c["start"] % 2 == 1), lambda c: c["start"])
    out = F.when(F.col("candidates").isNull(), F.col("text")).otherwise(correct.toggled(F.col("text"), F.col("candidates"), odd))
    return r.select("doc_id", F.md5(out).alias("output"))


def rendered_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, (terms, spellings) = docs(spark, sf_dir), dictionary(spark)
    asked = correct.judge_requests(d, correct.decisions(d, terms, spellings), terms)
    return asked.select("doc_id", F.md5(judge.prompt(F.col("sentence"), F.col("items"))).alias("prompt"))


def parsed_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("event_id")
    body = F.concat(F.lit('{"decisions": [{"index": '), F.when(n % 2 == 0, F.concat(F.lit('"'), n % 5, F.lit('"'))).otherwise((n % 5).cast("string")), F.lit(', "apply": '), F.when(n % 3 == 0, "true").when(n % 3 == 1, "false").otherwise('"maybe"'), F.lit(', "preferred": "'), F.col("event_type"), F.lit('", "reason": ""}, {"index": 9}]}'))
    answer = F.when(n % 7 == 0, "I can't say.").otherwise(F.concat(F.lit("Here: ```json\n"), body, F.lit("\n``` so.")))
    each = table(spark, sf_dir, "events").select(F.explode_outer(judge.parsed(answer)).alias("d"))
    return each.groupBy(F.col("d.index").cast("long").alias("ix"), F.col("d.apply").alias("apply"), F.col("d.preferred").alias("preferred")).agg(F.count("*").alias("n"))


def judge_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls = table(spark, sf_dir, "events").select(F.col("event_type").alias("model"), (F.col("event_id") % 1000).alias("input_tokens"), (F.col("event_id") % 77).alias("output_tokens"))
    prices = spark.sql("SELECT * FROM VALUES ('click', 0.5D, 2.0D), ('error', 3.0D, 15.0D) AS t(model, price_in, price_out)")
    spent = judge.costs(calls, prices).withColumn("called", F.col("model") != "view")
    return evaluate.call_rate(spent).select("calls", F.col("call_rate").cast("decimal(9,1)").cast("double").alias("call_rate"), "tokens", F.col("cost").cast("decimal(18,4)").cast("double").alias("cost"))


def intervention_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("event_id")
    expected = F.when(n % 4 == 0, F.array(F.lit("a"))).when(n % 4 == 1, F.array(F.lit("b"))).when(n % 4 == 2, F.array(F.lit("a"), F.lit("b"))).otherwise(F.expr("CAST(array() AS array<string>)"))
    e = table(spark, sf_dir, "events").select(F.lit("a").alias("text"), F.element_at(F.array(F.lit("a"), F.lit("b"), F.lit("c")), (n % 3 + 1).cast("int")).alias("output"), expected.alias("expected"), (F.col("event_type") == "error").alias("failed"))
    kinds = e.select(evaluate.intervention(F.col("text"), F.col("output"), F.col("expected"), F.col("failed")).alias("kind"), (~F.array_contains("expected", F.col("text"))).alias("wants"))
    return evaluate.intervention_counts(kinds)


def grown(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    count = lambda x: x.groupBy(F.col("event_type").alias("name")).agg(F.count("*").alias("n"))
    return memory.growth(count(e.where("event_id < 300")), count(e))


QUERIES = {f.__name__: f for f in (term_lookup, composed_lookup, key_owner, hydrated_terms, cascaded, retired_left, guards, checked_names, logged_observations, refused_deletes, spaced_text, observation_pairs, applied_places, headings, proper_edits, numbered_events, undone_text, rendered_prompts, parsed_verdicts, judge_costs, intervention_kinds, grown)}

_NAMES = f"(SELECT DISTINCT p_name AS preferred, {T.casefold('p_name')} AS term, {T.phrase_key('p_name', 'duckdb')} AS key FROM part)"
_APART = "upper(p_name)"
for _a, _accent in zip(BARE.upper(), ACCENTS, strict=True):
    _APART = f"replace({_APART}, '{_a}', '{_a}{_accent}')"
_CHILDREN = "(SELECT CAST(user_id AS VARCHAR) AS user_id, event_type AS term, 'm' || event_id % 7 AS misspelling, count(*) AS seen, count(*) FILTER (WHERE event_id % 5 = 0) AS vetoes FROM events GROUP BY ALL)"
_EVENTS = "(SELECT CAST(user_id AS VARCHAR) AS user_id, event_type, event_id, 't' || event_id % 40 AS term, 'k' || event_id % 15 AS key FROM events)"
_WHY = [T.quoted(why, "duckdb") for why, _ in REFUSALS]
_GUARD = f"list_distinct(regexp_extract_all(text, '{T.TOKEN}'))"
_EDITED = f"""(SELECT *, length(split_part(text, a, 1)) AS base, len(w) >= 6 AND len(list_filter(low, lambda x: x = low[3])) = 1 AND NOT list_contains(low, lower(a || b)) AND NOT list_contains(low, lower(a) || 'x') AS clear FROM (
    SELECT *, w[1] AS a, w[2] AS b, list_transform(w, lambda x: lower(x)) AS low FROM (SELECT conv_id * 1000 + turn AS id, (conv_id + turn) % 3 AS kind, text, regexp_extract_all(text, '{T.TOKEN}') AS w FROM conversations)))"""
_TITLED = f"""(SELECT conv_id * 1000 + turn AS id, CASE (conv_id + turn) % 3 WHEN 0 THEN array_to_string(list_transform(string_split(text, ' '), lambda w: translate(left(w, 1), '{T.LETTERS}', '{T.LETTERS.upper()}') || lower(substring(w, 2))), ' ')
    WHEN 1 THEN array_to_string(list_transform(string_split(text, ' '), lambda w, i: CASE WHEN i % 2 = 0 THEN translate(left(w, 1), '{T.LETTERS}', '{T.LETTERS.upper()}') || substring(w, 2) ELSE w END), ' ') ELSE text END AS text FROM conversations)"""
_TOLD = f"""(SELECT id, w, left(w, 1) <> lower(left(w, 1)) AS capital, regexp_matches(w, '^[^0-9×÷]') AS letter, head = '' OR right(head, 1) IN ({", ".join(T.quoted(c, "duckdb") for c in T.ENDERS)}) AS opens FROM (
    SELECT id, w, rtrim(left(text, CAST(until - length(w) AS BIGINT)), {T.quoted(T.OPENERS, "duckdb")}) AS head FROM (
      SELECT id, text, w, sum(length(g) + length(w)) OVER (PARTITION BY id ORDER BY i) AS until FROM (
        SELECT id, text, unnest(ws) AS w, unnest(gs[1:len(ws)]) AS g, unnest(range(len(ws))) AS i FROM (
          SELECT id, text, regexp_extract_all(text, '{T.TOKEN}') AS ws, regexp_split_to_array(text, '{T.TOKEN}') AS gs FROM {_TITLED})))))"""
_HEADINGS = f"""(SELECT id, coalesce((n > 1 AND letters > 0 AND big = letters) OR (inside > 2 AND 2 * big_inside >= inside), false) AS heading FROM {_TITLED} LEFT JOIN (
    SELECT id, count(*) AS n, count(*) FILTER (WHERE letter) AS letters, count(*) FILTER (WHERE letter AND capital) AS big, count(*) FILTER (WHERE NOT opens) AS inside, count(*) FILTER (WHERE NOT opens AND capital) AS big_inside FROM {_TOLD} GROUP BY id) USING (id))"""
ORACLES = {
    "observation_pairs": f"SELECT id, CASE WHEN kind = 2 THEN substring(text, base + 1, length(a) + position(b IN substring(text, base + length(a) + 1)) - 1 + length(b)) ELSE a END AS old, CASE kind WHEN 0 THEN translate(a, '{T.LETTERS}', '{T.LETTERS.upper()}') WHEN 1 THEN a || 'x' ELSE a || b END AS new, base AS start FROM {_EDITED} WHERE clear AND (kind > 0 OR regexp_matches(a, '[a-z]'))",
    "applied_places": oracle.decided(TERMS, SPELLINGS) + "SELECT doc_id, CAST(s + coalesce(sum(length(applied) - (e - s)) OVER (PARTITION BY doc_id ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS out_start, applied AS word FROM decided WHERE decision = 'applied'",
    "headings": f"SELECT id, heading FROM {_HEADINGS}",
    "proper_edits": f"SELECT id, count(*) AS n, count(*) FILTER (WHERE capital AND NOT opens AND NOT heading) AS n_proper FROM {_TOLD} JOIN {_HEADINGS} USING (id) WHERE lower(w) <> w GROUP BY id",
    "term_lookup": f"SELECT p_partkey, n AS name, t.preferred FROM (SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN upper(p_name) || 'X' ELSE upper(p_name) END AS n FROM part) LEFT JOIN {_NAMES} t ON t.term = {T.casefold('n')}",
    "composed_lookup": f"SELECT p_partkey, n AS name, t.preferred FROM (SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN upper(p_name) ELSE {_APART} END AS n FROM part) LEFT JOIN (SELECT DISTINCT translate(p_name, '{BARE}', '{ACCENTED}') AS preferred FROM part) t ON lower(nfc_normalize(t.preferred)) = lower(nfc_normalize(n))",
    "key_owner": f"SELECT key, arg_min(preferred, term) AS preferred FROM {_NAMES} GROUP BY key",
    "hydrated_terms": f"SELECT e.user_id, e.term, string_agg(misspelling || ':' || seen || ':' || vetoes || ':' || c.term, ',' ORDER BY misspelling) AS spellings FROM (SELECT DISTINCT CAST(user_id AS VARCHAR) AS user_id, event_type AS term FROM events) e LEFT JOIN (SELECT * FROM {_CHILDREN} WHERE misspelling <> 'm0') c USING (user_id, term) GROUP BY ALL",
    "cascaded": f"SELECT user_id, term, misspelling, seen FROM {_CHILDREN} c WHERE NOT EXISTS (SELECT 1 FROM events e WHERE e.event_id % 11 = 0 AND CAST(e.user_id AS VARCHAR) = c.user_id AND e.event_type = c.term)",
    "retired_left": f"SELECT user_id, term, key, event_id FROM {_EVENTS} g WHERE event_type = 'error' AND NOT EXISTS (SELECT 1 FROM {_EVENTS} a WHERE a.event_type = 'signup' AND a.event_id % 3 = 0 AND a.user_id = g.user_id AND (a.term = g.term OR a.key = g.key))",
    "guards": f"SELECT doc_id, array_to_string(list_concat(fresh, list_filter(old, lambda x: NOT list_contains(fresh, x)))[1:{GUARD_WORDS}], ',') AS guard FROM (SELECT doc_id, list_sort(list_filter({_GUARD}, lambda x: length(x) = 5)) AS fresh, list_reverse_sort(list_filter({_GUARD}, lambda x: length(x) IN (5, 6) AND NOT regexp_matches(x, '^[a-m]'))) AS old FROM documents)",
    "checked_names": f"""SELECT preferred, CASE WHEN NOT regexp_matches(preferred, '[A-Za-z]') THEN {_WHY[0]} WHEN length(preferred) > {LONGEST} THEN {_WHY[1]} WHEN array_to_string(regexp_extract_all(preferred, '{T.TOKEN}'), ' ') <> preferred THEN {_WHY[2]} END AS error, count(*) AS n FROM (
        SELECT trim(regexp_replace(CASE p_partkey % 6 WHEN 0 THEN '  ' || p_name || ' ' WHEN 1 THEN replace(p_name, ' ', ' ' || chr(9) || ' ') WHEN 2 THEN p_name || '-x' WHEN 3 THEN repeat(p_name || ' ', 9) WHEN 4 THEN CAST(p_partkey AS VARCHAR) ELSE p_name END, '\\s+', ' ', 'g')) AS preferred FROM part) GROUP BY ALL""",
    "logged_observations": "SELECT conv_id, count(*) AS n FROM conversations WHERE (turn % 3 = 1 AND trim(coalesce(text, ''), '" + T.SPACES + "') <> '') OR (turn % 2 = 0 AND trim(coalesce(role, ''), '" + T.SPACES + "') <> '') GROUP BY conv_id",
    "refused_deletes": "SELECT CAST(user_id AS VARCHAR) AS user_id, event_id AS seq FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS before FROM events WHERE event_type IN ('signup', 'error')) WHERE event_type = 'error' AND before IS DISTINCT FROM 'signup'",
    "spaced_text": oracle.decided(TERMS, SPELLINGS, f"(SELECT doc_id, replace(replace(text, ' t', '.x' || sp || 't'), 'on ', 'on' || sp) AS text FROM (SELECT *, substring('{T.SPACES}', doc_id % {len(T.SPACES)} + 1, 1) AS sp FROM documents))") + f"SELECT doc_id, md5(output) AS output, n_candidates FROM ({oracle.CORRECTED})",
    "numbered_events": "SELECT user_id, n + CASE WHEN EXISTS (SELECT 1 FROM events o WHERE o.event_id % 4 = 0 AND CAST(o.user_id AS VARCHAR) = x.user_id) THEN 1000 ELSE 0 END AS seq, payload FROM (SELECT CAST(user_id AS VARCHAR) AS user_id, row_number() OVER (PARTITION BY user_id ORDER BY date_trunc('hour', ts), event_type, event_id) AS n, lpad(CAST(event_id AS VARCHAR), 9, '0') AS payload FROM events WHERE event_id % 4 <> 0) x",
    "undone_text": oracle.decided(TERMS, SPELLINGS) + f"SELECT doc_id, md5(output) AS output FROM ({oracle.CORRECTED.replace(chr(39) + 'applied' + chr(39), chr(39) + 'applied' + chr(39) + ' AND s % 2 = 0')})",
    "rendered_prompts": oracle.decided(TERMS, SPELLINGS) + """
SELECT doc_id, md5('Text: ' || any_value(text) || chr(10) || string_agg('#' || i || ' heard as {"text":"' || span || '"}, may be ' || array_to_string(list_transform(options, lambda o: o || ' [term]'), ' or ') || CASE WHEN hint <> '' THEN ' (' || hint || ')' ELSE '' END, chr(10) ORDER BY s)) AS prompt
FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY s) - 1 AS i, array_to_string(list_filter([CASE WHEN elsewhere IS NOT NULL THEN 'the text also has ' || elsewhere || ' as it is spelled' END, CASE WHEN match = 'join' THEN '""" + correct.JOIN_HINT + """' END], lambda h: h IS NOT NULL), '; ') AS hint FROM decided WHERE pending) JOIN documents USING (doc_id) GROUP BY doc_id""",
    "parsed_verdicts": """SELECT ix, apply, preferred, count(*) AS n FROM (
        SELECT event_id % 5 AS ix, CASE event_id % 3 WHEN 0 THEN true WHEN 1 THEN false END AS apply, event_type AS preferred FROM events WHERE event_id % 7 <> 0
        UNION ALL SELECT 9, NULL, NULL FROM events WHERE event_id % 7 <> 0 UNION ALL SELECT NULL, NULL, NULL FROM events WHERE event_id % 7 = 0) GROUP BY ALL""",
    "judge_costs": """SELECT count(*) FILTER (WHERE event_type <> 'view') AS calls, CAST(CAST(round(100.0 * count(*) FILTER (WHERE event_type <> 'view') / count(*), 1) AS DECIMAL(9,1)) AS DOUBLE) AS call_rate, CAST(sum(event_id % 1000 + event_id % 77) AS BIGINT) AS tokens,
        CAST(CAST(sum(CASE event_type WHEN 'click' THEN round(((event_id % 1000) * 0.5 + (event_id % 77) * 2.0) / 1e6, 6) WHEN 'error' THEN round(((event_id % 1000) * 3.0 + (event_id % 77) * 15.0) / 1e6, 6) ELSE 0 END) AS DECIMAL(18,4)) AS DOUBLE) AS cost FROM events""",
    "intervention_kinds": """SELECT count(*) AS runs, count(*) FILTER (WHERE kind = 'useful') AS useful, count(*) FILTER (WHERE kind = 'missed') AS missed, count(*) FILTER (WHERE kind = 'harmful') AS harmful, count(*) FILTER (WHERE e IN (0, 2)) AS noop_expected, count(*) FILTER (WHERE e = 1) AS correction_expected FROM (
        SELECT e, CASE WHEN e = 3 THEN NULL WHEN e IN (0, 2) THEN CASE WHEN o = 0 OR (e = 2 AND o = 1) THEN 'no-op' WHEN f THEN 'missed' ELSE 'harmful' END WHEN o = 1 THEN 'useful' WHEN o = 0 OR f THEN 'missed' ELSE 'harmful' END AS kind FROM (
          SELECT event_id % 4 AS e, event_id % 3 AS o, event_type = 'error' AS f FROM events))""",
    "grown": "SELECT event_type AS name, count(*) FILTER (WHERE event_id >= 300) AS grown FROM events GROUP BY 1",
}
