"""Queries over the test tables, and their SQL."""

from __future__ import annotations


from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.lexicon import COMMON, GLUE, listed
from ..operators import correct, effects, evaluate, memory
from ..sources.log import row_counts
from ..sources.shared import kept
from . import oracle

TERMS = [("Tion", 3), ("Inti", 2), ("Ernt", 2), ("Erst", 4), ("Ersst", 2), ("Ontion", 2), ("Ting", 2), ("Erat", 1), ("Eres", 0), ("Cold Widget", 2), ("Hot Plate", 2)]
SPELLINGS = [("tion", "thtion", 2, 0, []), ("erst", "erstth", 1, 0, []), ("ernt", "erntth", 0, 1, ["with", "that", "and"]), ("inti", "inntti", 0, 1, [])]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dictionary(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    """Inline tables, so that the planner knows their size and joins them where the tokens are."""
    terms = ", ".join(f"({T.quoted(p.lower())}, {T.quoted(p)}, {t})" for p, t in TERMS)
    spelled = ", ".join(f"({T.quoted(t)}, {T.quoted(m)}, {seen}, {vetoes}, CAST(array({', '.join(map(T.quoted, guard))}) AS array<string>))" for t, m, seen, vetoes, guard in SPELLINGS)
    none = "CAST(NULL AS string)"
    return (spark.sql(f"SELECT term, preferred, {none} AS kind, {none} AS note, trust FROM VALUES {terms} AS t(term, preferred, trust)"),
            spark.sql(f"SELECT * FROM VALUES {spelled} AS t(term, misspelling, seen, vetoes, guard)"))


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text")


def corrected_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return correct.correct(docs(spark, sf_dir), *dictionary(spark)).select("doc_id", "output", F.col("n_candidates").cast("long").alias("n_candidates"), "reason")


def decision_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return correct.decisions(docs(spark, sf_dir), *dictionary(spark)).groupBy("match", "decision").agg(F.count("*").alias("n"))


def judge_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, (terms, spellings) = docs(spark, sf_dir), dictionary(spark)
    asked = correct.judge_requests(d, correct.decisions(d, terms, spellings), terms)
    line = lambda x: F.concat_ws("|", x["start"].cast("string"), x["text"], F.array_join(F.transform(x["options"], lambda o: o["preferred"]), ","), x["hint"])
    return asked.select("doc_id", F.size("items").cast("long").alias("n_items"), F.array_join(F.transform("items", line), ";").alias("items"))


def verdict_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of four pending spans one is applied, one refused, one answered with another word, and one not at all."""
    d = docs(spark, sf_dir)
    back = kept(correct.weighed(d, *dictionary(spark)))
    pending = correct.ruled(back, d).where("pending AND start % 4 < 3")
    said = F.when(F.col("start") % 4 == 2, "another word").otherwise(F.element_at(F.array_sort("options"), 1))
    verdicts = pending.select("doc_id", "start", (F.col("start") % 4 != 1).alias("apply"), said.alias("preferred"), F.lit("said so").alias("reason"))
    # the planner sizes them by the files of `back`, which are far smaller than their rows: they may not be broadcast for that
    return correct.ruled(back, d, verdicts.hint("merge")).groupBy("decision").agg(F.count("*").alias("n"))


def token_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = T.tokens(docs(spark, sf_dir))
    return t.groupBy("doc_id").agg(F.count("*").alias("n_tokens"), F.sum("start").cast("long").alias("starts"), F.sum("end").cast("long").alias("ends"))


def phonetic_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = docs(spark, sf_dir).select(F.explode(F.regexp_extract_all("text", F.lit(T.TOKEN), F.lit(0))).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    return words.select("word", F.expr(T.key("word")).alias("key"), "n")


def key_collisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phonetic_keys(spark, sf_dir).groupBy("key").agg(F.count("*").alias("spellings"), F.sum("n").alias("n")).where("spellings > 1")


def phrase_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", F.expr(T.phrase_key("p_name")).alias("key"))


def common_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = docs(spark, sf_dir).select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(T.TOKEN), F.lit(0))).alias("word"))
    return words.groupBy("doc_id").agg(F.count_if(F.expr(T.common("word", listed(COMMON)))).alias("n_common"), F.count("*").alias("n"))


def content_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return correct.context_words(T.owned(docs(spark, sf_dir))).select("doc_id", F.size("context").cast("long").alias("n_content"))


def sounds_alike_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Equal keys, or one edit apart if both have four letters, by an equi-join on shortened keys."""
    v = table(spark, sf_dir, "benchmark").select(F.explode(F.regexp_extract_all("text", F.lit(T.TOKEN), F.lit(0))).alias("w")).distinct().withColumn("k", F.expr(T.key("w"))).where("k <> ''")
    cut = v.withColumn("c", F.explode(F.expr(f"IF(length(k) >= 4, {correct.shortened('k')}, array(k))")))
    a, b = cut.select("c", F.col("w").alias("a"), F.col("k").alias("ka")), cut.select("c", F.col("w").alias("b"), F.col("k").alias("kb"))
    return a.join(b, "c").where("a < b").where(f"ka = kb OR (length(ka) >= 4 AND length(kb) >= 4 AND {T.near('ka', 'kb')})").select("a", "b").distinct()


def identifier_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = table(spark, sf_dir, "pages").select("page_id", F.explode(F.split("url", "[ \t\n]+")).alias("c"))
    return chunks.where(T.identifier("c")).groupBy("page_id").agg(F.count("*").alias("n"))


def ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as changes of trust: signup adds, view sets to its number modulo 4, some errors delete, the rest bump."""
    e = table(spark, sf_dir, "events")
    error, gone = F.col("event_type") == "error", F.col("event_id") % 4 == 0
    op = F.when(F.col("event_type") == "signup", "add").when(F.col("event_type") == "view", "set").when(error & gone, "delete").otherwise("bump")
    value = F.when(F.col("event_type") == "purchase", 1).when(error, -2).when(F.col("event_type") == "view", F.col("event_id") % 4).otherwise(0)
    return e.select("user_id", F.col("event_id").alias("seq"), op.alias("op"), value.cast("int").alias("value"))


def trust_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return memory.trust_fold(ops(spark, sf_dir)).select("user_id", "trust")


def status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trust_fold(spark, sf_dir).groupBy(memory.status(F.col("trust")).alias("status")).agg(F.count("*").alias("n"))


def trust_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return memory.history(ops(spark, sf_dir)).select("user_id", "seq", "trust")


def misspelling_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(F.col("user_id"), F.col("event_type").alias("term"), F.pmod("event_id", F.lit(7)).alias("misspelling"), F.lit(1).alias("d_seen"), (F.col("event_type") == "error").cast("int").alias("d_veto"), F.col("event_id").alias("ts"), F.col("event_id").alias("seq"))
    return memory.counters(e).select("user_id", "term", "misspelling", "seen", "vetoes", "last_ts")


def table_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return row_counts({n: table(spark, sf_dir, n) for n in ("documents", "events", "part", "conversations")})


def trace_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    return memory.top_traces(table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("trace_id"), "text"), 20)


def value_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.percentiles(table(spark, sf_dir, "events"), "event_type", "value")


#: Of each word (event_id modulo 7): what is heard and what is meant; the last three are edits that aren't vocabulary.
SENTENCES = (
    ("Ask Joonas now.", "Ask Jonas now."), ("Call ma arit today.", "Call Maarit today."), ("Tell them kiwi is live in wk# today.", "Tell them Kiwi is live in wk# today."),
    ("the kiwi notes", "The Kiwi Notes"), ("The note is here.", "The joy is here."), ("Send thier note.", "Send their note."), ("Ask Joonas and Joonas.", "Ask Jonas and Joonas."))


def learning(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Effects of events as the lives of three names, which signups add, some errors delete and some views set to 1. One is
    a word misheard, one is heard as two, one as a common word that differs in case, whose correction the user is shown.
    Purchases and odd clicks put them right; other events leave them; a sentence with two is put right once only."""
    e = table(spark, sf_dir, "events")
    kind, n = F.col("event_type"), F.col("event_id")
    word = F.when(n % 7 == 6, 0).otherwise(n % 7)
    one_of = lambda xs: F.element_at(F.array(*map(F.lit, xs)), (n % 7 + 1).cast("int"))
    week = lambda x: F.replace(x, F.lit("#"), F.format_string("%02d", n % 40))
    heard, meant = week(one_of([x for x, _ in SENTENCES])), week(one_of([y for _, y in SENTENCES]))
    name = F.element_at(F.array(*map(F.lit, ("Jonas", "Maarit", "Kiwi"))), (word + 1).cast("int"))
    type_ = F.when(word > 2, "observation").when(kind == "signup", "add_term").when((kind == "error") & (n % 3 == 0), "delete_term").when((kind == "view") & (n % 5 == 0), "set_trust").otherwise("observation")
    right = (word > 2) | (kind == "purchase") | ((kind == "click") & (n % 2 == 1))
    seen = F.struct(F.lit("").alias("asr"), heard.alias("formatted"), F.when(right, meant).otherwise(heard).alias("final"), F.when(word == 2, meant).alias("presented"))
    payload = F.when(type_ == "observation", F.to_json(seen)).otherwise(F.to_json(F.struct(name.alias("preferred"), F.lit(1).alias("trust"))))
    return effects.effects(e.select("user_id", n.alias("seq"), "ts", type_.alias("type"), payload.alias("payload")))


def learned_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    of = learning(spark, sf_dir)
    return effects.terms(of).select("user_id", "term", "preferred", "source", F.col("trust").cast("long").alias("trust"), "status")


def learned_spellings(spark: SparkSession, sf_dir: str) -> DataFrame:
    of = effects.misspellings(learning(spark, sf_dir))
    return of.select("user_id", "term", "misspelling", F.col("seen").cast("long").alias("seen"), F.col("vetoes").cast("long").alias("vetoes"), F.array_join("guard", "+").alias("guard"))


def retired_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return effects.retired(learning(spark, sf_dir)).select("user_id", "term", "preferred")


def learning_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = ("learned", "confirmed", "reverted", "ignored")
    said = F.from_json("report", "learned array<string>, confirmed array<string>, reverted array<string>, ignored array<string>")
    each = effects.reports(learning(spark, sf_dir)).withColumn("r", said)
    return each.groupBy("user_id").agg(*(F.coalesce(F.sum(F.when(F.size(f"r.{p}") > 0, F.size(f"r.{p}"))), F.lit(0)).cast("long").alias(p) for p in parts))


QUERIES = {f.__name__: f for f in (corrected_text, decision_counts, judge_requests, verdict_merge, token_offsets, phonetic_keys, key_collisions, phrase_keys, common_share, content_words, sounds_alike_pairs, identifier_chunks, trust_fold, status_counts, trust_history, misspelling_counters, table_counts, trace_top, value_percentiles, learned_terms, learned_spellings, retired_terms, learning_reports)}

_WORDS = f"unnest(regexp_extract_all(text, '{T.TOKEN}'))"
_STEPS = """SELECT user_id, event_id AS seq, list({'op': event_type, 'id': event_id}) OVER (PARTITION BY user_id ORDER BY event_id) AS log FROM events"""
_TRUST = """SELECT user_id, seq, CAST(list_reduce(list_prepend(CAST(NULL AS BIGINT), list_transform(log, lambda e: CAST(CASE
    WHEN e.op = 'signup' THEN 1000000 WHEN e.op = 'view' THEN 2000000 + e.id % 4 WHEN e.op = 'error' AND e.id % 4 = 0 THEN 3000000 WHEN e.op = 'purchase' THEN 1 WHEN e.op = 'error' THEN -2 ELSE 0 END AS BIGINT))),
  lambda a, e: CASE WHEN e = 1000000 THEN greatest(coalesce(a, 0), 2) WHEN e = 3000000 THEN NULL WHEN e >= 2000000 THEN CASE WHEN a IS NOT NULL THEN e - 2000000 END ELSE a + e END) AS BIGINT) AS trust FROM """
_LAST = f"({_TRUST} (SELECT user_id, 0 AS seq, list({{'op': event_type, 'id': event_id}} ORDER BY event_id) AS log FROM events GROUP BY user_id))"
_KEYS = f"SELECT word, {T.key('word', 'duckdb')} AS key, n FROM (SELECT word, count(*) AS n FROM (SELECT {_WORDS} AS word FROM documents) GROUP BY word)"


def _percentile(q: int) -> str:
    j, n = f"greatest(1, least(CAST(floor({q} * (len(v) + 1) / 100) AS BIGINT), len(v) - 1))", "len(v)"
    d = f"({q} * ({n} + 1) - 100 * {j})"
    return f"CASE WHEN {n} = 1 THEN v[1] ELSE round((v[{j}] * (100 - {d}) + v[{j} + 1] * {d}) / 100, 2) END"


ORACLES = {
    "token_offsets": f"""SELECT doc_id, count(*) AS n_tokens, CAST(sum(e - length(w)) AS BIGINT) AS starts, CAST(sum(e) AS BIGINT) AS ends FROM (
        SELECT doc_id, w, sum(length(g) + length(w)) OVER (PARTITION BY doc_id ORDER BY i) AS e FROM (
          SELECT doc_id, unnest(ws) AS w, unnest(gs[1:len(ws)]) AS g, unnest(range(len(ws))) AS i FROM (
            SELECT doc_id, regexp_extract_all(text, '{T.TOKEN}') AS ws, regexp_split_to_array(text, '{T.TOKEN}') AS gs FROM documents))) GROUP BY doc_id""",
    "phonetic_keys": _KEYS,
    "key_collisions": f"SELECT key, count(*) AS spellings, CAST(sum(n) AS BIGINT) AS n FROM ({_KEYS}) GROUP BY key HAVING count(*) > 1",
    "phrase_keys": f"SELECT p_partkey, {T.phrase_key('p_name', 'duckdb')} AS key FROM part",
    "common_share": f"SELECT doc_id, count(*) FILTER (WHERE {T.common('word', listed(COMMON))}) AS n_common, count(*) AS n FROM (SELECT doc_id, {_WORDS} AS word FROM documents) GROUP BY doc_id",
    "content_words": f"SELECT doc_id, CAST(len(list_distinct(list_filter(list_transform(regexp_extract_all(text, '{T.TOKEN}'), lambda x: {T.casefold('x')}), lambda w: length(w) >= 3 AND w NOT IN ({listed(GLUE)})))) AS BIGINT) AS n_content FROM documents",
    "sounds_alike_pairs": f"WITH v AS (SELECT w, {T.key('w', 'duckdb')} AS k FROM (SELECT DISTINCT {_WORDS} AS w FROM benchmark)) SELECT x.w AS a, y.w AS b FROM v x JOIN v y ON x.w < y.w AND x.k <> '' AND (x.k = y.k OR (length(x.k) >= 4 AND length(y.k) >= 4 AND {T.near('x.k', 'y.k', 'duckdb')}))",
    "identifier_chunks": f"SELECT page_id, count(*) AS n FROM (SELECT page_id, unnest(regexp_split_to_array(url, '[ \\t\\n]+')) AS c FROM pages) WHERE {T.identifier('c', 'duckdb')} GROUP BY page_id",
    "trust_fold": f"SELECT user_id, trust FROM {_LAST} WHERE trust IS NOT NULL",
    "status_counts": f"SELECT CASE WHEN trust >= 2 THEN 'trusted' WHEN trust > 0 THEN 'watching' ELSE 'muted' END AS status, count(*) AS n FROM {_LAST} WHERE trust IS NOT NULL GROUP BY 1",
    "trust_history": f"{_TRUST} ({_STEPS})",
    "misspelling_counters": "SELECT user_id, event_type AS term, event_id % 7 AS misspelling, count(*) AS seen, CAST(sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) AS BIGINT) AS vetoes, max(event_id) AS last_ts FROM events GROUP BY ALL",
    "table_counts": " UNION ALL ".join(f"SELECT '{n}' AS name, count(*) AS n FROM {n}" for n in ("documents", "events", "part", "conversations")),
    "trace_top": "SELECT conv_id * 1000 + turn AS trace_id, text FROM conversations ORDER BY 1 DESC LIMIT 20",
    "value_percentiles": f"SELECT event_type, {_percentile(50)} AS p50, {_percentile(95)} AS p95 FROM (SELECT event_type, list(value ORDER BY value) AS v FROM events WHERE value IS NOT NULL GROUP BY event_type)",
    "corrected_text": oracle.decided(TERMS, SPELLINGS) + oracle.CORRECTED,
    "decision_counts": oracle.decided(TERMS, SPELLINGS) + oracle.DECISIONS,
    "judge_requests": oracle.decided(TERMS, SPELLINGS) + oracle.REQUESTS,
    "verdict_merge": oracle.decided(TERMS, SPELLINGS) + oracle.VERDICTS,
    "learned_terms": oracle.LEARNED + oracle.TERMS_LEFT,
    "learned_spellings": oracle.LEARNED + oracle.SPELLINGS_LEFT,
    "retired_terms": oracle.LEARNED + oracle.RETIRED,
    "learning_reports": oracle.LEARNED + oracle.REPORTED,
}
