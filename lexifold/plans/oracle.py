"""SQL of the correction and learning queries, written from their definitions: tokens are cut inside runs without white
space, sentences are read from the text before a token, keys are met word by word, and overlaps are settled in one list for
each document."""

from __future__ import annotations

from ..functions import text as T
from ..functions.lexicon import COMMON, GLUE, listed
from ..operators.correct import JOIN_HINT
from ..operators.rules import ACTIVE, FUZZY_LENGTH, GUARD_WORDS

_CHUNK = f"{T.NO_SPACE}+"


def _quoted(x: str) -> str:
    return T.quoted(x, "duckdb")


def _cut(source: str, text: str, pattern: str, part: str, keep: str) -> str:
    """Rows of source with each match of a pattern in a text: `part`, `gap` before it, its number `n`, and `until`."""
    return f"""SELECT {keep}, part AS {part}, gap, n, CAST(sum(length(gap) + length(part)) OVER (PARTITION BY {keep} ORDER BY n) AS BIGINT) AS until FROM (
    SELECT {keep}, unnest(ps) AS part, unnest(gs[1:len(ps)]) AS gap, unnest(range(len(ps))) AS n FROM (
      SELECT {keep}, regexp_extract_all({text}, '{pattern}') AS ps, regexp_split_to_array({text}, '{pattern}') AS gs FROM {source}))"""


def decided(terms: list[tuple[str, int]], spellings: list[tuple[str, str, int, int, list[str]]], source: str = "documents") -> str:
    """WITH clauses over texts of a source, that end in decided(doc_id, s, e, span, match, decision, applied, pending, options, elsewhere)."""
    term_rows = ", ".join(f"({_quoted(p.lower())}, {_quoted(p)}, {t})" for p, t in terms)
    guard = lambda g: "[" + ", ".join(map(_quoted, g)) + "]::VARCHAR[]"
    spelled = ", ".join(f"({_quoted(t)}, {_quoted(m)}, {seen}, {vetoes}, {guard(g)})" for t, m, seen, vetoes, g in spellings)
    common = T.common("w", listed(COMMON))
    ends = ", ".join(_quoted(c) for c in T.ENDERS)
    return f"""
WITH texts AS (SELECT doc_id, text FROM {source}),
terms(term, preferred, trust) AS (VALUES {term_rows}),
spelled(term, misspelling, seen, vetoes, guard) AS (VALUES {spelled}),
keys AS (SELECT DISTINCT term, {T.phrase_key('x', 'duckdb')} AS key FROM (SELECT term, preferred AS x FROM terms UNION ALL SELECT term, misspelling FROM spelled)),
runs AS (SELECT doc_id, n AS c, chunk, gap AS white, until - length(chunk) AS base, {T.identifier('chunk', 'duckdb')} AS ident FROM ({_cut('texts', 'text', _CHUNK, 'chunk', 'doc_id')})),
cut AS ({_cut('runs', 'chunk', T.TOKEN, 'w', 'doc_id, c, base, white, ident')}),
placed AS (SELECT doc_id, c, n, white, ident, w, base + until - length(w) AS s, base + until AS e FROM cut),
words AS (SELECT w, {T.key('w', 'duckdb')} AS key, {common} AS common FROM (SELECT DISTINCT w FROM placed)),
said AS (
  SELECT p.*, key, common, row_number() OVER d AS p, rtrim(substring(d.text, greatest(s - 199, 1), least(s, 200)), {_quoted(T.OPENERS)}) AS head
  FROM placed p JOIN words USING (w) JOIN texts d USING (doc_id) WINDOW d AS (PARTITION BY p.doc_id ORDER BY s)),
marked AS (SELECT *, head = '' OR right(head, 1) IN ({ends}) AS opens, regexp_matches(w, '^[0-9]+$') AS digits, left(w, 1) <> lower(left(w, 1)) AS upper FROM said),
tok AS (
  SELECT *, lead(digits, 1, false) OVER d
      OR coalesce(first_value(CASE WHEN NOT digits AND lower(w) <> 's' THEN upper END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY p ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), false)
      OR coalesce(last_value(CASE WHEN NOT digits AND lower(w) <> 's' THEN upper AND NOT opens END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS in_phrase,
    lead(w) OVER d AS w2, lead(key) OVER d AS key2, lead(common) OVER d AS common2, lead(ident) OVER d AS ident2, lead(e) OVER d AS e2,
    coalesce(lead(s) OVER d = e + 1 AND lead(c) OVER d = c + 1 AND lead(white) OVER d = ' ', false) AS joint
  FROM marked WINDOW d AS (PARTITION BY doc_id ORDER BY p)),
near AS (SELECT DISTINCT w.key AS heard, k.term FROM (SELECT DISTINCT key FROM words WHERE length(key) >= {FUZZY_LENGTH} AND key NOT IN (SELECT key FROM keys)) w, keys k WHERE k.key NOT LIKE '% %' AND damerau_levenshtein(w.key, k.key) <= 1),
pairs AS (SELECT w, w2, {T.key('w || w2', 'duckdb')} AS key FROM (SELECT DISTINCT w, w2 FROM tok WHERE joint)),
hits AS (
  SELECT doc_id, s, e, 'key' AS match, 0 AS rank, w AS span, common AS all_common, in_phrase, term FROM tok JOIN keys USING (key) WHERE NOT ident
  UNION ALL SELECT doc_id, s, e, 'fuzzy', 0, w, common, in_phrase, term FROM tok JOIN near ON key = heard WHERE NOT ident
  UNION ALL SELECT doc_id, s, e2, 'key', 0, w || ' ' || w2, common AND common2, in_phrase, term FROM tok t JOIN keys k ON k.key = array_to_string(list_filter([t.key, key2], lambda x: x <> ''), ' ') WHERE joint AND NOT ident AND NOT ident2
  UNION ALL SELECT doc_id, s, e2, 'join', 1, w || ' ' || w2, common AND common2, in_phrase, term FROM tok JOIN pairs USING (w, w2) JOIN keys k ON k.key = pairs.key WHERE joint AND NOT ident AND NOT ident2 AND NOT (lower(w) IN ('a', 'an', 'the') AND common2)),
found AS (SELECT doc_id, s, e, match, rank, span, all_common, in_phrase, list(DISTINCT term ORDER BY term) AS names, bool_or(span = preferred) AS right_already FROM hits JOIN terms USING (term) GROUP BY ALL),
lists AS (SELECT doc_id, list([{{'s': s, 'e': e, 'match': match, 'span': span, 'all_common': all_common, 'in_phrase': in_phrase, 'names': names, 'right_already': right_already}}] ORDER BY s - e, s, rank) AS spans FROM found GROUP BY doc_id),
taken AS (SELECT doc_id, unnest(list_reduce(spans, lambda a, x: CASE WHEN len(list_filter(a, lambda t: t.s < x[1].e AND x[1].s < t.e)) = 0 THEN list_concat(a, x) ELSE a END)) AS t FROM lists),
spans AS (SELECT doc_id, t.s AS s, t.e AS e, t.match AS match, t.span AS span, t.all_common AS all_common, t.in_phrase AS in_phrase, t.names AS names FROM taken WHERE NOT t.right_already),
contexts AS (SELECT doc_id, list_distinct(list_filter(list_transform(regexp_extract_all(text, '{T.TOKEN}'), lambda x: {T.casefold('x')}), lambda x: length(x) >= 3 AND x NOT IN ({listed(GLUE)}))) AS context FROM texts),
options AS (
  SELECT doc_id, s, e, span, match, all_common, in_phrase, term, preferred, trust >= {ACTIVE} AS trusted, coalesce(seen, 0) AS seen,
    CASE WHEN trust >= {ACTIVE} AND vetoes > 0 THEN CASE WHEN len(guard) = 0 THEN 'skipped:vetoed' WHEN list_has_any(guard, context) THEN 'skipped:guarded' END END AS held
  FROM (SELECT *, unnest(names) AS term FROM spans) x JOIN terms USING (term) LEFT JOIN spelled p USING (term) JOIN contexts USING (doc_id)
  WHERE p.misspelling IS NULL OR p.misspelling = lower(span)
  UNION ALL
  SELECT doc_id, s, e, span, match, all_common, in_phrase, term, preferred, trust >= {ACTIVE}, 0, NULL
  FROM (SELECT *, unnest(names) AS term FROM spans) x JOIN terms USING (term)
  WHERE EXISTS (SELECT 1 FROM spelled p WHERE p.term = x.term) AND NOT EXISTS (SELECT 1 FROM spelled p WHERE p.term = x.term AND p.misspelling = lower(x.span))),
judged AS (
  SELECT doc_id, s, e, span, match, all_common, in_phrase, count(*) FILTER (WHERE trusted) AS n_trusted, arg_min(preferred, term) FILTER (WHERE trusted) AS word, arg_min(held, term) FILTER (WHERE held IS NOT NULL) AS held,
    coalesce(max(seen) FILTER (WHERE trusted), 0) AS seen, list(preferred ORDER BY preferred) FILTER (WHERE trusted) AS options
  FROM options GROUP BY ALL),
weighed AS (
  SELECT *, n_trusted > 1 OR match = 'fuzzy' OR all_common OR (match = 'key' AND NOT regexp_matches(span, '[0-9 ×÷]') AND (in_phrase OR (seen = 0 AND lower(span) = span))) AS unsure FROM judged),
elsewhere AS (
  SELECT o.doc_id, o.s, arg_min(o.preferred, o.term) AS elsewhere FROM options o JOIN tok t ON t.doc_id = o.doc_id AND o.trusted
    AND ((o.preferred NOT LIKE '% %' AND t.w = o.preferred AND (t.e <= o.s OR t.s >= o.e)) OR (o.preferred LIKE '% %' AND t.w || ' ' || t.w2 = o.preferred AND (t.e2 <= o.s OR t.s >= o.e)))
  GROUP BY ALL),
decided AS (
  SELECT doc_id, s, e, span, match, options, elsewhere, n_trusted > 0 AND held IS NULL AND unsure AS pending,
    CASE WHEN n_trusted = 0 THEN 'skipped:low-trust' WHEN held IS NOT NULL THEN held WHEN NOT unsure THEN 'applied' WHEN n_trusted > 1 THEN 'skipped:conflict' ELSE 'skipped:context-unavailable' END AS decision,
    CASE WHEN length(span) > 1 AND upper(span) = span AND lower(span) <> span AND upper(word) <> word AND length(upper(word)) = length(word) THEN upper(word) ELSE word END AS applied
  FROM weighed LEFT JOIN elsewhere USING (doc_id, s))"""


CORRECTED = """
SELECT doc_id, CASE WHEN n IS NULL THEN text ELSE coalesce(pieces, '') || substring(text, coalesce(last, 0) + 1) END AS output, CAST(coalesce(n, 0) AS BIGINT) AS n_candidates, CASE WHEN n IS NULL THEN 'no-candidates' ELSE '' END AS reason
FROM texts LEFT JOIN (SELECT doc_id, count(*) AS n FROM decided GROUP BY doc_id) USING (doc_id) LEFT JOIN (
  SELECT doc_id, string_agg(substring(text, before + 1, s - before) || applied, '' ORDER BY s) AS pieces, max(e) AS last
  FROM (SELECT doc_id, s, e, applied, coalesce(lag(e) OVER (PARTITION BY doc_id ORDER BY s), 0) AS before FROM decided WHERE decision = 'applied') JOIN texts USING (doc_id) GROUP BY doc_id) USING (doc_id)"""
DECISIONS = "SELECT match, decision, count(*) AS n FROM decided GROUP BY ALL"
REQUESTS = f"""
SELECT doc_id, count(*) AS n_items, string_agg(s || '|' || span || '|' || array_to_string(options, ',') || '|' || array_to_string(list_filter([CASE WHEN elsewhere IS NOT NULL THEN 'the text also has ' || elsewhere || ' as it is spelled' END, CASE WHEN match = 'join' THEN {_quoted(JOIN_HINT)} END], lambda h: h IS NOT NULL), '; '), ';' ORDER BY s) AS items
FROM decided WHERE pending GROUP BY doc_id"""
VERDICTS = "SELECT CASE WHEN NOT pending THEN decision WHEN s % 4 = 0 THEN 'applied' WHEN s % 4 = 1 THEN 'skipped:context' WHEN s % 4 = 2 THEN 'llm-error' ELSE decision END AS decision, count(*) AS n FROM decided GROUP BY 1"

_BLANK = {"op": "''", "word": "''", "week": "''", "term": "false", "retired": "false", "learnt": "false", "trust": "0", "told": "false", "seen": "0", "vetoes": "0", "guard": "[]::VARCHAR[]", "learned": "0", "confirmed": "0", "reverted": "0", "ignored": "0"}


def _state(of: str = "a", **changes: str) -> str:
    """A state of a life: that of `of` but for some fields; without one, a blank one."""
    fields = {k: changes.get(k, f"{of}.{k}" if of else v) for k, v in _BLANK.items()}
    return "{" + ", ".join(f"'{k}': {v}" for k, v in fields.items()) + "}"


def _more(*names: str) -> dict[str, str]:
    return {n: f"a.{n} + 1" for n in names}


#: A correction is made by itself where the term is trusted and its spelling has no veto; one that only sounds like it
#: has to have been seen, and a common word is never corrected without a judge, whose text the user is shown.
_APPLIES = "(a.term AND a.trust >= 2 AND a.vetoes = 0 AND ((x.word = 'jonas' AND a.seen > 0) OR x.word = 'maarit'))"
_SHOWN = "(a.term AND x.word = 'kiwi')"
_GUARD = f"CASE WHEN x.word = 'kiwi' THEN list_concat(['live', 'tell', x.week], list_filter(a.guard, lambda w: w NOT IN ('live', 'tell', x.week)))[1:{GUARD_WORDS}] ELSE a.guard END"

#: The lives of names under the events of catalog.learning: for each user and name a state that each event changes.
LEARNED = f"""
WITH log AS (
  SELECT user_id, event_id AS seq, CASE WHEN event_id % 7 IN (0, 6) THEN 'jonas' WHEN event_id % 7 = 1 THEN 'maarit' WHEN event_id % 7 = 2 THEN 'kiwi' ELSE '' END AS word, 'wk' || lpad(CAST(event_id % 40 AS VARCHAR), 2, '0') AS week,
    CASE WHEN event_id % 7 = 3 THEN 'title' WHEN event_id % 7 IN (4, 5) THEN 'other' WHEN event_type = 'signup' THEN 'add' WHEN event_type = 'error' AND event_id % 3 = 0 THEN 'delete' WHEN event_type = 'view' AND event_id % 5 = 0 THEN 'set'
      WHEN event_type = 'purchase' OR (event_type = 'click' AND event_id % 2 = 1) THEN CASE WHEN event_id % 7 = 6 THEN 'both' ELSE 'edit' END ELSE 'kept' END AS op FROM events),
steps AS (SELECT user_id, word, list_prepend({_state('')}, list({_state('', op='op', word='word', week='week')} ORDER BY seq)) AS steps FROM log GROUP BY user_id, word),
ended AS (SELECT user_id, word, list_reduce(steps, lambda a, x: CASE
  WHEN x.op = 'add' THEN {_state(term='true', retired='false', learnt='a.term AND a.learnt', trust='CASE WHEN a.term THEN greatest(a.trust, 2) ELSE 2 END')}
  WHEN x.op = 'delete' THEN {_state(term='false', retired='a.retired OR a.term', trust='0', told='false', seen='0', vetoes='0', guard='[]::VARCHAR[]')}
  WHEN x.op = 'set' THEN {_state(trust='CASE WHEN a.term THEN 1 ELSE 0 END')}
  WHEN x.op = 'kept' AND ({_APPLIES} OR {_SHOWN}) THEN {_state(told='true', trust='a.trust - 2', guard=_GUARD, **_more('vetoes', 'reverted'))}
  WHEN x.op = 'both' AND {_APPLIES} THEN {_state(told='true', trust='a.trust - 2', **_more('seen', 'vetoes', 'confirmed', 'reverted'))}
  WHEN x.op = 'edit' AND ({_APPLIES} OR {_SHOWN}) THEN {_state(told='true', **_more('trust', 'seen', 'confirmed'))}
  WHEN x.op IN ('edit', 'both') AND a.term THEN {_state(told='true', **_more('trust', 'seen', 'learned'))}
  WHEN x.op IN ('edit', 'both') AND a.retired THEN {_state(**_more('ignored'))}
  WHEN x.op IN ('edit', 'both') THEN {_state(term='true', learnt='true', trust='1', told='true', seen='1', vetoes='0', **_more('learned'))}
  WHEN x.op = 'title' THEN {_state(ignored='a.ignored + 3')}
  WHEN x.op = 'other' THEN {_state(**_more('ignored'))}
  ELSE {_state()} END) AS z FROM steps)"""
_OF = "CAST(user_id AS VARCHAR) AS user_id, word AS term"
_NAME = "CASE word WHEN 'jonas' THEN 'Jonas' WHEN 'maarit' THEN 'Maarit' ELSE 'Kiwi' END AS preferred"
TERMS_LEFT = f"SELECT {_OF}, {_NAME}, CASE WHEN z.learnt THEN 'learned' ELSE 'added' END AS source, CAST(z.trust AS BIGINT) AS trust, CASE WHEN z.trust >= 2 THEN 'trusted' WHEN z.trust > 0 THEN 'watching' ELSE 'muted' END AS status FROM ended WHERE z.term"
SPELLINGS_LEFT = f"SELECT {_OF}, CASE word WHEN 'jonas' THEN 'joonas' WHEN 'maarit' THEN 'ma arit' ELSE 'kiwi' END AS misspelling, CAST(z.seen AS BIGINT) AS seen, CAST(z.vetoes AS BIGINT) AS vetoes, array_to_string(z.guard, '+') AS guard FROM ended WHERE z.term AND z.told"
RETIRED = f"SELECT {_OF}, {_NAME} FROM ended WHERE z.retired"
REPORTED = "SELECT CAST(user_id AS VARCHAR) AS user_id, CAST(sum(z.learned) AS BIGINT) AS learned, CAST(sum(z.confirmed) AS BIGINT) AS confirmed, CAST(sum(z.reverted) AS BIGINT) AS reverted, CAST(sum(z.ignored) AS BIGINT) AS ignored FROM ended GROUP BY user_id"
