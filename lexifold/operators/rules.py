"""Thresholds, and the text functions of functions/text.py for one string at a time, as the fold needs them."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

from ..functions import text as T
from ..functions.lexicon import GLUE

#: Trust from which a term is applied; what a revert costs; keys shorter than this are never matched by an edit.
ACTIVE, PENALTY, FUZZY_LENGTH = 2, 2, 4
#: Words that a guard keeps, and characters that a name may have.
GUARD_WORDS, LONGEST = 24, 64
ARTICLES = frozenset({"a", "an", "the"})
#: Spellings that sound alike, those with an h first, as they are applied first; a letter twice.
WITH_H, WITHOUT_H = [x for x in T.EQUIVALENCES if "h" in x[0]], [x for x in T.EQUIVALENCES if "h" not in x[0]]
TWICE = re.compile(r"([a-z])\1+")
TOKEN, MARKED = re.compile(T.TOKEN), re.compile(f"[{re.escape(T.IDENTIFIER_MARKS)}.]")


@lru_cache(1 << 16)
def key(word: str) -> str:
    return sounded(bare(word))


def bare(word: str) -> str:
    """functions.text.plain, at once for words of ASCII letters and digits."""
    return word.lower() if word.isascii() and word.isalnum() else T.plain(word)


def sounded(k: str) -> str:
    """The key of a bare word."""
    if "h" in k:
        for a, b in WITH_H:
            k = k.replace(a, b)
    for a, b in WITHOUT_H:
        k = k.replace(a, b)
    return TWICE.sub(r"\1", k) if TWICE.search(k) else k


def phrase_key(text: str) -> str:
    return " ".join(filter(None, map(key, text.split())))


def one_edit(a: str, b: str) -> bool:
    if abs(len(a) - len(b)) > 1:
        return False
    i = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
    if len(a) == len(b):
        return a[i + 1:] == b[i + 1:] or (a[i: i + 2] == b[i: i + 2][::-1] and a[i + 2:] == b[i + 2:])
    return a[i + 1:] == b[i:] if len(a) > len(b) else a[i:] == b[i + 1:]


def alike(a: str, b: str) -> bool:
    x, y = key(a), key(b)
    return bool(x and y) and (x == y or (min(len(x), len(y)) >= FUZZY_LENGTH and one_edit(x, y)))


def fold_name(text: str) -> str:
    return unicodedata.normalize("NFC", text).casefold()


def spelled(text: str) -> str:
    """A spelling as it is looked up: folded, with one space between words."""
    return " ".join(text.casefold().split())


def opens_sentence(text: str, start: int) -> bool:
    rest = text[:start].rstrip(T.OPENERS)
    return not rest or rest[-1] in T.ENDERS


def content(text: str, without: frozenset[str] | set[str] = frozenset()) -> set[str]:
    return {w for w in map(str.casefold, TOKEN.findall(text)) if len(w) > 2} - GLUE - set(without)


def identifiers(text: str) -> Iterator[tuple[int, int]]:
    """The runs without white space that are identifiers: their edges cut, they have a mark or a dot."""
    for m in re.finditer(r"\S+", text):
        if MARKED.search(m.group().strip(T.EDGES)):
            yield m.span()


def heading(text: str) -> bool:
    """Whether capitals say nothing here: every word has one, or at least half of three words that open no sentence."""
    marks = [(m.group()[0], opens_sentence(text, m.start())) for m in TOKEN.finditer(text)]
    lettered = [first.isupper() for first, _ in marks if first.isalpha()]
    inner = [first.isupper() for first, opens in marks if not opens]
    return (len(marks) > 1 and bool(lettered) and all(lettered)) or (len(inner) > 2 and 2 * sum(inner) >= len(inner))


#: Why a name can't be kept as a term, in the order of the checks.
REFUSALS = (
    ("a term needs a letter", lambda name: not phrase_key(name) or not any(map(str.isalpha, name))),
    (f"a term has {LONGEST} characters at most", lambda name: len(name) > LONGEST),
    ("a term is words of letters and digits, one space between them", lambda name: TOKEN.findall(name) != name.split()),
)


def check_term(preferred: str | None) -> tuple[str, str | None]:
    """The name as it is kept, and why it can't be a term, if so."""
    name = unicodedata.normalize("NFC", " ".join((preferred or "").split()))
    return name, next((why for why, holds in REFUSALS if holds(name)), None)
