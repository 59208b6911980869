"""Runs of words in texts that may read as a key of a memory, found where the texts are, without a row for every token.

A sieve tells of (user, key) whether a memory may have that key, one that it begins, or one that is an edit from it: a bitmap
of fixed size over hashes, so that it costs the same whatever the memories hold. What passes it is met with the keys
themselves in a join; a sieve that lets more through changes no result. Each distinct word is looked at once in a while; a
text's other words are passed by. A task holds a batch of texts.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from functools import cached_property, lru_cache
from itertools import pairwise
from zlib import crc32

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.lexicon import COMMON, GLUE, is_common
from .rules import ARTICLES, FUZZY_LENGTH, MARKED, TOKEN, bare, key, sounded

#: Bits of a sieve, as a power of two, and how many are read together.
BITS, WORD = 23, 32
MASK = (1 << BITS) - 1
#: Runs that are handed out together.
OUT = 4096
RUNS = "user_id string, doc string, version long, start int, `end` int, text string, match string, n int, key string, all_common boolean, in_phrase boolean, asks array<string>, context array<string>"
_ARROW = pa.schema([("user_id", pa.string()), ("doc", pa.string()), ("version", pa.int64()), ("start", pa.int32()), ("end", pa.int32()), ("text", pa.string()), ("match", pa.string()), ("n", pa.int32()), ("key", pa.string()), ("all_common", pa.bool_()), ("in_phrase", pa.bool_()), ("asks", pa.list_(pa.string())), ("context", pa.list_(pa.string()))])
#: First characters of a word that may change how the end of the one before it sounds, once both are one word.
_MELTS = frozenset("hkeous")


#: What stands before an entry of a sieve that is no run of words: the beginning of a key of one word; such a key less a
#: letter, or whole; a spelling that guards hold back; a word that guards.
BEGINS, CUT, HELD, GUARDS = "^", "~", "?", "!"
#: What a word may be: the first of a run, an edit from a key, the first of two that read as one (if the second one melts
#: into it, or doesn't), one without a key, one that melts, one that guards.
FIRST, EDITED, MELTED, HEAD, EMPTY, MELTS, GUARD = (1 << i for i in range(7))
#: What a word is that may begin a run, by whether the word after it melts.
MAY, MAY_MELT = FIRST | EDITED | HEAD, FIRST | EDITED | MELTED
#: Words that a task keeps what they may be of, before it keeps those of the last so many and no others.
WORDS = 1 << 17


def sieve(keys: DataFrame, misspellings: DataFrame | None = None) -> bytes:
    """The sieve of (user_id, key), a key of several words by each run of words it begins with, and of the spellings
    (user_id, misspelling, vetoes, guard) that guards hold back."""
    lone = keys.where("key NOT LIKE '% %'")
    entry = lambda rows, mark, each: rows.select("user_id", F.explode(F.expr(each)).alias("e")).withColumn("e", F.concat(F.lit(mark), "e"))
    entries = entry(keys, "", "transform(sequence(1, size(split(key, ' '))), n -> substring_index(key, ' ', n))")
    entries = entries.union(entry(lone, BEGINS, "transform(sequence(0, length(key)), n -> left(key, n))"))
    entries = entries.union(entry(lone, CUT, "transform(sequence(0, length(key)), i -> CASE WHEN i = 0 THEN key ELSE concat(substring(key, 1, i - 1), substring(key, i + 1)) END)"))
    if misspellings is not None:
        held = misspellings.where("vetoes > 0 AND size(guard) > 0")
        entries = entries.union(entry(held, HELD, "array(misspelling)")).union(entry(held, GUARDS, "guard"))
    place = F.crc32(F.concat("user_id", F.lit("\0"), "e").cast("binary")).bitwiseAND((1 << BITS) - 1)
    words = entries.select(place.alias("p")).where("p IS NOT NULL").groupBy(F.floor(F.col("p") / WORD).cast("int").alias("w")).agg(F.bit_or(F.expr(f"shiftleft(1L, CAST(p % {WORD} AS int))")).alias("bits"))
    out = bytearray((1 << BITS) // 8)
    for w, bits in words.collect():  # as many as the sieve has, at most
        out[w * WORD // 8: (w + 1) * WORD // 8] = bits.to_bytes(WORD // 8, "little")
    return bytes(out)


def cuts(k: str) -> list[str]:
    """A key, and it less one of its letters."""
    return [k, *{k[:i] + k[i + 1:] for i in range(len(k))}]


class Seen(dict):
    """What the words of a user's texts may be, as far as a sieve tells; `last` has what was told of words before those.
    Keys are ASCII, and what marks an entry of the sieve is hashed once."""

    def __init__(self, user: str, bits: bytes, last: dict[str, int]):
        self.bits, self.last, self.seed = bits, last, crc32(f"{user}\0".encode())
        self.begins, self.cut, self.guards = (crc32(m.encode(), self.seed) for m in (BEGINS, CUT, GUARDS))

    def may(self, k: str) -> bool:
        return bool(self.has(k.encode(), self.seed))

    def has(self, k: bytes, mark: int) -> int:
        """Whether the sieve may have k after what was hashed to a mark, as 0 or 1."""
        at = crc32(k, mark) & MASK
        return self.bits[at >> 3] >> (at & 7) & 1

    def near(self, k: bytes) -> bool:
        """Whether the sieve may have one of the `cuts` of k; what stands before the letter left out is hashed once for all."""
        bits, head, at = self.bits, self.cut, crc32(k, self.cut) & MASK
        if bits[at >> 3] >> (at & 7) & 1:
            return True
        for i in range(len(k)):
            at = crc32(k[i + 1:], head) & MASK
            if bits[at >> 3] >> (at & 7) & 1:
                return True
            head = crc32(k[i: i + 1], head)
        return False

    def __missing__(self, word: str) -> int:
        if (flags := self.last.get(word)) is None:
            flags = self.told(word)
        self[word] = flags
        return flags

    def told(self, word: str) -> int:
        own, low, has = bare(word), word.casefold(), self.has
        k = sounded(own).encode()
        flags = GUARD if len(low) >= 3 and low not in GLUE and has(low.encode(), self.guards) else 0
        if not k:
            return flags | FIRST | EMPTY | MELTS
        flags |= FIRST * has(k, self.seed) | HEAD * has(k, self.begins) | MELTED * has(k[:-2], self.begins) | MELTS * (own[0] in _MELTS)
        return flags | EDITED if len(k) >= FUZZY_LENGTH and self.near(k) else flags


def joined_key(a: str, b: str) -> str:
    """The key of two words read as one: their keys side by side, unless they sound otherwise where they meet."""
    x, y = key(a), key(b)
    if not x or not y or bare(b)[0] in _MELTS:
        return sounded(bare(a) + bare(b))
    return x + y[1:] if x[-1] == y[0] and x[-1].isalpha() else x + y


class Text:
    """A text with what is asked of its words where a run is found."""

    def __init__(self, text: str, words: list[str]):
        self.text = text
        self.spans = [m.span() for m in TOKEN.finditer(text)]
        self.words = words
        self.run = 0, 0, False

    def beside(self, i: int) -> bool:
        """Whether one space stands between word i and the next one."""
        return i + 1 < len(self.spans) and self.spans[i + 1][0] == self.spans[i][1] + 1 and self.text[self.spans[i][1]] == " "

    def marked(self, i: int, j: int) -> bool:
        """Whether one of the words i to j is part of an identifier."""
        return any(map(self.identifier, range(i, j + 1)))

    def identifier(self, i: int) -> bool:
        """Whether the run without white space that word i is in is an identifier; the last run is known by its ends."""
        a, b = self.spans[i]
        if not self.run[0] <= a < self.run[1]:
            while a and not self.text[a - 1].isspace():
                a -= 1
            while b < len(self.text) and not self.text[b].isspace():
                b += 1
            self.run = a, b, bool(MARKED.search(self.text[a:b].strip(T.EDGES)))
        return self.run[2]

    @cached_property
    def telling(self) -> list[int]:
        """Words that are neither a number nor a lone s."""
        return [i for i, w in enumerate(self.words) if not w.isdigit() and w not in ("s", "S")]

    def opens(self, i: int) -> bool:
        """Whether word i begins a sentence, by the gap before it."""
        gap = self.text[self.spans[i - 1][1] if i else 0: self.spans[i][0]].rstrip(T.OPENERS)
        return gap[-1] in T.ENDERS if gap else i == 0

    def capital(self, i: int) -> bool:
        first = self.words[i][0]
        return first != first.lower() and not "0" <= first <= "9"

    def in_phrase(self, i: int) -> bool:
        """Whether a number follows word i, or the nearest word on a side that is neither a number nor a lone s has a
        capital (before it: one that isn't there for the sentence)."""
        if i + 1 < len(self.words) and self.words[i + 1].isdigit():
            return True
        after, before = bisect_right(self.telling, i), bisect_left(self.telling, i) - 1
        if after < len(self.telling) and self.capital(self.telling[after]):
            return True
        return before >= 0 and self.capital(self.telling[before]) and not self.opens(self.telling[before])


def runs(docs: DataFrame, bits: bytes, longest: int, words: frozenset[str] = COMMON) -> DataFrame:
    """RUNS of docs that pass a sieve: 1 to `longest` tokens with one space between neighbours and no identifier among them,
    as match "key"; two such neighbours read as one word have the match "join". `asks` has what a memory is asked for: the
    key after "=", and for a word that may be an edit from one its `cuts`, after CUT. A run whose spelling guards may hold
    back has the words of its text that may guard as `context`."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common = lru_cache(1 << 16)(lambda w: is_common(w, words))
        users: dict[str, Seen] = {}
        last: dict[str, Seen] = {}
        out: list[tuple] = []

        def batch() -> pa.RecordBatch:
            columns = zip(*out, strict=True) if out else [[]] * len(_ARROW)
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _ARROW.types, strict=True)], schema=_ARROW)

        for rows in batches:
            for row in range(rows.num_rows):
                user, doc, version, text = (rows.column(c)[row].as_py() for c in T.DOC + ("text",))
                if text is None:
                    continue
                if user not in users:
                    users[user] = Seen(user, bits, last.pop(user, {}))
                seen = users[user]
                may, said = seen.may, TOKEN.findall(text)
                flags = list(map(seen.__getitem__, said))
                starts = [i for i, (f, after) in enumerate(pairwise([*flags, 0])) if f & (MAY_MELT if after & MELTS else MAY)]
                t, hits = Text(text, said) if starts else None, []
                for i in starts:
                    f, k = flags[i], key(said[i])
                    cut = [CUT + c for c in cuts(k) if may(CUT + c)] if f & EDITED else []
                    if f & FIRST:
                        path = ""
                        for j in range(i, min(i + longest, len(said))):
                            if j > i and not t.beside(j - 1):
                                break
                            if after := key(said[j]):
                                path = f"{path} {after}" if path else after
                                if not may(path):
                                    break
                            if path:
                                hits.append((i, j, "key", path, cut if i == j else []))
                    elif cut:
                        hits.append((i, i, "key", k, cut))
                    if i + 1 < len(said) and f & (EMPTY | (MELTED if flags[i + 1] & MELTS else HEAD)) and t.beside(i):
                        both = joined_key(said[i], said[i + 1])
                        if both and may(both) and not (said[i].lower() in ARTICLES and common(said[i + 1])):
                            hits.append((i, i + 1, "join", both, []))
                context = None
                for i, j, match, k, cut in hits:
                    if not t.marked(i, j):
                        own = " ".join(said[i: j + 1])
                        held = may(HELD + own.casefold())
                        if held and context is None:
                            context = sorted({w.casefold() for w, f in zip(said, flags, strict=True) if f & GUARD})
                        out.append((user, doc, version, t.spans[i][0], t.spans[j][1], own, match, j - i + 1, k, all(map(common, said[i: j + 1])), t.in_phrase(i), [f"={k}", *cut], context if held else []))
                if len(out) >= OUT:
                    yield batch()
                    out.clear()
                if sum(map(len, users.values())) > WORDS or len(users) > 256:
                    for each in users.values():
                        each.last = {}
                    last, users = users, {}
        yield batch()

    # all columns, so that who joins the same texts to what was found reads one exchange
    return T.dealt(docs).mapInArrow(found, RUNS)
