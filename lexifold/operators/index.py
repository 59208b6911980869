"""What a memory is asked about keys, kept up to date by each change: nothing here is built anew for an event.

Spellings come in and go one by one. A key knows the terms that have a spelling of it (and how many), a key of one word
is found again from each of its cuts, which are it and what leaving out one letter makes of it, and a key of several
words counts towards each run of words it begins with. So whatever is one edit from a word shares a cut with it, and a
window of words grows only while some key goes on.
"""

from __future__ import annotations

from collections import Counter

from .rules import one_edit, phrase_key


def cuts(key: str) -> set[str]:
    return {key, *(key[:i] + key[i + 1:] for i in range(len(key)))}


class KeyIndex:
    def __init__(self) -> None:
        self.owners: dict[str, Counter[str]] = {}
        self.by_cut: dict[str, set[str]] = {}
        self.begun: Counter[str] = Counter()
        self.lengths: Counter[int] = Counter()
        self.preferred: dict[str, set[str]] = {}

    def add(self, name: str, spelling: str) -> None:
        if not (key := phrase_key(spelling)):
            return
        if (owners := self.owners.get(key)) is None:
            self.owners[key] = owners = Counter()
            self._link(key)
        owners[name] += 1

    def remove(self, name: str, spelling: str) -> None:
        if not (owners := self.owners.get(key := phrase_key(spelling))):
            return
        owners[name] -= 1
        owners += Counter()  # drops what is down to nothing
        if not owners:
            del self.owners[key]
            self._unlink(key)

    def prefer(self, name: str, spelling: str) -> None:
        """The spelling by which a term is known: it also counts for the longest window and for lookups by key."""
        self.add(name, spelling)
        self.lengths[len(spelling.split())] += 1
        self.preferred.setdefault(phrase_key(spelling), set()).add(name)

    def unprefer(self, name: str, spelling: str) -> None:
        self.remove(name, spelling)
        self.lengths[n := len(spelling.split())] -= 1
        if not self.lengths[n]:
            del self.lengths[n]
        if names := self.preferred.get(key := phrase_key(spelling)):
            names.discard(name)
            if not names:
                del self.preferred[key]

    def _link(self, key: str) -> None:
        words = key.split(" ")
        for n in range(1, len(words)):
            self.begun[" ".join(words[:n])] += 1
        if len(words) == 1:
            for c in cuts(key):
                self.by_cut.setdefault(c, set()).add(key)

    def _unlink(self, key: str) -> None:
        words = key.split(" ")
        for n in range(1, len(words)):
            self.begun[start := " ".join(words[:n])] -= 1
            if not self.begun[start]:
                del self.begun[start]
        if len(words) == 1:
            for c in cuts(key):
                self.by_cut[c].discard(key)
                if not self.by_cut[c]:
                    del self.by_cut[c]

    @property
    def longest(self) -> int:
        return max(self.lengths, default=0)

    def of(self, key: str) -> set[str]:
        """Names of the terms with a spelling of this key."""
        return set(self.owners.get(key, ()))

    def near(self, key: str) -> set[str]:
        """Names of the terms with a spelling of one word whose key is one edit from this one at most."""
        close = {k for c in cuts(key) for k in self.by_cut.get(c, ()) if one_edit(key, k)}
        return {name for k in close for name in self.owners[k]}

    def first(self, key: str) -> str | None:
        """Of the terms known by a spelling of this key, the first by name."""
        return min(self.preferred.get(key, ()), default=None)
