import random
import time

from lexifold.functions.lexicon import is_common
from lexifold.operators.index import KeyIndex
from lexifold.operators.kernel import Memory, Reading
from lexifold.operators.rules import TOKEN, identifiers, key, one_edit, opens_sentence, phrase_key
from lexifold.sources.generate import misheard, name, sentence


def test_index_is_what_its_spellings_say():
    """After any changes, the index answers as one over the spellings that are left."""
    r = random.Random(0)
    words = [name(r) for _ in range(12)] + ["× ÷", "Cold Plate", "Cold Plate ×", "cold", "a"]
    index, held = KeyIndex(), []
    for _ in range(3000):
        if held and r.random() < 0.5:
            kind, who, s = held.pop(r.randrange(len(held)))
            (index.remove if kind == "spelling" else index.unprefer)(who, s)
        else:
            kind, who, s = r.choice(["spelling", "preferred"]), r.choice("abcdefgh"), misheard(w, r) if (w := r.choice(words)).isalpha() and len(w) > 2 else w
            if kind == "preferred" and any(h[:2] == (kind, who) for h in held):
                continue
            held.append((kind, who, s))
            (index.add if kind == "spelling" else index.prefer)(who, s)
        k = key(r.choice(words))
        assert index.of(k) == {who for _, who, s in held if k and phrase_key(s) == k}
        assert index.near(k) == {who for _, who, s in held if phrase_key(s) and " " not in phrase_key(s) and one_edit(k, phrase_key(s))}
        assert index.longest == max((len(s.split()) for kind, _, s in held if kind == "preferred"), default=0)
        assert index.first(k) == min((who for kind, who, s in held if kind == "preferred" and phrase_key(s) == k), default=None)
    for kind, who, s in held:
        (index.remove if kind == "spelling" else index.unprefer)(who, s)
    assert not index.owners and not index.by_cut and not index.begun and not index.lengths and not index.preferred


def spans_by_definition(memory, text):
    """Every pair of words, looked at with every spelling."""
    words = [(m.start(), m.end()) for m in TOKEN.finditer(text)]
    spelled = [(n, phrase_key(s)) for n, t in memory.terms.items() for s in (t.preferred, *t.spellings)]
    longest = max((len(t.preferred.split()) for t in memory.terms.values()), default=0)
    found = []
    for i in range(len(words)):
        for j in range(i, len(words)):
            if any(text[words[x][1]: words[x + 1][0]] != " " for x in range(i, j)):
                break
            lo, hi = words[i][0], words[j][1]
            if any(a < hi and lo < b for a, b in identifiers(text)):
                continue
            k = phrase_key(text[lo:hi])
            same = {n for n, x in spelled if k and x == k}
            if same and j - i < longest:
                found.append((lo - hi, lo, 0, "key", same))
            if j == i and not same and len(k) >= 4:
                close = {n for n, x in spelled if x and " " not in x and one_edit(k, x)}
                if close:
                    found.append((lo - hi, lo, 0, "fuzzy", close))
            if j == i + 1:
                a, b = text[slice(*words[i])], text[slice(*words[j])]
                both = {n for n, x in spelled if x and x == key(a + b)}
                if both and not (a.casefold() in ("a", "an", "the") and is_common(b, memory.common)):
                    found.append((lo - hi, lo, 1, "join", both))
    out, taken = [], []
    for length, lo, _, match, names in sorted(found, key=lambda f: f[:3]):
        hi = lo - length
        if all(hi <= a or b <= lo for a, b in taken):
            taken.append((lo, hi))
            if all(memory.terms[n].preferred != text[lo:hi] for n in names):
                out.append((lo, hi, match, sorted(names)))
    return sorted(out)


def lived(r, names, events=60):
    """A memory after adds, deletes, edits and kept mishearings."""
    m = Memory()
    for i in range(events):
        n = r.choice(names)
        kind = r.choice(["add_term", "delete_term", "observation", "observation", "observation"])
        said = sentence(n, r)
        heard = said.replace(n, misheard(n, r) if n.isalnum() and len(n) > 2 else n)
        payload = {"preferred": n, "trust": 2} if kind != "observation" else {"formatted": heard, "final": r.choice([said, heard, said.upper()])}
        m.apply(kind, payload, str(i))
    return m


def test_spans_by_definition():
    r = random.Random(1)
    names = [name(r) for _ in range(8)] + ["Cold Plate", "Cold Plate ×", "Hot Cold Plate", "Notes", "Kiwi"]
    gaps = [" "] * 12 + ["  ", ", ", ". ", "\n", "-", " @", " ", "’s "]
    words = [*names, "a", "the", "note", "ditya", "cold", "plate", "×", "12", "s", "x.y", "kivi"]
    some = 0
    for _ in range(40):
        m = lived(r, names)
        rebuilt = Memory()
        for n, t in m.terms.items():
            rebuilt.put(n, t)
        for _ in range(15):
            text = "".join(w + r.choice(gaps) for w in (misheard(w, r) if w.isalpha() and len(w) > 2 and r.random() < 0.5 else w for w in r.choices(words, k=12)))
            want = spans_by_definition(m, text)
            for memory in (m, rebuilt):
                assert [(s.start, s.end, s.match, sorted(t.preferred.casefold() for t in s.terms)) for s in memory.spans(Reading(text))] == want
            some += len(want)
    assert some > 500


def test_names_beside_a_word():
    """Each word's neighbours, found by going out from it."""
    r = random.Random(2)
    for _ in range(300):
        text = "".join(r.choice(["Ask", "marit", "12", "s", "S", "Holm", "now", "Éa"]) + r.choice([" ", ". ", " “", "’", ", ", "\n"]) for _ in range(r.randrange(1, 12)))
        read = Reading(text)
        plain = [not w.text.isdigit() and w.text.casefold() != "s" for w in read.words]
        for i in range(len(read.words)):
            after = next((w for w, p in zip(read.words[i + 1:], plain[i + 1:], strict=True) if p), None)
            before = next((w for w, p in zip(read.words[:i][::-1], plain[:i][::-1], strict=True) if p), None)
            number = i + 1 < len(read.words) and read.words[i + 1].text.isdigit()
            want = number or (after is not None and after.text[0].isupper()) or (before is not None and before.text[0].isupper() and not opens_sentence(text, before.start))
            assert read.beside_name[i] == want, (text, i)


def test_an_observation_costs_about_the_same_with_many_terms():
    def cost(terms):
        r, m = random.Random(3), Memory()
        names = []
        while len(m.terms) < terms:
            names.append(n := name(r))
            m.apply("add_term", {"preferred": n}, "0")
        began = time.perf_counter()
        for i in range(300):
            n = r.choice(names)
            said = sentence(n, r)
            m.apply("observation", {"formatted": said.replace(n, misheard(n, r)), "final": said}, str(i))
        return (time.perf_counter() - began) / 300

    cost(5)
    few, many = cost(5), cost(500)
    print(f"{few * 1e3:.3f} ms with 5 terms, {many * 1e3:.3f} ms with 500")
    assert many < 0.004 and many < 4 * few + 0.001
