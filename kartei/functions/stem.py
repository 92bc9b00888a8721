"""English stems, by the published rules of the second Porter algorithm, and the words that share one.

A search asks for all words with the stem of a search word. As those are made from the stem by a closed set of endings,
they are listed once on the driver, and matching stays a comparison of words.
"""

from __future__ import annotations

import functools
import itertools
import re

VOWELS = "aeiouy"
# Fixed values of the algorithm: words with stems of their own, doubled letters, endings with what they become.
OWN = {"skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl", **{w: w for w in "sky news howe atlas cosmos bias andes".split()}}
KEPT = frozenset("inning outing canning herring earring proceed exceed succeed".split())
DOUBLES = ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")
STEP2 = {"ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "abli": "able", "entli": "ent", "izer": "ize", "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "aliti": "al", "alli": "al", "fulness": "ful", "ousli": "ous", "ousness": "ous", "iveness": "ive", "iviti": "ive", "biliti": "ble", "bli": "ble", "fulli": "ful", "lessli": "less"}
STEP3 = {"ational": "ate", "tional": "tion", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
STEP4 = "ement ance ence able ible ment ant ent ism ate iti ous ive ize ion al er ic".split()
#: Endings that a stem may have lost, alone or by twos, to be tried when words are made from it.
ENDINGS = "s es e ed ing ly er y ies ied ies al ance ence able ible ant ement ment ent ism ate ity ous ive ize ion ation ational ator izer ization alism fulness ful ness less iveness ousness ative ical icate ically".split()


def _regions(w: str) -> tuple[int, int]:
    """Where R1 and R2 begin: behind the first consonant that follows a vowel, and the same again."""

    def after(start: int) -> int:
        m = re.compile(r"[aeiouy][^aeiouy]").search(w, start)
        return m.end() if m else len(w)

    head = next((p for p in ("gener", "commun", "arsen") if w.startswith(p)), None)
    r1 = len(head) if head else after(0)
    return r1, after(r1)


def _short_end(w: str) -> bool:
    """True if the last syllable is short."""
    return bool(re.search(r"[^aeiouy][aeiouy][^aeiouywxY]$|^[aeiouy][^aeiouy]$", w))


@functools.lru_cache(1 << 16)
def stem(word: str) -> str:
    """The stem of a lower-case word."""
    if len(word) < 3:
        return word
    if word in OWN:
        return OWN[word]
    w = re.sub(r"(^|[aeiouy])y", lambda m: m[1] + "Y", word)
    r1, r2 = _regions(w)
    # plurals
    if w.endswith("sses"):
        w = w[:-2]
    elif w.endswith(("ied", "ies")):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif w.endswith("s") and not w.endswith(("us", "ss")) and re.search(r"[aeiouy].", w[:-1]):
        w = w[:-1]
    if w in KEPT:
        return w
    # past forms
    end = next((e for e in ("eedly", "ingly", "edly", "eed", "ing", "ed") if w.endswith(e)), None)
    if end in ("eedly", "eed"):
        w = w[: -len(end)] + "ee" if len(w) - len(end) >= r1 else w
    elif end and re.search(r"[aeiouy]", w[: -len(end)]):
        w = w[: -len(end)]
        if w.endswith(("at", "bl", "iz")):
            w += "e"
        elif w.endswith(DOUBLES):
            w = w[:-1]
        elif r1 >= len(w) and _short_end(w):
            w += "e"
    if len(w) > 2 and w[-1] in "yY" and w[-2] not in VOWELS:
        w = w[:-1] + "i"
    # derived forms
    for table in (STEP2, STEP3):
        end = next((e for e in sorted(table, key=len, reverse=True) if w.endswith(e)), None)
        if end and len(w) - len(end) >= r1:
            w = w[: -len(end)] + table[end]
        elif not end and table is STEP2 and w.endswith("ogi") and len(w) - 3 >= r1 and w[-4:-3] == "l":
            w = w[:-1]
        elif not end and table is STEP2 and w.endswith("li") and len(w) - 2 >= r1 and w[-3] in "cdeghkmnrt":
            w = w[:-2]
        elif not end and table is STEP3 and w.endswith("ative") and len(w) - 5 >= r2:
            w = w[:-5]
    end = next((e for e in sorted(STEP4, key=len, reverse=True) if w.endswith(e)), None)
    if end and len(w) - len(end) >= r2 and (end != "ion" or w[-4:-3] in ("s", "t")):
        w = w[: -len(end)]
    if w.endswith("e") and (len(w) - 1 >= r2 or len(w) - 1 >= r1 and not _short_end(w[:-1])) or w.endswith("ll") and len(w) - 1 >= r2:
        w = w[:-1]
    return w.lower()


@functools.lru_cache(1024)
def word_forms(word: str) -> tuple[str, ...]:
    """The word and all words of known endings that have its stem."""
    s = stem(word)
    bases = {s, word, s + s[-1:], s.removesuffix("i") + "y" if s.endswith("i") else s}
    ends = ["", *ENDINGS, *(a + b for a, b in itertools.product(ENDINGS, ("s", "ly", "ed", "ing", "ness", "ment", "ments", "e", "es")))]
    made = {b + e for b in bases for e in ends} | {b[:-1] + e for b in bases if len(b) > 3 for e in ("y", "ies", "ied", "ying", "ier", "iest", "ing", "ed")}
    return tuple(sorted({word, *(w for w in made if stem(w) == s)}))
