"""Porter stemmer (M. F. Porter, "An algorithm for suffix stripping",
Program 14(3), 1980), the original published rules.

A per-token helper for stemmed ROUGE; applied to token arrays in an
Arrow-batched pandas UDF with a per-worker cache (vocabularies repeat).
"""

from __future__ import annotations

from functools import lru_cache

VOWELS = "aeiou"


def _cons(w: str, i: int) -> bool:
    c = w[i]
    if c in VOWELS:
        return False
    if c == "y":
        return i == 0 or not _cons(w, i - 1)
    return True


def _m(stem: str) -> int:
    """Measure: number of VC sequences in [C](VC)^m[V]."""
    n, i, L = 0, 0, len(stem)
    while i < L and _cons(stem, i):
        i += 1
    while i < L:
        while i < L and not _cons(stem, i):
            i += 1
        if i >= L:
            break
        while i < L and _cons(stem, i):
            i += 1
        n += 1
    return n


def _has_vowel(stem: str) -> bool:
    return any(not _cons(stem, i) for i in range(len(stem)))


def _double_c(w: str) -> bool:
    return len(w) >= 2 and w[-1] == w[-2] and _cons(w, len(w) - 1)


def _cvc(w: str) -> bool:
    if len(w) < 3:
        return False
    return (_cons(w, len(w) - 3) and not _cons(w, len(w) - 2) and _cons(w, len(w) - 1)
            and w[-1] not in "wxy")


# The rule tables of the published algorithm, in its order.
STEP2 = [("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"),
         ("izer", "ize"), ("abli", "able"), ("alli", "al"), ("entli", "ent"), ("eli", "e"),
         ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"), ("ator", "ate"),
         ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"),
         ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble")]
STEP3 = [("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"),
         ("ful", ""), ("ness", "")]
STEP4 = ["al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent",
         "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize"]


def _longest(w: str, rules):
    """The rule with the longest suffix that ``w`` ends with (or None)."""
    best, best_len = None, -1
    for r in rules:
        suf = r[0] if isinstance(r, tuple) else r
        if len(suf) > best_len and w.endswith(suf):
            best, best_len = r, len(suf)
    return best


def _step1ab(w: str) -> str:
    if w.endswith("sses"):
        w = w[:-2]
    elif w.endswith("ies"):
        w = w[:-2]
    elif w.endswith("ss"):
        pass
    elif w.endswith("s"):
        w = w[:-1]
    if w.endswith("eed"):
        if _m(w[:-3]) > 0:
            w = w[:-1]
        return w
    for suf in ("ed", "ing"):
        if w.endswith(suf) and _has_vowel(w[:-len(suf)]):
            w = w[:-len(suf)]
            if w.endswith(("at", "bl", "iz")):
                return w + "e"
            if _double_c(w) and w[-1] not in "lsz":
                return w[:-1]
            if _m(w) == 1 and _cvc(w):
                return w + "e"
            return w
    return w


def _step1c(w: str) -> str:
    if w.endswith("y") and _has_vowel(w[:-1]):
        return w[:-1] + "i"
    return w


def _map_step(w: str, rules, min_m: int) -> str:
    r = _longest(w, rules)
    if r is None:
        return w
    suf, rep = r
    stem = w[:-len(suf)]
    return stem + rep if _m(stem) > min_m - 1 else w


def _step4(w: str) -> str:
    suf = _longest(w, STEP4)
    if suf is None:
        return w
    stem = w[:-len(suf)]
    if _m(stem) <= 1:
        return w
    if suf == "ion" and not stem.endswith(("s", "t")):
        return w
    return stem


def _step5(w: str) -> str:
    if w.endswith("e"):
        stem = w[:-1]
        m = _m(stem)
        if m > 1 or (m == 1 and not _cvc(stem)):
            w = stem
    if _m(w) > 1 and _double_c(w) and w.endswith("l"):
        w = w[:-1]
    return w


@lru_cache(maxsize=200_000)
def stem(word: str) -> str:
    w = word.lower()
    if len(w) <= 2:
        return w
    w = _step1ab(w)
    w = _step1c(w)
    w = _map_step(w, STEP2, 1)
    w = _map_step(w, STEP3, 1)
    w = _step4(w)
    return _step5(w)
