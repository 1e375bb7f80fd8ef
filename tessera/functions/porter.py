"""The Porter stemmer, after M. F. Porter, An algorithm for suffix stripping (1980).
"""

from __future__ import annotations

import re
from functools import lru_cache

_C, _V = "[^aeiou][^aeiouy]*", "[aeiouy][aeiou]*"
_M0 = re.compile(f"^({_C})?{_V}{_C}")  # m > 0
_M1 = re.compile(f"^({_C})?{_V}{_C}({_V})?$")  # m = 1
_M2 = re.compile(f"^({_C})?{_V}{_C}{_V}{_C}")  # m > 1
_VOWEL = re.compile(f"^({_C})?[aeiouy]")
_CVC = re.compile(f"^{_C}[aeiouy][^aeiouwxy]$")

_STEP2 = [
    ("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("logi", "log"), ("bli", "ble"), ("alli", "al"),
    ("entli", "ent"), ("eli", "e"), ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"),
    ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"),
]
_STEP3 = [("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", "")]
_STEP4 = ["al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ou", "ism", "ate", "iti", "ous", "ive", "ize"]


def _swap(word: str, rules: list[tuple[str, str]]) -> str:
    for end, new in sorted(rules, key=lambda r: -len(r[0])):
        if word.endswith(end):
            root = word[: -len(end)]
            return root + new if _M0.match(root) else word
    return word


@lru_cache(maxsize=1 << 16)
def stem(word: str) -> str:
    """Stem of a word whose ASCII letters are lower case.

    Letters of other scripts count by their UTF-8 bytes, all as consonants, and words of
    under 3 or over 64 bytes stay, as in the full-text index whose ranking is matched.
    """
    raw = word.encode()
    if not 3 <= len(raw) <= 64:
        return word
    return _stem(raw.decode("latin-1")).encode("latin-1").decode("utf-8", "ignore")


def _stem(w: str) -> str:
    first_y = w[0] == "y"
    if first_y:
        w = "Y" + w[1:]
    # 1a: plurals
    if w.endswith(("sses", "ies")):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    # 1b: past tenses and participles
    if w.endswith("eed"):
        if _M0.match(w[:-3]):
            w = w[:-1]
    else:
        for end in ("ed", "ing"):
            if w.endswith(end) and _VOWEL.match(w[: -len(end)]):
                w = w[: -len(end)]
                if w.endswith(("at", "bl", "iz")):
                    w += "e"
                elif len(w) > 1 and w[-1] == w[-2] and w[-1] not in "aeioulsz":
                    w = w[:-1]
                elif _M1.match(w) and _CVC.match(w):
                    w += "e"
                break
    # 1c
    if w.endswith("y") and _VOWEL.match(w[:-1]):
        w = w[:-1] + "i"
    w = _swap(w, _STEP2)
    w = _swap(w, _STEP3)
    # 4: suffixes of long words
    for end in sorted([*_STEP4, "ion"], key=len, reverse=True):
        if w.endswith(end):
            root = w[: -len(end)]
            if _M2.match(root) and (end != "ion" or root.endswith(("s", "t"))):
                w = root
            break
    # 5: final e and double l
    if w.endswith("e"):
        root = w[:-1]
        if _M2.match(root) or (_M0.match(root) and not (_M1.match(root) and _CVC.match(root))):
            w = root
    if w.endswith("ll") and _M2.match(w):
        w = w[:-1]
    return "y" + w[1:] if first_y else w
