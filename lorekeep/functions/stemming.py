"""English stems by the published Porter2 rules, for the one analysis step that is a program and not an expression."""

from __future__ import annotations

import re
from functools import lru_cache

# Words with stems of their own, words that stay, prefixes that set the first region, and endings before "li".
SPECIAL = {"skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl"}
STAY = frozenset("sky news howe atlas cosmos bias andes".split())
STAY_LATER = frozenset("inning outing canning herring earring proceed exceed succeed".split())
PREFIX = re.compile("gener|commun|arsen")
LI = "cdeghkmnrt"
# The rules of steps 2 to 4, by suffix.
STEP2 = {
    "tional": "tion", "enci": "ence", "anci": "ance", "abli": "able", "entli": "ent", "izer": "ize", "ization": "ize", "ational": "ate", "ation": "ate", "ator": "ate", "alism": "al", "aliti": "al", "alli": "al",
    "fulness": "ful", "ousli": "ous", "ousness": "ous", "iveness": "ive", "iviti": "ive", "biliti": "ble", "bli": "ble", "ogi": "og", "fulli": "ful", "lessli": "less", "li": "",
}
STEP3 = {"tional": "tion", "ational": "ate", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": "", "ative": ""}
STEP4 = tuple("al ance ence er ic able ible ant ement ment ent ism ate iti ous ive ize ion".split())
_FIRST = re.compile("[^aeiouy]*[aeiouy]+[^aeiouy]")
_SHORT = re.compile("(?:^|.*[^aeiouy])[aeiouy][^aeiouywxY]$|^[aeiouy][^aeiouy]$")


def _longest(word: str, suffixes) -> str:
    return max((s for s in suffixes if word.endswith(s)), key=len, default="")


def _regions(word: str) -> tuple[int, int]:
    found = PREFIX.match(word) or _FIRST.match(word)
    one = found.end() if found else len(word)
    second = _FIRST.match(word, one)
    return one, second.end() if second else len(word)


def _vowel(part: str) -> bool:
    return re.search("[aeiouy]", part) is not None


@lru_cache(maxsize=1 << 18)
def stem(word: str) -> str:
    """The stem of a lower-cased word; words of two letters and words outside a-z stay as they are."""
    if len(word) <= 2 or not re.fullmatch("[a-z]+", word) or word in STAY:
        return word
    if word in SPECIAL:
        return SPECIAL[word]
    w = re.sub("(?<=[aeiouy])y|^y", "Y", word)
    one, two = _regions(w)
    end = _longest(w, ("sses", "ied", "ies", "us", "ss", "s"))
    if end == "sses":
        w = w[:-2]
    elif end in ("ied", "ies"):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif end == "s" and _vowel(w[:-2]):
        w = w[:-1]
    if w in STAY_LATER:
        return w
    end = _longest(w, ("eed", "eedly", "ed", "edly", "ing", "ingly"))
    head = w[: len(w) - len(end)]
    if end in ("eed", "eedly"):
        w = head + "ee" if len(head) >= one else w
    elif end and _vowel(head):
        w = head
        if w.endswith(("at", "bl", "iz")) or (len(w) <= one and _SHORT.match(w)):
            w += "e"
        elif w[-2:] in ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt"):
            w = w[:-1]
    if len(w) > 2 and w[-1] in "yY" and w[-2] not in "aeiouy":
        w = w[:-1] + "i"
    end = _longest(w, STEP2)
    head = w[: len(w) - len(end)]
    if end and len(head) >= one and (end != "ogi" or head.endswith("l")) and (end != "li" or head[-1:] in tuple(LI)):
        w = head + STEP2[end]
    end = _longest(w, STEP3)
    head = w[: len(w) - len(end)]
    if end and len(head) >= (two if end == "ative" else one):
        w = head + STEP3[end]
    end = _longest(w, STEP4)
    head = w[: len(w) - len(end)]
    if end and len(head) >= two and (end != "ion" or head.endswith(("s", "t"))):
        w = head
    if w.endswith("e") and (len(w) > two or (len(w) > one and not _SHORT.match(w[:-1]))):
        w = w[:-1]
    elif w.endswith("ll") and len(w) > two:
        w = w[:-1]
    return w.replace("Y", "y")
