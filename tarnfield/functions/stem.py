"""Stemmers by the published Snowball rules: English (Porter2) and German."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import lru_cache

# Fixed values of the English algorithm: whole words with a stem of their own, words left after step 1a, suffix tables.
WHOLE = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli",
    "early": "earli", "only": "onli", "singly": "singl", "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas",
    "cosmos": "cosmos", "bias": "bias", "andes": "andes",
}
LEFT = {"inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed"}
STEP2 = {
    "ization": "ize", "ational": "ate", "fulness": "ful", "ousness": "ous", "iveness": "ive", "tional": "tion", "biliti": "ble",
    "lessli": "less", "entli": "ent", "ation": "ate", "alism": "al", "aliti": "al", "ousli": "ous", "iviti": "ive", "fulli": "ful",
    "enci": "ence", "anci": "ance", "abli": "able", "izer": "ize", "ator": "ate", "alli": "al", "bli": "ble", "ogi": "og", "li": "",
}
STEP3 = {"ational": "ate", "tional": "tion", "alize": "al", "icate": "ic", "iciti": "ic", "ative": "", "ical": "ic", "ness": "", "ful": ""}
STEP4 = ("ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "ion", "al", "er", "ic")
DOUBLES = ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")

V = "aeiouy"
REGION = re.compile(f"[{V}][^{V}]")


def _region(word: str, start: int = 0, vowels: str = V) -> int:
    m = re.compile(f"[{vowels}][^{vowels}]").search(word, start)
    return m.end() if m else len(word)


def _short(word: str) -> bool:
    """Ends in a short syllable: consonant, vowel, consonant other than w, x, Y; or the word is a vowel and a consonant."""
    return bool(re.search(rf"[^{V}][{V}][^{V}wxY]$", word) or re.fullmatch(rf"[{V}][^{V}]", word))


def _longest(word: str, suffixes) -> str:
    return max((s for s in suffixes if word.endswith(s)), key=len, default="")


def english(word: str) -> str:
    if len(word) <= 2:
        return word
    if word in WHOLE:
        return WHOLE[word]
    w = re.sub(rf"(^|[{V}])y", r"\1Y", word.removeprefix("'"))
    r1 = next((len(p) for p in ("gener", "commun", "arsen") if w.startswith(p)), _region(w))
    r2 = _region(w, r1)
    w = w.removesuffix(_longest(w, ("'s'", "'s", "'")))
    if w.endswith("sses"):
        w = w[:-2]
    elif w.endswith(("ied", "ies")):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif w.endswith("s") and not w.endswith(("us", "ss")) and re.search(f"[{V}]", w[:-2]):
        w = w[:-1]
    if w in LEFT:
        return w
    if s := _longest(w, ("eed", "eedly", "ed", "edly", "ing", "ingly")):
        if s.startswith("eed"):
            w = w[: -len(s)] + "ee" if len(w) - len(s) >= r1 else w
        elif re.search(f"[{V}]", w[: -len(s)]):
            w = w[: -len(s)]
            if w.endswith(("at", "bl", "iz")):
                w += "e"
            elif w.endswith(DOUBLES):
                w = w[:-1]
            elif r1 >= len(w) and _short(w):
                w += "e"
    if len(w) > 2 and w[-1] in "yY" and w[-2] not in V:
        w = w[:-1] + "i"
    s = _longest(w, STEP2)
    if s and len(w) - len(s) >= r1 and (s != "ogi" or w[:-3].endswith("l")) and (s != "li" or w[-3:-2] in tuple("cdeghkmnrt")):
        w = w[: -len(s)] + STEP2[s]
    s = _longest(w, STEP3)
    if s and len(w) - len(s) >= (r2 if s == "ative" else r1):
        w = w[: -len(s)] + STEP3[s]
    s = _longest(w, STEP4)
    if s and len(w) - len(s) >= r2 and (s != "ion" or w[:-3].endswith(("s", "t"))):
        w = w[: -len(s)]
    if w.endswith("e") and (len(w) - 1 >= r2 or len(w) - 1 >= r1 and not _short(w[:-1])) or w.endswith("ll") and len(w) - 1 >= r2:
        w = w[:-1]
    return w.lower()


def german(word: str) -> str:
    vowels = "aeiouyäöü"
    w = word.replace("ß", "ss")
    w = re.sub(rf"(?<=[{vowels}])([uy])(?=[{vowels}])", lambda m: m[1].upper(), w)
    first = _region(w, 0, vowels)
    r1, r2 = max(3, first), _region(w, first, vowels)
    within = lambda s, r: bool(s) and len(w) - len(s) >= r
    s = _longest(w, ("em", "ern", "er", "e", "en", "es", "s"))
    if within(s, r1) and (s != "s" or w[-2:-1] in tuple("bdfghklmnrt")):
        w = w[: -len(s)]
        if s in ("e", "en", "es") and w.endswith("niss"):
            w = w[:-1]
    s = _longest(w, ("en", "er", "est", "st"))
    if within(s, r1) and (s != "st" or len(w) > 5 and w[-3] in "bdfghklmnt"):
        w = w[: -len(s)]
    s = _longest(w, ("end", "ung", "ig", "ik", "isch", "lich", "heit", "keit"))
    if within(s, r2):
        stem = w[: -len(s)]
        if s in ("end", "ung"):
            w = stem
            if w.endswith("ig") and len(w) - 2 >= r2 and not w.endswith("eig"):
                w = w[:-2]
        elif s in ("ig", "ik", "isch"):
            w = w if stem.endswith("e") else stem
        elif s in ("lich", "heit"):
            w = stem
            if w.endswith(("er", "en")) and len(w) - 2 >= r1:
                w = w[:-2]
        else:
            w = stem
            t = _longest(w, ("lich", "ig"))
            if t and len(w) - len(t) >= r2:
                w = w[: -len(t)]
    return w.lower().translate(str.maketrans("äöü", "aou"))


STEMMERS: dict[str, Callable[[str], str]] = {"english": lru_cache(1 << 16)(english), "german": lru_cache(1 << 16)(german)}
#: Languages that a policy may name; those without a stemmer above are refused when the policy is read.
LANGUAGES = ("arabic", "danish", "dutch", "english", "finnish", "french", "german", "greek", "hungarian", "italian", "norwegian", "portuguese", "romanian", "russian", "spanish", "swedish", "tamil", "turkish")
