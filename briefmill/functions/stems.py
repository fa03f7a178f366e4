"""English word stems by the published second Porter algorithm, and the words that searches leave out."""

from __future__ import annotations

import functools
import re

# Stopwords and the algorithm's lists of suffixes and exceptions.
STOPWORDS = "a an and are as at be but by for if in into is it no not of on or such that the their then there these they this to was will with".split()
_SPECIAL = {"skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl"} | {w: w for w in ("sky", "news", "howe", "atlas", "cosmos", "bias", "andes")}
_AFTER_1A = {"inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed"}
_STEP2 = {"ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "abli": "able", "entli": "ent", "izer": "ize", "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "aliti": "al", "alli": "al", "fulness": "ful", "ousli": "ous", "ousness": "ous", "iveness": "ive", "iviti": "ive", "biliti": "ble", "bli": "ble", "ogi": "og", "fulli": "ful", "lessli": "less", "li": ""}
_STEP3 = {"ational": "ate", "tional": "tion", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": "", "ative": ""}
_STEP4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "ion")
_DOUBLE = ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")

_V = "[aeiouy]"
_REGION = re.compile(f"{_V}[^aeiouy]")


def _regions(word: str) -> tuple[int, int]:
    """Where the parts after the first and the second vowel with a consonant behind it begin."""
    head = re.match("gener|commun|arsen", word)
    first = head.end() if head else (m.end() if (m := _REGION.search(word)) else len(word))
    return first, (m.end() if (m := _REGION.search(word, first)) else len(word))


def _short_end(word: str) -> bool:
    """Whether a word ends in a short syllable."""
    return bool(re.search(r"[^aeiouy][aeiouy][^aeiouywxY]\Z|\A[aeiouy][^aeiouy]\Z", word))


def _longest(word: str, suffixes) -> str:
    return max((s for s in suffixes if word.endswith(s)), key=len, default="")


@functools.lru_cache(1 << 16)
def stem(word: str) -> str:
    """The stem of a lower-case word of a-z and digits."""
    if len(word) < 3:
        return word
    if word in _SPECIAL:
        return _SPECIAL[word]
    word = re.sub(r"\Ay|(?<=[aeiouy])y", "Y", word)  # a consonant y
    r1, r2 = _regions(word)
    # plurals
    if word.endswith("sses"):
        word = word[:-2]
    elif word.endswith(("ied", "ies")):
        word = word[: -2 if len(word) > 4 else -1]
    elif word.endswith("s") and not word.endswith(("us", "ss")) and re.search(_V, word[:-2]):
        word = word[:-1]
    if word.lower() in _AFTER_1A:
        return word.lower()
    # -eed, -ed, -ing and their adverbs
    end = _longest(word, ("eed", "eedly", "ed", "edly", "ing", "ingly"))
    if end in ("eed", "eedly"):
        if len(word) - len(end) >= r1:
            word = word[: -len(end)] + "ee"
    elif end and re.search(_V, word[: -len(end)]):
        word = word[: -len(end)]
        if word.endswith(("at", "bl", "iz")):
            word += "e"
        elif word.endswith(_DOUBLE):
            word = word[:-1]
        elif r1 >= len(word) and _short_end(word):
            word += "e"
    if len(word) > 2 and word[-1] in "yY" and word[-2] not in "aeiouy":
        word = word[:-1] + "i"
    # derivations
    end = _longest(word, _STEP2)
    if end and len(word) - len(end) >= r1:
        before = word[: -len(end)]
        if end == "ogi":
            word = before + "og" if before.endswith("l") else word
        elif end == "li":
            word = before if before[-1:] and before[-1] in "cdeghkmnrt" else word
        else:
            word = before + _STEP2[end]
    end = _longest(word, _STEP3)
    if end and len(word) - len(end) >= (r2 if end == "ative" else r1):
        word = word[: -len(end)] + _STEP3[end]
    end = _longest(word, _STEP4)
    if end and len(word) - len(end) >= r2 and (end != "ion" or word[-4:-3] in ("s", "t")):
        word = word[: -len(end)]
    # a last e or l
    if word.endswith("e"):
        if len(word) > r2 or (len(word) > r1 and not _short_end(word[:-1])):
            word = word[:-1]
    elif word.endswith("ll") and len(word) > r2:
        word = word[:-1]
    return word.lower()
