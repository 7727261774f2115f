"""English word stems for full-text search, by the published steps of the Snowball English stemmer (Porter2).

Words are runs of letters and digits of any script, in lower case, accents kept; a letter outside a-z is no vowel.
"""

from __future__ import annotations

import functools
import re

# Stop words of English search.
STOP = set(
    "i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its itself they them their theirs themselves what which who "
    "whom this that these those am is are was were be been being have has had having do does did doing a an the and but if or because as until while of at by for with about against "
    "between into through during before after above below to from up down in out on off over under again further then once here there when where why how all any both each few more "
    "most other some such no nor not only own same so than too very s t can will just don should now".split()
)
# Words with stems of their own, words that stay once a plural is gone, and beginnings after which the first region starts.
IRREGULAR = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl",
    "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas", "cosmos": "cosmos", "bias": "bias", "andes": "andes",
}
WHOLE = set("inning outing canning herring earring proceed exceed succeed".split())
BEGINNINGS = ("gener", "commun", "arsen")
# Endings and what takes their place, by step.
DERIVED = {
    "tional": "tion", "enci": "ence", "anci": "ance", "abli": "able", "entli": "ent", "izer": "ize", "ization": "ize", "ational": "ate", "ation": "ate", "ator": "ate",
    "alism": "al", "aliti": "al", "alli": "al", "fulness": "ful", "ousli": "ous", "ousness": "ous", "iveness": "ive", "iviti": "ive", "biliti": "ble", "bli": "ble",
    "ogi": "og", "fulli": "ful", "lessli": "less", "li": "",
}
REDUCED = {"tional": "tion", "ational": "ate", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": "", "ative": ""}
REMOVED = "al ance ence er ic able ible ant ement ment ent ism ate iti ous ive ize ion".split()
BEFORE_LI, DOUBLES = "cdeghkmnrt", ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")

# y between consonants is a vowel; one that isn't is written Y
_SHORT = re.compile(r"(?:[^aeiouy][aeiouy][^aeiouywxY]|^[aeiouy][^aeiouy])\Z")
_REGION = re.compile(r"[aeiouy][^aeiouy]")
_VOWEL = re.compile(r"[aeiouy]")


def _ending(word: str, endings) -> str:
    """The longest of the endings that the word has; empty for none."""
    return max((e for e in endings if word.endswith(e)), key=len, default="")


def _regions(word: str) -> tuple[int, int]:
    """Where the first and the second region begin: each after a vowel and a consonant."""
    named = next((len(b) for b in BEGINNINGS if word.startswith(b)), 0)
    found = _REGION.search(word)
    first = named or (found.end() if found else len(word))
    found = _REGION.search(word, first)
    return first, found.end() if found else len(word)


def _plural(word: str) -> str:
    end = _ending(word, ("sses", "ied", "ies", "us", "ss", "s"))
    if end == "sses":
        return word[:-2]
    if end in ("ied", "ies"):
        return word[:-2] if len(word) > 4 else word[:-1]
    return word[:-1] if end == "s" and _VOWEL.search(word[:-2]) else word


def _inflected(word: str, first: int) -> str:
    end = _ending(word, ("eed", "eedly", "ed", "edly", "ing", "ingly"))
    body = word[: len(word) - len(end)]
    if end in ("eed", "eedly"):
        return body + "ee" if len(body) >= first else word
    if not end or not _VOWEL.search(body):
        return word
    if body.endswith(("at", "bl", "iz")):
        return body + "e"
    if body.endswith(DOUBLES):
        return body[:-1]
    return body + "e" if len(body) <= first and _SHORT.search(body) else body


@functools.lru_cache(1 << 16)
def stem(word: str) -> str:
    """The stem of a word in lower case."""
    if len(word) < 3:
        return word
    if word in IRREGULAR:
        return IRREGULAR[word]
    word = re.sub(r"([aeiouy])y", r"\1Y", re.sub(r"\Ay", "Y", word))
    first, second = _regions(word)
    word = _plural(word)
    if word in WHOLE:
        return word
    word = _inflected(word, first)
    if word[-1] in "yY" and len(word) > 2 and word[-2] not in "aeiouy":
        word = word[:-1] + "i"

    end = _ending(word, DERIVED)
    at = len(word) - len(end)
    if end and at >= first and not (end == "ogi" and word[at - 1] != "l") and not (end == "li" and word[at - 1] not in BEFORE_LI):
        word = word[:at] + DERIVED[end]
    end = _ending(word, REDUCED)
    at = len(word) - len(end)
    if end and at >= (second if end == "ative" else first):
        word = word[:at] + REDUCED[end]
    end = _ending(word, REMOVED)
    at = len(word) - len(end)
    if end and at >= second and not (end == "ion" and word[at - 1] not in "st"):
        word = word[:at]

    at = len(word) - 1
    if word.endswith("e") and (at >= second or at >= first and not _SHORT.search(word[:-1])) or word.endswith("ll") and at >= second:
        word = word[:-1]
    return word.replace("Y", "y")


def words(text: str | None) -> list[str]:
    """A text's words without stop words, in order."""
    return [w for w in re.findall(r"[^\W_]+", (text or "").lower()) if w not in STOP]


def lexemes(text: str | None) -> list[str]:
    """Stems of a text's words without stop words, in order."""
    return [stem(w) for w in words(text)]
