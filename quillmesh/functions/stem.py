"""Porter's stemmer, by its published rules, as a column expression in Arrow batches."""

from __future__ import annotations

import re
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# The rules of the published algorithm, as suffix and what takes its place.
_SECOND = dict(x.split(":") for x in "ational:ate tional:tion enci:ence anci:ance izer:ize bli:ble alli:al entli:ent eli:e ousli:ous ization:ize ation:ate ator:ate alism:al iveness:ive fulness:ful ousness:ous aliti:al iviti:ive biliti:ble logi:log".split())
_THIRD = dict(x.split(":") for x in "icate:ic ative: alize:al iciti:ic ical:ic ful: ness:".split())
_FOURTH = "al ance ence er ic able ible ant ement ment ent ion ou ism ate iti ous ive ize".split()
#: Lengths of words that have a stem.
SHORTEST, LONGEST = 3, 64
_RUNS = re.compile("v+c+")


def _shape(word: str) -> str:
    """c for each consonant, v for each vowel; y is a vowel after a consonant."""
    out = ""
    for k, ch in enumerate(word):
        out += "v" if ch in "aeiou" or (ch == "y" and k and out[-1] == "c") else "c"
    return out


def _measure(stem: str) -> int:
    return len(_RUNS.findall(_shape(stem)))


def _closed(stem: str) -> bool:
    """Ends consonant, vowel, consonant, the last not w, x or y."""
    return _shape(stem).endswith("cvc") and stem[-1] not in "wxy"


def _doubled(stem: str) -> bool:
    return len(stem) > 1 and stem[-1] == stem[-2] and _shape(stem)[-1] == "c"


def _longest(word: str, suffixes) -> str:
    return max((s for s in suffixes if word.endswith(s)), key=len, default="")


def _replaced(word: str, rules: dict[str, str]) -> str:
    suffix = _longest(word, rules)
    base = word[: len(word) - len(suffix)]
    return base + rules[suffix] if suffix and _measure(base) > 0 else word


def _plural(word: str) -> str:
    for suffix, keep in (("sses", 2), ("ies", 1), ("ss", 2)):
        if word.endswith(suffix):
            return word[: len(word) - len(suffix) + keep]
    return word.removesuffix("s")


def _past(word: str) -> str:
    if word.endswith("eed"):
        return word[:-1] if _measure(word[:-3]) > 0 else word
    suffix = _longest(word, ("ed", "ing"))
    base = word[: len(word) - len(suffix)]
    if not suffix or "v" not in _shape(base):
        return word
    if base.endswith(("at", "bl", "iz")) or (_measure(base) == 1 and _closed(base) and not _doubled(base)):
        return base + "e"
    return base[:-1] if _doubled(base) and base[-1] not in "lsz" else base


def _residual(word: str) -> str:
    suffix = _longest(word, _FOURTH)
    base = word[: len(word) - len(suffix)]
    if not suffix or _measure(base) < 2 or (suffix == "ion" and not base.endswith(("s", "t"))):
        return word
    return base


def _final(word: str) -> str:
    if word.endswith("e"):
        m = _measure(word[:-1])
        if m > 1 or (m == 1 and not _closed(word[:-1])):
            word = word[:-1]
    return word[:-1] if word.endswith("ll") and _measure(word) > 1 else word


@lru_cache(maxsize=200_000)
def stem(word: str) -> str:
    if not SHORTEST <= len(word) <= LONGEST or not word.isascii() or not word.isalpha():
        return word
    word = _past(_plural(word))
    if word.endswith("y") and "v" in _shape(word[:-1]):
        word = word[:-1] + "i"
    return _final(_residual(_replaced(_replaced(word, _SECOND), _THIRD)))


def _stems(words: pd.Series) -> pd.Series:
    return words.map(lambda own: None if own is None else [stem(w) for w in own])


def stems(words: Column) -> Column:
    """The stems of an array of words in small letters, in order."""
    return F.pandas_udf(_stems, "array<string>")(words)
