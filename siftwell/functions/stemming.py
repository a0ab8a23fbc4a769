"""The stemmer of Porter (1980), for tables of distinct words."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: The published rules of steps 2 to 4; a suffix goes, or is replaced, where enough of a word stands before it.
SECOND = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "abli": "able", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous",
    "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble",
}
THIRD = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
FOURTH = dict.fromkeys(["al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize"], "")


def _form(word: str) -> str:
    """c for a consonant, v for a vowel; y is a vowel after a consonant."""
    out = ""
    for x in word:
        out += "v" if x in "aeiou" or (x == "y" and out[-1:] == "c") else "c"
    return out


def _measure(word: str) -> int:
    """How often a consonant follows a vowel."""
    return len(re.findall("v+c", _form(word)))


def _short(word: str) -> bool:
    """Ends in consonant, vowel, consonant, the last not w, x or y."""
    return _form(word).endswith("cvc") and word[-1] not in "wxy"


def _double(word: str) -> bool:
    return len(word) > 1 and word[-1] == word[-2] and _form(word).endswith("c")


def _by_rules(word: str, rules: dict[str, str], least: int) -> str:
    """The longest suffix decides, whether or not enough stands before it."""
    for suffix in sorted(rules, key=len, reverse=True):
        if word.endswith(suffix):
            stem = word[: len(word) - len(suffix)]
            fits = _measure(stem) > least and (suffix != "ion" or stem.endswith(("s", "t")))
            return stem + rules[suffix] if fits else word
    return word


def _inflections(word: str) -> str:
    for suffix, new in (("sses", "ss"), ("ies", "i"), ("ss", "ss"), ("s", "")):
        if word.endswith(suffix):
            word = word[: len(word) - len(suffix)] + new
            break
    if word.endswith("eed"):
        word = word[:-1] if _measure(word[:-3]) > 0 else word
    else:
        cut = next((word[: -len(x)] for x in ("ed", "ing") if word.endswith(x)), None)
        if cut is not None and "v" in _form(cut):
            if cut.endswith(("at", "bl", "iz")):
                word = cut + "e"
            elif _double(cut) and cut[-1] not in "lsz":
                word = cut[:-1]
            else:
                word = cut + "e" if _measure(cut) == 1 and _short(cut) else cut
    return word[:-1] + "i" if word.endswith("y") and "v" in _form(word[:-1]) else word


def porter(word: str) -> str:
    """The stem of a lower-case word; words of one or two letters stay."""
    if len(word) <= 2:
        return word
    word = _by_rules(_by_rules(_by_rules(_inflections(word), SECOND, 0), THIRD, 0), FOURTH, 1)
    if word.endswith("e") and (_measure(word[:-1]) > 1 or _measure(word[:-1]) == 1 and not _short(word[:-1])):
        word = word[:-1]
    return word[:-1] if _measure(word) > 1 and word.endswith("ll") else word


def stems(words: Column) -> Column:
    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda w: None if w is None else porter(w))

    return run(words)
