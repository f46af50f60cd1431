"""Porter's stemmer (1980), and its use on the distinct terms of a DataFrame."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Suffix tables of the published algorithm, steps 2 to 4.
STEP_2 = "ational:ate tional:tion enci:ence anci:ance izer:ize abli:able alli:al entli:ent eli:e ousli:ous ization:ize ation:ate ator:ate alism:al iveness:ive fulness:ful ousness:ous aliti:al iviti:ive biliti:ble"
STEP_3 = "icate:ic ative: alize:al iciti:ic ical:ic ful: ness:"
STEP_4 = "al ance ence er ic able ible ant ement ment ent ion ou ism ate iti ous ive ize"


def _rules(table: str) -> dict[str, list[tuple[str, str]]]:
    """suffix, replacement by the suffix's last letter, the longest first."""
    rules = sorted((r.partition(":")[::2] for r in table.split()), key=lambda r: -len(r[0]))
    return {c: [r for r in rules if r[0][-1] == c] for c in {r[0][-1] for r in rules}}


_STEP_2, _STEP_3, _STEP_4 = map(_rules, (STEP_2, STEP_3, STEP_4))
_KINDS = str.maketrans("abcdefghijklmnopqrstuvwxz", "vcccvcccvcccccvcccccvcccc")


def _kinds(w: str) -> str:
    """v and c for vowels and consonants: a y is a vowel after a consonant."""
    kinds = w.translate(_KINDS)
    while (at := kinds.find("y")) >= 0:
        kinds = kinds[:at] + ("v" if at and kinds[at - 1] == "c" else "c") + kinds[at + 1 :]
    return kinds


def _consonant(w: str, i: int) -> bool:
    return _kinds(w[: i + 1])[-1] == "c"


def _measure(w: str) -> int:
    """How often a consonant follows a vowel."""
    return _kinds(w).count("vc")


def _has_vowel(w: str) -> bool:
    return "v" in _kinds(w)


def _double(w: str) -> bool:
    return len(w) > 1 and w[-1] == w[-2] and _consonant(w, len(w) - 1)


def _cvc(w: str) -> bool:
    return w[-1:] not in "wxy" and _kinds(w)[-3:] == "cvc"


def _table(w: str, rules: dict[str, list[tuple[str, str]]], least: int) -> str:
    for suffix, to in rules.get(w[-1:], ()):
        if w.endswith(suffix):
            root = w[: len(w) - len(suffix)]
            return root + to if _measure(root) > least else w
    return w


def stem(w: str) -> str:
    """Stem of a lower-case word; words of other than a-z letters, or of fewer than three, are left."""
    if len(w) < 3 or not w.isascii() or not w.isalpha():
        return w
    if w.endswith("sses") or w.endswith("ies"):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    if w.endswith("eed"):
        w = w[:-1] if _measure(w[:-3]) > 0 else w
    else:
        for suffix in ("ed", "ing"):
            root = w[: len(w) - len(suffix)]
            if w.endswith(suffix) and _has_vowel(root):
                w = root
                if w.endswith(("at", "bl", "iz")):
                    w += "e"
                elif _double(w) and w[-1] not in "lsz":
                    w = w[:-1]
                elif _measure(w) == 1 and _cvc(w):
                    w += "e"
                break
    if w.endswith("y") and _has_vowel(w[:-1]):
        w = w[:-1] + "i"
    w = _table(_table(w, _STEP_2, 0), _STEP_3, 0)
    for suffix, _ in _STEP_4.get(w[-1:], ()):
        if w.endswith(suffix):
            root = w[: len(w) - len(suffix)]
            if _measure(root) > 1 and (suffix != "ion" or root.endswith(("s", "t"))):
                w = root
            break
    if w.endswith("e") and (_measure(w[:-1]) > 1 or _measure(w[:-1]) == 1 and not _cvc(w[:-1])):
        w = w[:-1]
    return w[:-1] if _measure(w) > 1 and _double(w) and w.endswith("l") else w


@F.pandas_udf(T.StringType())
def stem_udf(words: pd.Series) -> pd.Series:
    return words.map(stem, na_action="ignore")


def with_stems(df: DataFrame, term: str = "term", out: str = "stem") -> DataFrame:
    """Add stems; each distinct term goes through Python once."""
    stems = df.select(term).distinct().withColumn(out, stem_udf(term))
    return df.join(stems, term, "left")
