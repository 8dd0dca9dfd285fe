"""Text analysis for full-text search: letter and digit runs, lower case, stop words, Porter stems."""

from __future__ import annotations

import functools
import re

import pandas as pd
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The usual English stop words.
STOP_WORDS = "a an and are as at be but by for if in into is it no not of on or such that the their then there these they this to was will with".split()
MAX_TOKEN = 64
#: A token, in texts and queries alike.
TOKEN = r"[\p{L}\p{Nd}]+"

# Suffix rules of Porter's stemmer (1980), longest match first; each is (suffix, replacement).
STEP2 = [("ational", "ate"), ("ization", "ize"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("tional", "tion"), ("biliti", "ble"), ("entli", "ent"), ("ousli", "ous"), ("ation", "ate"), ("alism", "al"), ("aliti", "al"), ("iviti", "ive"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("abli", "able"), ("alli", "al"), ("ator", "ate"), ("eli", "e")]
STEP3 = [("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ness", ""), ("ful", "")]
STEP4 = "ement ance ence able ible ment ant ent ism ate iti ous ive ize ion al er ic ou".split()


def _shape(word: str) -> str:
    """c and v for consonants and vowels; y is a vowel behind a consonant."""
    out = ""
    for i, ch in enumerate(word):
        out += "v" if ch in "aeiou" or ch == "y" and i > 0 and out[-1] == "c" else "c"
    return out


def _measure(stem: str) -> int:
    return len(re.findall("v+c+", _shape(stem)))


def _short(stem: str) -> bool:
    """Ends consonant, vowel, consonant, the last not w, x or y."""
    return _shape(stem).endswith("cvc") and stem[-1] not in "wxy"


@functools.lru_cache(maxsize=200_000)
def stem(word: str) -> str:
    """Porter's stem of a lower-case word; words of fewer than three letters, or with others than a to z, stay."""
    if len(word) < 3 or not re.fullmatch("[a-z]+", word):
        return word
    w = word
    if w.endswith("sses") or w.endswith("ies"):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    if w.endswith("eed"):
        w = w[:-1] if _measure(w[:-3]) > 0 else w
    else:
        cut = next((w[: -len(x)] for x in ("ed", "ing") if w.endswith(x)), None)
        if cut is not None and "v" in _shape(cut):
            if cut.endswith(("at", "bl", "iz")):
                w = cut + "e"
            elif len(cut) > 1 and cut[-1] == cut[-2] and _shape(cut)[-1] == "c" and cut[-1] not in "lsz":
                w = cut[:-1]
            else:
                w = cut + "e" if _measure(cut) == 1 and _short(cut) else cut
    if w.endswith("y") and "v" in _shape(w[:-1]):
        w = w[:-1] + "i"
    for rules in (STEP2, STEP3):
        for suffix, new in rules:
            if w.endswith(suffix):
                w = w[: -len(suffix)] + new if _measure(w[: -len(suffix)]) > 0 else w
                break
    for suffix in STEP4:
        if w.endswith(suffix):
            base = w[: -len(suffix)]
            if _measure(base) > 1 and (suffix != "ion" or base.endswith(("s", "t"))):
                w = base
            break
    if w.endswith("e") and (_measure(w[:-1]) > 1 or _measure(w[:-1]) == 1 and not _short(w[:-1])):
        w = w[:-1]
    return w[:-1] if w.endswith("ll") and _measure(w) > 1 else w


@F.pandas_udf(T.ArrayType(T.StringType()))
def stem_all(tokens: pd.Series) -> pd.Series:
    return tokens.map(lambda ts: None if ts is None else [stem(t) for t in ts])


def tokens(text: Column, stemmed: bool = True) -> Column:
    """array<string> of the tokens of a text; NULL gives an empty array."""
    runs = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(f"({TOKEN})"), 1)
    kept = F.filter(runs, lambda t: (F.length(t) <= MAX_TOKEN) & ~t.isin(*STOP_WORDS))
    return stem_all(kept) if stemmed else kept


def tokens_of(text: str, stemmed: bool = True) -> list[str]:
    """The same for one text on the driver (a query)."""
    runs = [t for t in regex.findall(TOKEN, text.lower()) if len(t) <= MAX_TOKEN and t not in STOP_WORDS]
    return [stem(t) for t in runs] if stemmed else runs
