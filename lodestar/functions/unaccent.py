"""Letters without their accents, by rules: what a query's words are brought to before they are looked up.

Most rules come from Unicode itself: a letter that decomposes into a letter and
marks stands for the letter. Letters that do not decompose (ligatures, letters
with a stroke) have rules of their own, some of several letters. A null text
stays null.
"""

from __future__ import annotations

import unicodedata
from functools import cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Letters and signs that do not decompose, and what stands for them.
RULES = {
    "Æ": "AE", "æ": "ae", "Ø": "O", "ø": "o", "ß": "ss", "ẞ": "SS", "Đ": "D", "đ": "d", "Ð": "D", "ð": "d", "Þ": "TH", "þ": "th",
    "Ħ": "H", "ħ": "h", "ı": "i", "ĸ": "q", "Ł": "L", "ł": "l", "Ŋ": "N", "ŋ": "n", "Œ": "OE", "œ": "oe", "Ŧ": "T", "ŧ": "t",
    "ƀ": "b", "Ɓ": "B", "Ƃ": "B", "ƃ": "b", "Ƈ": "C", "ƈ": "c", "Ɖ": "D", "Ɗ": "D", "Ƌ": "D", "ƌ": "d", "Ɛ": "E", "Ƒ": "F", "ƒ": "f", "Ɠ": "G",
    "ƕ": "hv", "Ɩ": "I", "Ɨ": "I", "Ƙ": "K", "ƙ": "k", "ƚ": "l", "Ɲ": "N", "ƞ": "n", "Ƥ": "P", "ƥ": "p", "ƫ": "t", "Ƭ": "T", "ƭ": "t", "Ʈ": "T",
    "Ʋ": "V", "Ƴ": "Y", "ƴ": "y", "Ƶ": "Z", "ƶ": "z", "Ǥ": "G", "ǥ": "g", "‘": "'", "’": "'", "“": '"', "”": '"', "«": "<<", "»": ">>", "–": "-", "—": "-",
    "…": "...", "¼": " 1/4", "½": " 1/2", "¾": " 3/4",
}


def _plain(letter: str) -> str:
    """What a letter stands for: Latin ones may be ligatures or of another width, of others only the marks go."""
    if letter in RULES:
        return RULES[letter]
    form = "NFKD" if "LATIN" in unicodedata.name(letter, "") else "NFD"
    return "".join(c for c in unicodedata.normalize(form, letter) if not unicodedata.combining(c))


@cache
def rules() -> dict[str, str]:
    """Every character below U+10000 that stands for something else; Hangul and what follows the surrogates but for forms of letters stay."""
    every = (chr(code) for code in range(0x80, 0x10000) if not (0xAC00 <= code <= 0xD7A3 or 0xD800 <= code <= 0xFAFF))
    return {letter: plain for letter in every if (plain := _plain(letter)) != letter}


def unaccent(text: str) -> str:
    return text if text.isascii() else text.translate(str.maketrans(rules()))


@cache
def _steps() -> tuple[dict[str, str], dict[str, str]]:
    """Rules of a letter or none, and of several."""
    return {a: b for a, b in rules().items() if len(b) < 2}, {a: b for a, b in rules().items() if len(b) > 1}


def _replaced(text: str | None) -> str | None:
    """Rules of one letter, then of several: a replacement for each letter with a rule that the text holds, few of some two thousand.

    A letter that stands for one with a rule (``Ǿ`` for ``Ø``) comes after that one.
    """
    if text is None or text.isascii():
        return text
    for step in _steps():
        for letter in sorted(step.keys() & set(text), key=lambda a: step[a] in rules()):
            text = text.replace(letter, step[letter])
    return text


def unaccented(text: Column) -> Column:
    """The same for a column, but that a ligature with an accent (``ǣ``) becomes its letters (``ae``)."""

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(_replaced)

    return run(text)
