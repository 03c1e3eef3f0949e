"""The English (Porter2) stemmer, applied to distinct words only.

Follows the published description of the algorithm at snowballstem.org. Spark
has no stemmer; a pandas UDF over the vocabulary is the one Python step of
full-text indexing, so its cost follows the number of distinct words.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_V = "aeiouy"
# Words with their stems, and words that stay as they are.
_SPECIAL = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl",
    "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl",
}
_SAME = frozenset("sky news howe atlas cosmos bias andes".split())
_SAME_AFTER_1A = frozenset("inning outing canning herring earring proceed exceed succeed".split())
# Suffixes of step 2 and 3 with their replacements.
_STEP2 = (
    ("ational", "ate"), ("fulness", "ful"), ("iveness", "ive"), ("ization", "ize"), ("ousness", "ous"), ("biliti", "ble"),
    ("lessli", "less"), ("tional", "tion"), ("alism", "al"), ("aliti", "al"), ("ation", "ate"), ("entli", "ent"), ("fulli", "ful"),
    ("iviti", "ive"), ("ousli", "ous"), ("abli", "able"), ("alli", "al"), ("anci", "ance"), ("ator", "ate"), ("enci", "ence"),
    ("izer", "ize"), ("bli", "ble"), ("ogi", "og"), ("li", ""),
)
_STEP3 = (
    ("ational", "ate"), ("tional", "tion"), ("alize", "al"), ("icate", "ic"), ("iciti", "ic"), ("ative", ""), ("ical", "ic"), ("ness", ""), ("ful", ""),
)
_STEP4 = ("ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "ion", "al", "er", "ic")


def _region(word: str, start: int = 0) -> int:
    """Where the part after the first consonant that follows a vowel begins."""
    for i in range(start + 1, len(word)):
        if word[i] not in _V and word[i - 1] in _V:
            return i + 1
    return len(word)


def _short_end(word: str) -> bool:
    if len(word) == 2:
        return word[0] in _V and word[1] not in _V
    return len(word) > 2 and word[-3] not in _V and word[-2] in _V and word[-1] not in _V and word[-1] not in "wxY"


def stem(word: str) -> str:
    if len(word) <= 2 or not re.fullmatch("[a-z']+", word):
        return word
    if word in _SPECIAL:
        return _SPECIAL[word]
    if word in _SAME:
        return word
    w = word.removeprefix("'")
    w = re.sub(r"^y|(?<=[aeiouy])y", "Y", w)
    prefix = next((p for p in ("gener", "commun", "arsen") if w.startswith(p)), None)
    r1 = len(prefix) if prefix else _region(w)
    r2 = _region(w, r1)
    for s in ("'s'", "'s", "'"):
        if w.endswith(s):
            w = w[: -len(s)]
            break
    # 1a
    if w.endswith("sses"):
        w = w[:-2]
    elif w.endswith(("ied", "ies")):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif w.endswith("s") and not w.endswith(("us", "ss")) and any(c in _V for c in w[:-2]):
        w = w[:-1]
    if w in _SAME_AFTER_1A:
        return w
    # 1b
    for s in ("eedly", "ingly", "edly", "eed", "ing", "ed"):
        if w.endswith(s):
            head = w[: -len(s)]
            if s in ("eed", "eedly"):
                w = head + "ee" if len(head) >= r1 else w
            elif any(c in _V for c in head):
                w = head
                if w.endswith(("at", "bl", "iz")):
                    w += "e"
                elif re.search(r"(bb|dd|ff|gg|mm|nn|pp|rr|tt)$", w):
                    w = w[:-1]
                elif _short_end(w) and r1 >= len(w):
                    w += "e"
            break
    # 1c
    if len(w) > 2 and w[-1] in "yY" and w[-2] not in _V:
        w = w[:-1] + "i"
    # 2
    for s, to in _STEP2:
        if w.endswith(s):
            head = w[: -len(s)]
            if len(head) >= r1 and not (s == "ogi" and not head.endswith("l")) and not (s == "li" and head[-1:] not in tuple("cdeghkmnrt")):
                w = head + to
            break
    # 3
    for s, to in _STEP3:
        if w.endswith(s):
            head = w[: -len(s)]
            if len(head) >= (r2 if s == "ative" else r1):
                w = head + to
            break
    # 4
    for s in _STEP4:
        if w.endswith(s):
            head = w[: -len(s)]
            if len(head) >= r2 and not (s == "ion" and head[-1:] not in ("s", "t")):
                w = head
            break
    # 5
    if w.endswith("e") and (len(w) - 1 >= r2 or len(w) - 1 >= r1 and not _short_end(w[:-1])):
        w = w[:-1]
    elif w.endswith("ll") and len(w) - 1 >= r2:
        w = w[:-1]
    return w.replace("Y", "y")


def stem_column(words: Column) -> Column:
    """Stems of words; null stays null."""

    @F.pandas_udf("string")  # made at the call: its type needs a session
    def run(series: pd.Series) -> pd.Series:
        return series.map(lambda w: None if w is None else stem(w))

    return run(words)
