"""Porter's stemmer (1980), run once for each distinct term."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F

# The suffixes of steps 2, 3 and 4 of the published algorithm.
_STEP2 = (
    ("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("abli", "able"), ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"),
    ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"),
)
_STEP3 = (("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", ""))
_STEP4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize")
_WORD = re.compile("[a-z]{3,64}")


def _shape(word: str) -> str:
    """v for a vowel, c for a consonant; y is a vowel after a consonant."""
    out = ""
    for c in word:
        out += "v" if c in "aeiou" or (c == "y" and out.endswith("c")) else "c"
    return out


def _measure(stem: str) -> int:
    return len(re.findall("v+c", _shape(stem)))


def _short(stem: str) -> bool:
    """Ends in consonant, vowel, consonant, of which the last is not w, x or y."""
    return _shape(stem).endswith("cvc") and stem[-1] not in "wxy"


def _longest(word: str, rules) -> tuple[str, str] | None:
    """The stem before the longest suffix that the word ends in, and what comes in its place."""
    found = max((r for r in rules if word.endswith(r[0])), key=lambda r: len(r[0]), default=None)
    return (word[: -len(found[0])], found[1]) if found else None


def stem(word: str) -> str:
    """The stem of a folded term; anything but 3 to 64 letters a-z is its own."""
    if not _WORD.fullmatch(word):
        return word
    if word.endswith(("sses", "ies")):
        word = word[:-2]
    elif word.endswith("s") and not word.endswith("ss"):
        word = word[:-1]
    if word.endswith("eed"):
        word = word[:-1] if _measure(word[:-3]) > 0 else word
    elif (cut := re.fullmatch("(.*?)(?:ed|ing)", word)) and "v" in _shape(cut[1]):
        word = cut[1]
        if word.endswith(("at", "bl", "iz")):
            word += "e"
        elif _shape(word).endswith("cc") and word[-1:] == word[-2:-1] and word[-1] not in "lsz":
            word = word[:-1]
        elif _measure(word) == 1 and _short(word):
            word += "e"
    if word.endswith("y") and "v" in _shape(word[:-1]):
        word = word[:-1] + "i"
    for rules in (_STEP2, _STEP3):
        if (found := _longest(word, rules)) and _measure(found[0]) > 0:
            word = "".join(found)
    if (found := _longest(word, [(s, "") for s in _STEP4])) and _measure(found[0]) > 1 and (not word.endswith("ion") or found[0][-1:] in ("s", "t")):
        word = found[0]
    if word.endswith("e") and (_measure(word[:-1]) > 1 or (_measure(word[:-1]) == 1 and not _short(word[:-1]))):
        word = word[:-1]
    if word.endswith("ll") and _measure(word) > 1:
        word = word[:-1]
    return word


def stems(terms: DataFrame) -> DataFrame:
    """(term, stem) of the distinct terms of a table with a column term; null terms have none."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            yield pd.DataFrame({"term": rows["term"], "stem": rows["term"].map(stem)})

    return terms.select("term").where("term is not null").distinct().mapInPandas(work, "term string, stem string")


def stemmed(rows: DataFrame, table: DataFrame) -> DataFrame:
    """The rows with each term in its stem's place. table: stems of all their terms. Counts of terms that become one are
    for the caller to add up; see ranking.stem_postings."""
    return rows.join(table, "term").withColumn("term", F.col("stem")).drop("stem")
