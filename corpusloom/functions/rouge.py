"""ROUGE-L text scoring: word pieces, Porter stems and longest common subsequence.

Tokens are ASCII letters and digits of the lower-cased text. Stemming follows the public
Porter algorithm with the common extensions for short and irregular words.
"""

from __future__ import annotations

import re
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values: suffix tables and irregular words of the published stemmer ----------
IRREGULAR = {
    "skies": "sky", "sky": "sky", "dying": "die", "lying": "lie", "tying": "tie", "news": "news",
    "innings": "inning", "inning": "inning", "outings": "outing", "outing": "outing",
    "cannings": "canning", "canning": "canning", "howe": "howe",
    "proceed": "proceed", "exceed": "exceed", "succeed": "succeed",
}
STEP_2 = (
    ("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"),
    ("bli", "ble"), ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"),
    ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"),
    ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"),
    ("fulli", "ful"),
)
STEP_3 = (("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", ""))
STEP_4 = (
    "al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou",
    "ism", "ate", "iti", "ous", "ive", "ize",
)
# --------------------------------------------------------------------------------------

_WORD = re.compile(r"[a-z0-9]+")


def _shape(word: str) -> str:
    """Consonant/vowel pattern: ``y`` after a consonant counts as a vowel."""
    out = ""
    for i, ch in enumerate(word):
        vowel = ch in "aeiou" or (ch == "y" and i > 0 and out[-1] == "c")
        out += "v" if vowel else "c"
    return out


def _measure(stem: str) -> int:
    return _shape(stem).count("vc")


def _short_end(word: str) -> bool:
    shape = _shape(word)
    if len(word) == 2:
        return shape == "vc"
    return shape[-3:] == "cvc" and word[-1] not in "wxy"


def _swap(word: str, rules, least: int) -> str:
    """Apply the first rule whose suffix fits, if the stem measures more than ``least``."""
    for suffix, new in rules:
        if word.endswith(suffix):
            stem = word[: len(word) - len(suffix)]
            return stem + new if _measure(stem) > least else word
    return word


def _plural(w: str) -> str:
    if w.endswith("ies"):
        return w[:-1] if len(w) == 4 else w[:-2]
    if w.endswith("sses"):
        return w[:-2]
    return w[:-1] if w.endswith("s") and not w.endswith("ss") else w


def _past(w: str) -> str:
    if w.endswith("ied"):
        return w[:-1] if len(w) == 4 else w[:-2]
    if w.endswith("eed"):
        return w[:-1] if _measure(w[:-3]) > 0 else w
    for suffix in ("ed", "ing"):
        stem = w[: -len(suffix)]
        if w.endswith(suffix) and "v" in _shape(stem):
            break
    else:
        return w
    if stem.endswith(("at", "bl", "iz")):
        return stem + "e"
    if len(stem) > 1 and stem[-1] == stem[-2] and _shape(stem)[-1] == "c":
        return stem if stem[-1] in "lsz" else stem[:-1]
    return stem + "e" if _measure(stem) == 1 and _short_end(stem) else stem


def _second(w: str) -> str:
    if w.endswith("alli") and _measure(w[:-4]) > 0:
        return _second(w[:-2])
    if w.endswith("logi"):
        return w[:-1] if _measure(w[:-3]) > 0 else w
    return _swap(w, STEP_2, 0)


def _fourth(w: str) -> str:
    for suffix in STEP_4:
        if w.endswith(suffix):
            stem = w[: len(w) - len(suffix)]
            fits = _measure(stem) > 1 and (suffix != "ion" or stem[-1:] in ("s", "t"))
            return stem if fits else w
    return w


def _final(w: str) -> str:
    if w.endswith("e"):
        stem = w[:-1]
        m = _measure(stem)
        if m > 1 or (m == 1 and not _short_end(stem)):
            w = stem
    return w[:-1] if w.endswith("ll") and _measure(w[:-1]) > 1 else w


@lru_cache(maxsize=1 << 17)
def porter_stem(word: str) -> str:
    if word in IRREGULAR:
        return IRREGULAR[word]
    if len(word) <= 2:
        return word
    w = _past(_plural(word))
    if w.endswith("y") and len(w) > 2 and _shape(w)[-2] == "c":
        w = w[:-1] + "i"
    return _final(_fourth(_swap(_second(w), STEP_3, 0)))


def word_pieces(text: str, stem: bool) -> list[str]:
    found = _WORD.findall(text.lower())
    return [porter_stem(t) if len(t) > 3 else t for t in found] if stem else found


def lcs_length(a: list[str], b: list[str]) -> int:
    """Longest common subsequence by bit-parallel rows: one big-integer step per word of ``b``."""
    where: dict[str, int] = {}
    for i, token in enumerate(a):
        where[token] = where.get(token, 0) | (1 << i)
    full = (1 << len(a)) - 1
    row = full
    for token in b:
        hit = row & where.get(token, 0)
        if hit:
            row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


def rouge_f(prediction: str, reference: str, stem: bool = True) -> float:
    p, r = word_pieces(prediction, stem), word_pieces(reference, stem)
    if not p or not r:
        return 0.0
    return f_measure(len(p) if p == r else lcs_length(p, r), len(p), len(r))


def f_measure(common: int, predicted: int, referred: int) -> float:
    """F measure of so many common words of texts of these lengths."""
    if common == 0:
        return 0.0
    precision, recall = common / predicted, common / referred
    return 2 * precision * recall / (precision + recall)


def rouge_l(prediction: Column, reference: Column, stem: bool = True) -> Column:
    """ROUGE-L F measure of each pair; null when either text is null."""

    @F.pandas_udf("double")
    def run(p: pd.Series, r: pd.Series) -> pd.Series:
        return pd.Series(
            [None if a is None or b is None else rouge_f(a, b, stem) for a, b in zip(p, r)], index=p.index, dtype=float
        )

    return run(prediction, reference)
