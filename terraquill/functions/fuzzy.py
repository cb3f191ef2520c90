"""Fuzzy name scores, 0 to 100.

A score compares two short names; tables of names are compared by ``operators.matching``, which brings only distinct pairs
of a block here. ``levenshtein_score`` stays in the JVM; the others run as Arrow UDFs.
"""

from __future__ import annotations

import re
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def clean(text: str) -> str:
    """Lower case; all but letters and digits becomes a space."""
    return re.sub(r"[\W_]+", " ", text.lower()).strip()


def _common(a: str, b: str) -> int:
    """Length of the longest common subsequence, bit-parallel."""
    masks: dict[str, int] = {}
    for k, ch in enumerate(a):
        masks[ch] = masks.get(ch, 0) | 1 << k
    full = (1 << len(a)) - 1
    v = full
    for ch in b:
        hit = v & masks.get(ch, 0)
        v = ((v + hit) | (v - hit)) & full
    return len(a) - v.bit_count()


def ratio(a: str, b: str) -> float:
    """Indel similarity: 200 * common subsequence / total length."""
    return 200.0 * _common(a, b) / (len(a) + len(b)) if a or b else 100.0


def partial_ratio(a: str, b: str) -> float:
    """The best ratio of the shorter name with any stretch of the longer one of its length, or shorter at the ends."""
    if len(a) > len(b):
        a, b = b, a
    if not a:
        return 100.0 if not b else 0.0
    m = len(a)
    return max(ratio(a, b[max(0, k) : k + m]) for k in range(1 - m, len(b)))


def _sorted_tokens(text: str) -> str:
    return " ".join(sorted(clean(text).split()))


def token_sort_ratio(a: str, b: str) -> float:
    return ratio(_sorted_tokens(a), _sorted_tokens(b))


def _token_set(a: str, b: str, score) -> float:
    x, y = set(clean(a).split()), set(clean(b).split())
    if not x or not y:
        return 0.0
    both, only_x, only_y = " ".join(sorted(x & y)), " ".join(sorted(x - y)), " ".join(sorted(y - x))
    full_x, full_y = f"{both} {only_x}".strip(), f"{both} {only_y}".strip()
    return max(score(both, full_x) if both else 0.0, score(both, full_y) if both else 0.0, score(full_x, full_y))


def token_set_ratio(a: str, b: str) -> float:
    return _token_set(a, b, ratio)


def weighted_ratio(a: str, b: str) -> float:
    """The best of the plain, partial and token scores, the latter weighted by how unlike the lengths are."""
    a, b = clean(a), clean(b)
    if not a or not b:
        return 0.0
    longer = max(len(a), len(b)) / min(len(a), len(b))
    base = ratio(a, b)
    if longer < 1.5:
        return max(base, 0.95 * token_sort_ratio(a, b), 0.95 * token_set_ratio(a, b))
    weight = 0.6 if longer > 8 else 0.9
    tokens = max(partial_ratio(_sorted_tokens(a), _sorted_tokens(b)), _token_set(a, b, partial_ratio))
    return max(base, weight * partial_ratio(a, b), 0.95 * weight * tokens)


SCORES = {f.__name__: f for f in (ratio, partial_ratio, token_sort_ratio, token_set_ratio, weighted_ratio)}


def sorted_tokens(name: Column) -> Column:
    """The words that ``token_sort_ratio`` compares."""
    @F.pandas_udf("string")
    def words(x: pd.Series) -> pd.Series:
        return x.map(_sorted_tokens, na_action="ignore")

    return words(name)


def score(name: str, a: Column, b: Column) -> Column:
    """A score of two columns as a rounded number; null if either is null."""
    @F.pandas_udf("double")
    def scores(x: pd.Series, y: pd.Series) -> pd.Series:
        one = lru_cache(maxsize=100_000)(SCORES[name])
        return pd.Series([None if p is None or q is None else float(round(one(p, q))) for p, q in zip(x, y)], dtype="float64")

    return scores(a, b)


def levenshtein_score(a: Column, b: Column) -> Column:
    """100 * (1 - edits / longer length), without leaving the JVM."""
    longer = F.greatest(F.length(a), F.length(b))
    return F.when(longer == 0, 100.0).otherwise(100.0 * (1 - F.levenshtein(a, b) / longer))


def best_match(name: str, options: list[str], cutoff: float, scorer: str = "weighted_ratio") -> str | None:
    """Of a short list (column names, say), the first with the highest score that reaches the cutoff."""
    best = max(((SCORES[scorer](name, o), -k, o) for k, o in enumerate(options)), default=None)
    return best[2] if best and round(best[0]) >= cutoff else None
