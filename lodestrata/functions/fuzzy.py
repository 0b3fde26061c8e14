"""Similarity of short labels, 0 to 100: a pandas UDF over distinct pairs only.

The weighted score takes the best of a plain ratio of common subsequences, a token-sorted one, a
token-set one and, for texts of unlike lengths, partial ones at a discount.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _common(a: str, b: str) -> int:
    """Length of the longest common subsequence, by bit rows: a few machine words for a label."""
    where: dict[str, int] = {}
    for k, c in enumerate(a):
        where[c] = where.get(c, 0) | (1 << k)
    full = (1 << len(a)) - 1
    row = full
    for c in b:
        met = row & where.get(c, 0)
        row = ((row + met) | (row - met)) & full
    return len(a) - bin(row).count("1")


def ratio(a: str, b: str) -> float:
    return 200.0 * _common(a, b) / (len(a) + len(b)) if a or b else 100.0


def partial_ratio(a: str, b: str) -> float:
    """The best ratio of the shorter text with any window of its length in the longer."""
    short, long = sorted((a, b), key=len)
    if not short:
        return 0.0
    n = len(short)
    windows = {long[max(0, k) : k + n] for k in range(1 - n, len(long))}
    return max(ratio(short, w) for w in windows if w)


def weighted_ratio(a: str, b: str) -> float:
    if not a or not b:
        return 0.0
    wa, wb = sorted(a.split()), sorted(b.split())
    both, only_a, only_b = sorted(set(wa) & set(wb)), sorted(set(wa) - set(wb)), sorted(set(wb) - set(wa))
    core = " ".join(both)
    with_a, with_b = " ".join(both + only_a), " ".join(both + only_b)
    token_set = max(ratio(with_a, with_b), *((ratio(core, with_a), ratio(core, with_b)) if core else (0.0,)))
    if core and (not only_a or not only_b):
        token_set = 100.0
    best = max(ratio(a, b), 0.95 * max(ratio(" ".join(wa), " ".join(wb)), token_set))
    spread = max(len(a), len(b)) / min(len(a), len(b))
    if spread >= 1.5:
        scale = 0.6 if spread > 8 else 0.9
        best = max(ratio(a, b), scale * partial_ratio(a, b), 0.95 * scale * partial_ratio(" ".join(wa), " ".join(wb)))
    return best


@F.pandas_udf(T.DoubleType())
def fuzzy_score(left: pd.Series, right: pd.Series) -> pd.Series:
    """The weighted score; for labels of up to 6 characters no more than the plain ratio."""
    return pd.Series([None if a is None or b is None else min(weighted_ratio(a, b), ratio(a, b)) if len(b) <= 6 else weighted_ratio(a, b) for a, b in zip(left, right, strict=True)], dtype="float64")


@F.pandas_udf(T.DoubleType())
def plain_ratio(left: pd.Series, right: pd.Series) -> pd.Series:
    return pd.Series([None if a is None or b is None else ratio(a, b) for a, b in zip(left, right, strict=True)], dtype="float64")
