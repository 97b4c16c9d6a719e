"""Gated token-set similarity of titles."""

from __future__ import annotations

from collections.abc import Sequence
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .registry import LEAST_SHARED_CHARS, LEAST_SHARED_TOKENS


def common_length(a: Sequence, b: Sequence) -> int:
    """The length of the longest common subsequence, bit-parallel."""
    masks: dict = {}
    for i, c in enumerate(a):
        masks[c] = masks.get(c, 0) | 1 << i
    s = full = (1 << len(a)) - 1
    for c in b:
        u = s & masks.get(c, 0)
        s = (s + u | s - u) & full
    return (full & ~s).bit_count()


def indel_ratio(a: str, b: str) -> float:
    """100 less the share of letters put in or taken out between two texts."""
    n = len(a) + len(b)
    return 200.0 * common_length(a, b) / n if n else 100.0


def token_set_ratio(a: str, b: str) -> float:
    """The best ratio among the shared tokens and both texts' tokens with the shared ones first; 100 if one's tokens are all in the other."""
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    shared, only_x, only_y = " ".join(sorted(x & y)), " ".join(sorted(x - y)), " ".join(sorted(y - x))
    if shared and (not only_x or not only_y):
        return 100.0
    join = lambda rest: f"{shared} {rest}" if shared and rest else shared or rest
    left, right = join(only_x), join(only_y)
    # the common beginning counts as it stands; only the rests are aligned
    head = len(shared) + (1 if shared else 0)
    best = 100.0 * 2 * (head + common_length(only_x, only_y)) / (len(left) + len(right))
    if shared:
        best = max(best, 200.0 * len(shared) / (len(shared) + len(left)), 200.0 * len(shared) / (len(shared) + len(right)))
    return best


def difflib_token_set_ratio(a: str, b: str) -> int:
    """The same by matching blocks, rounded: the other scorer, with other numbers."""
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0
    shared, left, right = " ".join(sorted(x & y)), " ".join(sorted(x)), " ".join(sorted(y))
    pairs = [(left, right), *(((shared, left), (shared, right)) if shared else ())]
    return round(100 * max(SequenceMatcher(None, *p).ratio() for p in pairs))


def gate(a: str, b: str) -> bool:
    """Whether two titles share enough tokens, or tokens of enough letters, to be scored."""
    shared = set(a.split()) & set(b.split())
    return len(shared) >= LEAST_SHARED_TOKENS or sum(map(len, shared)) >= LEAST_SHARED_CHARS


def score(a: str | None, b: str | None) -> int:
    """0 to 100: the token-set ratio, cut to a whole number, behind the gate."""
    return int(token_set_ratio(a, b)) if a and b and gate(a, b) else 0


def gate_expr(a: Column, b: Column) -> Column:
    """The gate as a built-in expression, so that pairs are dropped before any is scored."""
    shared = F.array_intersect(F.filter(F.split(a, " "), lambda x: x != ""), F.filter(F.split(b, " "), lambda x: x != ""))
    letters = F.aggregate(F.transform(shared, F.length), F.lit(0), lambda s, x: s + x)
    return (F.size(shared) >= LEAST_SHARED_TOKENS) | (letters >= LEAST_SHARED_CHARS)


def may_score(a: Column, b: Column, least: int) -> Column:
    """Whether two titles, as arrays of distinct tokens, can score so much at all,
    from lengths alone: behind the gate, either one's shared tokens are a large
    enough part of it, or the rests could be alike as far as the shorter one goes."""
    letters = lambda words: F.aggregate(words, F.lit(0), lambda s, x: s + F.length(x))
    long = lambda words: letters(words) + F.greatest(F.size(words) - 1, F.lit(0))
    shared = F.array_intersect(a, b)
    s, x, y = long(shared), long(a), long(b)
    passes = (F.size(shared) >= LEAST_SHARED_TOKENS) | (letters(shared) >= LEAST_SHARED_CHARS)
    part = 200.0 * s >= least * (s + F.least(x, y))
    alike = 200.0 * F.least(x, y) >= least * (x + y)
    return passes & (part | alike)


@F.pandas_udf(T.IntegerType())
def score_udf(a: pd.Series, b: pd.Series) -> pd.Series:
    """Each pair of a batch is scored once."""
    pairs = list(zip(a, b))
    known = {p: score(*p) for p in set(pairs)}
    return pd.Series([known[p] for p in pairs])


@F.pandas_udf(T.IntegerType())
def block_score_udf(a: pd.Series, b: pd.Series) -> pd.Series:
    """The other scorer, behind the same gate; each pair of a batch once."""
    pairs = list(zip(a, b))
    known = {p: difflib_token_set_ratio(*p) if all(p) and gate(*p) else 0 for p in set(pairs)}
    return pd.Series([known[p] for p in pairs])
