"""Fuzzy text similarities that Spark lacks: numpy-free kernels behind Arrow functions, memoised per batch."""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _lcs(a: str, b: str) -> int:
    """Longest common subsequence by bit vectors."""
    if not a or not b:
        return 0
    masks: dict[str, int] = {}
    for i, ch in enumerate(a):
        masks[ch] = masks.get(ch, 0) | (1 << i)
    full = (1 << len(a)) - 1
    v = full
    for ch in b:
        u = v & masks.get(ch, 0)
        v = ((v + u) | (v - u)) & full
    return len(a) - v.bit_count()


@lru_cache(maxsize=100_000)
def ratio(a: str, b: str) -> float:
    """Insert and delete similarity, 0 to 100."""
    return 100.0 if not a and not b else 200.0 * _lcs(a, b) / (len(a) + len(b))


@lru_cache(maxsize=100_000)
def jaro_winkler(a: str, b: str) -> float:
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    window = max(0, max(len(a), len(b)) // 2 - 1)
    used, hits = [False] * len(b), []
    for i, ch in enumerate(a):
        for j in range(max(0, i - window), min(len(b), i + window + 1)):
            if not used[j] and b[j] == ch:
                used[j] = True
                hits.append(ch)
                break
    m = len(hits)
    if m == 0:
        return 0.0
    other = [b[j] for j in range(len(b)) if used[j]]
    moved = sum(x != y for x, y in zip(hits, other, strict=True)) // 2
    jaro = (m / len(a) + m / len(b) + (m - moved) / m) / 3
    prefix = 0
    while prefix < min(4, len(a), len(b)) and a[prefix] == b[prefix]:
        prefix += 1
    return jaro + prefix * 0.1 * (1 - jaro) if jaro > 0.7 else jaro


def token_sort(a: str, b: str) -> float:
    return ratio(" ".join(sorted(a.split())), " ".join(sorted(b.split())))


@lru_cache(maxsize=100_000)
def token_set(a: str, b: str) -> float:
    """Best of the shared words against each side's shared and own words."""
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    both, only_x, only_y = " ".join(sorted(x & y)), " ".join(sorted(x - y)), " ".join(sorted(y - x))
    if both and (not only_x or not only_y):
        return 100.0
    one, two = (f"{both} {w}".strip() for w in (only_x, only_y))
    return max(ratio(one, two), ratio(both, one) if both else 0.0, ratio(both, two) if both else 0.0)


@lru_cache(maxsize=100_000)
def partial(a: str, b: str) -> float:
    """Best ratio of the shorter text with any run of its length, or any shorter end piece, of the longer."""
    s, t = (a, b) if len(a) <= len(b) else (b, a)
    if not s:
        return 100.0 if not t else 0.0
    best, n = 0.0, len(s)
    for i in range(1 - n, len(t)):
        best = max(best, ratio(s, t[max(0, i) : i + n]))
        if best == 100.0:
            break
    return best


def wratio(a: str, b: str) -> float:
    """Weighted best of the whole, partial and token ratios, by the texts' length ratio."""
    if not a or not b:
        return 0.0
    lengths = max(len(a), len(b)) / min(len(a), len(b))
    whole = ratio(a, b)
    if lengths < 1.5:
        return max(whole, 0.95 * max(token_sort(a, b), token_set(a, b)))
    scale = 0.9 if lengths <= 8 else 0.6
    x, y = " ".join(sorted(a.split())), " ".join(sorted(b.split()))
    shared = 100.0 if set(a.split()) & set(b.split()) else partial(x, y)
    return max(whole, scale * partial(a, b), 0.95 * scale * max(partial(x, y), shared))


def _udf(kernel: Callable[[str, str], float], scale: float) -> Callable:
    @F.pandas_udf(T.DoubleType())
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([kernel(x or "", y or "") / scale for x, y in zip(a, b, strict=True)])

    return run


jaro_winkler_udf = _udf(jaro_winkler, 1.0)
ratio_udf, token_sort_udf, token_set_udf, partial_udf, wratio_udf = (_udf(f, 100.0) for f in (ratio, token_sort, token_set, partial, wratio))
