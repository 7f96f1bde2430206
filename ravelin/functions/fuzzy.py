"""Fuzzy string ratios (0 to 100) from their published definitions, for whole Arrow arrays.

The normalized Indel similarity of two strings is 200 * LCS / (len1 + len2); the longest common subsequence is counted
by bit-parallel addition on whole-string integers.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from ravelin.functions.text import given
from ravelin.shipping import ship


def _places(a: str) -> dict[str, int]:
    """Each character's places in a string as bits."""
    out: dict[str, int] = {}
    for k, c in enumerate(a):
        out[c] = out.get(c, 0) | 1 << k
    return out


def _lcs(places: dict[str, int], size: int, b: str) -> int:
    whole = (1 << size) - 1
    row = whole
    for c in b:
        hit = row & places.get(c, 0)
        row = (row + hit | row - hit) & whole
    return size - row.bit_count()


def lcs(a: str, b: str) -> int:
    """Length of the longest common subsequence."""
    return _lcs(_places(a), len(a), b) if a and b else 0


def ratio(a: str, b: str) -> float:
    if not a and not b:
        return 100.0
    return 200.0 * lcs(a, b) / (len(a) + len(b))


def token_sort_ratio(a: str, b: str) -> float:
    return ratio(" ".join(sorted(a.split())), " ".join(sorted(b.split())))


def token_set_ratio(a: str, b: str) -> float:
    """The best ratio of: shared words against shared words with each side's others, and those two against each other."""
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    both = " ".join(sorted(x & y))
    left, right = " ".join(sorted(x - y)), " ".join(sorted(y - x))
    if both and (not left or not right):
        return 100.0
    one, two = f"{both} {left}".strip(), f"{both} {right}".strip()
    best = ratio(one, two)
    if both:
        best = max(best, ratio(both, one), ratio(both, two))
    return best


def partial_ratio(a: str, b: str) -> float:
    """The best ratio of the shorter string with a stretch of the longer one, of its length or cut off at an end.

    A stretch has no longer common subsequence than it shares characters, counted with repeats; only stretches that could
    beat the best so far are measured.
    """
    if len(a) > len(b):
        a, b = b, a
    if not a:
        return 100.0 if not b else 0.0
    n, best, places = len(a), 0.0, _places(a)
    room = {c: p.bit_count() for c, p in places.items()}
    shared = 0
    for end in range(1, len(b) + n):
        if end <= len(b) and (c := b[end - 1]) in room:
            shared += room[c] > 0
            room[c] -= 1
        if end > n and (c := b[end - n - 1]) in room:
            room[c] += 1
            shared -= room[c] > 0
        start, stop = max(0, end - n), min(end, len(b))
        if 200.0 * shared / (n + stop - start) > best:
            best = max(best, 200.0 * _lcs(places, n, b[start:stop]) / (n + stop - start))
    return best


def weighted_ratio(a: str, b: str) -> float:
    """The largest of the weighted ratios; partial ones count where one string is at least half as long again."""
    if not a or not b:
        return 0.0
    long, short = max(len(a), len(b)), min(len(a), len(b))
    best = ratio(a, b)
    if long < 1.5 * short:
        return max(best, 0.95 * token_sort_ratio(a, b), 0.95 * token_set_ratio(a, b))
    scale = 0.9 if long <= 8 * short else 0.6
    x, y = a.split(), b.split()
    shared = set(x) & set(y)
    tokens = 100.0 if shared else partial_ratio(" ".join(sorted(x)), " ".join(sorted(y)))
    return max(best, scale * partial_ratio(a, b), 0.95 * scale * tokens)


@lru_cache(None)
def _remembered(name: str) -> Callable[[str, str], float]:
    """A ratio that keeps its last results for as long as a worker lives: names repeat in candidate pairs."""
    return lru_cache(1 << 17)(globals()[name])


def _column(of: Callable[[str, str], float]) -> Callable[[Column, Column], Column]:
    name = of.__name__

    def make(a: Column, b: Column) -> Column:
        def run(x: pa.Array, y: pa.Array) -> pa.Array:
            return pa.array(list(map(_remembered(name), x.to_pylist(), y.to_pylist())), pa.float64())

        ship(SparkSession.active())
        return F.arrow_udf(run, "double")(given(a), given(b))

    return make


ratio_column = _column(ratio)
token_sort_column = _column(token_sort_ratio)
token_set_column = _column(token_set_ratio)
partial_column = _column(partial_ratio)
weighted_column = _column(weighted_ratio)
