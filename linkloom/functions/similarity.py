"""Similarities of two columns in 0..1.

Set and equality measures are column expressions. Ratios over longest common subsequences have no JVM built-in:
they run as Arrow-batched functions over distinct string pairs (:func:`scored`), by bit-parallel arithmetic on Python integers.
"""

from __future__ import annotations

from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F


def lcs(a: str, b: str) -> int:
    """Length of the longest common subsequence, all positions of ``a`` at once in one integer."""
    masks: dict[str, int] = {}
    for i, ch in enumerate(a):
        masks[ch] = masks.get(ch, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for ch in b:
        hit = row & masks.get(ch, 0)
        row = (row + hit | row - hit) & full
    return len(a) - row.bit_count()


def ratio(a: str, b: str) -> float:
    """Twice the common subsequence over both lengths; 1 of two empty strings."""
    return 2 * lcs(a, b) / (len(a) + len(b)) if a or b else 1.0


def token_sort(a: str, b: str) -> float:
    return ratio(" ".join(sorted(a.split())), " ".join(sorted(b.split())))


def token_set(a: str, b: str) -> float:
    """The best ratio among the shared words and either side's words; 1 if one side's words are all shared, 0 if a side has none."""
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    both = " ".join(sorted(x & y))
    only_x, only_y = " ".join(sorted(x - y)), " ".join(sorted(y - x))
    if both and (not only_x or not only_y):
        return 1.0
    left, right = (" ".join(filter(None, (both, o))) for o in (only_x, only_y))
    found = [ratio(left, right)]
    if both:
        found += [ratio(both, left), ratio(both, right)]
    return max(found)


def partial(a: str, b: str) -> float:
    """The best ratio of the shorter string with a window of the longer one, windows at the ends may be shorter. 0 if only one is empty."""
    short, long = sorted((a, b), key=len)
    if not short:
        return 1.0 if not long else 0.0
    if short in long:
        return 1.0
    n, letters = len(short), set(short)
    best = 0.0
    for start in range(1 - n, len(long)):
        window = long[max(0, start) : start + n]
        # a window that ends with a foreign letter, or a cut one at the end that begins with one, has a better neighbour
        if (window[0 if start > len(long) - n else -1] in letters) and 2 * len(window) / (n + len(window)) > best:
            best = max(best, ratio(short, window))
    return best


def jaro_winkler(a: str, b: str) -> float:
    """Jaro similarity with the common prefix's bonus of 0.1 a letter up to four, above 0.7. 0 if either is empty."""
    if not a or not b:
        return 0.0
    if a == b:
        return 1.0
    reach = max(0, max(len(a), len(b)) // 2 - 1)
    used = [False] * len(b)
    mine = []
    for i, ch in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not used[j] and b[j] == ch:
                used[j] = True
                mine.append(ch)
                break
    m = len(mine)
    if not m:
        return 0.0
    theirs = [b[j] for j in range(len(b)) if used[j]]
    moved = sum(x != y for x, y in zip(mine, theirs)) // 2
    jaro = (m / len(a) + m / len(b) + (m - moved) / m) / 3
    prefix = 0
    while prefix < min(4, len(a), len(b)) and a[prefix] == b[prefix]:
        prefix += 1
    return jaro + prefix * 0.1 * (1 - jaro) if jaro > 0.7 else jaro


MEASURES = {"ratio": ratio, "tset": token_set, "tsort": token_sort, "partial": partial, "jw": jaro_winkler}


@lru_cache(maxsize=None)
def measure(kind: str):
    """Arrow-batched function of two string columns."""
    compute = MEASURES[kind]

    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([compute(x or "", y or "") for x, y in zip(a, b)], dtype="float64")

    return F.pandas_udf(run, "double")


def scored(pairs: DataFrame, left: str, right: str, kinds: list[str], prefix: str) -> DataFrame:
    """``pairs`` with ``<prefix>_<kind>`` for each measure, computed once per distinct pair of strings and joined back. A null string counts as an empty one."""
    distinct = pairs.select(left, right).distinct()
    made = distinct.select(left, right, *(measure(k)(F.col(left), F.col(right)).alias(f"{prefix}_{k}") for k in kinds))
    on = F.col(f"_l.{left}").eqNullSafe(F.col("_r._a")) & F.col(f"_l.{right}").eqNullSafe(F.col("_r._b"))
    named = made.withColumnsRenamed({left: "_a", right: "_b"})
    return pairs.alias("_l").join(named.alias("_r"), on).select("_l.*", *(f"_r.{prefix}_{k}" for k in kinds))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays in double precision; null where a length differs or a norm is zero."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return F.when(F.size(a) == F.size(b), F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))))


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays as sets; null if both are empty."""
    return F.try_divide(F.size(F.array_intersect(a, b)).cast("double"), F.size(F.array_union(a, b)))


def same_first(a: Column, b: Column) -> Column:
    """1 if the first elements agree, 0 if not; null if either has none."""
    return F.when((F.size(a) > 0) & (F.size(b) > 0), (F.try_element_at(a, F.lit(1)) == F.try_element_at(b, F.lit(1))).cast("double"))


def same_stated(a: Column, b: Column) -> Column:
    """1 if equal, 0 if not; null unless both are stated."""
    return F.when((a != "") & (b != ""), (a == b).cast("double"))
