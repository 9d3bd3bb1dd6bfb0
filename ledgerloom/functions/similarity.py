"""String similarities in [0, 1]; null where a side is missing.

Set measures and Levenshtein are built-in expressions.  Kernels that Spark lacks run in Arrow batches, and only over the
distinct pairs of strings (``on_distinct``), since candidate pairs repeat the same strings many times.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable
from math import sqrt

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def lcs_length(a: str, b: str) -> int:
    """Length of the longest common subsequence, a machine word per 64 letters of ``a``."""
    masks: dict[str, int] = {}
    for k, c in enumerate(a):
        masks[c] = masks.get(c, 0) | 1 << k
    full = (1 << len(a)) - 1
    row = full
    for c in b:
        hit = row & masks.get(c, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


def indel_ratio(a: str, b: str) -> float:
    """2 LCS / (|a| + |b|)."""
    return 2.0 * lcs_length(a, b) / (len(a) + len(b)) if a or b else 1.0


def token_set(a: str, b: str) -> float:
    """Indel ratio of the best arrangement of shared and own words."""
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    shared, left, right = (" ".join(sorted(s)) for s in (x & y, x - y, y - x))
    if shared and (not left or not right):
        return 1.0
    one, two = f"{shared} {left}".strip(), f"{shared} {right}".strip()
    best = indel_ratio(one, two)
    return max(best, indel_ratio(shared, one), indel_ratio(shared, two)) if shared else best


def token_sort(a: str, b: str) -> float:
    return indel_ratio(" ".join(sorted(a.split())), " ".join(sorted(b.split())))


def partial(a: str, b: str) -> float:
    """Best indel ratio of the shorter string with a window of the longer; windows may hang over its ends."""
    short, long = sorted((a, b), key=len)
    if not short:
        return 1.0 if not long else 0.0
    n = len(short)
    spans = {(max(0, k), min(len(long), k + n)) for k in range(1 - n, len(long))}
    return max(indel_ratio(short, long[i:j]) for i, j in spans)


def jaro(a: str, b: str) -> float:
    if not a or not b:
        return 1.0 if a == b else 0.0
    reach = max(max(len(a), len(b)) // 2 - 1, 0)
    used, left = [False] * len(b), []
    for i, c in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not used[j] and b[j] == c:
                used[j] = True
                left.append(c)
                break
    m = len(left)
    if not m:
        return 0.0
    swapped = sum(x != y for x, y in zip(left, (c for c, u in zip(b, used, strict=True) if u), strict=True))
    return (m / len(a) + m / len(b) + (m - swapped // 2) / m) / 3


def jaro_winkler(a: str, b: str, scale: float = 0.1) -> float:
    """Jaro, raised for a common start of up to four letters if it is above 0.7."""
    score = jaro(a, b)
    if score <= 0.7:
        return score
    start = 0
    while start < min(4, len(a), len(b)) and a[start] == b[start]:
        start += 1
    return score + start * scale * (1 - score)


def damerau(a: str, b: str) -> int:
    """Edits with swaps of neighbours, which later edits may part again."""
    last: dict[str, int] = {}
    far = len(a) + len(b)
    d = {(-1, -1): far}
    for i in range(len(a) + 1):
        d[i, -1], d[i, 0] = far, i
    for j in range(len(b) + 1):
        d[-1, j], d[0, j] = far, j
    for i in range(1, len(a) + 1):
        match = 0
        for j in range(1, len(b) + 1):
            k, m = last.get(b[j - 1], 0), match
            cost = a[i - 1] != b[j - 1]
            if not cost:
                match = j
            d[i, j] = min(d[i - 1, j - 1] + cost, d[i, j - 1] + 1, d[i - 1, j] + 1, d[k - 1, m - 1] + (i - k - 1) + 1 + (j - m - 1))
        last[a[i - 1]] = i
    return d[len(a), len(b)]


def damerau_similarity(a: str, b: str) -> float:
    n = max(len(a), len(b))
    return 1.0 - damerau(a, b) / n if n else 1.0


def trigram(a: str, b: str) -> float:
    """Cosine of the counts of character trigrams of the strings with a space on each side."""
    x, y = (Counter(f" {s} "[k : k + 3] for k in range(max(len(s), 1))) for s in (a, b))
    dot = sum(n * y[g] for g, n in x.items())
    return dot / sqrt(sum(n * n for n in x.values()) * sum(n * n for n in y.values()))


KERNELS: dict[str, Callable[[str, str], float]] = {
    "ratio": indel_ratio, "token_set": token_set, "token_sort": token_sort, "partial": partial,
    "jaro": jaro, "jaro_winkler": jaro_winkler, "damerau": damerau_similarity,
    "trigram": trigram,
}


def kernel(name: str) -> Callable[[Column, Column], Column]:
    """A kernel on columns; null in, null out."""
    f = KERNELS[name]

    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or y is None else f(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")

    run.__annotations__ = {"a": pd.Series, "b": pd.Series, "return": pd.Series}
    return F.pandas_udf(run, DoubleType())


def on_distinct(pairs: DataFrame, a: str, b: str, names: list[str]) -> DataFrame:
    """``pairs`` with a column <a>_<name> for each kernel, computed once for each distinct pair of strings, both present."""
    some = pairs.where(f"{a} != '' and {b} != ''").select(F.col(a).alias("_a"), F.col(b).alias("_b")).distinct()
    some = some.select("_a", "_b", *[kernel(n)("_a", "_b").alias(f"{a}_{n}") for n in names])
    return pairs.join(some, (F.col(a) == F.col("_a")) & (F.col(b) == F.col("_b")), "left").drop("_a", "_b")


# Built-in expressions


def present(a: Column, b: Column) -> Column:
    """Whether both sides are there; '' and null are missing."""
    return (F.coalesce(a, F.lit("")) != "") & (F.coalesce(b, F.lit("")) != "")


def state(a: Column, b: Column) -> Column:
    """0 both there, 1 only the left, 2 only the right, 3 neither."""
    x, y = F.coalesce(a, F.lit("")) != "", F.coalesce(b, F.lit("")) != ""
    return F.when(x & y, 0).when(x, 1).when(y, 2).otherwise(3)


def equal(a: Column, b: Column) -> Column:
    """1 or 0 where both sides are there."""
    return F.when(present(a, b), (a == b).cast("int"))


def conflict(a: Column, b: Column) -> Column:
    return F.when(present(a, b), (a != b).cast("int"))


def levenshtein_similarity(a: Column, b: Column) -> Column:
    return F.when(present(a, b), 1 - F.levenshtein(a, b) / F.greatest(F.length(a), F.length(b)))


def length_ratio(a: Column, b: Column) -> Column:
    return F.when(present(a, b), F.least(F.length(a), F.length(b)) / F.greatest(F.length(a), F.length(b)))


def prefix_ratio(a: Column, b: Column) -> Column:
    """Length of the common start over the longer length."""
    n = F.least(F.length(a), F.length(b))
    same = F.size(F.filter(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda k: F.substring(a, F.lit(1), k) == F.substring(b, F.lit(1), k)))
    return F.when(present(a, b), same / F.greatest(F.length(a), F.length(b)))


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays, as sets; null if one is empty."""
    return F.when((F.size(a) > 0) & (F.size(b) > 0), F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))


def containment(a: Column, b: Column) -> Column:
    a, b = F.array_distinct(a), F.array_distinct(b)
    return F.when((F.size(a) > 0) & (F.size(b) > 0), F.size(F.array_intersect(a, b)) / F.least(F.size(a), F.size(b)))


def set_state(a: Column, b: Column) -> Column:
    """2 both have elements, 1 one has, 0 neither."""
    return (F.size(a) > 0).cast("int") + (F.size(b) > 0).cast("int")


def set_equal(a: Column, b: Column) -> Column:
    return F.when(set_state(a, b) == 2, (F.array_sort(F.array_distinct(a)) == F.array_sort(F.array_distinct(b))).cast("int"))


def set_conflict(a: Column, b: Column) -> Column:
    """Whether two sets, both with elements, share none."""
    return F.when(set_state(a, b) == 2, (~F.arrays_overlap(a, b)).cast("int"))


def dense_cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q), F.lit(0.0), lambda s, v: s + v)
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))
