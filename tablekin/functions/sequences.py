"""Similarity of two equally long lists of ranks, for the measures Spark has no function for."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


def osa_distance(a: list[int], b: list[int]) -> int:
    """Optimal string alignment: edits plus swaps of neighbours, no part edited twice."""
    before, last = None, list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            cost = min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (x != y))
            if before is not None and j > 1 and x == b[j - 2] and a[i - 2] == y:
                cost = min(cost, before[j - 2] + 1)
            row.append(cost)
        before, last = last, row
    return last[-1]


def edit_distance(a: list[int], b: list[int]) -> int:
    last = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (x != y)))
        last = row
    return last[-1]


def jaro_winkler(a: list[int], b: list[int]) -> float:
    """Jaro similarity, raised by a common prefix of up to four where it exceeds 0.7."""
    reach = max(max(len(a), len(b)) // 2 - 1, 0)
    free = [True] * len(b)
    hits_a = []
    for i, x in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if free[j] and b[j] == x:
                free[j] = False
                hits_a.append(x)
                break
    m = len(hits_a)
    if m == 0:
        return 0.0
    hits_b = [y for y, f in zip(b, free) if not f]
    swaps = sum(x != y for x, y in zip(hits_a, hits_b)) // 2
    jaro = (m / len(a) + m / len(b) + (m - swaps) / m) / 3
    if jaro <= 0.7:
        return jaro
    prefix = 0
    for x, y in zip(a[:4], b[:4]):
        if x != y:
            break
        prefix += 1
    return jaro + 0.1 * prefix * (1 - jaro)


SIMILARITIES = T.StructType([T.StructField(c, T.DoubleType()) for c in ("damerau", "jaro_winkler", "levenshtein")])


@F.pandas_udf(SIMILARITIES)
def sequence_similarity(a: pd.Series, b: pd.Series) -> pd.DataFrame:
    """All three similarities of the rank lists of one batch; the lists are as long as the table is wide."""
    rows = []
    for x, y in zip(a, b):
        x, y = list(x), list(y)
        n = max(len(x), len(y))
        rows.append((1 - osa_distance(x, y) / n, jaro_winkler(x, y), 1 - edit_distance(x, y) / n))
    return pd.DataFrame(rows, columns=["damerau", "jaro_winkler", "levenshtein"])
