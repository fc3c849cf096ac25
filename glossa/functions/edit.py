"""Edit distances that Catalyst lacks: with transpositions, and aligned over token lists."""

from __future__ import annotations

from collections.abc import Collection, Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glossa.functions.stopwords import ENGLISH


def osa(a: str, b: str) -> int:
    """Optimal string alignment: insert, delete, replace, swap neighbours; no part is edited twice."""
    before: list[int] = []
    last = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            best = min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                best = min(best, before[j - 2] + 1)
            row.append(best)
        before, last = last, row
    return last[-1]


def aligned_distance(a: Sequence[str], b: Sequence[str], stopwords: Collection[str] = ENGLISH) -> tuple[float | None, bool]:
    """(mean normalised distance, covered): tokens of the shorter list go greedily to their nearest free partners.

    Coverage looks at all tokens, distance at those that aren't stopwords. Unmatched tokens of the longer list count as
    entirely different. Among equal distances the earlier token of the shorter list, then of the longer one, is taken.
    No tokens at all: null distance.
    """
    covered = set(a) <= set(b) or set(b) <= set(a)
    one, two = ([t for t in x if t not in stopwords] for x in (a, b))
    small, big = (one, two) if len(one) < len(two) else (two, one)
    if not big:
        return None, covered
    order = sorted((osa(s, t), i, j) for i, s in enumerate(small) for j, t in enumerate(big))
    partner: dict[int, int] = {}
    used: set[int] = set()
    while len(used) < len(small):
        _, i, j = next(x for x in order if x[1] not in used and x[2] not in partner)
        partner[j] = i
        used.add(i)
    total = 0.0
    for j, t in enumerate(big):
        s = small[partner[j]] if j in partner else ""
        total += osa(t, s) / max(len(t), len(s), 1)
    return total / len(big), covered


@F.pandas_udf(T.IntegerType())
def osa_distance(a: pd.Series, b: pd.Series) -> pd.Series:
    pairs = zip(a, b, strict=True)
    return pd.Series([None if x is None or y is None else osa(x, y) for x, y in pairs], dtype="Int32")


def aligned(a: Column, b: Column) -> Column:
    """struct(distance double, covered boolean) of two token arrays."""
    return _aligned(a, b)


@F.pandas_udf(T.StructType([T.StructField("distance", T.DoubleType()), T.StructField("covered", T.BooleanType())]))
def _aligned(a: pd.Series, b: pd.Series) -> pd.DataFrame:
    rows = [(None, None) if x is None or y is None else aligned_distance(list(x), list(y)) for x, y in zip(a, b, strict=True)]
    return pd.DataFrame(rows, columns=["distance", "covered"])
