"""Sets rendered as bar-separated strings at the edge, arrays inside."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def from_bars(s: Column) -> Column:
    return F.split(s, r"\|")


def to_bars(a: Column) -> Column:
    """Sorted, distinct, joined by bars; null for an empty array."""
    out = F.array_join(F.array_sort(F.array_distinct(a)), "|")
    return F.when(F.size(a) > 0, out)


def merge_bars(s: Column) -> Column:
    """Aggregate: the union of bar sets over a group."""
    return to_bars(F.flatten(F.collect_set(from_bars(s))))


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays as sets; null where both are empty."""
    return F.try_divide(F.size(F.array_intersect(a, b)).cast("double"), F.size(F.array_union(a, b)).cast("double"))


def covered(a: Column, b: Column) -> Column:
    """One set holds the other."""
    return (F.size(F.array_except(a, b)) == 0) | (F.size(F.array_except(b, a)) == 0)


def approximate_match(a: Column, b: Column) -> Column:
    """Some item of one bar set is part of, or holds, some item of the other."""
    return F.exists(from_bars(a), lambda x: F.exists(from_bars(b), lambda y: F.contains(x, y) | F.contains(y, x)))


def longest(s: Column, position: Column) -> Column:
    """Aggregate: the longest string, white space collapsed; of equally long ones the last by position."""
    best = F.max_by(s, F.struct(F.length(s), position))
    return F.trim(F.regexp_replace(best, r"\s+", " "))


def map_union(a: Column, b: Column) -> Column:
    """Map merge where the second map's entries win."""
    kept = F.map_filter(a, lambda k, _: ~F.map_contains_key(b, k))
    return F.map_concat(kept, b)


def any_outside(groups: Column, excluded: list[str]) -> Column:
    """Some item of a bar set isn't excluded."""
    return F.exists(from_bars(groups), lambda g: ~g.isin(excluded))


def parts_count(s: Column) -> Column:
    return F.size(from_bars(s))
