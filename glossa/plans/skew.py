"""Joins whose key may hold a large share of all rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A key that holds over 1 / HOT of the rows is hot, so there are fewer than HOT of them.
HOT = 512


def join_hot(rows: DataFrame, told: DataFrame, keys: list[str], n: str = "n", hot: int = HOT) -> DataFrame:
    """``rows`` inner-joined with ``told``, which has one row per key and the key's number of rows as ``n``.

    The keys of over a ``hot``-th of all rows, fewer than ``hot`` of them as their numbers add up to no more than all
    rows, are broadcast and their rows stay where they are; the rest is dealt by key, and no key is then large. Null
    keys match each other. ``n`` isn't returned. Both sides may be read twice: pass written tables.
    """
    total = told.agg(F.sum(n)).first()[0] or 0
    few, many = told.where(F.col(n) * hot > total).drop(n), told.where(F.col(n) * hot <= total).drop(n)
    if not few.head(1):
        return rows.join(_named(many, keys), _same(rows, keys)).drop(*map(_own, keys))
    out = rows.join(F.broadcast(_named(few, keys)), _same(rows, keys)).drop(*map(_own, keys))
    rest = rows.join(F.broadcast(_named(few.select(*keys), keys)), _same(rows, keys), "left_anti")
    return out.unionByName(rest.join(_named(many, keys), _same(rest, keys)).drop(*map(_own, keys)))


def _own(key: str) -> str:
    return f"_hot_{key}"


def _named(told: DataFrame, keys: list[str]) -> DataFrame:
    return told.withColumnsRenamed({k: _own(k) for k in keys})


def _same(rows: DataFrame, keys: list[str]) -> Column:
    return reduce(lambda a, b: a & b, [rows[k].eqNullSafe(F.col(_own(k))) for k in keys])
