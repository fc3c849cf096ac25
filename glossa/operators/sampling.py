"""Samples of exact sizes, the same at every run: rows ranked by a hash of their key.

Every function takes the ranking key as a column; ``hashed`` is the default. Keys that another engine can compute give
the same sample there.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glossa.plans.ranges import numbered

MAX_LONG, MAX_SHORT = 1_000, 50_000


def hashed(*keys: str, seed: int = 0) -> Column:
    return F.xxhash64(F.lit(seed), *keys)


def modular(key: str | Column, factor: int = 2654435761, modulus: int = 1000003) -> Column:
    """A scrambled number of an integer key, in plain integer arithmetic."""
    col = F.col(key) if isinstance(key, str) else key
    return (col * F.lit(factor).cast("long")) % modulus


def per_group(rows: DataFrame, group: str, n: int, rank: Column, *ties: str) -> DataFrame:
    """At most ``n`` rows of each group. The limit is pushed below the shuffle, so a hot group sends n rows a task."""
    order = Window.partitionBy(group).orderBy(rank, *ties)
    return rows.withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= n).drop("_rank")


def simple(rows: DataFrame, n: int, rank: Column, *ties: str) -> DataFrame:
    return rows.orderBy(rank, *ties).limit(n)


def by_cluster(rows: DataFrame, group: str, unit: str, most: int, rank: Column) -> DataFrame:
    """For groups of over ``most`` rows, the rows of int(most / rows * units) units (as documents); others whole."""
    sizes = rows.groupBy(group).agg(F.count("*").alias("_n"))
    large = sizes.where(F.col("_n") > most)
    units = rows.join(large, group).select(group, unit, "_n").distinct()
    counts = units.groupBy(group).agg(F.count("*").alias("_units"))
    keep = F.floor(F.lit(float(most)) / F.col("_n") * F.col("_units"))
    ranked = units.join(counts, group).withColumn("_rank", F.row_number().over(Window.partitionBy(group).orderBy(rank, unit)))
    chosen = ranked.where(F.col("_rank") <= keep).select(group, unit)
    small = rows.join(large.select(group), group, "left_anti")
    return small.unionByName(rows.join(chosen, [group, unit], "left_semi").select(*rows.columns))


def downsample(
    contexts: DataFrame, max_long: int = MAX_LONG, max_short: int = MAX_SHORT, long_rank: Column | None = None, short_rank: Column | None = None
) -> DataFrame:
    """Long-form contexts: at most ``max_long`` of a form; short-form contexts: whole documents up to ``max_short`` rows."""
    is_short = F.col("form") == F.col("sf")
    long_rank = hashed("doc_id", "context", seed=1992) if long_rank is None else long_rank
    long_rows = per_group(contexts.where(~is_short), "form", max_long, long_rank, "doc_id", "context")
    short_rank = hashed("doc_id", seed=1992) if short_rank is None else short_rank
    return long_rows.unionByName(by_cluster(contexts.where(is_short), "form", "doc_id", max_short, short_rank))


def row_pairs(rows: DataFrame, group: str, n_groups: int, rank: Column, group_rank: Column, columns: tuple[str, ...], tie: str) -> DataFrame:
    """(group, <c>_1.., <c>_2..): two rows of each of ``n_groups`` groups that have more than one row."""
    sizes = rows.groupBy(group).agg(F.count("*").alias("_n")).where("_n > 1")
    chosen = sizes.orderBy(group_rank, group).limit(n_groups).select(group)
    ranked = rows.join(chosen, group).withColumn("_rank", F.row_number().over(Window.partitionBy(group).orderBy(rank, tie)))
    picks = [F.max(F.when(F.col("_rank") == i, F.col(c))).alias(f"{c}_{i}") for i in (1, 2) for c in columns]
    return ranked.where("_rank <= 2").groupBy(group).agg(*picks)


def train_labels(rows: DataFrame, rank: Column, *ties: str) -> DataFrame:
    """Adds is_train: 0 for the first third by rank, 1 for the rest. Ranges are counted, no task sorts all rows."""
    placed = numbered(rows.withColumn("_rank", rank), "_rank", *ties)
    third = rows.count() // 3
    return placed.withColumn("is_train", (F.col("row_idx") >= third).cast("int")).drop("_rank", "row_idx")


def split(rows: DataFrame, rank: Column, share: float = 0.8, buckets: int = 1000003) -> DataFrame:
    """Adds is_train for about ``share`` of the rows, by their own key only: no sort, no shuffle."""
    return rows.withColumn("is_train", (F.pmod(rank, F.lit(buckets)) < int(share * buckets)).cast("int"))


def stratified_folds(
    rows: DataFrame, label: str, folds: int, test_share: float, key: str, rank: Callable[[Column], Column] | None = None, buckets: int = 4096, most: int = 1000003
) -> DataFrame:
    """(fold, is_test, columns..): every row in every fold; in each, the same share of each class is test.

    Those with the lowest ranks (from 0 up to ``most``, by default of a hash of fold and key) are. Ranks are counted by
    bucket; only the bucket in which the share ends is ordered, so no task orders a class.
    """
    rank = rank or (lambda fold: F.pmod(F.xxhash64(fold, F.col(key)), F.lit(most)))
    spread = rows.withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(folds - 1))))
    spread = spread.withColumn("_rank", rank(F.col("fold"))).withColumn("_bucket", F.floor(F.col("_rank") * buckets / most))
    sizes = spread.groupBy("fold", label, "_bucket").agg(F.count("*").alias("_n"))
    per = Window.partitionBy("fold", label)
    upto = F.sum("_n").over(per.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    wanted = F.round(F.sum("_n").over(per) * test_share)
    told = sizes.select("fold", label, "_bucket", (wanted - (upto - F.col("_n"))).alias("_left"), "_n")
    same = spread["fold"].eqNullSafe(told["fold"]) & spread[label].eqNullSafe(told[label]) & (spread["_bucket"] == told["_bucket"])
    met = spread.join(told, same).select(spread["*"], "_left", "_n")
    sure = met.where("_left <= 0 or _left >= _n").withColumn("is_test", (F.col("_left") > 0).cast("int"))
    order = F.row_number().over(Window.partitionBy("fold", label).orderBy("_rank", key))
    edge = met.where("_left > 0 and _left < _n").withColumn("is_test", (order <= F.col("_left")).cast("int"))
    return sure.unionByName(edge).drop("_rank", "_bucket", "_left", "_n")
