"""Positions and running sums over a whole table without sorting it in one task: sums by range first, then offsets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glossa.plans.materialize import materialize

Order = str | Column


def _ranges(rows: DataFrame, order: tuple[Order, ...], name: str) -> DataFrame:
    spread = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    return materialize(spread.withColumns({"_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id()}), name)


def _offsets(spread: DataFrame, sums: dict[str, Column]) -> DataFrame:
    """(_part, base_<name>..): sums over the ranges before each; one row for each partition reaches the driver."""
    got = sorted(spread.groupBy("_part").agg(*[s.alias(n) for n, s in sums.items()]).collect(), key=lambda r: r._part)
    base, out = [0] * len(sums), []
    for r in got:
        out.append((r._part, *base))
        base = [b + (r[n] or 0) for b, n in zip(base, sums, strict=True)]
    kinds = {f.name: f.dataType.simpleString() for f in spread.groupBy("_part").agg(*[s.alias(n) for n, s in sums.items()]).schema}
    schema = "_part int, " + ", ".join(f"base_{n} {kinds[n]}" for n in sums)
    cast = [(p, *[float(v) if kinds[n] == "double" else v for n, v in zip(sums, vs, strict=True)]) for p, *vs in out]
    return F.broadcast(spread.sparkSession.createDataFrame(cast, schema))


def numbered(rows: DataFrame, *order: Order) -> DataFrame:
    """``rows`` with row_idx from 0 in a given order."""
    spread = _ranges(rows, order, "numbered")
    got = spread.join(_offsets(spread, {"n": F.count("*")}), "_part")
    index = F.col("_at").bitwiseAND((1 << 33) - 1) + F.col("base_n")
    return got.withColumn("row_idx", index.cast("long")).drop("_part", "_at", "base_n")


def running_sums(rows: DataFrame, columns: list[str], *order: Order) -> DataFrame:
    """``rows`` with upto_<column>, the sum over all rows up to and with each in the order, for unique orders."""
    spread = _ranges(rows, order, "running")
    got = spread.join(_offsets(spread, {c: F.sum(c) for c in columns}), "_part")
    upto = Window.partitionBy("_part").orderBy("_at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    got = got.withColumns({f"upto_{c}": F.col(f"base_{c}") + F.sum(c).over(upto) for c in columns})
    return got.drop("_part", "_at", *[f"base_{c}" for c in columns])
