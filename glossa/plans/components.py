"""Connected components by alternating star contraction (Kiveris et al., 2014).

Each round re-hangs every node on the smallest node it can see; a path of n nodes needs O(log n) rounds.
Edges stay distributed: only one row of counters per round reaches the driver. The hub of a large star is a hot key;
its edges are joined where they are (``join_hot``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossa.plans.materialize import discard, materialize
from glossa.plans.skew import join_hot

MAX_ROUNDS = 100
#: Edges from which on a hub may be more than a task should read.
LARGE = 20_000


def _hang(edges: DataFrame, least: DataFrame, large: bool) -> DataFrame:
    """``edges`` (u, v) with the smallest neighbour m of each u."""
    return join_hot(edges, least, ["u"]) if large else edges.join(least.drop("n"), "u")


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """One large-star and one small-star step over (u, v) with u > v."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).withColumn("m", F.least("u", "m"))
    spread = _hang(both, least, large).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(
        least.where("m < u").select("u", F.col("m").alias("v"))
    ).distinct()
    if large:
        spread = materialize(spread, "components")
    least = spread.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
    return (
        _hang(spread, least, large).where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        .union(least.select("u", F.col("m").alias("v"))).distinct()
    )


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(node, component) for every node of ``edges``; component is the smallest node reachable.

    Nulls and self-loops carry no link and are dropped (a node with only a self-loop is not returned);
    repeated edges count once; an empty input gives an empty result.
    """
    a, b = F.col(src), F.col(dst)
    cur = edges.where(a.isNotNull() & b.isNotNull() & (a != b)).select(
        F.greatest(a, b).alias("u"), F.least(a, b).alias("v")
    ).distinct()
    cur, seen = materialize(cur, "components"), None
    for _ in range(MAX_ROUNDS):
        state = cur.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen or not state[0]:
            return cur.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
                cur.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
            )
        last, seen = cur, state
        cur = materialize(_stars(cur, state[0] >= LARGE), "components")
        discard(last)
    raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
