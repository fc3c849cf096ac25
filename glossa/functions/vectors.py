"""Vector arithmetic on array columns."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def unit(a: Column) -> Column:
    """A vector of length 1; nulls in place of a zero vector's elements."""
    # repeated as an array: inside a lambda the length would be computed for every element
    lengths = F.array_repeat(norm(a), F.size(a))
    return F.zip_with(a, lengths, lambda x, n: F.try_divide(x, n))


def cosine(a: Column, b: Column) -> Column:
    """Null where a vector is zero."""
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def gaussian_loglik(x: Column, mean: Column, scale: float) -> Column:
    """Log density of independent normals; ``scale`` is the standard deviation."""
    const = -0.5 * math.log(2 * math.pi) - math.log(scale)
    terms = F.zip_with(x, mean, lambda a, m: F.lit(const) - (a - m) * (a - m) / F.lit(2.0 * scale * scale))
    return F.aggregate(terms, F.lit(0.0), lambda s, t: s + t)


def stable_multiply(a: Column, b: Column, eps: float = 1e-5) -> Column:
    return F.exp(F.log(a + eps) + F.log(b + eps))


def mean_vectors(rows: DataFrame, keys: list[str], vector: str) -> DataFrame:
    """keys, n, sums, mean: element-wise, one shuffle of partial sums per (keys, position)."""
    cells = rows.select(*keys, F.posexplode(doubles(F.col(vector))).alias("pos", "x"))
    per = cells.groupBy(*keys, "pos").agg(F.sum("x").alias("s"), F.count("*").alias("c"))
    gathered = per.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("pos", "s", "c"))).alias("v"))
    return gathered.select(
        *keys, F.element_at("v", 1)["c"].alias("n"), F.transform("v", lambda t: t["s"]).alias("sums"),
        F.transform("v", lambda t: t["s"] / t["c"]).alias("mean"),
    )


def posterior_mean(mean: Column, n: Column, prior_mean: float, prior_var: float, likelihood_var: float) -> Column:
    """Mean of the posterior over a normal's mean, element by element."""
    spread = 1.0 / prior_var + n / likelihood_var
    return F.transform(mean, lambda m: (prior_mean / prior_var + n * m / likelihood_var) / spread)


def posterior_variance(n: Column, prior_var: float, likelihood_var: float) -> Column:
    return 1.0 / (1.0 / prior_var + n / likelihood_var)
