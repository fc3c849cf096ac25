"""Which long form does an occurrence of a short form mean? Nearest neighbours, and assignment by Gaussian parameters."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from glossa.functions import sets, vectors

#: Known vectors that one matrix product takes.
BLOCK = 4096
#: Queries that one matrix product takes.
ROWS = 256


def _matrix(column: pa.ListArray) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def nearest(queries: np.ndarray, known: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the k known rows with the largest products, ties to the first, and the products, for each query.

    ``ROWS`` queries are taken at a time, so what is held beside the result is bounded whatever the number of queries.
    """
    k = min(k, len(known))
    places, found = np.zeros((len(queries), k), np.int64), np.zeros((len(queries), k))
    for at in range(0, len(queries), ROWS):
        sims = np.round(queries[at : at + ROWS] @ known.T, 9)
        near = np.argsort(-sims, axis=1, kind="stable")[:, :k]
        places[at : at + ROWS], found[at : at + ROWS] = near, np.take_along_axis(sims, near, axis=1)
    return places, found


def neighbours(queries: DataFrame, known: DataFrame, k: int, block: int = BLOCK) -> DataFrame:
    """(q, sf, lf, id, sim, rank): the k nearest known vectors of the same short form, by cosine.

    ``queries`` (q, sf, embedding), ``known`` (id, sf, lf, embedding), vectors of one length. Known vectors of a short form
    are dealt into blocks of about ``block``; queries stream past each block, which gives its own k nearest of each by a
    matrix product. No pair leaves a block, and a frequent short form has as many tasks as blocks.
    """
    sizes = known.groupBy("sf").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    unit = lambda c: vectors.unit(vectors.doubles(F.col(c)))
    b = known.join(sizes, "sf").select(
        "sf", F.pmod(F.xxhash64("id"), F.col("blocks").cast("long")).cast("int").alias("block"), F.lit(0).alias("side"),
        F.col("id").cast("long").alias("key"), "lf", unit("embedding").alias("x"),
    )
    a = queries.join(sizes, "sf").select(
        "sf", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(1).alias("side"),
        F.col("q").cast("long").alias("key"), F.lit(None).cast("string").alias("lf"), unit("embedding").alias("x"),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, ids, names, parts, held = None, [], [], [], None
        for batch in batches:
            sf, blocks, side = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            cut = np.flatnonzero((sf[1:] != sf[:-1]) | (blocks[1:] != blocks[:-1]) | (side[1:] != side[:-1])) + 1
            for start, end in zip([0, *cut.tolist()], [*cut.tolist(), len(sf)], strict=True):
                part = batch.slice(start, end - start)
                if (sf[start], blocks[start]) != at:
                    at, ids, names, parts, held = (sf[start], blocks[start]), [], [], [], None
                if side[start] == 0:
                    ids += part.column(3).to_pylist()
                    names += part.column(4).to_pylist()
                    parts.append(_matrix(part.column(5)))
                    held = None
                elif ids:
                    order = np.argsort(ids, kind="stable") if held is None else held[0]
                    held = held or (order, np.concatenate(parts)[order], np.array(ids)[order])
                    near, sims = nearest(_matrix(part.column(5)), held[1], k)
                    rows, near = np.repeat(np.arange(len(near)), near.shape[1]), near.ravel()
                    yield pa.RecordBatch.from_arrays(
                        [part.column(3).take(pa.array(rows)), part.column(0).take(pa.array(rows)), pa.array([names[order[i]] for i in near], pa.string()), pa.array(held[2][near], pa.int64()), pa.array(sims.ravel())],
                        ["q", "sf", "lf", "id", "sim"],
                    )

    dealt = b.unionByName(a).repartition("sf", "block").sortWithinPartitions("sf", "block", "side", "key")
    best = dealt.mapInArrow(run, "q long, sf string, lf string, id long, sim double")
    order = Window.partitionBy("q").orderBy(F.desc("sim"), "id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def majority(found: DataFrame) -> DataFrame:
    """(q, predicted): most frequent long form of the neighbours; of equally frequent ones that of the farthest."""
    votes = found.groupBy("q", "lf").agg(F.count("*").alias("n"), F.max("rank").alias("far"))
    return votes.groupBy("q").agg(F.max_by("lf", F.struct("n", "far")).alias("predicted"))


def accuracy(predicted: DataFrame) -> DataFrame:
    """(n, exact, approximate) over (truth, predicted): equal, or equal up to one form holding another."""
    same = F.col("truth") == F.col("predicted")
    near = same | sets.approximate_match(F.col("predicted"), F.col("truth"))
    return predicted.agg(
        F.count("*").alias("n"), F.avg(same.cast("double")).alias("exact"), F.avg(near.cast("double")).alias("approximate")
    )


def assignments(data: DataFrame, params: DataFrame, scale: float = 1.0) -> DataFrame:
    """(id, sf, lf, logp, p): log beta + log likelihood of each long form, normalised over the short form's.

    ``data`` (id, sf, embedding), ``params`` (sf, lf, beta, mean). Parameters are one row per (sf, lf).
    """
    x = data.select("id", "sf", vectors.doubles(F.col("embedding")).alias("x"))
    rows = x.join(params, "sf").select(
        "id", "sf", "lf", (F.log("beta") + vectors.gaussian_loglik(F.col("x"), F.col("mean"), scale)).alias("logp")
    )
    per = Window.partitionBy("id")
    weight = F.exp(F.col("logp") - F.max("logp").over(per))
    return rows.withColumn("_w", weight).withColumn("p", F.col("_w") / F.sum("_w").over(per)).drop("_w")


def best_assignment(scored: DataFrame) -> DataFrame:
    """(id, sf, lf, logp): the likeliest long form; of equal ones the first in order."""
    order = Window.partitionBy("id").orderBy(F.desc("logp"), "lf")
    return scored.withColumn("_r", F.row_number().over(order)).where("_r = 1").select("id", "sf", "lf", "logp")


def log_joint(data: DataFrame, assigned: DataFrame, params: DataFrame, likelihood_scale: float = 1.0, prior_mean: float = 0.0, prior_scale: float = 1.0) -> DataFrame:
    """(log_joint): log prior of all means plus the mean over data of log beta + log likelihood of the assignment."""
    zeros = F.transform("mean", lambda m: F.lit(prior_mean))
    prior = params.agg(F.sum(vectors.gaussian_loglik(F.col("mean"), zeros, prior_scale)).alias("prior"))
    x = data.select("id", vectors.doubles(F.col("embedding")).alias("x"))
    rows = assigned.select("id", "sf", "lf").join(x, "id").join(params, ["sf", "lf"])
    fit = rows.agg(F.avg(F.log("beta") + vectors.gaussian_loglik(F.col("x"), F.col("mean"), likelihood_scale)).alias("fit"))
    return prior.join(fit, F.lit(True)).select((F.col("prior") + F.col("fit")).alias("log_joint"))


def mean_parameters(labelled: DataFrame, expansion_prior: float = 1.0) -> DataFrame:
    """(sf, lf, n, beta, mean): context means and smoothed shares of labelled vectors (sf, lf, embedding)."""
    means = vectors.mean_vectors(labelled, ["sf", "lf"], "embedding").select("sf", "lf", "n", "mean")
    per = Window.partitionBy("sf")
    share = (F.col("n") + expansion_prior) / (F.sum("n").over(per) + expansion_prior * F.count("*").over(per))
    return means.select("sf", "lf", "n", share.alias("beta"), "mean")


def initial_parameters(vocab: DataFrame, labelled: DataFrame, width: int, seed: int = 0) -> DataFrame:
    """(sf, lf, beta, mean): vocabulary entries with their context means; entries without contexts get normal noise."""
    means = mean_parameters(labelled).select("sf", "lf", "mean")
    noise = F.transform(F.sequence(F.lit(1), F.lit(width)), lambda i: F.sin(F.xxhash64("sf", "lf", F.lit(seed), i).cast("double")))
    per = Window.partitionBy("sf")
    rows = vocab.join(means, ["sf", "lf"], "left")
    beta = (F.col("support") + 1.0) / F.sum(F.col("support") + 1.0).over(per)
    return rows.select("sf", "lf", beta.alias("beta"), F.coalesce("mean", noise).alias("mean"))


def evaluate(data: DataFrame, params: DataFrame) -> DataFrame:
    """(id, sf, truth, predicted): the likeliest long form of labelled vectors (id, sf, lf, embedding) by saved parameters."""
    best = best_assignment(assignments(data, params)).select("id", F.col("lf").alias("predicted"))
    return data.select("id", "sf", F.col("lf").alias("truth")).join(best, "id")
