"""Gibbs samplers whose parameters stay in a table dealt by short form.

Vectors are dealt once into blocks of (short form, block) of some ``BLOCK`` rows, kept where they are by a cached,
co-partitioned table. In a sweep each block meets its own form's parameters, one row per short form that is repeated for
the form's blocks; rows draw their long form from a number that follows from their id, and a block gives the sums of what
it drew. Sums are folded ``FAN`` blocks at a time, in the order of the blocks, so runs repeat to the last bit and a form
with a third of all rows is no task of its own. New shares and means are drawn from the sums in tasks, seeded by short
form and sweep. Nothing of the vocabulary is collected or broadcast; the driver sees a few numbers a sweep.

Defined cases: rows with null id or short form, with a short form that has no parameters, or whose vector is null, holds
nulls or has another width than the parameters are dropped; repeated rows count each for itself; equal long forms of one
short form are one, its smallest row; without rows or parameters the result is empty.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glossa.functions import vectors
from glossa.plans.materialize import discard, materialize
from glossa.plans.skew import join_hot

BLOCK, FAN = 1024, 64
#: Sweeps that one job may hold.
CUT = 5
_STATE = "sf string, lfs array<string>, beta binary, means binary"
_SUMS = "sf string, block long, counts binary, fits binary, totals binary, lfs array<string>, beta binary, means binary"


def draws(logp: np.ndarray, ids: np.ndarray, *salt: int) -> np.ndarray:
    """An index for each row of ``logp`` by its weights, from a number that follows from the row's id alone."""
    p = np.exp(logp - logp.max(1, keepdims=True))
    mixed = ids.astype(np.uint64) + np.uint64(hash((97, *salt)) & (1 << 63) - 1)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB), (31, 1)):
        mixed = (mixed ^ (mixed >> np.uint64(shift))) * np.uint64(factor)
    u = (mixed >> np.uint64(11)) / float(1 << 53)
    return np.minimum((u[:, None] > np.cumsum(p / p.sum(1, keepdims=True), axis=1)).sum(1), p.shape[1] - 1)


def generator(name: str, *salt: int) -> np.random.Generator:
    """A generator that follows from a name and numbers."""
    return np.random.default_rng([int.from_bytes(hashlib.sha256(name.encode()).digest()[:8], "little"), *salt])


def likelihood(x: np.ndarray, means: np.ndarray, scale: float) -> np.ndarray:
    """Gaussian log likelihood of each vector by each mean, through products: nothing of the size rows x means x width."""
    distance = (x**2).sum(1)[:, None] - 2 * x @ means.T + (means**2).sum(1)[None, :]
    width = x.shape[1]
    return -0.5 * width * np.log(2 * np.pi) - width * np.log(scale) - distance / (2 * scale**2)


def _arrow(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {
        "string": pa.string(), "long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "binary": pa.binary(), "array<string>": pa.list_(pa.string()),
        "array<double>": pa.list_(pa.float64()),
    }
    fields = [f.strip().split(" ") for f in schema.split(",")]
    cols = list(zip(*rows, strict=True)) or [()] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(cols, fields, strict=True)], [n for n, _ in fields])


def _rowwise(df: DataFrame, make: Callable[..., tuple], schema: str) -> DataFrame:
    """``make(**row)`` of each of a few large rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                yield _arrow([make(**{n: batch.column(n)[i].as_py() for n in batch.schema.names})], schema)

    return df.mapInArrow(run, schema)


def _grouped(df: DataFrame, keys: list[str], order: list[str], make: Callable[[tuple, list[dict]], tuple], schema: str) -> DataFrame:
    """``make(key, rows)`` of each group, whose rows come in an order; a group is held in memory."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for batch in batches:
            for row in batch.to_pylist():
                key = tuple(row[k] for k in keys)
                if key != now:
                    if held:
                        yield _arrow([make(now, held)], schema)
                    now, held = key, []
                held.append(row)
        if held:
            yield _arrow([make(now, held)], schema)

    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)


def _floats(raw: bytes, *shape: int) -> np.ndarray:
    return np.frombuffer(raw, np.float64).reshape(*shape) if shape else np.frombuffer(raw, np.float64)


# -- data and state ----------------------------------------------------------------------------------------------------


def packed(data: DataFrame, forms: DataFrame, width: int, more: dict[str, str]) -> tuple[DataFrame, DataFrame]:
    """(blocks (sf, block, n, ids, x, <more>), sizes (sf, blocks)): ``data`` (sf, id, x, <more>) of the short forms ``forms``."""
    sound = F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v)) & (F.size("x") == width)
    rows = materialize(data.where(F.col("sf").isNotNull() & F.col("id").isNotNull() & sound).join(forms, "sf", "left_semi"), "sampler-rows")
    sizes = rows.groupBy("sf").agg(F.count("*").alias("n")).select("sf", F.ceil(F.col("n") / BLOCK).cast("long").alias("blocks"), "n")
    sizes = materialize(sizes, "sampler-sizes")
    dealt = join_hot(rows, sizes, ["sf"]).withColumn("block", F.pmod(F.xxhash64("id"), "blocks"))
    schema = "sf string, block long, n long, ids binary, x binary" + "".join(f", {c} {'array<string>' if k == 'string' else 'binary'}" for c, k in more.items())

    def make(key: tuple, held: list[dict]) -> tuple:
        extra = [[r[c] for r in held] if k == "string" else np.array([r[c] for r in held], np.int64).tobytes() for c, k in more.items()]
        x = np.array([r["x"] for r in held], np.float64)
        return (*key, len(held), np.array([r["id"] for r in held], np.int64).tobytes(), x.tobytes(), *extra)

    blocks = materialize(_grouped(dealt.select("sf", "block", "id", "x", *more), ["sf", "block"], ["id", "x"], make, schema), "sampler-blocks")
    n = int(data.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    discard(rows)
    return blocks.repartition(n, "sf", "block").persist(StorageLevel.DISK_ONLY), sizes.drop("n")


def meet(blocks: DataFrame, state: DataFrame, sizes: DataFrame) -> DataFrame:
    """Each block with its form's parameters, which are what moves."""
    spread = state.join(sizes, "sf").withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).drop("blocks")
    return blocks.join(spread.hint("shuffle_hash"), ["sf", "block"])


def folded(sums: DataFrame, most: int) -> DataFrame:
    """One row of sums, with the parameters, for each short form; ``most`` is the largest number of blocks of one."""

    def make(key: tuple, held: list[dict]) -> tuple:
        counts = np.sum([np.frombuffer(r["counts"], np.int64) for r in held], axis=0)
        fits, totals = (np.sum([_floats(r[c]) for r in held], axis=0) for c in ("fits", "totals"))
        return (*key, counts.tobytes(), fits.tobytes(), totals.tobytes(), held[0]["lfs"], held[0]["beta"], held[0]["means"])

    while True:
        groups = sums.withColumnRenamed("block", "own").withColumn("block", F.floor(F.col("own") / FAN).cast("long"))
        sums = _grouped(groups, ["sf", "block"], ["own"], make, _SUMS)
        if most <= FAN:
            return sums.drop("block")
        most = -(-most // FAN)


def packed_state(params: DataFrame) -> DataFrame:
    """One row per short form: long forms in order, shares and means as 64-bit floats."""
    entry = F.struct("lf", F.col("beta").cast("double").alias("beta"), F.col("mean").cast("array<double>").alias("mean"))
    rows = params.where("sf is not null and lf is not null").groupBy("sf").agg(F.array_sort(F.collect_list(entry)).alias("entries"))

    def make(sf: str, entries: list[dict]) -> tuple:
        first: dict[str, dict] = {}
        for e in entries:
            first.setdefault(e["lf"], e)
        beta, means = ([np.array([e[c] for e in first.values()], np.float64).tobytes() for c in ("beta", "mean")])
        return sf, list(first), beta, means

    return _rowwise(rows, make, _STATE)


def snapshot(state: DataFrame, path: str, iteration: int) -> None:
    """Keep the state before the sweep after ``iteration``; a snapshot counts once all its short forms are there."""
    whole = state.select("*", F.lit(state.count()).cast("long").alias("forms"))
    whole.write.mode("overwrite").parquet(f"{path.rstrip('/')}/iter={iteration}")


def last_snapshot(spark: SparkSession, path: str, most: int) -> tuple[int, DataFrame] | None:
    """(iteration, state) of the last whole snapshot of at most ``most`` sweeps."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        return None
    rows = spark.read.schema(_STATE + ", forms long, iter int").parquet(path)
    whole = rows.where(F.col("iter") <= most).groupBy("iter").agg(F.count("*").alias("n"), F.max("forms").alias("forms")).where("n = forms")
    at = whole.agg(F.max("iter")).first()[0]
    return None if at is None else (at, rows.where(F.col("iter") == at).drop("forms", "iter"))


# -- assignments, shares and means of each short form --------------------------------------------------------------------

GIBBS = "iter int, sf string, lf string, beta double, n long, mean array<double>, log_fit double, validation_fit double"
_DRAWN = _STATE + ", used_beta binary, used_means binary, counts binary, fits binary"


def draw_block(ids: np.ndarray, train: np.ndarray, x: np.ndarray, beta: np.ndarray, means: np.ndarray, scale: float, *salt: int) -> tuple[np.ndarray, ...]:
    """(counts and fits of validation and training rows, vector totals of training rows) by long form."""
    logp = np.log(beta + 1e-300)[None, :] + likelihood(x, means, scale)
    drawn = draws(logp, ids, *salt)
    fit = logp[np.arange(len(ids)), drawn]
    counts, totals = np.zeros((2, len(beta)), np.int64), np.zeros(means.shape)
    np.add.at(counts, (train, drawn), 1)
    np.add.at(totals, drawn[train == 1], x[train == 1])
    return counts, np.array([fit[train == t].sum() for t in (0, 1)]), totals


def draw_parameters(
    sf: str, counts: np.ndarray, totals: np.ndarray, means: np.ndarray, expansion_prior: float, prior_mean: float, prior_var: float, scale: float, *salt: int
) -> tuple[np.ndarray, np.ndarray]:
    """New shares and means; a long form that no row drew keeps its mean. Variances stand for standard deviations."""
    rng = generator(sf, *salt)
    beta = rng.dirichlet(counts + expansion_prior)
    spread = 1 / prior_var + counts / scale
    centre = (prior_mean / prior_var + totals / scale) / spread[:, None]
    drawn = rng.normal(centre, (1 / spread)[:, None])
    return beta, np.where(counts[:, None] > 0, drawn, means)


def gibbs(
    data: DataFrame, params: DataFrame, sweeps: int = 50, expansion_prior: float = 1.0, prior_mean: float = 0.0, prior_var: float = 1.0,
    likelihood_var: float = 1.0, seed: int = 0, keep_every: int = 0, snapshots: str | None = None, snapshot_every: int = 10,
) -> DataFrame:
    """Gibbs sampling of assignments, shares and means of each short form; seeded, so runs repeat.

    ``data`` (id, sf, embedding, is_train), ``params`` (sf, lf, beta, mean). Returns the parameters of the last sweep (and of
    every ``keep_every``-th), with how many training rows drew each long form and the mean log likelihoods of the short
    form's training and validation rows. With ``snapshots``, a folder that the cluster shares, the state is written every
    ``snapshot_every`` sweeps, and a later call goes on from the last one: the rows of the sweeps that are left equal those
    of an undisturbed run.
    """
    spark = data.sparkSession
    width = params.where("mean is not null").select(F.size("mean").alias("n")).head(1)
    if not width:
        return spark.createDataFrame([], GIBBS)
    width = width[0].n
    known = params.where(F.size("mean") == width)
    rows = data.select("sf", F.col("id").cast("long").alias("id"), vectors.doubles(F.col("embedding")).alias("x"), F.coalesce((F.col("is_train").cast("int") == 1).cast("int"), F.lit(0)).alias("is_train"))
    blocks, sizes = packed(rows, known.select("sf").distinct(), width, {"is_train": "long"})
    most = sizes.agg(F.max("blocks")).first()[0] or 1
    found = last_snapshot(spark, snapshots, sweeps - 1) if snapshots else None
    done, state = found or (0, packed_state(known))
    state = materialize(state.join(sizes.select("sf"), "sf", "left_semi"), "gibbs-state")
    kept: list[tuple[int, DataFrame]] = []
    for sweep in range(done + 1, sweeps + 1):

        def assign(sf, block, n, ids, x, is_train, lfs, beta, means, sweep=sweep) -> tuple:
            got = draw_block(
                np.frombuffer(ids, np.int64), np.frombuffer(is_train, np.int64), _floats(x, n, -1), _floats(beta), _floats(means, len(lfs), -1), likelihood_var, seed, sweep
            )
            return sf, block, *[v.tobytes() for v in got], lfs, beta, means

        def renew(sf, counts, fits, totals, lfs, beta, means, sweep=sweep) -> tuple:
            old, n = _floats(means, len(lfs), -1), np.frombuffer(counts, np.int64).reshape(2, -1)
            new = draw_parameters(sf, n[1], _floats(totals, len(lfs), -1), old, expansion_prior, prior_mean, prior_var, likelihood_var, seed, sweep)
            return sf, lfs, new[0].tobytes(), new[1].tobytes(), beta, means, counts, fits

        sums = folded(_rowwise(meet(blocks, state, sizes), assign, _SUMS), most)
        drawn = _rowwise(sums, renew, _DRAWN)
        keep = sweep == sweeps or bool(keep_every) and sweep % keep_every == 0
        mark = bool(snapshots) and sweep % snapshot_every == 0
        if keep or mark or sweep % CUT == 0:
            drawn = materialize(drawn, "gibbs-state")
        if keep:
            kept.append((sweep, drawn))
        state = drawn.select("sf", "lfs", "beta", "means")
        if mark:
            snapshot(state, snapshots, sweep)
    blocks.unpersist()
    out = None
    for sweep, drawn in kept:
        got = drawn.select("sf", "lfs", "used_beta", "used_means", "counts", "fits").mapInArrow(_told(sweep), GIBBS)
        out = got if out is None else out.unionByName(got)
    return spark.createDataFrame([], GIBBS) if out is None else out


def _told(sweep: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                counts, fits = np.frombuffer(r["counts"], np.int64).reshape(2, -1), _floats(r["fits"])
                mean = [float(f / n.sum()) if n.sum() else float("nan") for f, n in zip(fits, counts, strict=True)]
                rows = zip(r["lfs"], _floats(r["used_beta"]).tolist(), counts[1].tolist(), _floats(r["used_means"], len(r["lfs"]), -1).tolist(), strict=True)
                yield _arrow([(sweep, r["sf"], lf, b, n, m, mean[1], mean[0]) for lf, b, n, m in rows], GIBBS)

    return run


# -- documents that mix topics ---------------------------------------------------------------------------------------------

_TOPIC_STATE = "sf string, lfs array<string>, beta binary, means binary"
_TOPIC_BLOCK = "sf string, block long, ids binary, docs array<string>, topics binary, drawn binary, joint double, n long, counts binary, fits binary, totals binary, lfs array<string>, beta binary, means binary"


def draw_mixture(doc: str, counts: np.ndarray, topic_prior: float, *salt: int) -> np.ndarray:
    """A document's shares of topics, a Dirichlet draw made of gamma variates."""
    gamma = generator(doc, *salt).gamma(counts + topic_prior)
    return gamma / gamma.sum() if gamma.sum() > 0 else np.full(len(counts), 1 / len(counts))


def draw_topics(
    ids: np.ndarray, x: np.ndarray, topics: np.ndarray, theta: np.ndarray, beta: np.ndarray, means: np.ndarray, *salt: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(long form, topic, log joint) of each row: a long form by its topic's shares, then a topic by theta and that long form."""
    fit = likelihood(x, means, 1.0)
    lf = draws(np.log(beta[topics] + 1e-300) + fit, ids, *salt, 1)
    weight = np.log(theta + 1e-300) + np.log(beta[:, lf].T + 1e-300)
    topic = draws(weight, ids, *salt, 2)
    at = np.arange(len(ids))
    return lf, topic, weight[at, topic] + fit[at, lf]


def draw_topic_parameters(sf: str, counts: np.ndarray, totals: np.ndarray, means: np.ndarray, prior: float, *salt: int) -> tuple[np.ndarray, np.ndarray]:
    """New shares (topic, long form), and the mean vector of each long form that a row drew."""
    rng, n = generator(sf, *salt), counts.sum(axis=0)
    beta = np.stack([rng.dirichlet(c + prior) for c in counts])
    return beta, np.where(n[:, None] > 0, totals / np.maximum(n, 1)[:, None], means)


def first_topics(ids: np.ndarray, topics: int, seed: int) -> np.ndarray:
    return draws(np.zeros((len(ids), topics)), ids, seed, 0)


def first_topic_parameters(sf: str, n: int, width: int, topics: int, prior: float, seed: int) -> tuple[np.ndarray, np.ndarray]:
    rng = generator(sf, seed, 0)
    return rng.dirichlet(np.full(n, prior), topics), rng.normal(size=(n, width))


def topic_gibbs(
    examples: DataFrame, vocab: DataFrame, topics: int, sweeps: int = 50, topic_prior: float = 1.0, expansion_prior: float = 1.0, seed: int = 0
) -> tuple[DataFrame, list[float]]:
    """Gibbs sampling where each document mixes topics and each topic has its own shares of a short form's long forms.

    ``examples`` (id, doc, sf, embedding), ``vocab`` (sf, lf). A sweep counts the topics of each document and draws the
    document's mixture in a task, seeded by document and sweep; mixtures go to the blocks that hold the document's rows, which
    draw long forms and topics against their short form's parameters; new parameters follow from folded sums. Returns rows
    (id, doc, sf, lf, topic) and the mean log joint of each sweep.
    """
    spark = examples.sparkSession
    rows = examples.select("sf", F.col("id").cast("long").alias("id"), F.coalesce(F.col("doc").cast("string"), F.lit("")).alias("doc"), vectors.doubles(F.col("embedding")).alias("x"))
    width = rows.where("x is not null").select(F.size("x").alias("n")).head(1)
    width = width[0].n if width else 1
    known = vocab.where("sf is not null and lf is not null").groupBy("sf").agg(F.array_sort(F.collect_set("lf")).alias("lfs"))
    blocks, sizes = packed(rows, known.select("sf"), width, {"doc": "string"})
    most = sizes.agg(F.max("blocks")).first()[0] or 1

    def begin(sf, lfs) -> tuple:
        beta, means = first_topic_parameters(sf, len(lfs), width, topics, expansion_prior, seed)
        return sf, lfs, beta.tobytes(), means.tobytes()

    def started(sf, block, ids, doc) -> tuple:
        return sf, block, doc, first_topics(np.frombuffer(ids, np.int64), topics, seed).astype(np.int64).tobytes()

    state = materialize(_rowwise(known.join(sizes.select("sf"), "sf", "left_semi"), begin, _TOPIC_STATE), "topic-state")
    told = materialize(_rowwise(blocks.select("sf", "block", "ids", "doc"), started, "sf string, block long, docs array<string>, topics binary"), "topic-told")
    joints: list[float] = []
    for sweep in range(1, sweeps + 1):
        mixed = _mixtures(told, topics, topic_prior, seed, sweep)

        def assign(sf, block, n, ids, x, doc, lfs, beta, means, topics, theta, sweep=sweep) -> tuple:
            held, k = np.frombuffer(topics, np.int64), len(lfs)
            shares = _floats(beta, -1, k)
            name, x = np.frombuffer(ids, np.int64), _floats(x, n, -1)
            lf, topic, joint = draw_topics(name, x, held, _floats(theta, n, -1), shares, _floats(means, k, -1), seed, sweep)
            counts, totals = np.zeros(shares.shape, np.int64), np.zeros((k, x.shape[1]))
            np.add.at(counts, (topic, lf), 1)
            np.add.at(totals, lf, x)
            new = (topic.astype(np.int64).tobytes(), lf.astype(np.int64).tobytes(), float(joint.sum()), n)
            return sf, block, ids, doc, *new, counts.tobytes(), np.zeros(2).tobytes(), totals.tobytes(), lfs, beta, means

        def renew(sf, counts, fits, totals, lfs, beta, means, sweep=sweep) -> tuple:
            k = len(lfs)
            n = np.frombuffer(counts, np.int64).reshape(-1, k)
            new = draw_topic_parameters(sf, n, _floats(totals, k, -1), _floats(means, k, -1), expansion_prior, seed, sweep)
            return sf, lfs, new[0].tobytes(), new[1].tobytes()

        both = meet(blocks, state, sizes).join(mixed, ["sf", "block"])
        last = told
        told = materialize(_rowwise(both, assign, _TOPIC_BLOCK), "topic-told")
        discard(last)
        sums = folded(told.select("sf", "block", "counts", "fits", "totals", "lfs", "beta", "means"), most)
        before, state = state, materialize(_rowwise(sums, renew, _TOPIC_STATE), "topic-state")
        got = told.agg(F.sum("joint").alias("joint"), F.sum("n").alias("n")).first()
        joints.append(got.joint / got.n if got.n else float("nan"))
        discard(before)
    blocks.unpersist()
    if not sweeps:
        raise ValueError("at least one sweep")
    return told.mapInArrow(_topic_rows, "id long, doc string, sf string, lf string, topic int"), joints


def _mixtures(told: DataFrame, topics: int, topic_prior: float, seed: int, sweep: int) -> DataFrame:
    """(sf, block, topics, theta): the drawn mixtures of each block's rows, in their order."""
    rows = told.select("sf", "block", "docs", "topics").mapInArrow(_unpacked, "sf string, block long, at long, doc string, topic long")
    counts = F.array(*[F.count_if(F.col("topic") == t) for t in range(topics)])
    docs = materialize(rows.groupBy("doc").agg(counts.alias("counts"), F.count("*").alias("n")), "topic-docs")

    def draw(doc, counts, n) -> tuple:
        return doc, draw_mixture(doc, np.array(counts), topic_prior, seed, sweep).tobytes(), n

    theta = materialize(_rowwise(docs, draw, "doc string, theta binary, n long"), "topic-theta")
    discard(docs)

    def make(key: tuple, held: list[dict]) -> tuple:
        return (*key, np.array([r["topic"] for r in held], np.int64).tobytes(), b"".join([r["theta"] for r in held]))

    return _grouped(join_hot(rows, theta, ["doc"]).drop("doc"), ["sf", "block"], ["at"], make, "sf string, block long, topics binary, theta binary")


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for r in batch.to_pylist():
            topics = np.frombuffer(r["topics"], np.int64).tolist()
            rows = [(r["sf"], r["block"], i, d, t) for i, (d, t) in enumerate(zip(r["docs"], topics, strict=True))]
            yield _arrow(rows, "sf string, block long, at long, doc string, topic long")


def _topic_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for r in batch.select(["sf", "ids", "docs", "topics", "drawn", "lfs"]).to_pylist():
            ids, topics, lf = (np.frombuffer(r[c], np.int64).tolist() for c in ("ids", "topics", "drawn"))
            rows = [(i, d, r["sf"], r["lfs"][k], t) for i, d, k, t in zip(ids, r["docs"], lf, topics, strict=True)]
            yield _arrow(rows, "id long, doc string, sf string, lf string, topic int")
