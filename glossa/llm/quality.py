"""Quality classifier by positive-unlabelled learning with the non-negative risk (Kiryo et al., 2017).

Trusted positives are training rows of ``labels`` with quality 1; the unlabelled text is a sample of the web documents
themselves, whose labels are not looked at. With prior pi, positive risk R_P+ and R_P- (as if negative), and unlabelled
risk R_U-, training minimises pi * R_P+ + max(0, R_U- - pi * R_P-): where the second part of a batch turns negative, the
step goes against it instead. The class prior comes from positives and unlabelled rows alone: where a scorer that tells
them apart is surest, unlabelled mass over positive mass is least, and that is the prior (best bin estimation, Garg et
al., 2021; scores out of fold, within ``PRIOR`` bounds). Labelled negatives are never looked at. The scorer is a small numpy network over language-free features of a whole text: character classes,
repetition of words, neighbours, triples and lines, word lengths, token endings.

``fit`` takes at most ``positives`` and ``unlabelled`` ids, those with the lowest hashes, and one text of each; only
their features reach the driver. The bound on unlabelled rows is a departure: it holds the driver's memory, and scores,
features and verdicts cover all rows.

Defined cases: null text counts as empty and gets a score like any other; null, held-out or unmatched labels are not
learned from; of several texts of one id the first in order is; without a positive every score is the lowest prior; repeated rows stay repeated; an empty table gives an empty
result; columns other than id and text are not looked at.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossa.llm.labelled import hashed_sample, held_out, training_labels

POSITIVES, UNLABELLED, PRIOR, THRESHOLD = 8_000, 12_000, (0.05, 0.98), 0.5

#: Class of each UTF-8 byte: 0 other, 1 lower, 2 upper, 3 digit, 4 white space, 5 sentence marks, 6 other signs, 7 high.
_CLASS = np.zeros(256, np.uint8)
_CLASS[ord("a") : ord("z") + 1], _CLASS[ord("A") : ord("Z") + 1], _CLASS[ord("0") : ord("9") + 1] = 1, 2, 3
_CLASS[[9, 10, 11, 12, 13, 32]] = 4
_CLASS[list(b".,;:!?'\"()-")] = 5
_CLASS[list(b"#$%&*+/<=>@[\\]^_`{|}~")] = 6
_CLASS[128:] = 7


def features(text: str | None) -> np.ndarray:
    """Dense features of one whole text; all zero for an empty one but for the size."""
    raw = (text or "").encode("utf-8", "replace")
    share = np.bincount(_CLASS[np.frombuffer(raw, np.uint8)], minlength=8) / max(1, len(raw))
    words = raw.split()
    n = max(1, len(words))
    counts = Counter(words)
    lines = [x for x in raw.split(b"\n") if x]
    ends = Counter(w[-1] for w in words)
    signs = sum(k for b, k in ends.items() if _CLASS[b] == 6)
    upper = len([w for w in words if len(w) > 1 and w.isupper()])
    lone = len([w for w in words if len(w) == 1 and _CLASS[w[0]] in (5, 6)])
    size = math.log1p(len(words))
    # distinct words against what a text of this size has by a power law
    return np.array([
        *share[1:], size,
        len(counts) / n, len(counts) / n**0.85, max(counts.values(), default=0) / n,
        sum(map(eq, words, words[1:])) / n, sum(map(eq, words, words[2:])) / n,
        len(set(zip(words, words[1:], words[2:], strict=False))) / max(1, len(words) - 2) if len(words) > 2 else 1.0,
        len(set(lines)) / max(1, len(lines)) if lines else 1.0, len(lines) / n,
        len(raw) / n, signs / n, ends[ord("!")] / n, ends[ord(".")] / n, upper / n, lone / n,
        raw.count(b"|") / n, raw.count(b"http") / n, (raw.count(b"{") + raw.count(b";")) / n,
    ])


class Network:
    """One hidden layer, trained on the non-negative positive-unlabelled risk with the sigmoid loss."""

    def __init__(self, hidden: int = 16, rate: float = 0.005, epochs: int = 60, batch: int = 512, seed: int = 7) -> None:
        self.hidden, self.rate, self.epochs, self.batch, self.seed = hidden, rate, epochs, batch, seed

    def fit(self, positive: np.ndarray, unlabelled: np.ndarray, prior: float) -> Network:
        rng = np.random.default_rng(self.seed)
        both = np.concatenate([positive, unlabelled])
        self.mean, self.scale = both.mean(axis=0), both.std(axis=0) + 1e-6
        p, u = self._standard(positive), self._standard(unlabelled)
        d = both.shape[1]
        w = [rng.normal(0, 1 / math.sqrt(d), (d, self.hidden)), np.zeros(self.hidden)]
        w += [rng.normal(0, 1 / math.sqrt(self.hidden), self.hidden), np.zeros(1)]
        m, v, t = [np.zeros_like(a) for a in w], [np.zeros_like(a) for a in w], 0
        steps = max(1, len(u) // self.batch)
        for _ in range(self.epochs):
            order_u, order_p = rng.permutation(len(u)), rng.permutation(len(p))
            for s in range(steps):
                bu = u[order_u[s * len(u) // steps : (s + 1) * len(u) // steps]]
                bp = p[order_p[np.arange(s * len(p) // steps, max((s + 1) * len(p) // steps, s * len(p) // steps + 1)) % len(p)]]
                x = np.concatenate([bp, bu])
                h = np.tanh(x @ w[0] + w[1])
                f = h @ w[2] + w[3]
                z = 1 / (1 + np.exp(-f))
                dz = z * (1 - z)
                k = len(bp)
                # loss of calling x positive is 1 - z, of calling it negative z
                negative = z[k:].mean() - prior * z[:k].mean()
                g = np.zeros(len(x))
                if negative >= 0:
                    g[:k] = -2 * prior * dz[:k] / k
                    g[k:] = dz[k:] / len(bu)
                else:
                    g[:k] = prior * dz[:k] / k
                    g[k:] = -dz[k:] / len(bu)
                gh = np.outer(g, w[2]) * (1 - h**2)
                grads = [x.T @ gh + 1e-5 * w[0], gh.sum(axis=0), h.T @ g, np.array([g.sum()])]
                t += 1
                for i, gr in enumerate(grads):
                    m[i] = 0.9 * m[i] + 0.1 * gr
                    v[i] = 0.999 * v[i] + 0.001 * gr**2
                    w[i] -= self.rate * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.999**t)) + 1e-8)
        self.w = w
        return self

    def _standard(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -6, 6)

    def score(self, x: np.ndarray) -> np.ndarray:
        w = self.w
        f = np.tanh(self._standard(x) @ w[0] + w[1]) @ w[2] + w[3]
        return 1 / (1 + np.exp(-f))


class Model:
    def __init__(self, network: Network | None, prior: float) -> None:
        self.network, self.prior = network, prior

    def score(self, texts: list[str | None]) -> np.ndarray:
        if self.network is None or not texts:
            return np.full(len(texts), self.prior)
        return self.network.score(np.stack([features(t) for t in texts]))


def _feature_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [features(t).tolist() for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [batch.column("id"), batch.column("trusted"), pa.array(rows, pa.list_(pa.float64()))], ["id", "trusted", "x"]
        )


def class_prior(positive: np.ndarray, unlabelled: np.ndarray, folds: int = 2, doubt: float = 0.1) -> float:
    """The share of positives among unlabelled rows, from features of both."""
    if min(len(positive), len(unlabelled)) < 2 * folds:
        return PRIOR[1]
    p, u = np.zeros(len(positive)), np.zeros(len(unlabelled))
    for fold in range(folds):
        at_p, at_u = np.arange(len(p)) % folds == fold, np.arange(len(u)) % folds == fold
        net = Network(epochs=30, seed=fold).fit(positive[~at_p], unlabelled[~at_u], 0.5)
        p[at_p], u[at_u] = net.score(positive[at_p]), net.score(unlabelled[at_u])
    cuts = np.unique(p)
    mass_p = 1 - np.searchsorted(np.sort(p), cuts, "left") / len(p)
    mass_u = 1 - np.searchsorted(np.sort(u), cuts, "left") / len(u)
    slack = math.sqrt(math.log(4 / doubt) / 2) * (len(u) ** -0.5 + len(p) ** -0.5)
    best = ((mass_u + slack) / mass_p).argmin()
    return float(min(max(mass_u[best] / mass_p[best], PRIOR[0]), PRIOR[1]))


def fit(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", positives: int = POSITIVES, unlabelled: int = UNLABELLED
) -> Model:
    known = training_labels(labels, "quality")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    trusted = hashed_sample(known.where("label = 1").select("id"), positives).withColumn("trusted", F.lit(True))
    web = hashed_sample(rows.select("id").where(~held_out("id")).distinct(), unlabelled).withColumn("trusted", F.lit(False))
    chosen = trusted.union(web)  # at most positives + unlabelled ids: broadcast
    sample = rows.join(F.broadcast(chosen), "id").groupBy("id", "trusted").agg(F.min("text").alias("text"))
    table = sample.select("id", "text", "trusted").mapInArrow(_feature_batches, "id long, trusted boolean, x array<double>")
    table = table.toPandas().sort_values(["id", "trusted"], kind="stable")
    x = [np.stack(part.x) if len(part) else None for part in (table[table.trusted], table[~table.trusted])]
    if x[0] is None or x[1] is None:
        return Model(None, PRIOR[0])
    prior = class_prior(*x)
    return Model(Network().fit(x[0], x[1], prior), prior)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) for every row of ``docs``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                got = shared.value.score(part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(got, pa.float64())], ["id", "score"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "id long, score double")


def keep(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that the model doesn't reject, with the columns they came with."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                texts = part.column(part.schema.get_field_index(text_col)).to_pylist()
                yield part.filter(pa.array(shared.value.score(texts) >= THRESHOLD))

    return docs.mapInArrow(run, docs.schema)
