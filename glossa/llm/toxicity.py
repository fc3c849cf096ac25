"""Toxicity: gradient-boosted trees over dense features, calibrated by isotonic regression.

Features of a whole text: densities and strengths of lexicon words, how near they stand to second-person words, the
shares of capitals and punctuation, and rates of obfuscated tokens (letters mixed with digits or signs, stretched
letters). The lexicon is learned too: words and word beginnings whose document counts, in the labelled sample, lean
to toxic documents beyond chance. Features of a labelled document are always taken with the lexicon of the folds of
the sample that it isn't in, and the calibration is fitted on scores from trees that haven't seen the document.

``fit`` takes at most ``sample_ids`` labelled ids, those with the lowest hashes, and one text of each; everything else covers
all rows. Only the sample's feature rows and the counts of terms that at least two of its toxic documents hold reach the
driver: the sample bounds both, and no term is cut by number.

Defined cases: null text counts as empty and gets a score like any other; labels that are null, held out or without
a document are not learned from; with fewer than ``LEAST`` labels of a class every score is the share of toxic
labels (0 without labels); repeated rows stay repeated; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossa.llm.labelled import hashed_sample, training_labels
from glossa.plans.materialize import materialize

SAMPLE, LEAST, FOLDS, THRESHOLD = 16_000, 2, 5, 0.7
PREFIXES = (4, 5, 6, 7)
STRONG, NEAR, FAR, KEPT = 2.5, 5, 50, 300_000
FLUSH = 50_000
#: Second-person words of the corpus languages.
SECOND_PERSON = frozenset(
    "you your yours yourself yourselves u ur ya tu te toi ton ta tes vous votre vos du dich dir dein deine deinen "
    "deiner ihr euch euer eure sie tú ti tus usted ustedes vosotros vuestro vuestra".split()
)
LEET = str.maketrans("013457@$!", "oieastasi")
_EDGES = re.compile(r"^\W+|\W+$")
_PARTS = re.compile(r"\w+")
_STRETCH = re.compile(r"(.)\1{2,}")


def terms_of(word: str) -> Iterator[str]:
    """Lexicon keys of a lower-case word: the word, and its beginnings of each length (with a trailing ~)."""
    yield word
    for k in PREFIXES:
        if len(word) > k:
            yield word[:k] + "~"


class Token(dict):
    """Token to row of a table of what it is worth; tokens repeat, so a bounded number of them is kept."""

    def __init__(self, lexicon: dict[str, float]) -> None:
        super().__init__()
        self.lexicon, self.rows = lexicon, np.zeros((1 << 14, 5))

    def __missing__(self, token: str) -> int:
        n = len(self)
        if n == len(self.rows):
            self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
        self.rows[n] = self.judge(token)
        self[token] = n
        return n

    def __call__(self, text: str) -> np.ndarray:
        """One row of ``judge`` for each token of a text."""
        if len(self) > KEPT:
            self.clear()
        tokens = text.split()
        at = np.fromiter(map(self.__getitem__, tokens), np.int64, len(tokens))
        return self.rows[at]

    def judge(self, token: str) -> tuple[float, bool, bool, bool, int]:
        """(lexicon weight, second person, obfuscated, hit only when cleaned, capitals)."""
        low = token.lower()
        core = low if low.isalpha() else _EDGES.sub("", low)
        known, weight = self.lexicon.get, 0.0
        for part in (core,) if core.isalpha() else _PARTS.findall(low):
            weight = max(weight, known(part, 0.0), *[known(part[:k] + "~", 0.0) for k in PREFIXES if len(part) > k])
        mixed = not core.isalpha() and any(c.isalpha() for c in core) and not core.replace("'", "").isalpha()
        stretched = bool(_STRETCH.search(core))
        hidden = 0.0
        if mixed or stretched:
            clean = re.sub(r"\W|_", "", core.translate(LEET))
            for form in {clean, _STRETCH.sub(r"\1", clean), _STRETCH.sub(r"\1\1", clean)}:
                hidden = max([hidden, *(self.lexicon.get(t, 0.0) for t in terms_of(form))])
        return max(weight, hidden), core in SECOND_PERSON, mixed or stretched, hidden > weight, sum(map(str.isupper, token))


N_FEATURES = 17


def features(text: str | None, token: Token) -> np.ndarray:
    """Dense features of one whole text."""
    text = text or ""
    t = token(text)
    n, chars = max(1, len(t)), max(1, len(text))
    weight, second = (t[:, 0], t[:, 1] > 0) if len(t) else (np.zeros(0), np.zeros(0, bool))
    strong, near, least = weight >= STRONG, 0, FAR
    if strong.any() and second.any():
        hits, you = np.flatnonzero(strong), np.flatnonzero(second)
        right = np.searchsorted(you, hits)
        gap = np.minimum(
            np.abs(you[np.minimum(right, len(you) - 1)] - hits), np.abs(you[np.maximum(right - 1, 0)] - hits)
        )
        near, least = int((gap <= NEAR).sum()), int(min(FAR, gap.min()))
    hits = np.sort(weight[weight > 0])[::-1]
    top = hits[:3] if len(hits) else np.zeros(min(1, len(t)))
    marks = sum(map(text.count, ".,;:!?*#%&$|@"))
    return np.array([
        strong.sum() / n, math.log1p(strong.sum()), (weight > 0).sum() / n, weight.sum() / n, math.log1p(weight.sum()),
        top[0] if len(top) else 0, top.sum(), second.sum() / n, near / n, least,
        t[:, 4].sum() / chars, marks / chars, text.count("!") / chars, text.count("?") / chars, t[:, 2].sum() / n,
        t[:, 3].sum(), math.log1p(len(t)),
    ])


# -- lexicon ---------------------------------------------------------------------------------------------------------


def term_counts(sample: DataFrame, wanted: frozenset[str] | None = None) -> DataFrame:
    """(term, fold, label, n) over a sample of (id, text, label, fold): in how many documents each term stands.

    Only ``wanted`` terms, if given. Counts are added up in the task before they are shuffled.
    """
    shared = sample.sparkSession.sparkContext.broadcast(wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out() -> pa.RecordBatch:
            terms, folds, labels = ([k[i] for k in counts] for i in range(3))
            cols = [pa.array(terms, pa.string()), pa.array(folds, pa.int32()), pa.array(labels, pa.int32()), pa.array(list(counts.values()), pa.int64())]
            return pa.RecordBatch.from_arrays(cols, ["term", "fold", "label", "n"])

        counts: Counter = Counter()
        known = shared.value
        for batch in batches:
            for text, label, fold in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                terms = {t for w in set(_PARTS.findall((text or "").lower())) for t in terms_of(w)}
                counts.update((t, fold, label) for t in (terms if known is None else terms & known))
                if len(counts) > FLUSH:
                    yield out()
                    counts.clear()
        yield out()

    got = sample.select("text", "label", "fold").mapInArrow(run, "term string, fold int, label int, n long")
    return got.groupBy("term", "fold", "label").agg(F.sum("n").alias("n"))


def candidate_terms(sample: DataFrame) -> frozenset[str]:
    """Terms of at least two toxic documents of the sample."""
    toxic = term_counts(sample.where("label = 1")).groupBy("term").agg(F.sum("n").alias("n")).where("n >= 2")
    return frozenset(r.term for r in toxic.select("term").collect())


def counts_table(counts: DataFrame) -> tuple[list[str], np.ndarray]:
    """Terms in order, and for each the number of documents by fold and label (0, 1)."""
    cells = [F.sum(F.when((F.col("fold") == f) & (F.col("label") == c), F.col("n")).otherwise(0)).alias(f"n{f}_{c}") for f in range(FOLDS) for c in (0, 1)]
    got = counts.groupBy("term").agg(*cells).toPandas().sort_values("term", kind="stable")
    return got.term.tolist(), got.drop(columns="term").to_numpy(np.float64).reshape(-1, FOLDS, 2)


def lexicon(terms: list[str], table: np.ndarray, folds: list[int], toxic: int, clean: int) -> dict[str, float]:
    """Terms to the lower bound of their log odds ratio between toxic and clean documents of some folds."""
    b, a = table[:, folds].sum(axis=1).T if len(terms) else np.zeros((2, 0))
    ratio = np.log((a + 0.5) / (toxic + 1)) - np.log((b + 0.5) / (clean + 1))
    bound = np.round(ratio - 1.64 * np.sqrt(1 / (a + 0.5) + 1 / (b + 0.5)), 6)
    return {terms[i]: float(bound[i]) for i in np.flatnonzero((a >= 2) & (bound > 0))}


# -- trees and calibration -------------------------------------------------------------------------------------------


class Boosted:
    """Gradient-boosted trees of one depth on binned features, with logistic loss and Newton leaves."""

    def __init__(self, trees: int = 60, depth: int = 3, rate: float = 0.15, bins: int = 32, lam: float = 1.0) -> None:
        self.n_trees, self.depth, self.rate, self.bins, self.lam = trees, depth, rate, bins, lam
        self.trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def fit(self, x: np.ndarray, y: np.ndarray) -> Boosted:
        self.cuts = [np.unique(np.quantile(c, np.linspace(0, 1, self.bins + 1)[1:-1])) for c in x.T]
        binned = np.stack([np.searchsorted(c, v, "left") for c, v in zip(self.cuts, x.T, strict=True)], axis=1)
        share = min(max(y.mean(), 1e-6), 1 - 1e-6)
        self.base = math.log(share / (1 - share))
        score = np.full(len(y), self.base)
        for _ in range(self.n_trees):
            p = 1 / (1 + np.exp(-score))
            score += self._grow(x, binned, p - y, np.maximum(p * (1 - p), 1e-9))
        return self

    def _grow(self, x: np.ndarray, binned: np.ndarray, g: np.ndarray, h: np.ndarray) -> np.ndarray:
        nodes = 2**self.depth - 1
        feature, cut = np.zeros(nodes, np.int64), np.full(nodes, np.inf)
        where = np.zeros(len(g), np.int64)
        for node in range(nodes):
            rows = np.flatnonzero(where == node)
            best = 1e-9
            if len(rows):
                gs, hs = g[rows], h[rows]
                whole = gs.sum() ** 2 / (hs.sum() + self.lam)
                for f, cuts in enumerate(self.cuts):
                    if not len(cuts):
                        continue
                    b = binned[rows, f]
                    gl = np.cumsum(np.bincount(b, gs, len(cuts) + 1))[:-1]
                    hl = np.cumsum(np.bincount(b, hs, len(cuts) + 1))[:-1]
                    gain = gl**2 / (hl + self.lam) + (gs.sum() - gl) ** 2 / (hs.sum() - hl + self.lam) - whole
                    gain[(hl < 1e-6) | (hs.sum() - hl < 1e-6)] = -1
                    i = int(gain.argmax())
                    if gain[i] > best:
                        best, feature[node], cut[node] = gain[i], f, cuts[i]
                where[rows] = 2 * node + 1 + (x[rows, feature[node]] > cut[node])
        leaf = where - nodes
        gsum, hsum = np.bincount(leaf, g, nodes + 1), np.bincount(leaf, h, nodes + 1)
        value = -self.rate * gsum / (hsum + self.lam)
        self.trees.append((feature, cut, value))
        return value[leaf]

    def raw(self, x: np.ndarray) -> np.ndarray:
        out, rows = np.full(len(x), self.base), np.arange(len(x))
        for feature, cut, value in self.trees:
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[rows, feature[node]] > cut[node])
            out += value[node - len(feature)]
        return out


def isotonic(score: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pooled adjacent violators: ascending scores and the non-decreasing shares at them."""
    xs, inverse = np.unique(score, return_inverse=True)
    total, weight = np.bincount(inverse, y), np.bincount(inverse)
    stack: list[list[float]] = []
    for i in range(len(xs)):
        stack.append([total[i], weight[i], i])
        while len(stack) > 1 and stack[-2][0] * stack[-1][1] >= stack[-1][0] * stack[-2][1]:
            t, w, _ = stack.pop()
            stack[-1][0] += t
            stack[-1][1] += w
    fitted = np.empty(len(xs))
    ends = [int(s[2]) for s in stack[1:]] + [len(xs)]
    for (t, w, start), end in zip(stack, ends, strict=True):
        fitted[int(start) : end] = t / w
    return xs, fitted


class Model:
    """Lexicon, trees and calibration; ``score`` is increasing in the trees' sum, ties of the calibration included."""

    def __init__(self, words: dict[str, float], trees: Boosted | None, at: np.ndarray, share: np.ndarray) -> None:
        self.words, self.trees, self.at, self.share = words, trees, at, share

    def score(self, texts: list[str | None], token: Token) -> np.ndarray:
        if self.trees is None or not texts:
            return np.full(len(texts), self.share[0])
        raw = self.trees.raw(np.stack([features(t, token) for t in texts]))
        # a thousandth is left to the trees themselves, to order what calibration makes equal
        return 0.999 * np.interp(raw, self.at, self.share) + 0.001 / (1 + np.exp(-raw))


def _with_features(sample: DataFrame, words: Callable[[int], dict[str, float]]) -> pd.DataFrame:
    """The sample's labels and features, each row with the lexicon of the other folds. The sample bounds them."""
    given = {fold: words(fold) for fold in range(FOLDS)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        token = {fold: Token(given[fold]) for fold in given}
        for batch in batches:
            folds = batch.column("fold").to_pylist()
            rows = [features(t, token[f]).tolist() for t, f in zip(batch.column("text").to_pylist(), folds, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in ("id", "label", "fold")] + [pa.array(rows, pa.list_(pa.float64()))],
                ["id", "label", "fold", "x"],
            )

    got = sample.mapInArrow(run, "id long, label int, fold int, x array<double>").toPandas()
    return got.sort_values(["id", "label"], kind="stable").reset_index(drop=True)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample_ids: int = SAMPLE) -> Model:
    chosen = hashed_sample(training_labels(labels, "toxic"), sample_ids).withColumn(
        "fold", (F.crc32(F.concat(F.lit("fold "), F.col("id").cast("string")).cast("binary")) % FOLDS).cast("int")
    )
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    sample = rows.join(F.broadcast(chosen), "id").groupBy("id", "label", "fold").agg(F.min("text").alias("text"))
    sample = materialize(sample, "toxicity-sample")
    n = Counter({(r.fold, r.label): r["count"] for r in sample.groupBy("fold", "label").count().collect()})
    toxic, clean = (sum(n[f, c] for f in range(FOLDS)) for c in (1, 0))
    if min(toxic, clean) < LEAST:
        share = toxic / (toxic + clean) if toxic + clean else 0.0
        return Model({}, None, np.zeros(1), np.array([share]))
    terms, counts = counts_table(term_counts(sample, candidate_terms(sample)))

    def without(fold: int) -> dict[str, float]:
        others = [f for f in range(FOLDS) if f != fold]
        return lexicon(terms, counts, others, toxic - n[fold, 1], clean - n[fold, 0])

    table = _with_features(sample, without)
    x, y, fold = np.stack(table.x), table.label.to_numpy(np.float64), table.fold.to_numpy()
    unseen = np.zeros(len(y))
    for f in range(FOLDS):
        if (fold == f).any() and (fold != f).any():
            unseen[fold == f] = Boosted().fit(x[fold != f], y[fold != f]).raw(x[fold == f])
    at, share = isotonic(unseen, y)
    return Model(lexicon(terms, counts, [*range(FOLDS)], toxic, clean), Boosted().fit(x, y), at, share)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) for every row of ``docs``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        token = Token(shared.value.words)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                got = shared.value.score(part.column(1).to_pylist(), token)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(got, pa.float64())], ["id", "score"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "id long, score double")


def keep(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that the model doesn't reject, with the columns they came with."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        token = Token(shared.value.words)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                texts = part.column(part.schema.get_field_index(text_col)).to_pylist()
                yield part.filter(pa.array(shared.value.score(texts, token) < THRESHOLD))

    return docs.mapInArrow(run, docs.schema)
