import math
import random

import numpy as np
import pytest

from glossa.llm import quality as Q
from glossa.llm.labelled import held_out


def corpus(n=600, seed=3):
    rng = random.Random(seed)
    vocab = ["".join(rng.choices("aeiorstn", k=rng.randrange(2, 8))) for _ in range(300)]
    docs, labels = [], []
    for i in range(n):
        words, good = rng.choices(vocab, k=rng.randrange(30, 120)), int(rng.random() < 0.7)
        if not good:
            words = [w for w in words[:20] for _ in range(5)] if i % 2 else [w.upper() + "!!" for w in words]
        docs.append((i, " ".join(words)))
        if i % 3:
            labels.append((i, good, 0))
    return docs, labels


def test_held_out_accuracy_and_odd_rows(spark):
    docs, labels = corpus()
    d = spark.createDataFrame(docs + [(None, None), (5, None)], "doc_id long, text string").selectExpr(
        "*", "1 as id", "true as trusted", "2 as label"
    )
    ls = spark.createDataFrame(labels + labels[:4] + [(None, 1, 1), (3, None, 1)], "doc_id long, quality int, toxic int")
    model = Q.fit(d, ls)
    got = Q.score(d, model).withColumn("held", held_out("id")).collect()
    assert len(got) == len(docs) + 2 and all(0 <= r.score <= 1 for r in got)
    truth = {i: q for i, q, _ in labels}
    held = [r for r in got if r.held and r.id in truth]
    assert sum((r.score >= 0.5) == truth[r.id] for r in held) / len(held) > 0.95
    assert Q.score(d.limit(0), model).count() == 0
    again = Q.fit(d, ls)
    x = np.stack([Q.features(t) for _, t in docs[:50]])
    assert np.allclose(model.network.score(x), again.network.score(x))


def test_without_labels(spark):
    d = spark.createDataFrame([(1, "a"), (2, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert [r.score for r in Q.score(d, Q.fit(d, none)).collect()] == [Q.PRIOR[0]] * 2


def test_risk_never_rewards_overfitting():
    """Unlabelled data that are the positives themselves must not be driven to the negative class."""
    x = np.random.default_rng(1).normal(size=(300, 4))
    net = Q.Network(epochs=30).fit(x, x, 0.9)
    assert net.score(x).mean() > 0.6


def test_features_are_finite():
    for t in (None, "", " ", "a", "\n\n", "x" * 10**6, "|" * 50):
        assert np.isfinite(Q.features(t)).all()


@pytest.mark.parametrize("prior", [0.3, 0.6, 0.85])
def test_class_prior_of_known_mixtures(prior):
    rng = np.random.default_rng(int(prior * 100))
    good = lambda n: rng.normal(size=(n, 6)) + [2, 1, 0, 0, 0, 0]
    bad = lambda n: rng.normal(size=(n, 6)) * 1.5 - [2, 1, 0, 1, 0, 0]
    n = 4000
    mixed = np.concatenate([good(int(n * prior)), bad(n - int(n * prior))])
    rng.shuffle(mixed)
    assert abs(Q.class_prior(good(1500), mixed) - prior) < 0.08


def test_negatives_are_not_looked_at(spark):
    docs, labels = corpus(200)
    d = spark.createDataFrame(docs + docs[:5] + [(1, "another text of this id")], "doc_id long, text string")
    models = [Q.fit(d, spark.createDataFrame(ls, "doc_id long, quality int, toxic int")) for ls in (labels, [x for x in labels if x[1]])]
    assert models[0].prior == models[1].prior


def slow_features(text):
    """Some of the features by their definition."""
    words = (text or "").split()
    raw = (text or "").encode()
    n = max(1, len(words))
    triples = {tuple(words[i : i + 3]) for i in range(len(words) - 2)}
    return {
        0: sum(97 <= b <= 122 for b in raw) / max(1, len(raw)), 8: len(set(words)) / n, 10: max([words.count(w) for w in words], default=0) / n,
        11: sum(a == b for a, b in zip(words, words[1:])) / n, 13: len(triples) / max(1, len(words) - 2) if len(words) > 2 else 1.0, 16: len(raw) / n,
    }


def test_features_match_their_definition():
    for _, text in corpus(60)[0]:
        x = Q.features(text)
        assert all(abs(x[i] - v) < 1e-12 for i, v in slow_features(text).items())


def test_scores_match_a_loop_over_texts(spark):
    docs, labels = corpus(120)
    d = spark.createDataFrame(docs, "doc_id long, text string")
    model = Q.fit(d, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    got = {r.id: r.score for r in Q.score(d, model).collect()}
    net = model.network
    for i, text in docs:
        x = [min(6, max(-6, (v - m) / s)) for v, m, s in zip(Q.features(text), net.mean, net.scale, strict=True)]
        hidden = [math.tanh(sum(a * b for a, b in zip(x, net.w[0][:, j], strict=True)) + net.w[1][j]) for j in range(net.hidden)]
        f = sum(a * b for a, b in zip(hidden, net.w[2], strict=True)) + net.w[3][0]
        assert abs(got[i] - 1 / (1 + math.exp(-f))) < 1e-9
