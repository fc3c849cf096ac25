import math
import random

import numpy as np
import pytest

from glossa.llm import toxicity as T
from glossa.llm.labelled import held_out


def corpus(n=400, seed=4):
    rng = random.Random(seed)
    vocab = ["".join(rng.choices("aeiorstn", k=rng.randrange(2, 8))) for _ in range(300)]
    docs, labels = [], []
    for i in range(n):
        words, toxic = rng.choices(vocab, k=rng.randrange(5, 120)), int(rng.random() < 0.3)
        for _ in range(rng.randrange(2, 5) if toxic else 0):
            words.insert(rng.randrange(len(words)), "grumbel" + rng.choice(["", "o", "ung", "est"]))
        docs.append((i, " ".join(words)))
        labels.append((i, 1, toxic))
    return docs, labels


@pytest.fixture(scope="module")
def fitted(spark):
    docs, labels = corpus()
    d = spark.createDataFrame(docs, "doc_id long, text string")
    ls = spark.createDataFrame(labels + labels[:3] + [(None, 1, 1), (3, 1, None)], "doc_id long, quality int, toxic int")
    return d, dict((i, t) for i, _, t in labels), T.fit(d, ls)


def test_held_out_accuracy(spark, fitted):
    docs, truth, model = fitted
    got = T.score(docs, model).withColumn("held", held_out("id")).collect()
    assert len(got) == len(truth) and all(0 <= r.score <= 1 for r in got)
    held = [r for r in got if r.held]
    assert sum((r.score >= T.THRESHOLD) == truth[r.id] for r in held) / len(held) > 0.93


def test_odd_rows_and_clashing_columns(spark, fitted):
    _, _, model = fitted
    rows = [(1, None), (1, None), (None, ""), (2, "grumbel " * 20000), (3, "gr#u" * 9)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as id", "2 as score", "3 as toxic")
    got = T.score(df, model).collect()
    assert len(got) == 5 and all(0 <= r.score <= 1 for r in got)
    assert {r.score for r in got if r.id == 1} == {r.score for r in got if r.id is None}
    assert T.score(df.limit(0), model).count() == 0


def test_too_few_labels(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert [r.score for r in T.score(df, T.fit(df, none)).collect()] == [0.0, 0.0]


def test_hidden_words_and_nearness():
    token = T.Token({"idiot": 5.0})
    plain, hidden, clean = (T.features(t, token) for t in ("you idiot", "you 1d10t", "you friend"))
    assert plain[1] == hidden[1] > clean[1] and hidden[15] == 1 and plain[9] == 1 and clean[9] == T.FAR


def test_isotonic_matches_least_squares():
    rng = np.random.default_rng(0)
    x = rng.integers(0, 12, 60).astype(float)
    y = (rng.random(60) < x / 12).astype(float)
    at, share = T.isotonic(x, y)
    assert (np.diff(share) >= -1e-12).all()
    # min-max form of isotonic regression
    for i, v in enumerate(at):
        best = max(min(y[(x >= lo) & (x <= hi)].mean() for hi in at[i:]) for lo in at[: i + 1])
        assert abs(share[i] - best) < 1e-9, v


def test_lexicon_matches_brute_force(spark):
    """Counts and weights of every term against a loop over documents."""
    docs, labels = corpus(150)
    rows = [(i, text, t, i % T.FOLDS) for (i, text), (_, _, t) in zip(docs, labels, strict=True)]
    df = spark.createDataFrame(rows, "id long, text string, label int, fold int")
    terms, table = T.counts_table(T.term_counts(df, T.candidate_terms(df)))
    toxic, clean = sum(r[2] for r in rows if r[3] != 2), sum(not r[2] for r in rows if r[3] != 2)
    got = T.lexicon(terms, table, [f for f in range(T.FOLDS) if f != 2], toxic, clean)
    sets = [({t for w in text.split() for t in [w, *[w[:k] + "~" for k in T.PREFIXES if len(w) > k]]}, label, fold) for _, text, label, fold in rows]
    want = {}
    for term in {t for s, label, _ in sets if label for t in s}:
        a = sum(term in s for s, label, fold in sets if label and fold != 2)
        b = sum(term in s for s, label, fold in sets if not label and fold != 2)
        bound = math.log((a + 0.5) / (toxic + 1)) - math.log((b + 0.5) / (clean + 1)) - 1.64 * math.sqrt(1 / (a + 0.5) + 1 / (b + 0.5))
        if a >= 2 and round(bound, 6) > 0:
            want[term] = round(bound, 6)
    assert got.keys() == want.keys() and all(abs(got[t] - want[t]) < 2e-6 for t in want) and "grumbel" in want


def test_scores_match_a_loop_over_texts(spark, fitted):
    docs, _, model = fitted
    token = T.Token(model.words)
    for r in T.score(docs.limit(40), model).join(docs.withColumnRenamed("doc_id", "id"), "id").collect():
        x = T.features(r.text, token)
        raw = model.trees.base
        for feature, cut, value in model.trees.trees:
            node = 0
            while node < len(feature):
                node = 2 * node + 1 + int(x[feature[node]] > cut[node])
            raw += value[node - len(feature)]
        want = 0.999 * np.interp(raw, model.at, model.share) + 0.001 / (1 + math.exp(-raw))
        assert abs(r.score - want) < 1e-9


def test_repeated_ids_stay_within_the_sample(spark):
    docs, labels = corpus(60)
    d = spark.createDataFrame(docs + [(0, docs[0][1])] * 200 + [(0, "another text")] * 50, "doc_id long, text string")
    ls = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    once = T.fit(spark.createDataFrame(docs[1:] + [(0, min(docs[0][1], "another text"))], "doc_id long, text string"), ls)
    assert T.fit(d, ls).words == once.words
