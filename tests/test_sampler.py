"""The samplers against walks through all rows that take the same draws, and runs that stop and go on."""

from collections import defaultdict

import numpy as np
import pytest

from glossa.operators import sampler as S


@pytest.fixture
def small_blocks(monkeypatch):
    monkeypatch.setattr(S, "BLOCK", 8)
    monkeypatch.setattr(S, "FAN", 2)


def examples(seed=0, n=150):
    rng = np.random.default_rng(seed)
    return [(i, "hot" if i % 3 else "T", (rng.normal(size=4) + (3 if i % 2 else -3)).tolist(), int(i % 5 > 0)) for i in range(n)]


DATA = "id long, sf string, embedding array<double>, is_train int"
PARAMS = [(s, lf, b, [v] * 4) for s in ("hot", "T", "unused") for lf, b, v in (("hi", 0.3, 1.0), ("lo", 0.5, -1.0), ("no", 0.2, 90.0))]


def tables(spark, rows):
    odd = [(900, "strange", [0.0] * 4, 1), (901, "T", [0.0] * 3, 1), (902, "T", None, 1), (None, "T", [0.0] * 4, 1), (903, None, [0.0] * 4, 1), (904, "T", [None] * 4, 1)]
    data = spark.createDataFrame(rows + odd, DATA).repartition(5)
    return data, spark.createDataFrame([*PARAMS, PARAMS[0]], "sf string, lf string, beta double, mean array<double>")


def plain_gibbs(rows, sweeps, seed=0):
    """All rows of a short form at once, no blocks."""
    out = {}
    for sf in ("hot", "T"):
        mine = sorted(r for r in rows if r[1] == sf)
        ids, x, train = np.array([r[0] for r in mine]), np.array([r[2] for r in mine]), np.array([r[3] for r in mine])
        beta, means = np.array([p[2] for p in PARAMS[:3]]), np.array([p[3] for p in PARAMS[:3]])
        for sweep in range(1, sweeps + 1):
            logp = np.stack([[np.log(b + 1e-300) + sum(-0.5 * np.log(2 * np.pi) - 0.5 * (v - m) ** 2 for v, m in zip(row, mu, strict=True)) for b, mu in zip(beta, means, strict=True)] for row in x])
            drawn = S.draws(logp, ids, seed, sweep)
            counts = np.array([sum((drawn == k) & (train == 1)) for k in range(3)])
            totals = np.array([x[(drawn == k) & (train == 1)].sum(axis=0) for k in range(3)])
            fit = logp[np.arange(len(ids)), drawn]
            out[sf, sweep] = (beta, counts, means, fit[train == 1].mean(), fit[train == 0].mean())
            beta, means = S.draw_parameters(sf, counts, totals, means, 1.0, 0.0, 1.0, 1.0, seed, sweep)
    return out


def test_gibbs_equals_a_walk(spark, small_blocks):
    rows = examples()
    got = S.gibbs(*tables(spark, rows), sweeps=7, keep_every=3).collect()
    want = plain_gibbs(rows, 7)
    assert {(r.iter, r.sf) for r in got} == {(i, s) for i in (3, 6, 7) for s in ("hot", "T")} and len(got) == 18
    for r in got:
        beta, counts, means, fit, other = want[r.sf, r.iter]
        k = ["hi", "lo", "no"].index(r.lf)
        assert r.n == counts[k] and r.beta == pytest.approx(beta[k]) and r.mean == pytest.approx(means[k].tolist())
        assert (r.log_fit, r.validation_fit) == pytest.approx((fit, other))
    last = {(r.sf, r.lf): r.mean[0] for r in got if r.iter == 7}
    assert all(last[s, "hi"] > 2 and last[s, "lo"] < -2 and last[s, "no"] == 90.0 for s in ("hot", "T"))


def test_a_stopped_run_goes_on(spark, small_blocks, tmp_path):
    rows = examples(1)
    key = lambda df: sorted(tuple(map(str, r)) for r in df.collect())
    whole = key(S.gibbs(*tables(spark, rows), sweeps=9, keep_every=3))
    path = f"{tmp_path}/snapshots"
    S.gibbs(*tables(spark, rows), sweeps=5, snapshots=path, snapshot_every=2).collect()
    assert sorted(p.name for p in (tmp_path / "snapshots").iterdir() if p.is_dir()) == ["iter=2", "iter=4"]
    (tmp_path / "snapshots" / "iter=8").mkdir()  # a stopped write: there, but not whole
    spark.read.parquet(f"{path}/iter=4").where("sf = 'T'").write.mode("overwrite").parquet(f"{path}/iter=6")
    calls = []
    inner = S.folded
    S.folded = lambda *a: calls.append(1) or inner(*a)
    try:
        again = key(S.gibbs(*tables(spark, rows), sweeps=9, keep_every=3, snapshots=path, snapshot_every=100))
    finally:
        S.folded = inner
    assert len(calls) == 5 and again == [r for r in whole if r[0] != "3"]


def test_nothing_to_sample(spark):
    data, params = tables(spark, examples())
    assert S.gibbs(data.limit(0), params, sweeps=2).count() == 0 and S.gibbs(data, params.limit(0), sweeps=2).count() == 0


def plain_topics(rows, vocab, topics, sweeps, seed=0):
    """Row by row, one long form and one topic after the other."""
    width = len(rows[0][3])
    state = {s: S.first_topic_parameters(s, len(v), width, topics, 1.0, seed) for s, v in vocab.items()}
    topic = {r[0]: int(S.first_topics(np.array([r[0]]), topics, seed)[0]) for r in rows}
    joints = []
    for sweep in range(1, sweeps + 1):
        counts = defaultdict(lambda: np.zeros(topics, int))
        for i, doc, *_ in rows:
            counts[doc][topic[i]] += 1
        theta = {d: S.draw_mixture(str(d), c, 1.0, seed, sweep) for d, c in counts.items()}
        drawn, joint = {}, []
        for i, doc, s, x in rows:
            beta, means = state[s]
            fit = np.array([sum(-0.5 * np.log(2 * np.pi) - 0.5 * (a - m) ** 2 for a, m in zip(x, mu, strict=True)) for mu in means])
            lf = int(S.draws((np.log(beta[topic[i]] + 1e-300) + fit)[None], np.array([i]), seed, sweep, 1)[0])
            weight = np.log(theta[doc] + 1e-300) + np.log(beta[:, lf] + 1e-300)
            topic[i] = int(S.draws(weight[None], np.array([i]), seed, sweep, 2)[0])
            drawn[i] = lf
            joint.append(weight[topic[i]] + fit[lf])
        joints.append(np.mean(joint))
        for s, names in vocab.items():
            mine = [r for r in rows if r[2] == s]
            n = np.zeros((topics, len(names)), int)
            totals = np.zeros((len(names), width))
            for i, _, _, x in mine:
                n[topic[i], drawn[i]] += 1
                totals[drawn[i]] += x
            state[s] = S.draw_topic_parameters(s, n, totals, state[s][1], 1.0, seed, sweep)
    return sorted((i, str(d), s, vocab[s][drawn[i]], topic[i]) for i, d, s, _ in rows), joints


def test_topics_equal_a_walk(spark, small_blocks):
    rng = np.random.default_rng(1)
    rows = [(d, s, (rng.normal(size=3) + (4 if d % 2 else -4)).tolist()) for d in range(10) for s in ("A", "B") for _ in range(4)]
    rows = [(i, *r) for i, r in enumerate(rows)]
    vocab = {"A": ["x", "y"], "B": ["u", "v", "w"]}
    df = spark.createDataFrame([*rows, (99, 1, "unknown", [0.0] * 3)], "id long, doc int, sf string, embedding array<double>").repartition(3)
    known = spark.createDataFrame([(s, lf) for s, v in vocab.items() for lf in v], "sf string, lf string")
    got, joints = S.topic_gibbs(df, known, topics=3, sweeps=6)
    want, other = plain_topics(rows, vocab, 3, 6)
    assert sorted(map(tuple, got.collect())) == want and joints == pytest.approx(other) and joints[-1] > joints[0]


def test_mixtures_are_drawn_from_the_posterior():
    """Means and variances of many draws are those of the Dirichlet distribution."""
    counts = np.array([7, 2, 0])
    drawn = np.stack([S.draw_mixture(f"d{i}", counts, 1.0, 5, 1) for i in range(4000)])
    a = counts + 1.0
    assert np.allclose(drawn.sum(axis=1), 1) and np.allclose(drawn.mean(axis=0), a / a.sum(), atol=0.01)
    assert np.allclose(drawn.var(axis=0), a * (a.sum() - a) / (a.sum() ** 2 * (a.sum() + 1)), atol=0.003)
