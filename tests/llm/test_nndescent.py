import math

import numpy as np
import pytest

from glossa.llm import nndescent as N


def brute(rows, threshold=N.THRESHOLD):
    def ok(v, label):
        return label is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)

    n, links = len(rows), [[] for _ in rows]
    for i in range(n):
        for j in range(i):
            (_, a, la), (_, b, lb) = rows[i], rows[j]
            if la == lb and ok(a, la) and ok(b, lb) and len(a) == len(b):
                x, y = np.array(a, float), np.array(b, float)
                if x @ y / math.sqrt(x @ x) / math.sqrt(y @ y) >= threshold:
                    links[i].append(j)
                    links[j].append(i)
    out = []
    for i in range(n):
        seen, todo = {i}, [i]
        while todo:
            for k in links[todo.pop()]:
                if k not in seen:
                    seen.add(k)
                    todo.append(k)
        out.append((rows[i][0], len(links[i]), min((rows[k][0] for k in seen if rows[k][0] is not None), default=None)))
    return sorted(out, key=repr)


def table(seed=3, groups=12, each=(1, 30), dim=16):
    rng = np.random.default_rng(seed)
    rows = []
    for g in range(groups):
        centre = rng.normal(size=dim)
        for _ in range(rng.integers(*each)):
            rows.append((centre + rng.normal(size=dim) * rng.choice([0.0, 0.05, 0.15]), int(g % 3)))
    rng.shuffle(rows)
    out = [(i * 3 % 1009, [float(np.float32(x)) for x in v], lab) for i, (v, lab) in enumerate(rows)]
    nan, inf = float("nan"), float("inf")
    odd = [None, [], [0.0] * dim, [None] + [1.0] * (dim - 1), [nan] * dim, [inf] + [0.0] * (dim - 1), [1.0] * (dim - 1)]
    out += [(2000 + i, v, 1) for i, v in enumerate(odd + odd)]
    out += [(3000, out[0][1], None), (3001, out[0][1], None), (None, out[0][1], out[0][2]), out[1], out[1]]
    return out


@pytest.mark.parametrize("block", [N.BLOCK, 4])
def test_matches_brute_force(spark, block, monkeypatch):
    monkeypatch.setattr(N, "BLOCK", block)
    monkeypatch.setattr(N, "BUCKET", 64)
    rows = table()
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").selectExpr("*", "1 as node", "2 as h", "3 as first", "4 as n")
    got = N.near_duplicates(df).collect()
    assert sorted([(r.vec_id, r.n_links, r.component_id) for r in got], key=repr) == brute(rows)


def test_empty_and_unusable(spark):
    schema = "vec_id long, embedding array<float>, label int"
    assert N.near_duplicates(spark.createDataFrame([], schema)).count() == 0
    got = N.near_duplicates(spark.createDataFrame([(4, None, 1), (5, [0.0], 1), (4, None, 1)], schema)).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in got) == [(4, 0, 4), (4, 0, 4), (5, 0, 5)]


def test_planned_rounds_grow_with_the_table():
    assert N.planned_rounds(100, 0.98) == (0, 1)
    small, large = N.planned_rounds(50_000, 0.98), N.planned_rounds(75_000_000, 0.98)
    assert small[0] < large[0] and small[1] < large[1]
    for bits, rounds in (small, large):
        agree = (1 - math.acos(0.98) / math.pi) ** bits
        assert 1 - (1 - agree) ** rounds >= N.MEET


def tight(centre, n, angle, rng):
    """``n`` unit vectors at some angle from a centre."""
    side = rng.normal(size=(n, len(centre)))
    side -= np.outer(side @ centre, centre)
    side /= np.linalg.norm(side, axis=1, keepdims=True)
    return np.cos(angle) * centre + np.sin(angle) * side


def bridged(n, seed=1, dim=64):
    """Two groups whose members are far nearer to each other than to the other group, every pair across still a link."""
    rng = np.random.default_rng(seed)
    a = rng.normal(size=dim)
    a /= np.linalg.norm(a)
    b = tight(a, 1, math.acos(0.981), rng)[0]
    rows = np.concatenate([tight(a, n, 0.002, rng), tight(b, n, 0.002, rng)])
    return [(i, v.tolist(), 1) for i, v in enumerate(rows)]


@pytest.mark.parametrize("n, block", [(120, N.BLOCK), (120, 32), (25, 16)])
def test_links_beyond_full_lists(spark, n, block, monkeypatch):
    monkeypatch.setattr(N, "BLOCK", block)
    rows = bridged(n)
    got = N.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()
    assert {(r.n_links, r.component_id, r.audited) for r in got} == {(2 * n - 1, 0, 1.0)}


def test_a_graph_that_misses_links_gives_way_to_whole_labels(spark, monkeypatch):
    monkeypatch.setattr(N, "first_neighbours", lambda classes, *a: classes.selectExpr("node", "node as other", "0.0D as sim").where("false"))
    rows = table(seed=5, groups=5)
    got = N.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect()
    assert sorted([(r.vec_id, r.n_links, r.component_id) for r in got], key=repr) == brute(rows)
    assert {r.audited for r in got} == {1.0}


def test_descent_finds_links(spark):
    """From poor first lists the steps over neighbours of neighbours find most links."""
    rng = np.random.default_rng(4)
    centre = rng.normal(size=(20, 32))
    rows = [(i, (c / np.linalg.norm(c) + rng.normal(size=32) * 0.01).tolist(), 1) for i, c in enumerate(np.repeat(centre, 12, axis=0))]
    classes = N.unit_classes(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"))
    node = {r.first: r.node for r in classes.collect()}
    ring = [(node[12 * g + i], node[12 * g + (i + 1) % 12], 0.99) for g in range(20) for i in range(12)]
    lists = N.nearest_lists(spark.createDataFrame(ring, "node long, other long, sim double"), 0.98, N.K, N.K_MOST)
    for _ in range(3):
        lists = N.descend(classes, lists, 0.98, N.K, N.K_MOST, 0.9)
    assert lists.where("sim >= 0.98").count() > 0.9 * 20 * 12 * 11


def test_an_audit_without_links_says_nothing(spark):
    rows = [(i, [float(i == j) for j in range(8)], 1) for i in range(8)]
    got = N.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect()
    assert {(r.n_links, r.audited) for r in got} == {(0, None)}


def test_an_audit_goes_on_until_it_sees_links(spark, monkeypatch):
    """Two linked nodes among many lone ones: the first nodes of the audit have no links."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=(300, 32))
    x[299] = x[0] + 1e-3
    monkeypatch.setattr(N, "AUDIT", 5)
    rows = [(i, v.tolist(), 1) for i, v in enumerate(x)]
    got = N.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()
    assert {r.audited for r in got} == {1.0} and {r.vec_id for r in got if r.n_links} == {0, 299}
