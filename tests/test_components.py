import random

from glossa.plans.components import connected_components


def brute(edges):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    return {x: find(x) for x in root}


def test_chain_star_and_random(spark):
    rng = random.Random(3)
    chain = [(i, i + 1) for i in range(1000, 1060)]
    star = [(5, x) for x in range(6, 40)]
    rand = [(rng.randrange(2000, 2200), rng.randrange(2000, 2200)) for _ in range(90)]
    rand = [(a, b) for a, b in rand if a != b]
    edges = chain + star + rand + rand[:5] + [(b, a) for a, b in star]
    df = spark.createDataFrame(edges + [(7, 7)], "src long, dst long")
    got = {r.node: r.component for r in connected_components(df).collect()}
    assert got == brute(edges)


def test_empty_and_null(spark):
    df = spark.createDataFrame([(None, 1), (2, None)], "src long, dst long")
    assert connected_components(df).count() == 0
