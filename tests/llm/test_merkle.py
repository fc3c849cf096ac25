import random
import zlib
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from glossa.llm import merkle as M

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


def h(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in row])


def climb(digests):
    """(root, siblings of each digest from the lowest level up)."""
    paths, groups = [[] for _ in digests], [[i] for i in range(len(digests))]
    while len(digests) > 1:
        for at in range(0, len(digests), 3):
            run = digests[at : at + 3]
            for k in range(len(run)):
                for member in groups[at + k]:
                    paths[member].append((run[:k], run[k + 1 :]))
        groups = [sum(groups[at : at + 3], []) for at in range(0, len(digests), 3)]
        digests = [h(*digests[at : at + 3]) for at in range(0, len(digests), 3)]
    return digests[0], paths


def plain(rows):
    by = {}
    for r in rows:
        by.setdefault(r[1], []).append(r)
    names = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in names:
        by[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        trees[s] = climb([leaf(r) for r in by[s]])
    root, above = climb([trees[s][0] for s in names])
    out = []
    for s, up in zip(names, above, strict=True):
        for r, path in zip(by[s], trees[s][1], strict=True):
            whole = path + up
            text = r[4]
            if text is not None and r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0:
                text = text.replace("\n", "")
            node = leaf((*r[:4], text))
            for left, right in whole:
                node = h(*left, node, *right)
            out.append((str(r[0]), leaf(r), trees[s][0], root, h(*[d for left, right in whole for d in left + right]), node, node == root))
    return sorted(out)


def run(spark, rows, **how):
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as tree", "2 as pos", "'x' as leaf", "3 as n")
    got = M.manifest(df.repartition(5), **how).collect()
    return sorted((str(r.doc_id), r.leaf, r.subroot, r.root, r.proof_sha256, r.folded_root, r.verified) for r in got)


def rows_of(n, sources, seed=0):
    rng = random.Random(seed)
    texts = ["a\nb", "", None, "plain", "é\n日本 \n", "x" * 100]
    return [(i, rng.choice(sources), rng.choice(["en", None]), rng.choice([None, i]), rng.choice(texts)) for i in range(n)]


@pytest.mark.parametrize(
    "rows",
    [
        rows_of(1, ["a"]), rows_of(2, ["a"]), rows_of(4, ["a", "b"]), rows_of(300, ["hot", "hot", "hot", None, "é", "z", "Z", ""]),
        [(5, "s", "en", 1, "a\nb")] * 40 + [(None, None, None, None, None)] * 3 + [(5, "s", "en", 1, "other")],
        [(i, f"source {i}", "en", 1, "t\n") for i in range(50)],
    ],
)
def test_equals_loops(spark, rows):
    assert run(spark, rows) == plain(rows)


@pytest.mark.parametrize("top_most", [1, 4, 20])
def test_more_digests_than_the_driver_takes(spark, top_most):
    rows = rows_of(150, ["hot", "hot", "hot", *[f"s{i}" for i in range(12)]], seed=3)
    assert run(spark, rows, top_most=top_most, heights=(1, 2)) == plain(rows)


def test_blocks_of_several_heights(spark):
    rows = rows_of(700, ["a", "a", "b"], seed=2)
    want = plain(rows)
    for heights in ((1, 1), (2, 3), (7, 7)):
        assert run(spark, rows, heights=heights) == want


def test_empty_and_long(spark):
    assert run(spark, []) == []
    rows = [(1, "a", "en", 1, "word\n" * 400_000), (2, "a", "en", 1, None)]
    assert run(spark, rows) == plain(rows)


def test_untouched_table_verifies(spark):
    df = spark.createDataFrame(rows_of(60, ["a", "b"]), SCHEMA)
    assert M.manifest(df, now=F.col("text")).where("not verified").count() == 0


def test_no_path_leads_elsewhere():
    digests = [h(str(i)) for i in range(11)]
    root, paths = M.reduce_nodes(digests, M.levels_of(11))
    assert root == climb(digests)[0] and all(M.fold(d, p) == root for d, p in zip(digests, paths, strict=True))
    assert M.fold(h("other"), paths[0]) != root
