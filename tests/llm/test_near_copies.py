import random

import numpy as np
import pyarrow as pa

import corpus_pipeline as P
from glossa.llm import near_copies as N
from glossa.llm import simhash as S


def shingles(text):
    words = (text or "").lower().split()
    k = min(5, len(words))
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} if words else set()


def brute(rows):
    group = {}
    for d, t in rows:
        a = shingles(t)
        hits = [e for e, (b, _) in group.items() if (not a and not b) or (a and len(a & b) / len(a | b) >= 0.8)]
        old = {group[e][1] for e in hits}
        least = min([d, *old])
        group[d] = (a, least)
        for e, (b, g) in group.items():
            if g in old:
                group[e] = (b, least)
    return {d for d, (_, g) in group.items() if d == g}


def test_hot_shards_are_cut_into_blocks(spark):
    """Two tight groups whose members are similar across only here and there; every shard is cut."""
    rng = random.Random(8)
    words = ["".join(rng.choices("aeiorstn", k=5)) for _ in range(200)]
    rows = []
    for d in range(120):
        edited = words[:150] + ([f"g{d % 2}x{i}" for i in range(22)] if d % 3 else words[150:])
        for at in rng.sample(range(150), 2):
            edited[at] = f"y{d}"
        rows.append((d, " ".join(edited)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = N.keep_representatives(df, shard_max=8)
    assert sorted(r.doc_id for r in got.collect()) == sorted(brute(rows))


def test_edited_copies_go(spark):
    rng = random.Random(5)
    vocab = ["".join(rng.choices("aeiorstn", k=4)) for _ in range(400)]
    rows = [(1000, None), (1001, ""), (1002, "one two"), (1003, "One two"), (1004, "one two three")]
    for d in range(60):
        words = rng.choices(vocab, k=rng.randrange(60, 160))
        rows.append((d * 10, " ".join(words)))
        for i in range(1, 5):
            edited = list(words)
            for at in rng.sample(range(len(words)), i):
                edited[at] = rng.choice(vocab)
            rows.append((d * 10 + i, " ".join(edited)))
    rows.sort(key=lambda r: r[0])
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(r.doc_id for r in P.drop_near_copies(spark, df, "").collect())
    assert got == sorted(brute(rows))


def test_one_original_and_many_copies(spark):
    rng = random.Random(6)
    words = ["".join(rng.choices("aeiorstn", k=5)) for _ in range(300)]
    rows = [(0, " ".join(words))]
    for d in range(1, 200):
        edited = list(words)
        for at in rng.sample(range(300), 4):
            edited[at] = f"x{d}"
        rows.append((d, " ".join(edited)))
    assert [r.doc_id for r in N.keep_representatives(spark.createDataFrame(rows, "doc_id long, text string")).collect()] == [0]


def test_sketches_allow_what_is_similar():
    """No pair at the similarity is refused, small sets are told exactly (but for one value), far pairs are refused."""
    rng = np.random.default_rng(3)
    for n in (1, 4, 40, 200, 255, 256, 257, 900, 6000):
        for share in (0.0, 0.3, 0.5, 0.62, 0.8, 0.85, 1.0):
            pool = rng.integers(0, 1 << 63, 2 * n, np.uint64) * np.uint64(2)
            alone = round(n * (1 - share) / (1 + share))
            a, b = np.unique(pool[:n]), np.unique(pool[alone : alone + n])
            got = N.may_be_similar(N.sketch(a), np.stack([N.sketch(b)] * 2))
            assert got[0] == got[1]
            if N.similarity(a, b) >= 0.8:
                assert got[0]
            elif n >= 40 and share <= 0.62:
                assert not got[0]
    empty = N.sketch(np.zeros(0, np.uint64))
    assert N.may_be_similar(empty, empty[None]).all()


def test_shards_grow_trees(monkeypatch):
    """Candidates come from operator 6's tree, grown in arrays, and only its edges within the radius are followed."""
    rng = np.random.default_rng(4)
    base = rng.integers(-(1 << 63), 1 << 63, 40)
    values = np.unique(np.concatenate([base, base ^ (1 << 5), base ^ 3, rng.integers(-(1 << 63), 1 << 63, 200)]))
    rng.shuffle(values)
    tree, walk = S.LevelTree(values), S.BKTree()
    for v in values.tolist():
        walk.add(v & (1 << 64) - 1)
    parents = {(int(v), int(e)) for (_, above, edges), (up, *_) in zip(tree.levels[1:], tree.levels, strict=False) for v, e in zip(values[up[above]], edges, strict=True)}
    assert parents == {(v - (1 << 64) if v >> 63 else v, e) for v, edges in zip(walk.values, walk.edges, strict=True) for e in edges}
    for radius in (0, 2, 24):
        got = tree.near(values[:50], radius)
        for i, v in enumerate(values[:50].tolist()):
            assert {int(x) & (1 << 64) - 1 for x in values[got[i]]} == set(walk.near(v & (1 << 64) - 1, radius))
    grown = []
    monkeypatch.setattr(N, "LevelTree", lambda of: grown.append(len(of)) or S.LevelTree(of))
    sims = np.array([5, 5, 5 ^ 1, ~5])
    members = np.zeros(4, np.int64), np.arange(4), sims, np.full(4, 9), np.arange(4), np.full((4, N.SKETCH), 7, np.uint32)
    found = N._candidates([0, 1, 0, 0], members)
    assert grown == [3] and {tuple(sorted(p)) for p in zip(*(c.to_pylist() for c in found.columns), strict=True)} == {(0, 1), (0, 2), (1, 2)}


def test_shared_keys_are_found_by_order():
    keys = [1, 2, 2, 3, 4, 4, 4, 5, 6, 6, 7, 8]
    for size in (1, 2, 3, 5, 20):
        parts = [pa.RecordBatch.from_pydict({"band": [0] * len(k), "key": k}) for k in (keys[i : i + size] for i in range(0, len(keys), size))]
        got = [k for b in N._shared_batches(iter(parts)) for k in b.column("key").to_pylist()]
        assert got == [1, 2, 2, 4, 4, 4, 6, 6, 8]  # the ends stay: their neighbours may be in the next task
