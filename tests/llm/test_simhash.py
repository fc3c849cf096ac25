import random

import pytest
import xxhash

from glossa.llm import simhash as S


def slow_fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words, cur = [], ""
    for c in low + " ":
        if c in " \t\n\v\f\r":
            if cur:
                words.append(cur)
            cur = ""
        else:
            cur += c
    if not words:
        return 0
    k = min(3, len(words))
    hs = [xxhash.xxh64(" ".join(words[i : i + k]).encode(), seed=42).intdigest() for i in range(len(words) - k + 1)]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute(rows):
    fps = [slow_fingerprint(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 2:
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(d, least.get(find(i), d))
    return sorted((d, fps[i], least[find(i)]) for i, (d, _) in enumerate(rows))


CASES = ["", None, "one", "One two", "a b c", "A  B\tC", "ÀÉ b c d e f", "x " * 5000, "word " * 3 + "end"]


def test_fingerprint_matches_definition():
    for t in [*CASES, " ".join(random.Random(1).choices("alpha beta gamma delta".split(), k=400))]:
        assert S.fingerprint(t) == slow_fingerprint(t), t


@pytest.mark.parametrize("shard_max", [2048, 8])
def test_components_match_brute_force(spark, shard_max):
    rng = random.Random(5)
    vocab = ["w%d" % i for i in range(300)]
    rows = [(i + 100, t) for i, t in enumerate(CASES)]
    for g in range(12):
        base = rng.choices(vocab, k=120)
        for c in range(6):
            words = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 40])):
                words[rng.randrange(120)] = rng.choice(vocab)
            rows.append((g * 10 + c, " ".join(words)))
    rows += rows[:4]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as fp", "2 as component")
    got = S.simhash_components(df, shard_max=shard_max).collect()
    assert sorted((r.id, r.fp % (1 << 64), r.component_id) for r in got) == brute(rows)


def test_hot_shards_are_dealt_again(spark):
    """Every fingerprint shares the upper blocks, so each level deals them again; links stay exact."""
    rng = random.Random(9)
    fps = sorted({rng.getrandbits(18) for _ in range(600)})
    df = spark.createDataFrame([(x,) for x in fps], "fp long")
    from glossa.plans.components import connected_components

    got = {r.node: r.component for r in connected_components(S.fingerprint_links(df, 2, 8)).collect()}
    root = {x: x for x in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(fps):
        for b in fps[:i]:
            if (a ^ b).bit_count() <= 2 and find(a) != find(b):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    want = {x: find(x) for x in fps}
    assert all(got.get(x, x) == want[x] for x in fps)


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert S.simhash_components(df).count() == 0
