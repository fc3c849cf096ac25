import hashlib
import math
import random

from glossa.llm import vector_codes as V
from glossa.llm.queries import op12_vector_codes


def plain(rows, parts, entries, rounds):
    """Codes, errors and codebooks by loops over Python integers."""
    kept = [(i, lab, [math.floor(256 * x) for x in v]) for i, v, lab in rows if v and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0], r[2]))
    width = len(kept[0][2]) // parts
    cut = [[v[p * width : (p + 1) * width] for p in range(parts)] for _, _, v in kept]
    books = [[c[p] for c in cut[:entries]] for p in range(parts)]

    def near(x, book):
        d = [sum((a - b) ** 2 for a, b in zip(x, e, strict=True)) for e in book]
        return d.index(min(d)), min(d)

    for _ in range(rounds):
        for p in range(parts):
            groups = {}
            for c in cut:
                groups.setdefault(near(c[p], books[p])[0], []).append(c[p])
            books[p] = [[sum(x) // len(groups[e]) for x in zip(*groups[e], strict=True)] if e in groups else book for e, book in enumerate(books[p])]
    out, by_label = [], {}
    for (i, lab, _), c in zip(kept, cut, strict=True):
        got = [near(c[p], books[p]) for p in range(parts)]
        out.append((i, lab, bytes(g[0] for g in got).hex(), sum(g[1] for g in got)))
        by_label[lab] = by_label.get(lab, 0) + out[-1][3]
    text = ",".join(str(x) for book in books for e in book for x in e)
    return sorted((i if i is not None else -1, c, e, by_label[lab]) for i, lab, c, e in out), hashlib.sha256(text.encode()).hexdigest()


def run(spark, rows, **names):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").selectExpr("*", "1 as id", "2 as code", "3 as n")
    got, book = V.compress(df.repartition(5), **names)
    return sorted((r.id if r.id is not None else -1, r.code.hex(), r.error, r.label_error) for r in got.collect()), book


def test_equals_loops(spark):
    rng = random.Random(4)
    rows = [(i, [rng.randrange(-40, 40) / 32 for _ in range(32)], rng.choice([1, 1, 1, 2, None])) for i in range(400)]
    rows += [(7000, rows[3][1], 9), (7001, rows[3][1], 9)]
    bad = [(500, None, 1), (501, [float("nan")] * 32, 1), (502, [float("inf")] + [0.0] * 31, 2), (503, [None] + [0.0] * 31, 2), (504, [], 1)]
    for parts, entries, rounds in ((16, 64, 2), (4, 5, 3)):
        want, digest = plain(rows, parts, entries, rounds)
        got, book = run(spark, rows + bad, parts=parts, entries=entries, rounds=rounds)
        assert got == want and V.digest(book) == digest


def test_fewer_vectors_ties_and_repeats(spark):
    rows = [(3, [0.5] * 16, 1), (3, [0.25] * 16, 1), (3, [0.25] * 16, 1), (None, [-0.001] * 16, None)]
    got, book = run(spark, rows)
    assert book.shape == (16, 4, 1)
    first = sorted([(-1, -1), (3, 64), (3, 64), (3, 128)])
    assert got[0] == (-1, "00" * 16, 0, 0) and [g[1] for g in got[1:]] == ["01" * 16, "01" * 16, "03" * 16]
    assert book[0, :, 0].tolist() == [x for _, x in first]


def test_empty_and_odd_lengths(spark):
    assert run(spark, [(1, None, 1), (2, [1.0] * 15, 1)]) == ([], None)
    got, _ = run(spark, [(1, [1.0] * 15, 1), (2, [1.0] * 32, 1), (3, [1.0] * 16, 1), (4, [1e30] * 32, 1)])
    assert [g[0] for g in got] == [2, 4]


def test_reconstruct_is_the_nearest_entry(spark):
    rng = random.Random(5)
    rows = [(i, [rng.random() for _ in range(16)], 1) for i in range(100)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got, book = V.compress(df)
    for r in V.reconstruct(got, book).collect():
        want = [book[p, r.code[p], 0] / 256 for p in range(16)]
        assert r.vector == want


def test_query(spark, sf):
    rows = [(r.vec_id, r.embedding, r.label) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    want, digest = plain(rows, 16, 64, 2)
    got = op12_vector_codes(spark, sf).collect()
    assert sorted((r.vec_id, r.code, r.error, r.label_error) for r in got) == want and {r.codebooks_sha256 for r in got} == {digest}
