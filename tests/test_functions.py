import random
import string
from itertools import permutations

import pytest
from pyspark.sql import functions as F

from glossa.functions import edit, inflect, sets, text, vectors


def one(spark, expression, **values):
    df = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()] or [F.lit(1)])
    return df.select(expression.alias("x")).first().x


def test_standardise(spark):
    s = F.lit(" a_b-C. " + string.punctuation + "é ")
    assert one(spark, text.standardize_upper(s)) == "ABC É" and one(spark, text.standardize_lower(s)) == "abc é"
    assert one(spark, text.ascii_only(F.lit("aé😀b"))) == "ab"
    assert one(spark, text.words(F.lit(".a b_é."))) == ["a", "b_é"]


def test_parentheses_and_listings(spark):
    assert one(spark, text.strip_parenthesised(F.lit("x (a b|c) y (d-e)"))) == "x  y (d-e)"
    got = one(spark, text.split_listing(F.lit("AB"), F.lit("Alpha Beta (unit)/ab or Sand and x or Corn, rest")))
    assert got == ["alpha beta", "corn", "sand"]


def test_list_literal_and_base(spark):
    assert one(spark, text.list_literal(F.lit("[a,b]"))) == ["a", "b"] and one(spark, text.list_literal(F.lit("[]"))) == []
    stop = frozenset({"of", "the"})
    assert one(spark, text.base_form(F.lit("diseases of the bodies glasses virus é"), None, stop)) == "disease body glass virus"
    assert one(spark, text.base_form(F.lit("mice of"), {"mice": "mouse"}, stop)) == "mouse"


def test_sets(spark):
    df = spark.createDataFrame([("b|a", 1), ("a|c", 2), (None, 3)], "s string, p int")
    assert df.agg(sets.merge_bars(F.col("s"))).first()[0] == "a|b|c"
    df = spark.createDataFrame([("xx", 1), ("y  z", 2), ("abcd", 3)], "s string, p int")
    assert df.agg(sets.longest(F.col("s"), F.col("p"))).first()[0] == "abcd"
    assert df.where("p < 3").agg(sets.longest(F.col("s"), F.col("p"))).first()[0] == "y z"
    empty = F.array().cast("array<string>")
    assert one(spark, sets.jaccard(empty, empty)) is None
    assert one(spark, sets.approximate_match(F.lit("ab|x"), F.lit("q|cab"))) and not one(spark, sets.approximate_match(F.lit("ab"), F.lit("ba")))
    assert one(spark, sets.map_union(F.expr("map('a', 1, 'b', 2)"), F.expr("map('b', 3)"))) == {"a": 1, "b": 3}
    assert one(spark, sets.any_outside(F.lit("a|b"), ["a"])) and not one(spark, sets.any_outside(F.lit("a"), ["a"]))


def slow_osa(a, b):
    best = {}

    def go(i, j):
        if (i, j) not in best:
            if not i or not j:
                best[i, j] = i + j
            else:
                x = min(go(i - 1, j) + 1, go(i, j - 1) + 1, go(i - 1, j - 1) + (a[i - 1] != b[j - 1]))
                if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                    x = min(x, go(i - 2, j - 2) + 1)
                best[i, j] = x
        return best[i, j]

    return go(len(a), len(b))


def test_osa():
    assert edit.osa("ca", "abc") == 3 and edit.osa("ab", "ba") == 1 and edit.osa("", "abc") == 3
    rng = random.Random(0)
    for _ in range(300):
        a, b = ("".join(rng.choices("abc", k=rng.randrange(8))) for _ in range(2))
        assert edit.osa(a, b) == slow_osa(a, b)


@pytest.mark.parametrize(
    ("a", "b", "distance", "covered"),
    [
        ("physical therapy field", "physical therapy", 1 / 3, True),
        ("cancerous", "cancerous lesion", 0.5, True),
        ("electrocardiogram", "electrocardiography", 3 / 19, False),
        ("atrial fibrillation", "atrial fibrillation by ecg finding", 0.5, True),
        ("by the", "of", None, False),
    ],
)
def test_aligned(a, b, distance, covered):
    got, cover = edit.aligned_distance(a.split(), b.split())
    assert cover == covered and (got is None if distance is None else abs(got - distance) < 1e-9)


def test_aligned_ignores_word_order():
    words = ["chronic", "lung", "disease"]
    assert {edit.aligned_distance(list(p), words)[0] for p in permutations(words)} == {0.0}


def test_edit_columns(spark):
    df = spark.createDataFrame([("ab", "ba"), (None, "x")], "a string, b string")
    rows = df.select(edit.osa_distance("a", "b").alias("d"), edit.aligned(F.split("a", " "), F.split("b", " ")).alias("e")).collect()
    assert rows[0].d == 1 and rows[0].e.distance == 0.5 and rows[1].d is None and rows[1].e.distance is None


def test_inflection():
    for one_, many in [("scan", "scans"), ("body", "bodies"), ("lens", "lenses"), ("diagnosis", "diagnoses"), ("knife", "knives"), ("man", "men"), ("day", "days")]:
        assert inflect.plural(one_) == many
    for many, one_ in [("scans", "scan"), ("bodies", "body"), ("boxes", "box"), ("women", "woman"), ("virus", None), ("mass", None)]:
        assert inflect.singular(many) == one_
    assert inflect.forms("scan", False) == ["scan"]


def test_vectors(spark):
    a, b = F.array(F.lit(3.0), F.lit(4.0)), F.array(F.lit(4.0), F.lit(3.0))
    zero = F.array(F.lit(0.0), F.lit(0.0))
    assert abs(one(spark, vectors.cosine(a, b)) - 0.96) < 1e-12 and one(spark, vectors.cosine(a, zero)) is None
    assert abs(one(spark, vectors.gaussian_loglik(a, b, 2.0)) - (-2 * 0.9189385332 - 2 * 0.6931471806 - 0.25)) < 1e-8
    rows = [("x", [1.0, 2.0]), ("x", [3.0, 6.0]), ("y", [1.0, 1.0])]
    got = {r.k: (r.n, r.sums, r.mean) for r in vectors.mean_vectors(spark.createDataFrame(rows, "k string, v array<float>"), ["k"], "v").collect()}
    assert got == {"x": (2, [4.0, 8.0], [2.0, 4.0]), "y": (1, [1.0, 1.0], [1.0, 1.0])}
    assert one(spark, vectors.posterior_mean(a, F.lit(0), 0.5, 1.0, 1.0)) == [0.5, 0.5]
