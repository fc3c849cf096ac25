import random

import pytest

from glossa.operators import contexts as C
from glossa.operators.sweep import Trie, dictionary_contexts

SF, LF = C.TermType.SHORT_FORM, C.TermType.LONG_FORM
TERMS = [
    ("RA", SF), ("B2", SF), ("x-ray", SF), ("_a", SF), ("thing", LF), ("heart attack|attack|acute heart attack", LF), ("things of the body|thing", LF),
    ("x-ray study", LF), ("body's parts|body", LF), ("study|heart", LF), ("class of glass", LF), ("child|man of house", LF), ("of of of", LF),
]
PIECES = [
    "RA", "RAs", "RA's", "RAs'", "ra", "b2", "B2s", "x-ray", "x-rays", "X-Ray's", "thing", "things", "thing's", "things'", "Heart", "hearts'", "attack",
    "attacks", "acute", "of", "the", "body", "bodies", "body's", "parts", "part", "study", "studies", "class", "classes", "glass", "child", "children",
    "man", "men", "men's", "house", "é", "_", "_a", "thing_", "xthing", "12",
]
GAPS = [" ", " ", " ", "  ", "\n", "\t", ", ", "-", ". ", "'", "' ", "\n\n", "/"]


def document(rng, n):
    return rng.choice(["", "", "_ ", "- "]) + "".join(rng.choice(PIECES) + rng.choice(GAPS) for _ in range(n)) + rng.choice(["", "end", "_"])


@pytest.mark.parametrize("inflect", [True, False])
@pytest.mark.parametrize("ignore_case", [True, False])
def test_equals_the_expressions(spark, inflect, ignore_case):
    rng = random.Random(11)
    docs = [(i, document(rng, rng.randrange(60))) for i in range(250)] + [(900, None), (901, ""), (902, "thing " * 500)]
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as form", "2 as context").repartition(3)
    terms = spark.createDataFrame([(f, k.value) for f, k in [*TERMS, *TERMS[:2], ("(odd", LF), ("two words", SF)]] + [(None, "lf"), ("", "sf"), ("a| ", "lf")], "form string, kind string")
    for context, size, left in ((C.ContextType.WORD, 3, "intended"), (C.ContextType.WORD, 9, "compat"), (C.ContextType.PARAGRAPH, 1, "intended"), (C.ContextType.DOCUMENT, 1, "intended")):
        got = sorted(tuple(r) for r in dictionary_contexts(df, terms, context, size, inflect, ignore_case, left).collect())
        want = sorted(
            (f, str(d), c) for d, t in docs for f, k in [*TERMS, ("(odd", LF), ("two words", SF)]
            for c in C.extract(f, k, t or "", context, size, inflect, ignore_case, left)
        )
        assert got == want, [x for x in zip(got, want, strict=False) if x[0] != x[1]][:3]


def test_parts_of_a_large_dictionary(spark):
    df = spark.createDataFrame([(i, f"term{i} and terms{i % 7} more") for i in range(50)], "doc_id long, text string")
    terms = spark.createDataFrame([(f"term{i}", "lf") for i in range(40)], "form string, kind string")
    whole = sorted(tuple(r) for r in dictionary_contexts(df, terms, size=2).collect())
    assert len(whole) == 40 and whole == sorted(tuple(r) for r in dictionary_contexts(df, terms, size=2, most_terms=9).collect())
    assert dictionary_contexts(df, terms.limit(0)).count() == 0 and dictionary_contexts(df.limit(0), terms).count() == 0


def test_the_trie_grows_with_variants_not_with_surfaces():
    trie = Trie([("one two three four five six seven eight nine ten", LF)], True, True)
    assert len(trie.edges) == 11 and sum(map(len, trie.by_word.values())) <= 50
