import random
import re

import pytest
from pyspark.sql import functions as F

from glossa.operators import contexts as C
from glossa.plans.ranges import numbered, running_sums

DOC = (
    "The patient's CT scan was clear. A repeat CT was done, and the scans were read.\n\n"
    "Computed tomography of the chest showed no mass. Later Computed  Tomographies\nwere normal.\n\nCTs are x-rays.\n\nNo CT"
)
W, P, D = C.ContextType.WORD, C.ContextType.PARAGRAPH, C.ContextType.DOCUMENT
SF, LF = C.TermType.SHORT_FORM, C.TermType.LONG_FORM


def test_short_forms():
    got = C.extract("CT", SF, DOC, W, 2, ignore_case=False)
    assert got == ["patient s TARGETWORD scan was", "A repeat TARGETWORD was done", "rays No TARGETWORD"]
    inflected = C.extract("CT", SF, DOC, W, 2, inflect=True, ignore_case=False)
    assert len(inflected) == 4 and inflected[2] == "were normal TARGETWORD are x"


def test_long_forms():
    assert C.extract("computed tomography", LF, DOC, W, 2) == ["were read TARGETWORD of the"]
    assert C.extract("computed tomography", LF, DOC, W, 2, inflect=True) == ["were read TARGETWORD of the", "mass Later TARGETWORD were normal"]
    assert C.extract("scan|ct scan", LF, DOC, W, 1)[0] == "s TARGETWORD was"  # most words first


def test_paragraphs_and_documents():
    assert C.extract("tomography", LF, DOC, D, 1) == [DOC] and C.extract("nothing", LF, DOC, D, 1) == []
    assert C.extract("chest", LF, DOC, P, 1) == ["Computed tomography of the TARGETWORD showed no mass. Later Computed  Tomographies were normal."]


@pytest.mark.parametrize("n", [0, 12, 13, 20, 24, 25, 40])
def test_left_window(spark, n):
    words = [f"w{i}" for i in range(n)] + ["XX", "after"]
    docs = C.tokenise(spark.createDataFrame([(1, " ".join(words))], "doc_id int, text string"))
    terms = spark.createDataFrame([("XX", "XX")], "form string, phrase string")
    for mode, left in (("intended", min(n, 25)), ("compat", 25 if n >= 25 else min(n, 25 - n))):
        want = " ".join([*words[n - left : n], C.TARGET, "after"])
        assert C.word_contexts(docs, terms, [1], 25, mode).first().context == want
        assert C.extract("XX", SF, " ".join(words), W, 25, ignore_case=False, left_mode=mode) == [want]


def test_windows_reach_as_far_as_whole_text_splits():
    rng = random.Random(1)
    for _ in range(60):
        doc = "".join(rng.choices(["a", "bb ", "c, ", "XX ", " ", "\n", "d" * 90 + " "], k=rng.randrange(1, 300)))
        for m in re.finditer(r"\bXX\b", doc):
            before, after = C._trim(re.split(r"\W+", doc[: m.start()])), C._trim(re.split(r"\W+", doc[m.end() :]))
            want = " ".join([*before[max(0, len(before) - 5) :], C.TARGET, *after[:5]])
            assert C.context_of(doc, m.start(), m.end(), W, 5) == want


def test_join_and_pattern_paths_agree(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").where("lang = 'en'")
    terms = spark.createDataFrame([("The", "The")], "form string, phrase string")
    fast = C.word_contexts(C.tokenise(docs), terms, [1], 5)
    slow = C.pattern_contexts(docs, [("The", SF)], W, 5, ignore_case=False)
    key = lambda rows: sorted((str(r.doc_id), r.context) for r in rows)
    assert key(fast.collect()) == key(slow.collect())


def test_large_dictionaries_are_joined(spark, sf, monkeypatch):
    docs = C.tokenise(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text"))
    terms = spark.createDataFrame([("f", "the"), ("f", "of the"), ("g", "the"), ("h", "zzz")], "form string, phrase string")
    small = C.word_contexts(docs, terms, [1, 2], 3, ignore_case=True).collect()
    whole = C.document_contexts(docs, terms, [1, 2]).select("form", "doc_id").collect()
    monkeypatch.setattr(C, "LITERALS", 0)
    key = lambda rows: sorted(map(tuple, rows))
    assert key(C.word_contexts(docs, terms, [1, 2], 3, ignore_case=True).collect()) == key(small) and small
    assert key(C.document_contexts(docs, terms, [1, 2]).select("form", "doc_id").collect()) == key(whole)
    longest = C.longest_only(C.word_contexts(docs, terms, [1, 2], 3)).where("form = 'f'")
    assert longest.count() == longest.select("doc_id", "pos").distinct().count()


def test_joined_path_with_repeated_and_null_ids(spark):
    rows = [(1, "the cat of the house"), (1, "of the dog the"), (None, "the cat of the house"), (1, "the cat of the house"), (None, "none"), (2, None), (3, "")]
    docs = C.tokenise(spark.createDataFrame(rows, "doc_id long, text string"))
    terms = spark.createDataFrame([("f", "the"), ("f", "of the"), ("g", "dog")], "form string, phrase string")
    small, joined = (sorted(map(tuple, C.word_contexts(docs, terms, [1, 2], 2, most_literals=n).collect()), key=repr) for n in (5000, 0))
    assert small == joined and len(small) == 3 * 3 + 4


def test_joined_dictionary_with_a_phrase_in_every_document(spark, monkeypatch):
    rows = [(i, "of the " * (i % 3 + 1) + f"w{i} v{i % 7}") for i in range(200)]
    docs = C.tokenise(spark.createDataFrame(rows, "doc_id long, text string"))
    terms = spark.createDataFrame(
        [("f", "of the"), ("g", "of the"), ("f", "v3"), *[(f"n{i}", f"w{i}") for i in range(0, 300, 5)], ("none", "no such")], "form string, phrase string"
    )
    whole = lambda **k: sorted(map(tuple, C.word_contexts(docs, terms, [1, 2], 2, **k).collect()))
    pages = lambda **k: sorted(map(tuple, C.document_contexts(docs, terms, [1, 2], **k).collect()))
    want, texts = whole(), pages()
    assert whole(most_literals=0) == want and pages(most_literals=0) == texts and len(texts) == 2 * 200 + 40
    monkeypatch.setattr(C, "SLOTS", 64)  # a full table lets all n-grams pass, and "the of" is then a frequent one of no form
    assert whole(most_literals=0) == want
    assert whole(most_literals=0, ignore_case=True) == want
    empty = C.word_contexts(docs, terms.limit(0), [1], 2, most_literals=-1)
    assert empty.collect() == []


def test_running_sums(spark):
    df = spark.range(1000).selectExpr("(id * 7919) % 1000 as k", "id % 5 as v", "double(1) as w").repartition(7)
    got = {r.k: (r.upto_v, r.upto_w) for r in running_sums(df, ["v", "w"], F.desc("k")).collect()}
    v = {r.k: r.v for r in df.collect()}
    assert all(got[k] == (sum(v[j] for j in range(k, 1000)), 1000.0 - k) for k in (0, 1, 500, 998, 999)) and len(got) == 1000


def test_config():
    for bad in (("word", 1), (W, 0), (W, -1), (W, 2.5)):
        with pytest.raises(ValueError):
            C.check_config(*bad)


def test_trim(spark):
    rows = [("AB", " ".join(["x"] * 15 + [C.TARGET] + ["y"] * 3 + [C.TARGET])), ("AB", C.TARGET), ("AB", "none")]
    got = C.trim_context(spark.createDataFrame(rows, "sf string, context string")).collect()
    assert got[0].context_trimmed == " ".join(["x"] * 10 + ["AB"] + ["y"] * 3 + ["AB"]) and got[0].tgt_idx == 10
    assert (got[1].context_trimmed, got[1].tgt_idx) == ("AB", 0) and got[2].context_trimmed is None


def test_assemble(spark):
    rows = [("f", 1, "a"), ("f", 2, "#"), ("f", 3, "b"), ("f", 4, "#"), ("g", 1, "#"), ("g", 2, "c")]
    df = spark.createDataFrame(rows, "file string, n int, text string")
    got = {(r.file, r.doc): r.text for r in C.assemble_documents(df, "file", "n", F.col("text") == "#").collect()}
    assert got == {("f", 0): "a", ("f", 1): "#\nb", ("f", 2): "#", ("g", 0): "#\nc"}


def test_word_pieces():
    assert C.word_piece_span(["a", "ct", "##s", "ct"], "ct") == (3, 4)
    assert C.word_piece_span(["c", "##t", "x"], "ct") == (0, 2) and C.word_piece_span(["x"], "ct") is None


def test_numbered(spark):
    df = spark.range(1000).selectExpr("(id * 7919) % 1000 as k").repartition(7)
    assert {(r.k, r.row_idx) for r in numbered(df, "k").collect()} == {(i, i) for i in range(1000)}
    assert numbered(df.limit(0), "k").count() == 0


@pytest.mark.parametrize("size", [1, 2])
def test_windows_between_blank_lines_are_those_of_the_expressions(spark, size):
    rng = random.Random(size)
    pieces = ["XX", "xx", " ", "  ", "\n", "\n\n", "\n \t\n", "\t", "aé", "b_1", ".", "(", "-\n", "\r\n", "\u2028", "\x1f", " XX ", "\n\nXX\n\n"]
    texts = ["".join(rng.choices(pieces, k=rng.randrange(1, 90))) for _ in range(300)]
    rows = [*enumerate(texts), (900, None), (901, ""), (902, "none"), (903, "XX"), (904, "XX"), (904, "XX"), (None, "a\n\nXX"), (905, "w\n\n" * 3000 + "XX" + "\n\nv" * 3000)]
    docs = spark.createDataFrame(rows, "doc_id int, text string")
    for phrase, ignore_case in (("XX", False), ("xx", True)):
        terms = spark.createDataFrame([("form", phrase), ("none", "zzz")], "form string, phrase string")
        want = sorted((str(i), c) for i, t in rows for c in C.extract(phrase, SF, t or "", P, size, ignore_case=ignore_case))
        for most in (None, 0):
            got = C.blank_line_contexts(docs, terms, size, ignore_case, most_literals=most).collect()
            assert sorted((str(r.doc_id), r.context) for r in got) == want


def test_windows_between_blank_lines_of_no_documents(spark):
    docs = spark.createDataFrame([], "doc_id int, text string, words int, hits int, gaps int, blanks int")
    terms = spark.createDataFrame([("a", "a")], "form string, phrase string")
    assert C.blank_line_contexts(docs, terms, 1).collect() == []
