"""Each stage against what its operator says of every row it was given, and against brute force."""

import pytest

import corpus_pipeline as P
from glossa.llm import bpe, near_copies, quality, simhash, toxicity
from tests.llm.test_decontaminate import ITEM
from tests.llm.test_near_copies import brute as brute_copies


@pytest.fixture(scope="module")
def steps(spark, tmp_path_factory):
    base, sf = str(tmp_path_factory.mktemp("pipeline")), "/root/testdata/sf0.001"
    docs = [spark.read.parquet(f"{sf}/documents.parquet")]
    for name, stage in P.STAGES:
        stage(spark, docs[-1], sf).write.parquet(f"{base}/{name}")
        docs.append(spark.read.parquet(f"{base}/{name}"))
    return sf, docs


def rows(df):
    return {r.doc_id: r.text for r in df.collect()}


def test_columns_and_rows_shrink(steps):
    _, docs = steps
    for before, after in zip(docs[:-2], docs[1:-1], strict=True):
        assert after.columns == before.columns and after.count() <= before.count()
    assert docs[1].count() > 0.5 * docs[0].count()


def test_filters_follow_scores(spark, steps):
    sf, docs = steps
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    good = {r.id for r in quality.score(docs[0], quality.fit(docs[0], labels)).where("score >= 0.5").collect()}
    assert set(rows(docs[1])) == good
    civil = {r.id for r in toxicity.score(docs[1], toxicity.fit(docs[1], labels)).where("score < 0.7").collect()}
    assert set(rows(docs[2])) == civil


def test_one_of_each_group_stays(steps):
    _, docs = steps
    want = brute_copies(sorted(rows(docs[2]).items()))  # five-word shingles, similarity of 0.8
    assert set(rows(docs[3])) == want and docs[3].count() == len(want)


def test_tokens(steps):
    _, docs = steps
    own = bpe.load(open(bpe.default_path(), "rb").read())
    texts = rows(docs[4])
    got = docs[5].collect()
    assert {r.doc_id for r in got} == set(texts)
    for r in got:
        assert bytes(r.ids) == own.encode(texts[r.doc_id]) and own.decode(bytes(r.ids)) == texts[r.doc_id]


def test_repeated_and_null_rows(spark):
    rows = [(1, "a b c d"), (1, "a b c d"), (2, "a b c d"), (None, None), (None, ""), (7, "x y z"), (None, "x y z")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "5 as id", "6 as fp", "7 as component_id")
    got = simhash.keep_representatives(df)
    assert got.columns == df.columns
    assert sorted((r.doc_id or 0, r.text or "") for r in got.collect()) == [(0, ""), (1, "a b c d"), (7, "x y z")]


@pytest.mark.parametrize("keep", [simhash.keep_representatives, near_copies.keep_representatives])
def test_rows_of_one_id_and_clashing_names(spark, keep):
    a, b = "one text about a thing", "quite another text about something else entirely"
    given = [(1, b), (5, a), (5, b), (None, b), (None, "no id has this one here"), (None, "no id has this one here"), (5, a)]
    names = "_kept _repeated _fp _row_id _row_key _row_kept _row_again _row_n id key n kept".split()
    df = spark.createDataFrame(given, "doc_id long, text string").selectExpr("*", *[f"{i} as {n}" for i, n in enumerate(names)])
    got = keep(df)
    assert got.columns == df.columns
    assert sorted((r.doc_id or 0, r.text) for r in got.collect()) == [(0, "no id has this one here"), (1, b), (5, a)]


def test_contaminated_rows_go(spark, tmp_path):
    spark.createDataFrame([(1, ITEM)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    given = [(1, ITEM), (1, "a clean row of the same id"), (None, ITEM), (None, None), (2, ITEM), (2, ITEM), (3, ""), (3, "")]
    df = spark.createDataFrame(given, "doc_id long, text string").selectExpr("*", "1 as _row_key", "2 as _row_salt", "3 as key")
    got = P.drop_contaminated(spark, df, str(tmp_path))
    assert got.columns == df.columns
    assert sorted((r.doc_id or 0, r.text or "") for r in got.collect()) == [(0, ""), (1, "a clean row of the same id"), (3, ""), (3, "")]


def test_stages_on_empty_tables(spark, tmp_path):
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.createDataFrame([], "doc_id long, text string, lang string")
    for _, stage in P.STAGES[:-1]:
        got = stage(spark, docs, str(tmp_path))
        assert got.columns == docs.columns and got.count() == 0
    few = spark.createDataFrame([(None, None, "en"), (1, "", "en"), (None, "some words", None)], docs.schema)
    for _, stage in P.STAGES[:-1]:
        assert stage(spark, few, str(tmp_path)).columns == docs.columns
