import gzip
import json
import random

import pytest

from glossa.sources import readers as R
from glossa.sources import sinks as S


@pytest.fixture
def put(tmp_path):
    def write(name, content, zipped=False):
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(gzip.compress(content.encode()) if zipped else content.encode())
        return str(path)

    return write


def test_lists(spark, put):
    path = put("a.tsv", "ab.\tx\nA B\ty\nq\tz\nab\tw\n")
    assert [r.sf for r in R.short_form_list(spark, path).collect()] == ["AB", "A B", "AB"]
    assert [r.name for r in R.plain_list(spark, put("b.txt", " b \na\n\nb\n")).collect()] == ["a", "b"]


def test_json(spark, put):
    path = put("m/1.json", json.dumps({"AB": ["x", "y"], "C": []}))
    assert {(r.sf, r.lf) for r in R.json_map_of_lists(spark, path).collect()} == {("AB", "x"), ("AB", "y")}
    put("m/2.json", json.dumps({"AB": ["z"]}))
    shards = R.merged_json_shards(spark, path.rsplit("/", 1)[0])
    assert {r.key: r["items"] for r in shards.collect()} == {"AB": ["z"], "C": []}
    assert [r.sf for r in R.json_array(spark, put("a.json", '["p", "q"]')).collect()] == ["p", "q"]
    both = R.from_sources(spark, {"one": ("json", path), "two": ("json", path)})
    assert {r.source for r in both.collect()} == {"one", "two"} and both.count() == 4


def test_delimited_and_csv(spark, put):
    path = put("t.txt", 'aapp|T116|Amino Acid, "Peptide"\n')
    assert tuple(R.semantic_types(spark, path).first()) == ("aapp", "T116", 'Amino Acid, "Peptide"')
    csv = put("d/a.csv", 'sf,n\nNA,1\n"x\ny",2\n,3\n')
    rows = R.headered_csv(spark, csv, "sf string, n int")
    assert [r.sf for r in rows.orderBy("n").collect()] == ["NA", "x\ny", None]
    assert [r.sf for r in R.headered_csv(spark, csv, "sf string, n int", fold_nulls=True).orderBy("n").collect()] == [None, "x\ny", None]
    put("d/b.csv", "sf,n\nNA,1\n")
    assert R.csv_directory(spark, csv.rsplit("/", 1)[0], "sf string, n int").count() == 2


def test_documents(spark, put):
    path = put("c.txt", "first note\nmore\n<DOCSTART> id=17\nsecond says <DOCSTART> inside\n<DOCSTART>\nx\n")
    got = R.marked_documents(spark, path).orderBy("doc_id").collect()
    assert [(r.doc_id, r.text) for r in got] == [("doc_2", "first note\nmore\n"), ("doc_4", "second says <DOCSTART> inside\n"), ("doc_5", "x\n")]
    path = put("b.txt", "one\nmore\n\n\n\ntwo\n\nthree")
    got = {r.doc_id: r.text for r in R.blank_line_documents(spark, path).collect()}
    assert got == {"2_b.txt": "one\nmore\n", "6_b.txt": "two\n", "7_b.txt": "three\n"}
    put("x/n.txt", "hello\n")
    put("x/n.md", "no")
    assert [tuple(r) for r in R.text_directory(spark, path.rsplit("/", 1)[0] + "/x").collect()] == [("n.txt", "hello\n")]


def test_xml(spark, put):
    record = "<PubmedArticle><MedlineCitation><PMID Version='1'>7</PMID><Article><Abstract><AbstractText Label='A'>One.</AbstractText><AbstractText Label='B'>Two.</AbstractText></Abstract></Article></MedlineCitation></PubmedArticle>"
    path = put("p.xml.gz", f"<Set>{record}<PubmedArticle><MedlineCitation><PMID Version='1'>8</PMID></MedlineCitation></PubmedArticle></Set>", True)
    assert [tuple(r) for r in R.xml_abstracts(spark, path).collect()] == [("7", "One. Two.")]


def test_partitions_and_stages(spark, tmp_path):
    rows = spark.createDataFrame([("AB", 1988), ("CD", 1990), ("CD", 2014)], "sf string, year int")
    S.write_partitioned(rows, f"{tmp_path}/y", "year")
    years = R.documents_by_year(spark, f"{tmp_path}/y", 1989, 2014)
    assert years.count() == 2 and "PartitionFilters: [isnotnull(year" in years._jdf.queryExecution().executedPlan().toString()
    S.write_partitioned(rows.where("year = 1988").withColumn("sf", rows.sf.substr(1, 1)), f"{tmp_path}/y", "year")
    assert {r.sf for r in spark.read.parquet(f"{tmp_path}/y").collect()} == {"A", "CD"}
    S.write_partitioned(rows, f"{tmp_path}/k", "sf")
    assert R.by_key(spark, f"{tmp_path}/k", "sf", ["CD"]).count() == 2
    calls = []

    def make():
        calls.append(1)
        return rows

    for cached in (True, True, False):
        assert S.stage(spark, f"{tmp_path}/s", make, cached).count() == 3
    assert len(calls) == 2
    for i in (1, 2):
        S.write_iteration(rows, f"{tmp_path}/i", i)
    assert spark.read.parquet(f"{tmp_path}/i").where("iter = 2").count() == 3


def test_json_and_csv_sinks(spark, tmp_path):
    rows = spark.createDataFrame([("A", 'x "q"'), ("A", "w"), ("B", "z\nz")], "sf string, lf string")
    S.write_json_map(rows, f"{tmp_path}/j", per_file=1)
    assert [json.loads(r.value) for r in spark.read.text(f"{tmp_path}/j").orderBy("value").collect()] == [{"A": ["w", 'x "q"']}, {"B": ["z\nz"]}]
    S.write_csv(rows, f"{tmp_path}/c")
    assert {tuple(r) for r in R.headered_csv(spark, f"{tmp_path}/c", "sf string, lf string").collect()} == {tuple(r) for r in rows.collect()}


def test_batches_and_synthetic(spark):
    rows = R.synthetic_vectors(spark, ["A", "B"], 10, 3, 1.0, 5)
    assert rows.collect() == R.synthetic_vectors(spark, ["A", "B"], 10, 3, 1.0, 5).collect()
    assert {r.sf for r in rows.collect()} == {"A", "B"} and all(len(r.embedding) == 3 for r in rows.collect())
    assert R.in_batches(rows.select("row_id"), lambda b: b.assign(row_id=b.row_id * 2), "row_id long").agg({"row_id": "sum"}).first()[0] == 90


def _scan(text, marker):
    """What a walk through one file's lines gives."""
    out, held, lines = [], "", text.split("\n")[: -1 if text.endswith("\n") or not text else None]
    for i, line in enumerate(lines):
        if line.startswith(marker):
            if len(held) > 1:
                out.append((f"doc_{i}", held))
            held = ""
        else:
            held += line + "\n"
    return [*out, *([(f"doc_{len(lines) - 1}", held)] if held else [])]


@pytest.mark.parametrize("split", ["300b", "16m"])
def test_one_file_is_spread_over_splits(spark, put, split):
    rng = random.Random(7)
    parts = ["<DOCSTART>", "<DOCSTART> id", " <DOCSTART>", "word " * 9, "", "a", "é", "b" * 150]
    texts = ["".join(rng.choice(parts) + "\n" for _ in range(150)), "no marker\n" * 60, "<DOCSTART>\n<DOCSTART>\n\n<DOCSTART>\nq", "\n", ""]
    for i, text in enumerate(texts):
        path = put(f"s{split}/{i}.txt", text)
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", split)
        spark.conf.set("spark.sql.files.openCostInBytes", "1b")
        got = R.marked_documents(spark, path.rsplit("/", 1)[0]).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    for i, text in enumerate(texts):
        mine = sorted((r.doc_id, r.text) for r in got if r.file.endswith(f"/{i}.txt"))
        assert mine == sorted(_scan(text, "<DOCSTART>"))


def test_made_up_rows_repeat(spark):
    vectors = R.synthetic_vectors(spark, ["AB", "CD"], 10, 3, 1.0, 7).collect()
    assert vectors == R.synthetic_vectors(spark, ["AB", "CD"], 10, 3, 1.0, 7).collect() and [r.sf for r in vectors[:3]] == ["AB", "CD", "AB"]
    texts = R.synthetic_documents(spark, ["x", "y"], 5, 4).collect()
    assert len(texts) == 5 and all(set(r.text.split()) <= {"x", "y"} and len(r.text.split()) == 4 for r in texts)
    assert {tuple(r.embedding) for r in R.evaluation_rows(spark, "AB", "above", 2).collect()} == {(1.0, 1.0)}
