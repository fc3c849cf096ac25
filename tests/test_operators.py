import math
import random
import tracemalloc
import uuid
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from glossa.operators import abbreviations, cluster, collect, contexts, dictionary, disambiguate, embedding, inclusion, listings, metrics, sampling


def test_merge_sources(spark):
    rows = [("a.b", "Alpha-Beta", "x"), ("AB", "alphabeta", "y"), ("AB", "the", "x"), ("AB", "AB", "x"), ("AB", "No results", "x"), ("AB", "--", "x"), ("CD", "c d", "x"), ("NA", "null", "x")]
    df = spark.createDataFrame(rows, "sf string, lf string, source string")
    got = sorted(tuple(r) for r in dictionary.merge_sources(df).collect())
    assert got == [("AB", "alphabeta", "x|y"), ("CD", "c d", "x"), ("NA", "null", "x")]
    assert dictionary.merge_sources(df, spark.createDataFrame([("CD",)], "sf string")).count() == 1


def test_standardize(spark):
    rows = [("AB", "alpha beta", "x"), ("AB", "alpha-beta", "y"), ("AB", "ab", "x"), ("AB", "!", "x")]
    df = spark.createDataFrame(rows, "sf string, lf string, source string")
    got = dictionary.standardize(df, F.when(F.col("lf") == "!", "").otherwise(F.col("lf"))).collect()
    assert [tuple(r) for r in got] == [("AB", "alpha beta|alpha-beta", "alpha-beta", "x|y")]


def test_concepts(spark):
    types = spark.createDataFrame([("a", "T1", "Type A"), ("b", "T2", "Type B")], "abbr string, tui string, name string")
    groups = spark.createDataFrame([("G", "Group", "T1", "Type A")], "group_code string, group_name string, tui string, type_name string")
    concepts = spark.createDataFrame([(1, "C1", "[a,b]"), (1, "C0", "[a]"), (2, "C9", "[]"), (3, "C2", "[z]")], "idx int, cui string, semtypes string")
    found = dictionary.semantic_lookup(concepts, types, groups)
    assert {r.group_name: r.n for r in dictionary.group_counts(found).collect()} == {"Group": 2}
    sets = {r.idx: tuple(r)[1:] for r in dictionary.concept_sets(found).collect()}
    assert sets == {1: ("C0|C1", "Type A|Type B", "Group"), 3: ("C2", None, None)}
    rows = spark.createDataFrame([(1, "AB", "x"), (4, "AB", "y"), (5, "AB", "z")], "idx int, sf string, lf string")
    joined = dictionary.with_concepts(rows, dictionary.concept_sets(found)).withColumns({"lf_base": F.col("lf"), "source": F.lit("s")})
    got = {r.cui: r.lf for r in dictionary.group_by_concept(joined).collect()}
    assert got == {"C0|C1": "x", None: "y|z"}


def test_vocabulary(spark):
    rows = [("A", "x", 2, 1), ("A", "y", 0, 2), ("A", "w", 0, 3), ("A", "z", 5, 0), ("B", "q", 1, 0)]
    df = spark.createDataFrame(rows, "sf string, lf string, support long, pos int")
    vocab = dictionary.vocabulary(df, "pos")
    assert {tuple(r) for r in vocab.collect()} == {("A", "z", 0, 5), ("A", "x", 1, 2), ("A", "$w$y", 2, 0), ("B", "q", 0, 1), ("B", "$", 1, 0)}
    got = dictionary.token_ids(spark.createDataFrame([("A", "no"), ("A", "x")], "sf string, lf string"), vocab)
    assert {(r.lf, r.lf_id, r.support) for r in got.collect()} == {("no", -1, None), ("x", 1, 2)}


def test_clusters(spark):
    rows = [
        (1, "S", "a b c", None, 10), (2, "S", "b c d", None, 11), (3, "S", "a b", None, 12), (4, "S", "q r", "C1|C2", 13), (5, "S", "s t", "C2", 14), (6, "S", "u", None, 14),
        (7, "T", "a b c", "C1", 15), (8, "S", "lone", None, 16), (9, "S", "c b a", None, 17),
    ]
    df = spark.createDataFrame(rows, "id long, sf string, lf string, cui string, row_id int")
    got = {r.id: r.cluster_id for r in cluster.cluster(df).collect()}
    assert got == {1: 1, 3: 1, 9: 1, 2: 2, 4: 4, 5: 4, 6: 4, 7: 7, 8: 8}
    assert {r.lf for r in cluster.merged_clusters(df, cluster.cluster(df), ("lf",)).where("cluster_id = 4").collect()} == {"q r|s t|u"}


def test_similar_pairs_match_brute_force(spark):
    rng = random.Random(5)
    rows = [(i, rng.choice("ST"), " ".join(rng.choices("abcdefg", k=rng.randrange(1, 6)))) for i in range(120)]
    df = spark.createDataFrame(rows, "id long, sf string, lf string")
    for t in (0.3, 0.66):
        got = {(r.a, r.b) for r in cluster.similar_pairs(df, t).collect()}
        sets = {i: set(lf.split()) for i, _, lf in rows}
        want = {(i, j) for i, s, _ in rows for j, u, _ in rows if i < j and s == u and len(sets[i] & sets[j]) / len(sets[i] | sets[j]) > t}
        assert got == want


def test_similar_pairs_under_a_token_of_half_the_names(spark):
    rng = random.Random(6)
    rows = [(i, rng.choice("ST"), " ".join([*(["hot"] if i % 2 else []), *rng.choices("abcdefghij", k=rng.randrange(1, 7))])) for i in range(300)]
    rows += [(300, "S", None), (301, "S", ""), (302, None, "hot a"), (303, "S", "B A hot"), (304, "S", "hot a b b")]
    df = spark.createDataFrame(rows, "id long, sf string, lf string")
    sets = {i: (s, {w for w in lf.lower().split(" ") if w}) for i, s, lf in rows if s and lf}
    for t in (0.0, 0.5, 0.66):
        got = sorted((r.sf, r.a, r.b, round(r.similarity, 9)) for r in cluster.similar_pairs(df, t, block=16).collect())
        want = [
            (s, i, j, round(len(x & y) / len(x | y), 9)) for i, (s, x) in sets.items() for j, (u, y) in sets.items() if i < j and s == u and len(x & y) / len(x | y) > t
        ]
        assert got == sorted(want)
    docs = spark.createDataFrame([(i, s, sorted(x)) for i, (s, x) in sets.items()], "id long, sf string, tokens array<string>")
    dealt = cluster.block_pairs(docs, 0.0, 16)
    joined = cluster.block_pairs(docs, 0.0, 16, most_hot=0)
    assert dealt.count() == joined.count() and dealt.exceptAll(joined).isEmpty()
    assert dealt.groupBy("sf", "key").count().agg({"count": "max"}).first()[0] > 300
    assert dealt.groupBy("sf", "key", "low", "high").count().agg({"count": "max"}).first()[0] < 64


def test_similar_distinct_meets_as_sketches_and_row_classes_as_signatures(spark):
    rng = random.Random(8)
    rows = [(i, rng.choice("ST"), " ".join(rng.choices("abcdefgh", k=rng.randrange(0, 7)))) for i in range(300)] + [(300, None, "a"), (301, "S", None), (302, "S", "  "), (303, "S", "A  b a")]
    df = spark.createDataFrame(rows, "id long, sf string, lf string")
    first, copies = {}, {}
    for i, s, lf in rows:
        key = (s, frozenset(w for w in (lf or "").lower().split(" ") if w))
        if s and key[1]:
            first.setdefault(key, i)
            copies.setdefault(key, []).append(i)
    got = {(r.a, r.b) for r in cluster.similar_distinct(df, 0.6, block=16).collect()}
    assert got == {(i, j) for (s, x), i in first.items() for (u, y), j in first.items() if i < j and s == u and len(x & y) / len(x | y) > 0.6}
    assert {tuple(r) for r in cluster.row_classes(df).collect()} == {(i, ids[0], len(ids)) for ids in copies.values() for i in ids}
    dealt = cluster.block_pairs(spark.createDataFrame([(1, "S", ["a"])], "id long, sf string, tokens array<string>"), 0.6)
    assert {"size", "parity"} < set(dealt.columns) and "tokens" not in dealt.columns  # sets stay out of the pair join


def test_frequent_tokens_are_keys_together_not_alone(spark):
    rng = random.Random(9)
    sets = {i: set(rng.sample([f"w{k}" for k in range(30)], rng.randrange(1, 9))) for i in range(600)}
    sets |= {i: {f"w{k}" for k in rng.sample(range(30), 8)} | {f"l{k}" for k in rng.sample(range(34), rng.randrange(16, 34))} for i in range(600, 680)}  # over and under 40 tokens
    docs = spark.createDataFrame([(i, "S", sorted(x)) for i, x in sets.items()], "id long, sf string, tokens array<string>")
    for t in (0.45, 0.66):
        got = {(r.a, r.b) for r in cluster.similar_sets(docs, t, block=16).collect()}
        assert got == {(i, j) for i, x in sets.items() for j, y in sets.items() if i < j and len(x & y) / len(x | y) > t}
    dealt = cluster.block_pairs(docs.where("id < 600"), 0.66, block=16)
    groups = [r["count"] for r in dealt.groupBy("sf", "key", "low", "high").count().collect()]
    assert sum(n * (n - 1) // 2 for n in groups) < 600 * 599 / 2 / 8  # of all pairs


def test_token_classes_keep_copies_out_of_pairs(spark):
    rows = [(i, "S", "b a" if i % 2 else "A B") for i in range(400)] + [(400, "S", "a b c"), (401, "T", "a b"), (402, "S", None)]
    classes = cluster.token_classes(spark.createDataFrame(rows, "id long, sf string, lf string"))
    assert {tuple(r) for r in classes.groupBy("sf", "first").count().collect()} == {("S", 0, 400), ("S", 400, 1), ("T", 401, 1)}
    assert [(r.a, r.b) for r in cluster.similar_sets(classes.where("id = first"), 0.6).collect()] == [(0, 400)]
    df = spark.createDataFrame([(*r, None) for r in rows], "id long, sf string, lf string, cui string")
    assert {r.cluster_id for r in cluster.cluster(df, 0.6).where("id <= 400").collect()} == {0}
    assert cluster.similar_pairs(df.limit(0)).collect() == []


def test_collect(spark):
    d = spark.createDataFrame([("S1", "x", 0), ("S2", "x", 1), ("S3", "S1", 2)], "sf string, lf string, pos int")
    a = spark.createDataFrame([("x", "1", "c"), ("x", "1", "c"), ("x", "2", None), ("S1", "3", "e"), ("zz", "4", "f")], "form string, doc_id string, context string")
    got = {tuple(r) for r in collect.collect({"n": a, "m": a.limit(0)}, d).collect()}
    assert got == {("x", "1", "c", "n", "S1"), ("S1", "3", "e", "n", "S1")}
    assert [r.form for r in collect.unknown_forms(a, d).collect()] == ["zz"]
    counts = {(r.sf, r.lf): (r.sf_count, r.lf_count) for r in collect.with_counts(d, a).collect()}
    assert counts == {("S1", "x"): (1, 3), ("S2", "x"): (0, 3), ("S3", "S1"): (0, 1)}


def test_downsample(spark):
    rows = [("L", f"d{i}", f"c{i}", "S") for i in range(50)] + [("S", f"d{i % 10}", f"k{i}", "S") for i in range(100)] + [("M", "d", "c", "S")]
    df = spark.createDataFrame(rows, "form string, doc_id string, context string, sf string")
    got = sampling.downsample(df, 20, 45).collect()
    assert len(set(got)) == len(got) and got == sampling.downsample(df, 20, 45).collect()
    by = {f: [r for r in got if r.form == f] for f in "LSM"}
    assert len(by["L"]) == 20 and len(by["M"]) == 1 and len(by["S"]) == 40 and len({r.doc_id for r in by["S"]}) == 4


def test_split_and_folds(spark):
    df = spark.range(3000).withColumn("y", (F.col("id") % 5 == 0).cast("int"))
    share = sampling.split(df, sampling.hashed("id")).agg(F.avg("is_train")).first()[0]
    assert abs(share - 0.8) < 0.03
    folds = sampling.stratified_folds(df, "y", 3, 0.2, "id").groupBy("fold", "y").agg(F.sum("is_test").alias("t"), F.count("*").alias("n")).collect()
    assert {(r.y, r.t, r.n) for r in folds} == {(0, 480, 2400), (1, 120, 600)}
    labels = sampling.train_labels(df.where("id < 300"), sampling.hashed("id"), "id")
    assert labels.agg(F.sum("is_train")).first()[0] == 200


def test_knn_ties_go_to_the_farthest(spark):
    known = [(1, "S", "a", [1.0, 0.0]), (2, "S", "b", [1.0, 0.1]), (3, "S", "a", [1.0, 0.9]), (4, "S", "b", [1.0, 0.8]), (5, "T", "c", [1.0, 0.0])]
    k = spark.createDataFrame(known, "id int, sf string, lf string, embedding array<double>")
    q = spark.createDataFrame([(9, "S", [1.0, 0.0])], "q int, sf string, embedding array<double>")
    found = disambiguate.neighbours(q, k, 4)
    assert [r.id for r in found.orderBy("rank").collect()] == [1, 2, 4, 3]
    assert disambiguate.majority(found).first().predicted == "a"
    got = disambiguate.accuracy(spark.createDataFrame([("x|yy", "yy"), ("a", "a"), ("a", "b")], "truth string, predicted string")).first()
    assert got.n == 3 and abs(got.exact - 1 / 3) < 1e-12 and abs(got.approximate - 2 / 3) < 1e-12


def test_neighbours_in_blocks(spark):
    rng = np.random.default_rng(2)
    known = [(i, "hot" if i % 3 else "b", f"L{i % 4}", rng.integers(-2, 3, 3).astype(float).tolist()) for i in range(200)]
    known = [(i, s, lf, x if any(x) else [1.0, 0.0, 0.0]) for i, s, lf, x in known]
    queries = [(i, s, x) for i, s, _, x in known[:40]] + [(500, "none", [1.0, 1.0, 1.0])]
    k = spark.createDataFrame(known, "id long, sf string, lf string, embedding array<double>")
    q = spark.createDataFrame(queries, "q long, sf string, embedding array<double>")
    want = set()
    for i, s, x in queries:
        sims = sorted(((-round(float(np.dot(x, y) / np.linalg.norm(x) / np.linalg.norm(y)), 9), j, lf) for j, t, lf, y in known if s == t))[:5]
        want |= {(i, s, lf, j, r + 1) for r, (_, j, lf) in enumerate(sims)}
    for block in (4096, 7):
        assert {(r.q, r.sf, r.lf, r.id, r["rank"]) for r in disambiguate.neighbours(q, k, 5, block).collect()} == want


def _contexts(spark):
    rows = [(i, "f", "heart", f"{'wide words here and there ' * (i % 4)}the heart beats {'so long as it can ' * (i % 3)}") for i in range(40)]
    rows += [(99, "f", "gone", "nothing"), (100, "f", None, None), (101, "f", "widespread", "A widespread widespread word"), (102, "f", "heart", "heart")]
    return rows, spark.createDataFrame(rows, "row_idx long, form string, sf string, context_trimmed string").repartition(3)


def _key(got):
    return sorted((r.row_idx, r.span, None if r.embedding is None else [round(x, 9) for x in r.embedding]) for r in got.collect())


def test_blocks_give_what_rows_give(spark, monkeypatch):
    rows, df = _contexts(spark)
    want = []
    for i, _, sf, text in rows:
        pieces = embedding.pieces_of(text or "")
        span = contexts.word_piece_span(pieces, (sf or "").lower())
        h = embedding.hashed_layers([pieces])[0]
        want.append((i, None if span is None else list(span), None if span is None else [round(x, 9) for x in h[-4:, span[0] : span[1]].mean(axis=1).mean(axis=0)]))
    assert _key(embedding.embed(df)) == sorted(want)
    whole = lambda block: embedding.hashed_block(block)
    monkeypatch.setattr(embedding, "BLOCK_TOKENS", 40)
    assert _key(embedding.embed(df, encoder=whole)) == sorted(want) == _key(embedding.embed(df))


def test_rows_lie_in_blocks_by_length(monkeypatch):
    monkeypatch.setattr(embedding, "BLOCK_TOKENS", 20)
    sizes = np.array([3, 9, 0, 10, 2, 30, 9])
    blocks = [b.tolist() for b in embedding._blocks(sizes)]
    assert blocks == [[5], [3, 1], [6, 0], [4]] and sorted(sum(blocks, [])) == [0, 1, 3, 4, 5, 6]


def test_embedding_goes_on_after_a_stop(spark, tmp_path):
    _, df = _contexts(spark)
    path = f"{tmp_path}/vectors"
    assert embedding.embed_with_restart(df, path, 16, most=2).count() == 32
    before = {p.name for p in (tmp_path / "vectors" / "batch=0").iterdir()}
    assert _key(embedding.embed_with_restart(df, path, 16)) == _key(embedding.embed(df))
    assert {p.name for p in (tmp_path / "vectors" / "batch=0").iterdir()} == before
    assert embedding.embed_with_restart(df.limit(0), f"{tmp_path}/none").count() == 0


def test_tagging_goes_on_after_a_stop(spark, tmp_path):
    calls = tmp_path / "calls"
    calls.mkdir()

    def tagger(phrases):
        (calls / uuid.uuid4().hex).write_text("|".join(phrases))
        if "p25" in phrases or stop.exists() and "p33" in phrases:
            raise (SystemExit if "p33" in phrases else ValueError)("no answer")
        return [p.upper() for p in phrases]

    stop = tmp_path / "stop"
    rows = [(i, f"p{i}", f"q{i}") for i in range(60) if i != 41] + [(None, "x", "y"), (7, "p7", "q7")]
    df = spark.createDataFrame(rows, "idx long, lf_base string, lf string").repartition(4)
    whole = sorted(map(tuple, dictionary.tag_with_restart(df, tagger, f"{tmp_path}/whole", 5, 2).collect()))
    assert len(whole) == 60 and {c for i, b, c in whole if b == 5} == {f"Q{i}" for i in range(25, 30)} and (7, 1, "P7") in whole
    for old in calls.iterdir():
        old.unlink()
    stop.touch()
    with pytest.raises(Exception, match="SystemExit|no answer|crash|failed"):
        dictionary.tag_with_restart(df, tagger, f"{tmp_path}/cut", 5, 2)
    stop.unlink()
    before = {c.read_text() for c in calls.iterdir()}
    assert sorted(map(tuple, dictionary.tag_with_restart(df, tagger, f"{tmp_path}/cut", 5, 2).collect())) == whole
    seen = Counter(c.read_text() for c in calls.iterdir())
    # the waves before the stop were asked for once, by the run that was stopped
    first = [t for t in seen if t.startswith("p") and int(t.split("|")[0][1:]) < 30]
    assert len(first) == 6 and all(seen[t] == 1 and t in before for t in first)
    assert dictionary.tag_with_restart(df.limit(0), tagger, f"{tmp_path}/none").count() == 0


def test_waves_do_not_list_one_another(spark, tmp_path):
    df = spark.range(40).selectExpr("id AS idx", "'a' AS lf_base", "'b' AS lf")
    spark.sparkContext.setJobGroup(str(tmp_path), "")
    assert dictionary.tag_with_restart(df, lambda phrases: phrases, f"{tmp_path}/tagged", 1, 1).count() == 40
    jobs = spark.sparkContext.statusTracker().getJobIdsForGroup(str(tmp_path))
    spark.sparkContext.setJobGroup("", "")
    assert len(jobs) < 3 * 40  # two to write a wave; two more a wave listed all folders and read a schema


def test_tagger_that_fails(spark):
    def tagger(phrases):
        if any("bad" in p for p in phrases):
            raise ValueError(phrases)
        return [p.upper() for p in phrases]

    rows = [(1, "a", "x"), (2, "bad", "y"), (3, "c", "bad too"), (4, "d", "z")]
    df = spark.createDataFrame(rows, "idx long, lf_base string, lf string").coalesce(1)
    got = {r.idx: r.cui for r in dictionary.tag_in_batches(df, tagger, 3).collect()}
    assert got == {1: "X", 2: "Y", 3: dictionary.ERROR, 4: "D"}
    assert [r.idx for r in dictionary.untagged(df, df.where("idx < 4")).collect()] == [4]


def test_metrics(spark):
    rows = [(1, 0.9), (1, 0.8), (0, 0.8), (1, 0.3), (0, 0.1), (0, 0.1)]
    df = spark.createDataFrame(rows, "label int, score double")
    want = np.mean([(a > b) + 0.5 * (a == b) for x, a in rows for y, b in rows if x and not y])
    assert abs(metrics.roc_auc(df).first().auc - want) < 1e-12
    curve = {r.threshold: (r.tpr, r.fpr) for r in metrics.roc_curve(df).collect()}
    assert curve[0.8] == (2 / 3, 1 / 3) and curve[0.1] == (1.0, 1.0)
    assert metrics.roc_auc(df.where("label = 1")).first().auc is None
    report = {r.label: r for r in metrics.classification_report(spark.createDataFrame([("a", "a"), ("a", "b"), ("c", "a")], "truth string, predicted string")).collect()}
    assert report["a"].precision == 0.5 and report["a"].recall == 0.5 and report["b"].support == 0 and report["c"].f1 == 0
    assert abs(report["accuracy"].f1 - 1 / 3) < 1e-12 and abs(report["weighted avg"].recall - 1 / 3) < 1e-12


def test_listings(spark):
    page = "\n".join(["intro", "== Medicine ==", "one", "two", "== Science ==", "=== Biology ===", "bio", "=== Other ===", "no", "== Arts ==", "x"])
    sections = listings.parse_sections(page)
    assert [s[2] for s in sections] == ["Medicine", "Science", "Biology", "Other", "Arts"] and sections[2][1] == 1
    # Science comes off the end first and hands its part to the head of the line, so Medicine is read
    assert listings.wanted_section(sections) == "one\ntwo"
    assert listings.wanted_section(sections[1:]) == "bio"
    assert listings.wanted_section([(0, None, "Arts", "x")]) is None
    df = spark.createDataFrame([("p", *s) for s in sections], "page string, ord int, parent int, title string, text string")
    assert [tuple(r) for r in listings.section_lines(df).collect()] == [("p", "one"), ("p", "two")]


def test_abbreviations(spark):
    text = "We used computed tomography (CT) and heat shock protein (HSP). The MRI (magnetic resonance imaging) was (see there) fine (1990)."
    assert abbreviations.pairs(text) == [("CT", "computed tomography"), ("HSP", "heat shock protein"), ("MRI", "magnetic resonance imaging")]
    assert abbreviations.definition("HSP", "no such thing") is None and abbreviations.pairs(None) == []
    df = spark.createDataFrame([(1, text), (2, "computed tomography (CT)")], "doc_id int, text string")
    got = abbreviations.by_short_form(abbreviations.extract(df)).collect()
    assert {r.sf: r.lfs for r in got}["CT"] == ["computed tomography"] * 2


def test_inclusion(spark):
    rng = random.Random(2)
    rows = []
    for i in range(240):
        good = i % 2
        lf = "alpha beta" if good else rng.choice(["gamma ray", "the red of it"])
        rows.append((i, "AB", lf, lf, rng.choice(["pubmed", "umls"]), "T1" if good else rng.choice(["T2", "T3"]), None if i % 7 == 0 else "G", good))
    df = spark.createDataFrame(rows, "id int, sf string, lf string, lf_base string, source string, semtypes string, semgroups string, label int")
    for kind in ("forest", "logistic"):
        model = inclusion.fit(df.where("id < 160"), kind=kind, trees=10)
        got = inclusion.predict(model, df.where("id >= 160").withColumn("semtypes", F.concat_ws("|", "semtypes", F.lit("unseen"))))
        assert got.where("is_valid = label").count() == 80
    assert inclusion.keep_valid(model, df).count() == 120


def test_embedding(spark):
    rows = [(0, "f", "CT", "the CT scan"), (1, "f", "CT", "none here"), (2, "f", "CT", None)]
    df = spark.createDataFrame(rows, "row_idx long, form string, sf string, context_trimmed string")
    got = {r.row_idx: r for r in embedding.embed(df).collect()}
    assert got[0].span == [1, 2] and len(got[0].embedding) == 32 and got[1].embedding is None and got[2].span is None
    rng = np.random.default_rng(3)
    x = rng.normal(size=(60, 3)) * [5, 1, 0.1] + 7
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id int, embedding array<double>")
    reduced, shares = embedding.reduce_dimensions(df, 2)
    pc = np.array([r.pc for r in reduced.orderBy("id").collect()])
    assert np.allclose(pc.mean(0), 0, atol=1e-9) and shares[0] > 0.9
    centred = x - x.mean(0)
    values = np.linalg.eigvalsh(np.cov(centred.T))[::-1]
    assert np.allclose(pc.var(0, ddof=1), values[:2], rtol=1e-6) and math.isclose(shares[0], values[0] / values.sum(), rel_tol=1e-6)


def test_stream(spark, tmp_path):
    from glossa.streaming import contexts as S

    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.txt").write_text("one CT two\nnothing\nCT end\n")
    terms = spark.createDataFrame([("CT", "CT")], "form string, phrase string")
    out = S.stream_contexts(S.read_documents(spark, f"{tmp_path}/in"), terms, [1], 2)
    S.write_contexts(out, f"{tmp_path}/out", f"{tmp_path}/check").awaitTermination()
    assert {r.context for r in spark.read.parquet(f"{tmp_path}/out").collect()} == {"one TARGETWORD two", "TARGETWORD end"}


def test_nearest_holds_few_similarities_at_once():
    rng = np.random.default_rng(3)
    known, asked = rng.normal(size=(4096, 8)), rng.normal(size=(6000, 8))
    known[7] = known[5]
    tracemalloc.start()
    near, sims = disambiguate.nearest(asked, known, 3)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 64e6  # all similarities at once are 197 MB, and each copy of them as much
    all_sims = np.round(asked[:500] @ known.T, 9)
    assert (near[:500] == np.argsort(-all_sims, axis=1, kind="stable")[:, :3]).all() and np.allclose(sims[:500], -np.sort(-all_sims, axis=1)[:, :3])
