"""Named queries over the driver's tables, and the SQL that gives the same rows elsewhere.

The tables hold no clinical text, so they stand in for it: ``part`` for the expansion table (long form: p_name, short
form: its initials, source: p_brand, concept: p_type), nation and region for semantic types and groups, ``documents``
for the corpus, ``embeddings`` for context vectors (long form: label, short form: label % 3).
"""

from __future__ import annotations

import string

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glossa.functions import edit, sets, text, vectors
from glossa.operators import (
    abbreviations, cluster, collect, contexts, dictionary, disambiguate, embedding, inclusion, listings, metrics, sampler, sampling,
    sweep,
)

from glossa.plans.materialize import materialize, scratch_path
from glossa.plans.ranges import numbered
from glossa.plans.registry import ORACLE_SQL, QUERIES, query  # noqa: F401
from glossa.sources.readers import lookup_source
from glossa.sources import models, services, sinks
from glossa.sources.tables import table

#: (form, phrase variants by bars)
SHORT_TERMS = ("The", "And", "Of", "In", "That")
LONG_TERMS = ("of the", "the and", "in the|at the", "thth of")
WORDS = r"list_filter(regexp_split_to_array(text, '[^\p{L}\p{N}_]+'), lambda x: x <> '')"
SF_SQL = "upper(substr(split_part(p_name, ' ', 1), 1, 1) || substr(split_part(p_name, ' ', 2), 1, 1))"
PUNCTUATION_SQL = string.punctuation.replace("'", "''")


def expansions(spark: SparkSession, sf: str) -> DataFrame:
    """(id, sf, lf, source, cui, size): the expansion table."""
    part = table(spark, sf, "part")
    return part.select(
        F.col("p_partkey").alias("id"), F.upper(text.initials(F.col("p_name"))).alias("sf"), F.col("p_name").alias("lf"), F.col("p_brand").alias("source"),
        F.col("p_type").alias("cui"), F.col("p_size").alias("size"),
    )


def terms(spark: SparkSession, forms: tuple[str, ...]) -> DataFrame:
    values = ", ".join(f"('{f}')" for f in forms)
    return contexts.variants(spark.sql(f"SELECT * FROM VALUES {values} AS t(form)"))


def corpus(spark: SparkSession, sf: str) -> DataFrame:
    return contexts.tokenise(table(spark, sf, "documents").select("doc_id", "text"))


# -- text functions and scans ----------------------------------------------------------------------------------------


@query(f"""SELECT p_partkey, sf FROM (SELECT p_partkey, upper(trim(translate(p_brand, '{PUNCTUATION_SQL}', ''))) AS sf FROM part) t WHERE length(sf) > 1""")
def sf_list_normalise(spark, sf):
    rows = table(spark, sf, "part").select("p_partkey", text.standardize_upper(F.col("p_brand")).alias("sf"))
    return rows.where(F.length("sf") > 1)


@query("""SELECT event_id, k, CAST(json_extract_string(props, '$.' || k) AS INTEGER) AS v FROM (SELECT event_id, props, unnest(json_keys(props)) AS k FROM events) t""")
def json_map_explode(spark, sf):
    rows = table(spark, sf, "events").select("event_id", F.from_json("props", "map<string,int>").alias("m"))
    return rows.select("event_id", F.explode("m").alias("k", "v"))


@query("""SELECT event_id, to_json(map_concat(MAP {'k': CAST(json_extract_string(props, '$.k') AS INTEGER), 'a': 1}, MAP {'a': 2, 'b': 3})) AS m FROM events""")
def map_update(spark, sf):
    rows = table(spark, sf, "events").select("event_id", F.from_json("props", "map<string,int>").alias("m"))
    base = sets.map_union(F.col("m"), F.create_map(F.lit("a"), F.lit(1)))
    return rows.select("event_id", F.to_json(sets.map_union(base, F.create_map(F.lit("a"), F.lit(2), F.lit("b"), F.lit(3)))).alias("m"))


@query("""SELECT CAST(year(o_orderdate) AS INTEGER) AS year, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders WHERE year(o_orderdate) BETWEEN 1996 AND 1999 GROUP BY 1""")
def year_scan(spark, sf):
    rows = table(spark, sf, "orders").where("o_orderdate >= timestamp'1996-01-01' AND o_orderdate < timestamp'2000-01-01'")
    return rows.groupBy(F.year("o_orderdate").alias("year")).agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query(rf"""SELECT doc_id, row_number() OVER (ORDER BY lang, doc_id) - 1 AS row_idx FROM documents""")
def row_numbers(spark, sf):
    return numbered(table(spark, sf, "documents").select("doc_id", "lang"), "lang", "doc_id").select("doc_id", "row_idx")


@query(r"""SELECT doc_id, n_ascii, n_words, first_three, squeezed FROM (SELECT doc_id,
  length(regexp_replace(text, '[^\x00-\x7F]', '', 'g')) AS n_ascii, length(regexp_replace(text, '[^\p{L}\p{N}_]+', '', 'g')) AS n_words,
  array_to_string(list_filter(regexp_split_to_array(text, '[^\p{L}\p{N}_]+'), lambda x: x <> '')[1:3], ' ') AS first_three,
  md5(trim(regexp_replace(text, '\s+', ' ', 'g'))) AS squeezed FROM documents) t""")
def text_functions(spark, sf):
    t = F.col("text")
    return table(spark, sf, "documents").select(
        "doc_id", F.length(text.ascii_only(t)).cast("long").alias("n_ascii"), F.length(text.strip_non_word(t)).cast("long").alias("n_words"),
        F.array_join(F.slice(text.words(t), 1, 3), " ").alias("first_three"), F.md5(text.collapse_space(t)).alias("squeezed"),
    )


@query(r"""WITH t AS (SELECT p_partkey, string_split(p_name || 's of the ' || p_type || 'ies', ' ') AS w FROM part)
SELECT p_partkey, array_to_string(list_filter(list_transform(w, lambda x: CASE WHEN length(x) <= 3 THEN x WHEN regexp_matches(x, 'ies$') THEN regexp_replace(x, 'ies$', 'y')
  WHEN regexp_matches(x, '[^sui]s$') THEN regexp_replace(x, 's$', '') ELSE x END), lambda x: x NOT IN ('of', 'the')), ' ') AS lf_base FROM t""")
def base_forms(spark, sf):
    phrase = F.concat("p_name", F.lit("s of the "), "p_type", F.lit("ies"))
    return table(spark, sf, "part").select("p_partkey", text.base_form(phrase, None, frozenset({"of", "the"})).alias("lf_base"))


@query(f"""WITH p AS (SELECT p_partkey, left(p_type, 3) AS sf, p_name AS lf, CASE WHEN p_size % 2 = 0 THEN 'pubmed' ELSE p_brand END AS source FROM part),
 i AS (SELECT *, lower(substr(split_part(lf, ' ', 1), 1, 1) || substr(split_part(lf, ' ', 2), 1, 1)) AS ini FROM p)
SELECT p_partkey, 1 AS support, levenshtein(lower(sf), ini) AS distance, levenshtein(lower(sf), ini) AS base_distance, length(lf) AS base_length,
 len(list_filter(string_split(lf, ' '), lambda x: x IN ('old', 'red'))) AS stopwords, CAST(source = 'pubmed' AS INTEGER) AS from_pubmed FROM i""")
def initials_levenshtein(spark, sf):
    rows = table(spark, sf, "part").select(
        "p_partkey", F.substring("p_type", 1, 3).alias("sf"), F.col("p_name").alias("lf"), F.col("p_name").alias("lf_base"),
        F.when(F.col("p_size") % 2 == 0, "pubmed").otherwise(F.col("p_brand")).alias("source"),
    )
    return inclusion.numeric_features(rows, frozenset({"old", "red"})).select("p_partkey", *inclusion.NUMERIC)


@query(f"""WITH l AS (SELECT DISTINCT {SF_SQL} AS sf, lower(p_name || ' (old kind)/' || p_type || ' or ' || p_brand || ', other') AS line FROM part),
 s AS (SELECT sf, unnest(list_transform(regexp_split_to_array(trim(split_part(line, ',', 1)), '/| or '), lambda x: trim(x))) AS x FROM l)
SELECT DISTINCT sf, trim(regexp_replace(x, '\\([\\w|\\s]+\\)', '', 'g')) AS lf FROM s WHERE length(x) > 1 AND x <> lower(sf)""")
def listing_pairs(spark, sf):
    rows = expansions(spark, sf)
    line = F.concat("lf", F.lit(" (old kind)/"), "cui", F.lit(" or "), "source", F.lit(", other"))
    return listings.listing_pairs(rows.select("sf", line.alias("line")).distinct())


@query(f"""SELECT 'p' || p_partkey AS doc_id, {SF_SQL} AS sf, p_name AS lf FROM part""")
def abbrev_pairs(spark, sf):
    rows = expansions(spark, sf)
    body = F.concat(F.lit("Again. We saw the "), "lf", F.lit(" ("), "sf", F.lit(") of (not this) today."))
    return abbreviations.extract(rows.select(F.concat(F.lit("p"), "id").alias("doc_id"), body.alias("text")))


# -- dictionary ------------------------------------------------------------------------------------------------------


@query(f"""WITH p AS (SELECT {SF_SQL} AS sf, p_name AS lf, p_brand AS source, p_size FROM part)
SELECT sf, lf, string_agg(DISTINCT source, '|' ORDER BY source) AS source FROM p
WHERE lf NOT IN ('red rod', 'no results') AND lf <> lower(sf) AND sf IN (SELECT sf FROM p WHERE p_size > 45) GROUP BY sf, lf""")
def merge_sources(spark, sf):
    rows = expansions(spark, sf)
    return dictionary.merge_sources(rows.select("sf", "lf", "source"), rows.where("size > 45").select("sf"), frozenset({"red rod"}))


@query(f"""WITH v AS (SELECT p_partkey AS pos, {SF_SQL} AS sf, p_brand AS source,
   CASE p_size % 3 WHEN 0 THEN p_name WHEN 1 THEN replace(p_name, ' ', '-') ELSE replace(upper(p_name), ' ', '  ') END AS lf FROM part),
 b AS (SELECT *, lower(lf) AS lf_base, regexp_replace(lower(lf), '[^\\p{{L}}\\p{{N}}_]+', '', 'g') AS key FROM v WHERE lower(sf) <> lower(lf)),
 r AS (SELECT *, row_number() OVER (PARTITION BY sf, key ORDER BY length(lf_base) DESC, pos DESC) AS rn FROM b)
SELECT sf, string_agg(DISTINCT lf, '|' ORDER BY lf) AS lf, trim(regexp_replace(max(CASE WHEN rn = 1 THEN lf_base END), '\\s+', ' ', 'g')) AS lf_base,
 string_agg(DISTINCT source, '|' ORDER BY source) AS source FROM r GROUP BY sf, key""")
def standardize_group(spark, sf):
    rows = expansions(spark, sf)
    kind = F.col("size") % 3
    lf = F.when(kind == 0, F.col("lf")).when(kind == 1, F.replace("lf", F.lit(" "), F.lit("-"))).otherwise(F.replace(F.upper("lf"), F.lit(" "), F.lit("  ")))
    rows = rows.select("id", "sf", lf.alias("lf"), "source")
    return dictionary.standardize(rows, F.lower("lf"), F.col("id"))


@query(f"""WITH p AS (SELECT {SF_SQL} AS sf, nullif(p_type, 'PROMO') AS cui, p_name AS lf, p_name || ' base' AS lf_base, p_brand AS source FROM part)
SELECT sf, cui, string_agg(DISTINCT lf, '|' ORDER BY lf) AS lf, string_agg(DISTINCT lf_base, '|' ORDER BY lf_base) AS lf_base,
 string_agg(DISTINCT source, '|' ORDER BY source) AS source, min(lower(cui)) AS semtypes, min(left(cui, 1)) AS semgroups FROM p GROUP BY sf, cui""")
def concept_group(spark, sf):
    rows = expansions(spark, sf).withColumn("cui", F.nullif("cui", F.lit("PROMO")))
    rows = rows.withColumns({"lf_base": F.concat("lf", F.lit(" base")), "semtypes": F.lower("cui"), "semgroups": F.substring("cui", 1, 1)})
    return dictionary.group_by_concept(rows)


def _looked_up(spark, sf):
    nation, region = table(spark, sf, "nation"), table(spark, sf, "region")
    types = nation.select(F.concat(F.lit("n"), "n_nationkey").alias("abbr"), F.col("n_name").alias("name"))
    groups = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_name").alias("type_name"), F.col("r_name").alias("group_name"))
    second = (F.col("c_custkey") * 7) % 31
    concepts = table(spark, sf, "customer").select(
        (F.col("c_custkey") % 400).alias("idx"), F.concat(F.lit("C"), "c_nationkey").alias("cui"),
        F.when(F.col("c_custkey") % 11 == 0, "[]").otherwise(F.concat(F.lit("[n"), "c_nationkey", F.lit(",n"), second, F.lit("]"))).alias("semtypes"),
    )
    return dictionary.semantic_lookup(concepts, types, groups)


_LOOKUP = """WITH c AS (SELECT c_custkey % 400 AS idx, 'C' || c_nationkey AS cui, unnest(['n' || c_nationkey, 'n' || ((c_custkey * 7) % 31)]) AS abbr FROM customer WHERE c_custkey % 11 <> 0),
 l AS (SELECT c.*, n_name AS type_name, r_name AS group_name FROM c LEFT JOIN nation ON abbr = 'n' || n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey) """


@query(_LOOKUP + "SELECT group_name, count(*) AS n FROM l WHERE group_name IS NOT NULL GROUP BY 1")
def semtype_semgroup_lookup(spark, sf):
    return dictionary.group_counts(_looked_up(spark, sf))


@query(
    _LOOKUP
    + """SELECT idx, string_agg(DISTINCT cui, '|' ORDER BY cui) AS cui, string_agg(DISTINCT type_name, '|' ORDER BY type_name) AS semtypes,
 string_agg(DISTINCT group_name, '|' ORDER BY group_name) AS semgroups FROM l GROUP BY idx"""
)
def concept_sets(spark, sf):
    return dictionary.concept_sets(_looked_up(spark, sf))


@query("""WITH r AS (SELECT p_partkey AS idx, p_name AS lf_base, p_type AS lf FROM part), t AS (SELECT DISTINCT p_name AS phrase, 'C1' AS cui FROM part WHERE p_name LIKE 'red%' UNION ALL SELECT DISTINCT p_type, 'C2' FROM part WHERE p_type < 'N'),
 f AS (SELECT idx, cui FROM r JOIN t ON lf_base = phrase), s AS (SELECT * FROM f UNION ALL SELECT idx, cui FROM r JOIN t ON lf = phrase WHERE idx NOT IN (SELECT idx FROM f))
SELECT r.idx, s.cui FROM r LEFT JOIN s USING (idx)""")
def concept_tagging(spark, sf):
    part = table(spark, sf, "part")
    rows = part.select(F.col("p_partkey").alias("idx"), F.col("p_name").alias("lf_base"), F.col("p_type").alias("lf"))
    a = part.where("p_name LIKE 'red%'").select(F.col("p_name").alias("phrase")).distinct().withColumn("cui", F.lit("C1"))
    b = part.where("p_type < 'N'").select(F.col("p_type").alias("phrase")).distinct().withColumn("cui", F.lit("C2"))
    tagged = dictionary.tag_concepts(rows, a.union(b).withColumn("semtypes", F.lit("[]")))
    return dictionary.with_concepts(rows, tagged).select("idx", "cui")


@query(f"""WITH p AS (SELECT p_partkey AS id, p_name AS lf, p_size, CASE p_size % 3 WHEN 0 THEN NULL WHEN 1 THEN 'Genes & Molecular Sequences' ELSE 'Disorders|Genes & Molecular Sequences' END AS semgroups FROM part)
SELECT id, lf FROM p WHERE semgroups LIKE 'Disorders%' AND lf IN (SELECT lf FROM p WHERE p_size > 48)""")
def clinical_group_filter(spark, sf):
    kind = F.col("size") % 3
    genes = F.lit("Genes & Molecular Sequences")
    rows = expansions(spark, sf).withColumn("semgroups", F.when(kind == 1, genes).when(kind == 2, F.concat(F.lit("Disorders|"), genes)))
    return dictionary.usable_long_forms(rows, rows.where("size > 48")).select("id", "lf")


@query("""SELECT count(*) AS n FROM part WHERE NOT (nullif(p_type, 'SMALL') IS NULL AND nullif(p_size % 5, 0) IS NULL)""")
def annotated_rows(spark, sf):
    rows = table(spark, sf, "part").select(F.nullif("p_type", F.lit("SMALL")).alias("semgroups"), F.nullif(F.col("p_size") % 5, F.lit(0)).alias("semtypes"))
    return dictionary.has_annotation(rows).agg(F.count("*").alias("n"))


@query("""SELECT 'lf' AS "column", max(contains(p_name, 'anvil')) AS found FROM part UNION ALL SELECT 'lf_base', max(contains(p_type, 'anvil')) FROM part""")
def find_term(spark, sf):
    rows = table(spark, sf, "part").select(F.col("p_name").alias("lf"), F.col("p_type").alias("lf_base"), "p_brand")
    return dictionary.find_term(rows, "anvil")


@query(f"""SELECT DISTINCT {SF_SQL} AS sf, p_name AS lf FROM part WHERE {SF_SQL} IN ('RB', 'OG')""")
def term_lookup(spark, sf):
    rows = expansions(spark, sf)
    wanted = spark.sql("SELECT * FROM VALUES ('RB'), ('OG'), ('XX') AS t(sf)")
    return lookup_source(wanted, rows.select("sf", "lf").distinct())


class _Numbers:
    """A service that knows the digits of a name, and gives no answer the first time that it is asked for every fifth."""

    def __init__(self):
        self.asked = set()

    def __call__(self, term: str) -> list[str]:
        digits = term.split("#")[-1].lstrip("0")
        if digits.endswith(("0", "5")) and term not in self.asked:
            self.asked.add(term)
            raise ConnectionError(term)
        return [digits, digits[::-1]] if digits else []


@query("""WITH n AS (SELECT DISTINCT c_name AS term, ltrim(split_part(c_name, '#', 2), '0') AS d FROM customer)
SELECT term, d AS answer FROM n WHERE d <> '' UNION ALL SELECT term, reverse(d) FROM n WHERE d <> ''""")
def served_terms(spark, sf):
    """Every customer's name asked of a service that fails now and then."""
    return services.answers(table(spark, sf, "customer"), _Numbers(), "c_name", delay=0)


_VOCAB = f"""WITH p AS (SELECT {SF_SQL} AS sf, p_name || ' ' || p_type AS lf, p_partkey AS pos, CASE WHEN p_type IN ('PROMO', 'SMALL') THEN 0 ELSE p_size % 7 + 1 END AS support FROM part),
 f AS (SELECT sf, lf, min(pos) AS first_at, max(support) AS support FROM p WHERE support > 0 GROUP BY sf, lf),
 k AS (SELECT sf, lf, CAST(row_number() OVER (PARTITION BY sf ORDER BY first_at, lf) - 1 AS INTEGER) AS lf_id, CAST(support AS BIGINT) AS support FROM f),
 z AS (SELECT sf, '$' || coalesce(string_agg(DISTINCT lf, '$' ORDER BY lf) FILTER (WHERE support = 0), '') AS lf,
   CAST(count(DISTINCT lf) FILTER (WHERE support > 0) AS INTEGER) AS lf_id, CAST(0 AS BIGINT) AS support FROM p GROUP BY sf),
 v AS (SELECT * FROM k UNION ALL SELECT * FROM z) """


def _vocabulary(spark, sf):
    rows = expansions(spark, sf)
    support = F.when(F.col("cui").isin("PROMO", "SMALL"), 0).otherwise(F.col("size") % 7 + 1)
    return dictionary.vocabulary(rows.select("sf", F.concat_ws(" ", "lf", "cui").alias("lf"), F.col("id").alias("pos"), support.alias("support")), "pos")


@query(_VOCAB + "SELECT * FROM v")
def vocab_ids(spark, sf):
    return _vocabulary(spark, sf)


@query(
    _VOCAB
    + f"""SELECT p_partkey AS id, coalesce(lf_id, -1) AS lf_id, support FROM (SELECT p_partkey, {SF_SQL} AS sf, p_name || ' ' || p_type AS lf FROM part) t LEFT JOIN v USING (sf, lf)"""
)
def vocab_lookup(spark, sf):
    tokens = expansions(spark, sf).select("id", "sf", F.concat_ws(" ", "lf", "cui").alias("lf"))
    return dictionary.token_ids(tokens, _vocabulary(spark, sf)).select("id", "lf_id", "support")


@query(f"""SELECT sf, lf, arg_max(source, id) AS source, arg_max(cui, id) AS cui FROM (SELECT p_partkey AS id, {SF_SQL} AS sf, p_name AS lf, p_brand AS source, p_type AS cui FROM part) t GROUP BY sf, lf""")
def last_attributes(spark, sf):
    return dictionary.last_attributes(expansions(spark, sf), ["source", "cui"], "id")


@query(f"""SELECT sf, count(*) AS n, string_agg(lf, '|' ORDER BY lf) AS lfs FROM (SELECT {SF_SQL} AS sf, p_name AS lf FROM part) t GROUP BY sf""")
def long_form_lists(spark, sf):
    got = abbreviations.by_short_form(expansions(spark, sf).select("sf", "lf"))
    return got.select("sf", F.size("lfs").cast("long").alias("n"), F.array_join("lfs", "|").alias("lfs"))


def _tagger(phrases: list[str]) -> list[str | None]:
    """A service that knows words of five letters and fails on any list with 'green' in it."""
    if any("green" in p for p in phrases):
        raise RuntimeError("no answer")
    return [next((w.upper() for w in p.split() if len(w) == 5), None) for p in phrases]


@query("""SELECT p_partkey AS idx, CASE WHEN contains(p_name, 'green') THEN CASE WHEN contains(p_type, 'green') THEN 'error' ELSE upper(list_filter(string_split(p_type, ' '), lambda w: length(w) = 5)[1]) END
 ELSE upper(list_filter(string_split(p_name, ' '), lambda w: length(w) = 5)[1]) END AS cui FROM part""")
def tag_in_batches(spark, sf):
    rows = table(spark, sf, "part").select(F.col("p_partkey").alias("idx"), F.col("p_name").alias("lf_base"), F.col("p_type").alias("lf"))
    done = dictionary.tag_in_batches(rows.where("idx % 2 = 0"), _tagger, 1)
    return done.union(dictionary.tag_in_batches(dictionary.untagged(rows, done), _tagger, 1))


def _careful_tagger(phrases: list[str]) -> list[str | None]:
    """As ``_tagger``, but only a green part of a number that ends in 777 is too much."""
    if any("green" in p and p.endswith("777") for p in phrases):
        raise RuntimeError("no answer")
    return [next((w.upper() for w in p.split() if len(w) == 5 and w.isalpha()), None) for p in phrases]


@query("""WITH p AS (SELECT p_partkey AS idx, p_partkey // 1000 AS batch, p_type, p_name, bool_or(contains(p_name, 'green') AND p_partkey % 1000 = 777) OVER (PARTITION BY p_partkey // 1000) AS failed FROM part)
SELECT idx, CAST(batch AS BIGINT) AS batch, upper(list_filter(string_split(CASE WHEN failed THEN p_type ELSE p_name END, ' '), lambda w: length(w) = 5)[1]) AS cui FROM p""")
def tag_with_restart(spark, sf):
    """Batches of 1,000; a run that ends after one wave, and one that goes on from what it wrote."""
    number = F.concat_ws(" ", "p_name", "p_partkey")
    rows = table(spark, sf, "part").select(F.col("p_partkey").alias("idx"), number.alias("lf_base"), F.col("p_type").alias("lf"))
    path = scratch_path(spark, "tagged")
    dictionary.tag_with_restart(rows, _careful_tagger, path, wave=4, most_waves=1)
    return dictionary.tag_with_restart(rows, _careful_tagger, path, wave=4)


# -- clusters --------------------------------------------------------------------------------------------------------

_NAMES = """WITH RECURSIVE n AS (SELECT DISTINCT upper(left(p_name, 1)) AS sf, p_name AS id, string_split(p_name, ' ') AS w FROM part),
 s AS (SELECT a.sf, a.id AS a, b.id AS b, len(list_intersect(a.w, b.w)) / len(list_distinct(list_concat(a.w, b.w))) AS similarity FROM n a JOIN n b ON a.sf = b.sf AND a.id < b.id) """


def _names(spark, sf):
    lf = F.col("p_name")
    return table(spark, sf, "part").select(F.upper(F.substring(lf, 1, 1)).alias("sf"), lf.alias("lf"), lf.alias("id"), F.lit(None).cast("string").alias("cui")).distinct()


@query(_NAMES + "SELECT sf, a, b, round(similarity, 6) AS similarity FROM s WHERE similarity > 0.3")
def pair_jaccard(spark, sf):
    return cluster.similar_pairs(_names(spark, sf), 0.3).withColumn("similarity", F.round("similarity", 6))


@query(
    _NAMES
    + """SELECT sf, a, b, len(list_intersect(string_split(a, ' '), string_split(b || ' x', ' '))) = 2 AS covered, contains(a, b) OR contains(b, a) OR contains(split_part(b, ' ', 2), a) AS near FROM s WHERE similarity > 0"""
)
def covered_pairs(spark, sf):
    pairs = cluster.similar_pairs(_names(spark, sf), 0.0)
    one, two = text.space_tokens(F.col("a")), text.space_tokens(F.concat("b", F.lit(" x")))
    second = F.element_at(text.space_tokens(F.col("b")), 2)
    return pairs.select("sf", "a", "b", sets.covered(one, two).alias("covered"), sets.approximate_match(F.col("a"), F.concat_ws("|", "b", second)).alias("near"))


@query(
    _NAMES
    + """, e AS (SELECT a, b FROM s WHERE similarity > 0.3 UNION SELECT b, a FROM s WHERE similarity > 0.3), r(a, b) AS (SELECT id, id FROM n UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
SELECT a AS id, min(b) AS cluster_id FROM r GROUP BY a"""
)
def lf_clusters(spark, sf):
    return cluster.cluster(_names(spark, sf), 0.3)


@query(
    _NAMES
    + """, e AS (SELECT a, b FROM s WHERE similarity > 0.3 AND sf IN ('B', 'R') UNION SELECT b, a FROM s WHERE similarity > 0.3 AND sf IN ('B', 'R')), r(a, b) AS (SELECT id, id FROM n WHERE sf IN ('B', 'R') UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
SELECT a AS id, min(b) AS cluster_id FROM r GROUP BY a"""
)
def selected_clusters(spark, sf):
    """Clusters of some short forms, which is what this operator's argument selects."""
    return cluster.cluster(_names(spark, sf), 0.3, only=("B", "R"))


@query(f"""WITH RECURSIVE p AS (SELECT p_partkey AS id, {SF_SQL} AS sf, p_name AS lf, p_brand AS source, p_brand || '|' || p_size AS cui FROM part),
 c AS (SELECT id, sf, unnest(string_split(cui, '|')) AS x FROM p),
 f AS (SELECT sf, x, min(id) AS m FROM c GROUP BY sf, x), q AS (SELECT sf, lf, min(id) AS m FROM p GROUP BY sf, lf),
 e AS (SELECT id AS a, m AS b FROM c JOIN f USING (sf, x) UNION SELECT p.id, q.m FROM p JOIN q USING (sf, lf)),
 g AS (SELECT a, b FROM e UNION SELECT b, a FROM e), r(a, b) AS (SELECT id, id FROM p UNION SELECT r.a, g.b FROM r JOIN g ON r.b = g.a), k AS (SELECT a AS id, min(b) AS cluster_id FROM r GROUP BY a)
SELECT sf, cluster_id, string_agg(DISTINCT lf, '|' ORDER BY lf) AS lf, string_agg(DISTINCT source, '|' ORDER BY source) AS source FROM p JOIN k USING (id) GROUP BY sf, cluster_id""")
def merged_clusters(spark, sf):
    rows = expansions(spark, sf).withColumns({"cui": F.concat_ws("|", "source", "size"), "row_id": F.col("lf")})
    rows = rows.withColumn("lf_own", F.col("lf")).withColumn("lf", F.concat_ws(" ", F.lit("x"), F.col("id").cast("string"))).select("id", "sf", "lf", "cui", "source", "row_id", "lf_own")
    clusters = cluster.cluster(rows, 0.66)
    return cluster.merged_clusters(rows.withColumn("lf", F.col("lf_own")), clusters, ("lf", "source"))


_SENTENCES = r"""WITH t AS (SELECT doc_id, unnest(string_split(replace(text, chr(10), ' '), '. ')) AS s, generate_subscripts(string_split(replace(text, chr(10), ' '), '. '), 1) AS pos FROM documents),
 p AS (SELECT {{'doc_id': doc_id, 'pos': pos - 1}} AS id, left(s, 1) || left(split_part(s, ' ', 2), 1) AS sf, list_sort(list_distinct(list_filter(string_split(lower(s), ' '), lambda x: x <> ''))) AS w FROM t),
 c AS (SELECT sf, w, min(id) AS id, count(*) AS copies FROM p WHERE len(w) > 0 GROUP BY sf, w),
 s AS (SELECT a.sf, a.id AS a, b.id AS b, len(list_intersect(a.w, b.w)) / len(list_distinct(list_concat(a.w, b.w))) AS similarity FROM c a JOIN c b ON a.sf = b.sf AND a.id < b.id AND least(len(a.w), len(b.w)) / greatest(len(a.w), len(b.w)) > {t}) """.format


def _sentences(spark, sf):
    """Sentences as long forms, their first two words' initials as the short form."""
    parts = F.split(F.replace("text", F.lit("\n"), F.lit(" ")), r"\. ")
    rows = table(spark, sf, "documents").select("doc_id", F.posexplode(parts).alias("pos", "lf"))
    space = F.locate(" ", F.col("lf"))
    second = F.when(space > 0, F.replace(F.substr("lf", space + 1, F.lit(1)), F.lit(" "), F.lit(""))).otherwise("")
    initials = F.concat(F.left("lf", F.lit(1)), second)
    return rows.select(F.struct("doc_id", "pos").alias("id"), initials.alias("sf"), "lf")


@query(_SENTENCES(t=cluster.THRESHOLD) + "SELECT sf, a.doc_id AS a_doc, a.pos AS a_pos, b.doc_id AS b_doc, b.pos AS b_pos, round(similarity, 6) AS similarity FROM s WHERE similarity > 0.66")
def similar_sentences(spark, sf):
    """Sentences that are nearly alike, between the first sentences of equal word sets."""
    found = cluster.similar_distinct(_sentences(spark, sf))
    ids = [F.col(f"{c}.{f}").alias(f"{c}_{f.split('_')[0]}") for c in "ab" for f in ("doc_id", "pos")]
    return found.select("sf", *ids, F.round("similarity", 6).alias("similarity"))


@query(_SENTENCES(t=0) + "SELECT p.id.doc_id AS doc_id, p.id.pos AS pos, c.id.doc_id AS first_doc, c.id.pos AS first_pos, copies FROM p JOIN c ON p.sf = c.sf AND p.w = c.w")
def sentence_classes(spark, sf):
    return cluster.row_classes(_sentences(spark, sf)).select("id.doc_id", "id.pos", F.col("first.doc_id").alias("first_doc"), F.col("first.pos").alias("first_pos"), "copies")


# -- contexts --------------------------------------------------------------------------------------------------------


def _values(forms: tuple[str, ...]) -> str:
    return ", ".join(f"('{f}', '{p}')" for f in forms for p in f.split("|"))


def _found(forms: tuple[str, ...], length: int, ignore_case: bool = False, where: str = "true") -> str:
    """CTEs d (documents' words) and o (occurrences: doc_id, w, pos, form)."""
    gram = " || ' ' || ".join(f"w[pos + {i + 1}]" for i in range(length))
    gram = f"lower({gram})" if ignore_case else gram
    return f"""WITH d AS (SELECT doc_id, source, text, {WORDS} AS w FROM documents WHERE {where}), terms(form, phrase) AS (VALUES {_values(forms)}),
 x AS (SELECT doc_id, source, text, w, unnest(range(len(w) - {length - 1})) AS pos FROM d), o AS (SELECT x.*, form, {length} AS length FROM x JOIN terms ON {gram} = phrase)"""


def _window(size: int, left: str = "least(pos, {n})") -> str:
    n = left.format(n=size)
    return f"array_to_string(list_concat(w[pos - {n} + 1:pos], ['TARGETWORD'], w[pos + length + 1:pos + length + {size}]), ' ')"


@query(_found(SHORT_TERMS, 1) + f"SELECT form, doc_id, CAST(pos AS INTEGER) AS pos, {_window(25)} AS context FROM o")
def short_form_contexts(spark, sf):
    return contexts.word_contexts(corpus(spark, sf), terms(spark, SHORT_TERMS), [1]).drop("length")


@query(_found(LONG_TERMS, 2, True) + f"SELECT form, doc_id, CAST(pos AS INTEGER) AS pos, {_window(25)} AS context FROM o")
def long_form_contexts(spark, sf):
    found = contexts.word_contexts(corpus(spark, sf), terms(spark, LONG_TERMS), [2], ignore_case=True)
    return contexts.longest_only(found).drop("length")


@query(_found(SHORT_TERMS, 1) + f"SELECT form, doc_id, CAST(pos AS INTEGER) AS pos, {_window(25)} AS context FROM o")
def joined_term_contexts(spark, sf):
    """Short-form contexts by the path for dictionaries that are too large for a projection."""
    return contexts.word_contexts(corpus(spark, sf), terms(spark, SHORT_TERMS), [1], most_literals=0).drop("length")


_COMPAT = "CASE WHEN pos < {n} THEN least(pos, {n} - pos) ELSE {n} END"


@query(_found(SHORT_TERMS, 1) + f"SELECT form, doc_id, CAST(pos AS INTEGER) AS pos, {_window(25, _COMPAT)} AS context FROM o")
def contexts_compat_left_window(spark, sf):
    return contexts.word_contexts(corpus(spark, sf), terms(spark, SHORT_TERMS), [1], left_mode="compat").drop("length")


@query(_found(LONG_TERMS, 2) + " SELECT DISTINCT form, doc_id, md5(text) AS context FROM o")
def document_contexts(spark, sf):
    got = contexts.document_contexts(corpus(spark, sf), terms(spark, LONG_TERMS), [2])
    return got.withColumn("context", F.md5("context"))


@query(rf"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line FROM documents),
 d AS (SELECT doc_id, line, {WORDS} AS w FROM l WHERE trim(text) <> ''), x AS (SELECT *, unnest(range(len(w))) AS pos FROM d), terms(form, phrase) AS (VALUES {_values(SHORT_TERMS)})
SELECT form, doc_id, CAST(line AS INTEGER) AS line, CAST(pos AS INTEGER) AS pos, array_to_string(list_concat(w[1:pos], ['TARGETWORD'], w[pos + 2:]), ' ') AS context FROM x JOIN terms ON w[pos + 1] = phrase""")
def paragraph_contexts(spark, sf):
    docs = table(spark, sf, "documents")
    return contexts.line_contexts(docs, terms(spark, SHORT_TERMS), [1])


#: Where sentences end with a full stop and a space they become paragraphs; the tables have no blank lines.
_AS_PARAGRAPHS = "replace(text, '. ', '.' || chr(10) || chr(10))"
_LINE_ENDS, _SPACES = r"\n\r\x0B\f\x1C-\x1E\x{85}\x{2028}\x{2029}", r"\s\x0B\x1C-\x1F\x{85}\p{Z}"


def _less_ends(name: str, source: str, column: str) -> str:
    """CTEs that take a lone sign, then an empty line, off the start of a list of lines."""
    return f"""{name}s AS (SELECT *, CASE WHEN length({column}[1]) = 1 AND NOT regexp_matches({column}[1], '[\\p{{L}}\\p{{N}}]') THEN 1 ELSE 0 END AS sign_{name} FROM {source}),
 {name} AS (SELECT *, {column}[sign_{name} + CASE WHEN {column}[sign_{name} + 1] = '' THEN 2 ELSE 1 END:] AS {name}_lines FROM {name}s)"""


@query(rf"""WITH terms(phrase) AS (VALUES {", ".join(f"('{t}')" for t in SHORT_TERMS)}), d AS (SELECT doc_id, {_AS_PARAGRAPHS} AS text FROM documents),
 t AS (SELECT doc_id, regexp_extract_all(text, '[\p{{L}}\p{{N}}_]+') AS w, regexp_split_to_array(text, '[\p{{L}}\p{{N}}_]+') AS g FROM d),
 x AS (SELECT *, unnest(list_filter(range(len(w)), lambda i: w[i + 1] IN ({", ".join(f"'{t}'" for t in SHORT_TERMS)}))) AS pos FROM t),
 h AS (SELECT doc_id, pos, w[pos + 1] AS form,
  array_to_string(list_transform(range(pos), lambda i: concat(g[i + 1], w[i + 1])), '') AS earlier, g[pos + 1] AS head, length(g[pos + 1]) = 1 AND coalesce(w[pos] = w[pos + 1], false) AS taken,
  g[pos + 2] AS tail, array_to_string(list_transform(range(pos + 1, len(w)), lambda i: concat(w[i + 1], g[i + 2])), '') AS later FROM x),
 c AS (SELECT doc_id, pos, form, concat(earlier, CASE WHEN regexp_matches(head, '[{_SPACES}]$') AND NOT taken THEN substr(head, 1, length(head) - 1) ELSE head END) AS b,
  concat(CASE WHEN regexp_matches(tail, '^[{_SPACES}]') THEN substr(tail, 2) ELSE tail END, later) AS a FROM h),
 s AS (SELECT row_number() OVER () AS n, doc_id, pos, form, b, a FROM c),
 l AS (SELECT n, 'b' AS side, regexp_split_to_array(b, '[{_LINE_ENDS}] *') AS part FROM s UNION ALL SELECT n, 'a', regexp_split_to_array(a, '[{_LINE_ENDS}] *') FROM s),
 {_less_ends("q", "l", "part")}, r AS (SELECT n, side, list_reverse(q_lines) AS part FROM q), {_less_ends("v", "r", "part")},
 near AS (SELECT n, side, CASE side WHEN 'b' THEN v_lines ELSE list_reverse(v_lines) END AS part FROM v),
 z AS (SELECT *, list_filter(range(len(part)), lambda i: NOT regexp_matches(part[i + 1], '[^{_SPACES}]')) AS blank FROM near),
 k AS (SELECT n, side, part[1:CASE WHEN len(blank) = 0 THEN len(part) WHEN len(blank) > 2 THEN blank[2] WHEN side = 'a' THEN blank[-1] ELSE blank[1] END] AS part FROM z)
SELECT form, doc_id, CAST(pos AS INTEGER) AS pos, array_to_string(list_concat(list_reverse(kb.part), ['TARGETWORD'], ka.part), ' ') AS context
FROM s JOIN k kb ON kb.n = s.n AND kb.side = 'b' JOIN k ka ON ka.n = s.n AND ka.side = 'a'""")
def blank_line_contexts(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", F.expr(_AS_PARAGRAPHS.replace("chr(10)", "char(10)")).alias("text"))
    return contexts.blank_line_contexts(docs, terms(spark, SHORT_TERMS), 2)


DICTIONARY = (("TA", "The", 1), ("XA", "The", 2), ("TA", "And", 3), ("OF", "Of", 4), ("In", "The", 5), ("In", "Nowhere", 6))


def _dictionary(spark):
    return spark.sql("SELECT * FROM VALUES " + ", ".join(map(str, DICTIONARY)) + " AS t(sf, lf, pos)")


def _contexts_of(spark, sf, first):
    """Contexts of one source, or of all the others."""
    own = F.coalesce(F.col("source") == "src1", F.lit(False))
    docs = contexts.tokenise(table(spark, sf, "documents").where(own if first else ~own).select("doc_id", "text"))
    found = contexts.word_contexts(docs, terms(spark, SHORT_TERMS), [1], 5)
    return found.select("form", F.col("doc_id").cast("string").alias("doc_id"), "context")


def _collected(spark, sf):
    return collect.collect({"first": _contexts_of(spark, sf, True), "rest": _contexts_of(spark, sf, False)}, _dictionary(spark))


_COLLECT = (
    _found(SHORT_TERMS, 1)
    + f""", dict(sf, lf, pos) AS (VALUES {", ".join(map(str, DICTIONARY))}), own AS (SELECT DISTINCT sf AS form, sf FROM dict),
 idx AS (SELECT * FROM own UNION ALL SELECT lf, arg_min(sf, pos) FROM dict WHERE lf NOT IN (SELECT form FROM own) GROUP BY lf),
 col AS (SELECT DISTINCT form, CAST(doc_id AS VARCHAR) AS doc_id, {_window(5)} AS context, CASE WHEN source = 'src1' THEN 'first' ELSE 'rest' END AS source FROM o) """
)


@query(_COLLECT + "SELECT form, doc_id, context, source, sf FROM col JOIN idx USING (form)")
def collect_contexts(spark, sf):
    return _collected(spark, sf)


@query(_COLLECT + "SELECT DISTINCT form FROM col WHERE form NOT IN (SELECT form FROM idx)")
def unknown_forms(spark, sf):
    rows = _contexts_of(spark, sf, True).union(_contexts_of(spark, sf, False))
    return collect.unknown_forms(rows, _dictionary(spark))


@query(
    _COLLECT
    + """, n AS (SELECT form, count(*) AS n FROM col JOIN idx USING (form) GROUP BY form)
SELECT sf, lf, dict.pos, coalesce(a.n, 0) AS sf_count, coalesce(b.n, 0) AS lf_count FROM dict LEFT JOIN n a ON a.form = sf LEFT JOIN n b ON b.form = lf"""
)
def form_counts(spark, sf):
    return collect.with_counts(_dictionary(spark), _collected(spark, sf)).select("sf", "lf", "pos", "sf_count", "lf_count")


@query(
    _found(SHORT_TERMS, 1)
    + f""", c AS (SELECT form, doc_id, pos, string_split({_window(25)}, ' ') AS t FROM o), p AS (SELECT *, list_position(t, 'TARGETWORD') - 1 AS k FROM c)
SELECT form, doc_id, CAST(pos AS INTEGER) AS pos, replace(array_to_string(t[greatest(k - 10, 0) + 1:k + 11], ' '), 'TARGETWORD', upper(form)) AS context_trimmed, CAST(k - greatest(k - 10, 0) AS INTEGER) AS tgt_idx FROM p"""
)
def context_trim(spark, sf):
    rows = short_form_contexts(spark, sf).withColumn("sf", F.upper("form"))
    return contexts.trim_context(rows).select("form", "doc_id", "pos", "context_trimmed", "tgt_idx")


@query(r"""WITH m AS (SELECT *, CAST(role = 'user' AS INTEGER) AS b, first_value(role) OVER (PARTITION BY conv_id ORDER BY turn) = 'user' AS f FROM conversations),
 d AS (SELECT *, sum(b) OVER (PARTITION BY conv_id ORDER BY turn) - CAST(f AS INTEGER) AS doc FROM m)
SELECT conv_id, CAST(doc AS BIGINT) AS doc, string_agg(text, chr(10) ORDER BY turn) AS text FROM d GROUP BY conv_id, doc""")
def doc_assembly(spark, sf):
    lines = table(spark, sf, "conversations")
    return contexts.assemble_documents(lines, "conv_id", "turn", F.col("role") == "user")


@query(r"""SELECT CAST(page_id AS VARCHAR) AS page, unnest(regexp_extract_all(html, '<p>([^<]*)</p>', 1)) AS line FROM pages WHERE contains(lower(regexp_extract(html, '(?s)<h1>(.*?)</h1>', 1)), 'th')""")
def section_lines(spark, sf):
    pages = table(spark, sf, "pages").select(F.col("page_id").cast("string").alias("page"), "html")
    return listings.flat_section_lines(pages, ("th",))


@query("""WITH n AS (SELECT n_regionkey AS r, n_nationkey AS k, n_name AS name FROM nation),
 w AS (SELECT r, coalesce(max(k) FILTER (WHERE k % 4 = 2), max(k) FILTER (WHERE k % 4 = 0) + 100) AS s FROM n GROUP BY r)
SELECT CAST(w.r AS VARCHAR) AS page, unnest([lower(name), 'line of ' || s]) AS line FROM w JOIN n ON n.k = s % 100""")
def section_tree(spark, sf):
    """Pages are regions; every second nation is a section on medicine, and every fourth of those has one part."""
    nation = table(spark, sf, "nation")
    k, page = F.col("n_nationkey"), F.col("n_regionkey").cast("string").alias("page")
    body = lambda at: F.concat(F.lower("n_name"), F.lit("\nline of "), at.cast("string")).alias("text")
    top = nation.select(page, k.alias("ord"), F.lit(None).cast("int").alias("parent"), F.when(k % 2 == 0, "Medical terms").otherwise("Places").alias("title"), body(k))
    parts = nation.where(k % 4 == 0).select(page, (k + 100).alias("ord"), k.alias("parent"), F.lit("In science").alias("title"), body(k + 100))
    return listings.section_lines(top.union(parts))


_PATTERN_TERMS = [("The", contexts.TermType.SHORT_FORM), ("thing|of the", contexts.TermType.LONG_FORM)]
_DICTIONARY = [
    *_PATTERN_TERMS, ("she", contexts.TermType.SHORT_FORM), ("of", contexts.TermType.SHORT_FORM), ("and the|a hour", contexts.TermType.LONG_FORM),
    ("in that of|all that|he", contexts.TermType.LONG_FORM), ("de la|que|une personne", contexts.TermType.LONG_FORM), ("der die|das|und", contexts.TermType.LONG_FORM),
    ("man of the world|child", contexts.TermType.LONG_FORM),
]


def _sweep_sql(found: list[tuple[str, contexts.TermType]], size: int) -> str:
    """Contexts of the phrases that terms stand for; no phrase of these terms begins inside another of its form."""
    text = lambda v: "'" + v.replace("'", "''") + "'"
    rows = ", ".join(f"({text(form)}, {text(first)}, {n}, {text(phrase)}, {rank})" for form, first, n, phrase, rank in sweep.phrases(found, True, True))
    return rf"""WITH p(form, first, n, phrase, rank) AS (VALUES {rows}),
d AS (SELECT doc_id, regexp_extract_all(text, '[\p{{L}}\p{{N}}_]+') AS w,
  list_transform(regexp_extract_all(text, '[\p{{L}}\p{{N}}_]+([^\p{{L}}\p{{N}}_]*)', 1), lambda g: regexp_replace(g, '\s+', ' ', 'g')) AS g FROM documents),
x AS (SELECT *, unnest(range(len(w))) AS pos FROM d),
c AS (SELECT x.*, p.form, p.n, p.rank FROM x JOIN p ON lower(w[pos + 1]) = first
  AND array_to_string(list_transform(range(p.n), lambda i: lower(w[pos + i + 1]) || CASE WHEN i < p.n - 1 THEN g[pos + i + 1] ELSE '' END), '') = phrase),
b AS (SELECT form, doc_id, pos, any_value(w) AS w, arg_min(n, rank) AS n FROM c GROUP BY form, doc_id, pos)
SELECT form, CAST(doc_id AS VARCHAR) AS doc_id,
  array_to_string(list_concat(w[greatest(pos - {size}, 0) + 1:pos], ['TARGETWORD'], w[pos + n + 1:pos + n + {size}]), ' ') AS context FROM b"""


@query(_sweep_sql(_PATTERN_TERMS, 5))
def pattern_contexts(spark, sf):
    """Inflected terms by their regular expressions."""
    docs = table(spark, sf, "documents")
    return contexts.pattern_contexts(docs, _PATTERN_TERMS, contexts.ContextType.WORD, 5, inflect=True)


@query(_sweep_sql(_DICTIONARY, 10))
def dictionary_contexts(spark, sf):
    """Inflected terms of a dictionary in one pass over each document."""
    known = spark.createDataFrame([(f, k.value) for f, k in _DICTIONARY], "form string, kind string")
    return sweep.dictionary_contexts(table(spark, sf, "documents"), known, size=10)


# -- samples ---------------------------------------------------------------------------------------------------------

KEY_SQL = "({0} * 2654435761) % 1000003"


@query(f"""SELECT doc_id, source FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY {KEY_SQL.format("doc_id")}, doc_id) AS r FROM documents) t WHERE r <= 20""")
def sample_per_form(spark, sf):
    rows = table(spark, sf, "documents").select("doc_id", "source")
    return sampling.per_group(rows, "source", 20, sampling.modular("doc_id"), "doc_id")


@query(f"""SELECT doc_id FROM documents ORDER BY {KEY_SQL.format("doc_id")}, doc_id LIMIT 300""")
def sample_simple(spark, sf):
    return sampling.simple(table(spark, sf, "documents").select("doc_id"), 300, sampling.modular("doc_id"), "doc_id")


@query(f"""WITH n AS (SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS u FROM events GROUP BY 1),
 r AS (SELECT event_type, user_id, row_number() OVER (PARTITION BY event_type ORDER BY {KEY_SQL.format("user_id")}, user_id) AS r FROM (SELECT DISTINCT event_type, user_id FROM events) t)
SELECT event_id, event_type, user_id FROM events JOIN n USING (event_type) JOIN r USING (event_type, user_id) WHERE n <= 1500 OR r <= floor(1500.0 / n * u)""")
def sample_docs_cluster(spark, sf):
    rows = table(spark, sf, "events").select("event_id", "event_type", "user_id")
    return sampling.by_cluster(rows, "event_type", "user_id", 1500, sampling.modular("user_id"))


@query(f"""WITH p AS (SELECT p_partkey AS id, {SF_SQL} AS sf, p_name AS lf, p_brand AS source FROM part), g AS (SELECT sf FROM p GROUP BY sf HAVING count(*) > 1 ORDER BY sf LIMIT 30),
 r AS (SELECT p.*, row_number() OVER (PARTITION BY sf ORDER BY {KEY_SQL.format("id")}, id) AS r FROM p JOIN g USING (sf))
SELECT sf, max(CASE WHEN r = 1 THEN lf END) AS lf_1, max(CASE WHEN r = 1 THEN source END) AS source_1, max(CASE WHEN r = 2 THEN lf END) AS lf_2, max(CASE WHEN r = 2 THEN source END) AS source_2 FROM r WHERE r <= 2 GROUP BY sf""")
def sample_pairs(spark, sf):
    return sampling.row_pairs(expansions(spark, sf), "sf", 30, sampling.modular("id"), F.col("sf"), ("lf", "source"), "id")


@query(f"""WITH s AS (SELECT p_partkey, {KEY_SQL.format("p_partkey")} AS k FROM part), r AS (SELECT *, row_number() OVER (ORDER BY k, p_partkey) AS r, count(*) OVER () AS n FROM s)
SELECT p_partkey, CAST(r > floor(n / 3) AS INTEGER) AS is_train FROM r""")
def train_labels(spark, sf):
    rows = table(spark, sf, "part").select("p_partkey")
    return sampling.train_labels(rows, sampling.modular("p_partkey"), "p_partkey")


@query(f"""SELECT is_train, count(*) AS n FROM (SELECT CAST({KEY_SQL.format("vec_id")} < 800002 AS INTEGER) AS is_train FROM embeddings) t GROUP BY 1""")
def train_split(spark, sf):
    rows = sampling.split(table(spark, sf, "embeddings").select("vec_id"), sampling.modular("vec_id"))
    return rows.groupBy("is_train").agg(F.count("*").alias("n"))


@query("""WITH f AS (SELECT doc_id, quality, unnest(range(9)) AS fold FROM labels), k AS (SELECT *, ((doc_id * 9 + fold) * 2654435761) % 1000003 AS k FROM f),
 r AS (SELECT *, row_number() OVER (PARTITION BY fold, quality ORDER BY k, doc_id) AS r, count(*) OVER (PARTITION BY fold, quality) AS n FROM k)
SELECT CAST(fold AS INTEGER) AS fold, doc_id, quality, CAST(r <= round(n * 0.2) AS INTEGER) AS is_test FROM r""")
def stratified_folds(spark, sf):
    rows = table(spark, sf, "labels").select("doc_id", "quality")
    rank = lambda fold: sampling.modular(F.col("doc_id") * 9 + fold)
    return sampling.stratified_folds(rows, "quality", 9, 0.2, "doc_id", rank)


_LARGE, _SMALL = 700, 40


@query(f"""WITH l AS (SELECT event_type AS form, 'S' AS sf, event_id AS doc_id, event_id AS row_id, row_number() OVER (PARTITION BY event_type ORDER BY {KEY_SQL.format("event_id")}, event_id) AS r FROM events),
 n AS (SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS u FROM events GROUP BY 1),
 d AS (SELECT event_type, user_id, row_number() OVER (PARTITION BY event_type ORDER BY {KEY_SQL.format("user_id")}, user_id) AS r FROM (SELECT DISTINCT event_type, user_id FROM events) t)
SELECT form, sf, doc_id, row_id FROM l WHERE r <= {_SMALL} UNION ALL
SELECT event_type, event_type, user_id, event_id FROM events JOIN n USING (event_type) JOIN d USING (event_type, user_id) WHERE n <= {_LARGE} OR r <= floor({_LARGE}.0 / n * u)""")
def downsample(spark, sf):
    rows = table(spark, sf, "events")
    long_rows = rows.select(F.col("event_type").alias("form"), F.lit("S").alias("sf"), F.col("event_id").alias("doc_id"), F.col("event_id").alias("row_id"))
    short_rows = rows.select(F.col("event_type").alias("form"), F.col("event_type").alias("sf"), F.col("user_id").alias("doc_id"), F.col("event_id").alias("row_id"))
    both = long_rows.union(short_rows).withColumn("context", F.col("row_id").cast("string"))
    return sampling.downsample(both, _SMALL, _LARGE, sampling.modular("doc_id"), sampling.modular("doc_id")).drop("context")


# -- vectors and disambiguation --------------------------------------------------------------------------------------


def _vectors(spark, sf):
    rows = table(spark, sf, "embeddings")
    return rows.select(
        F.col("vec_id").alias("id"), (F.col("label") % 3).cast("string").alias("sf"), F.concat(F.lit("L"), "label").alias("lf"), vectors.doubles(F.col("embedding")).alias("embedding")
    )


_VECTORS = """v AS (SELECT vec_id AS id, CAST(label % 3 AS VARCHAR) AS sf, 'L' || label AS lf, CAST(embedding AS DOUBLE[]) AS x FROM embeddings)"""


@query(f"""WITH {_VECTORS}, c AS (SELECT sf, lf, unnest(range(len(x))) AS pos, unnest(x) AS y FROM v)
SELECT sf, lf, CAST(pos AS INTEGER) AS pos, count(*) AS n, round(avg(y), 6) AS mean, round(sum(y), 6) AS total FROM c GROUP BY sf, lf, pos""")
def label_mean_vectors(spark, sf):
    means = vectors.mean_vectors(_vectors(spark, sf), ["sf", "lf"], "embedding")
    cells = means.select("sf", "lf", "n", F.posexplode(F.arrays_zip("mean", "sums")).alias("pos", "z"))
    return cells.select("sf", "lf", "pos", "n", F.round("z.mean", 6).alias("mean"), F.round("z.sums", 6).alias("total"))


_KNN = f"""WITH {_VECTORS}, u AS (SELECT id, sf, lf, x, sqrt(list_inner_product(x, x)) AS n FROM v),
 s AS (SELECT a.id AS q, a.lf AS truth, b.lf, b.id, round(list_inner_product(list_transform(a.x, lambda t: t / a.n), list_transform(b.x, lambda t: t / b.n)), 9) AS sim FROM u a JOIN u b ON a.sf = b.sf AND a.id % 10 = 0 AND b.id % 10 <> 0),
 r AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY sim DESC, id) AS rank FROM s), k AS (SELECT * FROM r WHERE rank <= 5),
 g AS (SELECT q, truth, lf, count(*) AS n, max(rank) AS far FROM k GROUP BY q, truth, lf), p AS (SELECT q, truth, lf AS predicted, row_number() OVER (PARTITION BY q ORDER BY n DESC, far DESC) AS o FROM g) """


def _knn(spark, sf):
    rows = _vectors(spark, sf)
    queries, known = rows.where("id % 10 = 0").withColumnRenamed("id", "q"), rows.where("id % 10 <> 0")
    predicted = disambiguate.majority(disambiguate.neighbours(queries, known, 5))
    return predicted.join(queries.select("q", F.col("lf").alias("truth")), "q")


@query(_KNN + "SELECT q, id, CAST(rank AS INTEGER) AS rank, sim FROM k")
def knn_neighbours(spark, sf):
    rows = _vectors(spark, sf)
    got = disambiguate.neighbours(rows.where("id % 10 = 0").withColumnRenamed("id", "q"), rows.where("id % 10 <> 0"), 5)
    return got.select("q", "id", "rank", "sim")


@query(_KNN + "SELECT q, truth, predicted FROM p WHERE o = 1")
def knn_predict(spark, sf):
    return _knn(spark, sf).select("q", "truth", "predicted")


@query(_KNN + "SELECT count(*) AS n, avg(CAST(truth = predicted AS DOUBLE)) AS exact, avg(CAST(contains(truth, predicted) OR contains(predicted, truth) AS DOUBLE)) AS approximate FROM p WHERE o = 1")
def knn_accuracy(spark, sf):
    return disambiguate.accuracy(_knn(spark, sf))


_MODEL = f"""WITH {_VECTORS}, t AS (SELECT * FROM v WHERE id % 10 <> 0), c AS (SELECT sf, lf, unnest(range(len(x))) AS pos, unnest(x) AS y FROM t),
 m AS (SELECT sf, lf, list(a ORDER BY pos) AS mean FROM (SELECT sf, lf, pos, avg(y) AS a FROM c GROUP BY sf, lf, pos) z GROUP BY sf, lf),
 n AS (SELECT sf, lf, count(*) AS n FROM t GROUP BY sf, lf),
 b AS (SELECT sf, lf, n, (n + 1.0) / (sum(n) OVER (PARTITION BY sf) + count(*) OVER (PARTITION BY sf)) AS beta, mean FROM n JOIN m USING (sf, lf)),
 l AS (SELECT v.id, v.sf, b.lf, ln(beta) + list_sum(list_transform(list_zip(x, mean), lambda z: -0.5 * ln(2 * pi()) - (z[1] - z[2]) * (z[1] - z[2]) / 2)) AS logp, beta FROM v JOIN b USING (sf) WHERE v.id % 10 = 0) """


def _model(spark, sf):
    rows = _vectors(spark, sf)
    return rows.where("id % 10 = 0"), disambiguate.mean_parameters(rows.where("id % 10 <> 0"))


@query(_MODEL + ", r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY logp DESC, lf) AS r FROM l) SELECT id, sf, lf, round(logp, 6) AS logp FROM r WHERE r = 1")
def assign_argmax(spark, sf):
    data, params = _model(spark, sf)
    best = disambiguate.best_assignment(disambiguate.assignments(data, params))
    return best.withColumn("logp", F.round("logp", 6))


@query(_MODEL + ", w AS (SELECT *, exp(logp - max(logp) OVER (PARTITION BY id)) AS w FROM l) SELECT id, lf, round(w / sum(w) OVER (PARTITION BY id), 6) AS p FROM w")
def assign_probabilities(spark, sf):
    data, params = _model(spark, sf)
    return disambiguate.assignments(data, params).select("id", "lf", F.round("p", 6).alias("p"))


@query(
    _MODEL
    + """, r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY logp DESC, lf) AS r FROM l),
 pr AS (SELECT sum(list_sum(list_transform(mean, lambda y: -0.5 * ln(2 * pi()) - y * y / 2))) AS prior FROM b) SELECT round(prior + (SELECT avg(logp) FROM r WHERE r = 1), 4) AS log_joint FROM pr"""
)
def log_joint(spark, sf):
    data, params = _model(spark, sf)
    best = disambiguate.best_assignment(disambiguate.assignments(data, params))
    return disambiguate.log_joint(data, best, params).select(F.round("log_joint", 4).alias("log_joint"))


@query(_MODEL + "SELECT sf, lf, round(1 / (1.0 / 2.0 + n / 0.5), 9) AS variance, round(list_sum(list_transform(mean, lambda y: (0.1 / 2.0 + n * y / 0.5) / (1.0 / 2.0 + n / 0.5))), 6) AS total FROM b")
def posterior_means(spark, sf):
    _, params = _model(spark, sf)
    mean = vectors.posterior_mean(F.col("mean"), F.col("n"), 0.1, 2.0, 0.5)
    total = F.aggregate(mean, F.lit(0.0), lambda s, x: s + x)
    return params.select("sf", "lf", F.round(vectors.posterior_variance(F.col("n"), 2.0, 0.5), 9).alias("variance"), F.round(total, 6).alias("total"))


@query("SELECT p_partkey, round(exp(ln(p_size / 50.0 + 1e-5) + ln(p_retailprice / 1000 + 1e-5)), 9) AS product FROM part")
def stable_products(spark, sf):
    product = vectors.stable_multiply(F.col("p_size") / 50.0, F.col("p_retailprice") / 1000)
    return table(spark, sf, "part").select("p_partkey", F.round(product, 9).alias("product"))


@query()
def gibbs_disambiguate(spark, sf):
    rows = sampling.split(_vectors(spark, sf), sampling.modular("id"))
    params = disambiguate.mean_parameters(rows.where("is_train = 1"))
    return sampler.gibbs(rows, params, sweeps=30, keep_every=10)


@query()
def topic_gibbs(spark, sf):
    rows = _vectors(spark, sf).withColumn("doc", F.col("id") % 20)
    _, joints = sampler.topic_gibbs(rows, rows.select("sf", "lf").distinct(), topics=5, sweeps=5)
    return spark.createDataFrame(list(enumerate(joints)), "sweep int, log_joint double")


_INITIAL = """WITH e AS (SELECT CAST(label % 3 AS VARCHAR) AS sf, 'L' || label AS lf, CAST(embedding AS DOUBLE[]) AS x FROM embeddings),
 v(sf, lf, support) AS (VALUES ('0', 'L0', 3), ('0', 'L3', 1), ('1', 'L1', 5), ('1', 'L4', 0), ('0', 'L999', 0)),
 c AS (SELECT sf, lf, unnest(range(len(x))) AS pos, unnest(x) AS y FROM e), m AS (SELECT sf, lf, round(sum(a), 6) AS total FROM (SELECT sf, lf, pos, avg(y) AS a FROM c GROUP BY 1, 2, 3) z GROUP BY 1, 2)
"""


@query(_INITIAL + "SELECT sf, lf, round((support + 1.0) / sum(support + 1.0) OVER (PARTITION BY sf), 9) AS beta, total FROM v LEFT JOIN m USING (sf, lf)")
def initial_parameters(spark, sf):
    """Entries without contexts start from noise, whose sum isn't given."""
    vocab = spark.sql("SELECT * FROM VALUES ('0', 'L0', 3), ('0', 'L3', 1), ('1', 'L1', 5), ('1', 'L4', 0), ('0', 'L999', 0) AS t(sf, lf, support)")
    got = disambiguate.initial_parameters(vocab, _vectors(spark, sf), 64)
    known = _vectors(spark, sf).select("sf", "lf").distinct().withColumn("known", F.lit(True))
    total = F.when(F.col("known"), F.round(F.aggregate("mean", F.lit(0.0), lambda a, x: a + x), 6))
    return got.join(known, ["sf", "lf"], "left").select("sf", "lf", F.round("beta", 9).alias("beta"), total.alias("total"))


@query()
def pca_reduce(spark, sf):
    rows, shares = embedding.reduce_dimensions(_vectors(spark, sf), 5)
    return rows.select("id", "sf", F.col("lf").alias("form"), "pc").withColumn("explained", F.lit(float(sum(shares))))


@query()
def embed_contexts(spark, sf):
    rows = context_trim(spark, sf).withColumn("sf", F.upper("form"))
    rows = numbered(rows, "doc_id", "pos", "form")
    return embedding.embed(rows)


_FORMS = "WITH e AS (SELECT vec_id AS id, CAST(label % 3 AS VARCHAR) AS sf, CASE WHEN vec_id % 4 = 0 THEN CAST(label % 3 AS VARCHAR) ELSE 'L' || label END AS form, embedding[1] AS first FROM embeddings) "


def _form_vectors(spark, sf):
    own = F.when(F.col("id") % 4 == 0, F.col("sf")).otherwise(F.col("lf"))
    return _vectors(spark, sf).withColumn("form", own).drop("lf")


@query(_FORMS + "SELECT id, sf, form, sf = form AS is_own, first FROM e")
def vectors_by_form(spark, sf):
    got = embedding.by_form(_form_vectors(spark, sf))
    return got.select("id", "sf", "form", "is_own", F.col("embedding")[0].cast("float").alias("first"))


@query(_FORMS + "SELECT id, sf, form FROM e WHERE sf <> form")
def vectors_of_long_forms(spark, sf):
    return embedding.by_form(_form_vectors(spark, sf), own=False).select("id", "sf", "form")


@query(_FORMS + "SELECT form, count(*) AS n, string_agg(CAST(id AS VARCHAR), ',' ORDER BY id) AS ids FROM e GROUP BY form")
def vector_bundles(spark, sf):
    got = embedding.bundles(_form_vectors(spark, sf), "form", ["id"])
    return got.select("form", "n", F.array_join(F.transform(F.array_sort("items"), lambda x: x["id"].cast("string")), ",").alias("ids"))


@query("SELECT vec_id AS id, CAST(label % 3 AS VARCHAR) AS sf, 'L' || label AS form, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y FROM embeddings")
def scatter_points(spark, sf):
    rows = _vectors(spark, sf).withColumnsRenamed({"lf": "form", "embedding": "pc"})
    return sinks.scatter(rows, "id", "sf").join(sinks.scatter(rows, "id", "form").select("id", "form"), "id")


@query("SELECT CAST(label % 3 AS VARCHAR) AS sf, 'L' || label AS form, false AS is_own, count(*) AS n FROM embeddings GROUP BY label")
def organised_vectors(spark, sf):
    return embedding.organised(_vectors(spark, sf).withColumnRenamed("lf", "form")).select("sf", "form", "is_own", "n")


# -- metrics and models ----------------------------------------------------------------------------------------------


def _scored(spark, sf):
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    return docs.join(labels, "doc_id").select("doc_id", F.col("quality").alias("label"), (F.col("n_chars") % 50).cast("double").alias("score"), "toxic")


_SCORED = "WITH s AS (SELECT doc_id, quality AS label, CAST(n_chars % 50 AS DOUBLE) AS score, toxic FROM documents JOIN labels USING (doc_id)) "


@query(
    _SCORED
    + """, d AS (SELECT score, sum(label) AS pos, count(*) - sum(label) AS neg FROM s GROUP BY score)
SELECT score AS threshold, round(sum(pos) OVER w / sum(pos) OVER (), 9) AS tpr, round(sum(neg) OVER w / sum(neg) OVER (), 9) AS fpr, round(sum(pos) OVER w / sum(pos) OVER () - sum(neg) OVER w / sum(neg) OVER (), 9) AS youden FROM d WINDOW w AS (ORDER BY score DESC)"""
)
def roc_curve(spark, sf):
    curve = metrics.roc_curve(_scored(spark, sf))
    return curve.select("threshold", *[F.round(c, 9).alias(c) for c in ("tpr", "fpr", "youden")])


@query(_SCORED + "SELECT round(sum(CASE WHEN a.score > b.score THEN 1.0 WHEN a.score = b.score THEN 0.5 ELSE 0 END) / count(*), 9) AS auc FROM s a, s b WHERE a.label = 1 AND b.label = 0")
def roc_auc(spark, sf):
    return metrics.roc_auc(_scored(spark, sf)).select(F.round("auc", 9).alias("auc"))


@query(
    _SCORED
    + """, t AS (SELECT label AS t, CAST(score >= 10 AS INTEGER) AS p FROM s), c AS (SELECT k AS label, count(*) FILTER (WHERE t = k AND p = k) AS hit, count(*) FILTER (WHERE p = k) AS called, count(*) FILTER (WHERE t = k) AS actual FROM t, (VALUES (0), (1)) z(k) GROUP BY k),
 m AS (SELECT CAST(label AS VARCHAR) AS label, coalesce(hit / nullif(called, 0), 0) AS precision, coalesce(hit / nullif(actual, 0), 0) AS recall, actual AS support, hit FROM c),
 f AS (SELECT *, coalesce(2 * precision * recall / nullif(precision + recall, 0), 0) AS f1 FROM m)
SELECT label, round(precision, 9) AS precision, round(recall, 9) AS recall, round(f1, 9) AS f1, CAST(support AS BIGINT) AS support FROM (
 SELECT label, precision, recall, f1, support FROM f UNION ALL SELECT 'macro avg', avg(precision), avg(recall), avg(f1), sum(support) FROM f
 UNION ALL SELECT 'weighted avg', sum(precision * support) / sum(support), sum(recall * support) / sum(support), sum(f1 * support) / sum(support), sum(support) FROM f
 UNION ALL SELECT 'accuracy', sum(hit) / sum(support), sum(hit) / sum(support), sum(hit) / sum(support), sum(support) FROM f) u"""
)
def classification_report(spark, sf):
    rows = _scored(spark, sf).select(F.col("label").alias("truth"), (F.col("score") >= 10).cast("int").alias("predicted"))
    got = metrics.classification_report(rows)
    return got.select("label", *[F.round(c, 9).alias(c) for c in ("precision", "recall", "f1")], "support")


@query(_SCORED + "SELECT doc_id, round((score / 50 + (doc_id % 7) / 7.0 + (doc_id % 3) / 3.0) / 3, 9) AS p, CAST((score / 50 + (doc_id % 7) / 7.0 + (doc_id % 3) / 3.0) / 3 >= 0.5 AS INTEGER) AS predicted FROM s WHERE CAST((score / 50 + (doc_id % 7) / 7.0 + (doc_id % 3) / 3.0) / 3 >= 0.5 AS INTEGER) <> label")
def fold_mispredicted(spark, sf):
    p = F.explode(F.array(F.col("score") / 50, F.col("doc_id") % 7 / 7.0, F.col("doc_id") % 3 / 3.0))
    folds = metrics.fold_average(_scored(spark, sf).select("doc_id", p.alias("p")), "doc_id")
    rows = folds.join(_scored(spark, sf).select("doc_id", "label"), "doc_id")
    return metrics.mispredicted(rows, "label").select("doc_id", F.round("p", 9).alias("p"), "predicted")


@query(_SCORED + "SELECT count(*) FILTER (WHERE label = 1 AND toxic = 1) AS positive, count(*) FILTER (WHERE NOT (label = 1 AND toxic = 1)) AS negative FROM s")
def label_counts(spark, sf):
    return metrics.label_counts(_scored(spark, sf), "label", "toxic")


@query(f"""WITH p AS (SELECT p_partkey AS id, p_type AS t, left(p_type, 1) AS g FROM part) SELECT id, string_agg(DISTINCT x, ',' ORDER BY x) AS names FROM (SELECT id, unnest([t, g]) AS x FROM p) z GROUP BY id""")
def inclusion_names(spark, sf):
    """The semantic names that become one-hot features."""
    rows = expansions(spark, sf).select("id", "sf", "lf", F.col("lf").alias("lf_base"), "source", F.col("cui").alias("semtypes"), F.substring("cui", 1, 1).alias("semgroups"))
    return inclusion.featurise(rows).select("id", F.array_join(F.array_sort("names"), ",").alias("names"))


def _judged(spark, sf):
    """Expansions with features, and a label that follows from them."""
    return expansions(spark, sf).select(
        "id", "sf", "lf", F.col("lf").alias("lf_base"), "source", F.col("cui").alias("semtypes"), F.substring("cui", 1, 1).alias("semgroups"), (F.length("lf") > 9).cast("int").alias("label")
    )


@query()
def inclusion_forest(spark, sf):
    rows = sampling.split(_judged(spark, sf), sampling.modular("id"))
    model = inclusion.fit(rows.where("is_train = 1"), trees=20)
    return inclusion.predict(model, rows.where("is_train = 0")).select("id", "p", "is_valid", "label")


@query()
def stored_inclusion_filter(spark, sf):
    """A filter that is fitted, saved, loaded by its columns, and applied to all expansions."""
    rows = _judged(spark, sf)
    path = scratch_path(spark, "inclusion-model")
    models.save_model(inclusion.fit(rows, kind="logistic"), inclusion.featurise(rows), path)
    return inclusion.keep_valid(models.load_model(spark, path, inclusion.featurise(rows)), rows).select("id", "sf", "lf", "label")


@query()
def cross_validation(spark, sf):
    """Five stratified folds through fitted forests: AUC of each, and how many rows the mean over folds gets wrong."""
    found = inclusion.cross_validate(_judged(spark, sf), "id", folds=5, trees=10)
    truth = found.select("id", "label").distinct()
    wrong = metrics.mispredicted(metrics.fold_average(found, "id").join(truth, "id"), "label").select("id")
    per = found.join(wrong.withColumn("wrong", F.lit(1)), "id", "left").groupBy("fold").agg(F.count("wrong").alias("mispredicted"))
    return metrics.roc_auc_by(found, "fold", "label", "p").join(per, "fold")


_MERGE = _NAMES + ", m AS (SELECT a AS lf_1, b AS lf_2, similarity FROM s WHERE similarity > 0) "


def _merge_scores(spark, sf):
    pairs = cluster.similar_pairs(_names(spark, sf), 0.0)
    return inclusion.merge_scores(pairs.select(F.col("a").alias("lf_1"), F.col("b").alias("lf_2")))


@query(_MERGE + "SELECT lf_1, lf_2, round(similarity, 9) AS similarity FROM m")
def merge_scores(spark, sf):
    return _merge_scores(spark, sf).select("lf_1", "lf_2", F.round("similarity", 9).alias("similarity"))


@query(_MERGE + """, y AS (SELECT similarity, CAST(length(lf_1) = length(lf_2) AS INTEGER) AS label FROM m)
SELECT round(sum(CASE WHEN p.similarity > n.similarity THEN 1.0 WHEN p.similarity = n.similarity THEN 0.5 ELSE 0 END) / count(*), 9) AS auc FROM y p, y n WHERE p.label = 1 AND n.label = 0""")
def merge_score_auc(spark, sf):
    rows = _merge_scores(spark, sf).select(F.col("similarity").alias("score"), (F.length("lf_1") == F.length("lf_2")).cast("int").alias("label"))
    return metrics.roc_auc(rows).select(F.round("auc", 9).alias("auc"))


@query()
def aligned_distances(spark, sf):
    pairs = cluster.similar_pairs(_names(spark, sf), 0.3).select("a", "b")
    got = edit.aligned(text.space_tokens(F.col("a")), text.space_tokens(F.col("b")))
    return pairs.select("a", "b", edit.osa_distance("a", "b").alias("osa"), got.alias("d")).select("a", "b", "osa", "d.distance", "d.covered")
