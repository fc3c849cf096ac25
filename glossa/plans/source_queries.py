"""Queries of readers and sinks: a driver table is written in a source's format and read back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glossa.operators import disambiguate
from glossa.plans.catalogue import _MODEL, _model, _vectors, SF_SQL, PUNCTUATION_SQL, expansions
from glossa.plans.materialize import scratch_path
from glossa.plans.registry import query
from glossa.sources import readers, sinks
from glossa.sources.tables import table


def _text(rows: DataFrame, value: Column, name: str, **options: object) -> str:
    """A folder of text files, one line for each row."""
    path = scratch_path(rows.sparkSession, name)
    rows.select(value.alias("value")).write.options(**options).text(path)
    return path


@query(f"""SELECT sf FROM (SELECT upper(trim(translate(p_brand, '{PUNCTUATION_SQL}', ''))) AS sf FROM part) t WHERE length(sf) > 1""")
def tsv_short_forms(spark, sf):
    part = table(spark, sf, "part")
    return readers.short_form_list(spark, _text(part, F.concat_ws("\t", "p_brand", "p_name"), "tsv"))


@query("""SELECT DISTINCT trim(n_name) AS name FROM nation""")
def plain_name_list(spark, sf):
    nation = table(spark, sf, "nation")
    return readers.plain_list(spark, _text(nation, F.concat(F.lit("  "), "n_name", F.lit(" \n\n"), "n_name"), "names"))


@query(f"""SELECT DISTINCT {SF_SQL} AS sf, p_name AS lf FROM part""")
def json_map_files(spark, sf):
    path = scratch_path(spark, "json-map")
    sinks.write_json_map(expansions(spark, sf), path, per_file=1)
    return readers.json_map_of_lists(spark, path)


@query(f"""SELECT DISTINCT {SF_SQL} AS sf, p_name AS lf, source FROM part, (VALUES ('first'), ('second')) s(source)""")
def merged_source_files(spark, sf):
    path = scratch_path(spark, "json-source")
    sinks.write_json_map(expansions(spark, sf), path, per_file=1)
    return readers.from_sources(spark, {"first": ("json", path), "second": ("umls", path)})


@query("""SELECT n_name AS sf FROM nation""")
def json_array_files(spark, sf):
    names = table(spark, sf, "nation").groupBy("n_regionkey").agg(F.collect_list("n_name").alias("names"))
    return readers.json_array(spark, _text(names, F.to_json("names"), "json-array", maxRecordsPerFile=1))


@query("""SELECT 'n' || n_nationkey AS abbr, 'T' || n_regionkey AS tui, n_name || ', "x"' AS name FROM nation""")
def bar_delimited_types(spark, sf):
    nation = table(spark, sf, "nation")
    line = F.concat_ws("|", F.concat(F.lit("n"), "n_nationkey"), F.concat(F.lit("T"), "n_regionkey"), F.concat("n_name", F.lit(', "x"')))
    return readers.semantic_types(spark, _text(nation, line, "bars"))


@query("""SELECT r_name AS group_code, n_name AS group_name, 'T' || n_nationkey AS tui, n_name AS type_name FROM nation JOIN region ON n_regionkey = r_regionkey""")
def bar_delimited_groups(spark, sf):
    rows = table(spark, sf, "nation").join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return readers.semantic_groups(spark, _text(rows, F.concat_ws("|", "r_name", "n_name", F.concat(F.lit("T"), "n_nationkey"), "n_name"), "bars"))


def _customers(spark, sf) -> DataFrame:
    k = F.col("c_custkey")
    segment = F.when(k % 5 == 0, "NA").when(k % 5 == 1, "null").otherwise(F.concat("c_mktsegment", F.lit(' "q",\nx')))
    return table(spark, sf, "customer").select("c_custkey", segment.alias("segment"), "c_name")


_CSV = "c_custkey long, segment string, c_name string"


@query("""SELECT c_custkey, CASE WHEN c_custkey % 5 > 1 THEN c_mktsegment || ' "q",' || chr(10) || 'x' END AS segment, c_name FROM customer""")
def csv_with_null_words(spark, sf):
    path = scratch_path(spark, "csv")
    sinks.write_csv(_customers(spark, sf), path)
    return readers.headered_csv(spark, path, _CSV, fold_nulls=True)


@query("""SELECT c_custkey, c_custkey * 2 AS twice, length(c_name) AS size FROM customer""")
def csv_in_batches(spark, sf):
    path = scratch_path(spark, "csv")
    sinks.write_csv(_customers(spark, sf), path)
    rows = readers.headered_csv(spark, path, _CSV)
    made = lambda b: b.assign(twice=b.c_custkey * 2, size=b.c_name.str.len())[["c_custkey", "twice", "size"]]
    return readers.in_batches(rows, made, "c_custkey long, twice long, size long")


@query("""SELECT c_custkey, c_mktsegment AS segment, c_name FROM customer WHERE c_custkey % 7 <> 0""")
def csv_directory(spark, sf):
    path = scratch_path(spark, "csv-directory")
    rows = table(spark, sf, "customer").select("c_custkey", F.when(F.col("c_custkey") % 7 != 0, F.col("c_mktsegment")).alias("segment"), "c_name")
    sinks.write_csv(rows.union(rows.where("c_custkey % 3 = 0")), path)
    return readers.csv_directory(spark, path, _CSV)


#: Documents of one file.
_PER_FILE = 250


def _shelves(spark, sf, record: Column, name: str) -> str:
    """Text files of the documents in order of their ids, ``_PER_FILE`` consecutive ids in a file, with ``record`` for each."""
    path = scratch_path(spark, name)
    docs = table(spark, sf, "documents").withColumn("text", F.regexp_replace("text", "\r\n?", "\n"))
    rows = docs.withColumn("shelf", F.floor(F.col("doc_id") / _PER_FILE)).select("shelf", "doc_id", record.alias("value"))
    rows.repartition("shelf").sortWithinPartitions("shelf", "doc_id").select("shelf", "value").write.partitionBy("shelf").text(path)
    return path


def _shelved(docs: DataFrame) -> DataFrame:
    shelf = F.regexp_extract("file", r"shelf=(\d+)/", 1).cast("long")
    return docs.select(shelf.alias("shelf"), "doc_id", F.length("text").cast("long").alias("size"), F.md5("text").alias("text_md5"))


#: Documents with the lines they take in their file; {lines} are those that the file has besides the text's own.
_SHELVES_SQL = f"""
d AS (SELECT doc_id, doc_id // {_PER_FILE} AS shelf, regexp_replace(text, chr(13) || chr(10) || '?', chr(10), 'g') AS text FROM documents),
l AS (SELECT *, length(text) - length(replace(text, chr(10), '')) + 1 AS own FROM d)"""


@query(
    f"""WITH {_SHELVES_SQL}, e AS (
  SELECT *, sum(own + 3 + CAST(doc_id % 5 = 0 AS INTEGER)) OVER (PARTITION BY shelf ORDER BY doc_id) - CAST(doc_id % 5 = 0 AS INTEGER) - 1 AS line,
    text || chr(10) || 'says <DOCSTART> inside' || chr(10) || ' <DOCSTART>' || chr(10) AS whole FROM l
)
SELECT shelf, 'm_' || line::BIGINT AS doc_id, length(whole) AS size, md5(whole) AS text_md5 FROM e"""
)
def marked_document_files(spark, sf):
    """Markers inside lines are text, a marker's own line is dropped, two markers in a row close nothing."""
    more = F.when(F.col("doc_id") % 5 == 0, "\n<DOCSTART>").otherwise("")
    record = F.concat("text", F.lit("\nsays <DOCSTART> inside\n <DOCSTART>\n<DOCSTART> id="), "doc_id", more)
    return _shelved(readers.marked_documents(spark, _shelves(spark, sf, record, "marked"), prefix="m"))


@query(
    f"""WITH {_SHELVES_SQL}, r AS (
  SELECT shelf, doc_id, i, unnest, sum(1) OVER (PARTITION BY shelf ORDER BY doc_id, i) - 1 AS line
  FROM (SELECT shelf, doc_id, unnest(string_split(text || chr(10), chr(10))) AS unnest, generate_subscripts(string_split(text || chr(10), chr(10)), 1) AS i FROM d)
), g AS (
  SELECT *, count(*) FILTER (WHERE unnest = '') OVER (PARTITION BY shelf ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS k FROM r
), t AS (
  SELECT shelf, max(line) AS line, string_agg(unnest || chr(10), '' ORDER BY line) FILTER (WHERE unnest <> '') AS whole FROM g GROUP BY shelf, k
)
SELECT shelf, CAST(CAST(line AS BIGINT) AS VARCHAR) AS doc_id, length(whole) AS size, md5(whole) AS text_md5 FROM t WHERE whole IS NOT NULL"""
)
def blank_line_document_files(spark, sf):
    """Every text is closed by an empty line; empty lines inside texts close documents too."""
    docs = _shelved(readers.blank_line_documents(spark, _shelves(spark, sf, F.concat("text", F.lit("\n")), "blank")))
    return docs.withColumn("doc_id", F.substring_index("doc_id", "_", 1))


@query("""SELECT o_orderkey, CAST(year(o_orderdate) AS INTEGER) AS year FROM orders WHERE year(o_orderdate) BETWEEN 1996 AND 1998""")
def year_partitions(spark, sf):
    path = scratch_path(spark, "years")
    sinks.write_partitioned(table(spark, sf, "orders").select("o_orderkey", F.year("o_orderdate").alias("year")), path, "year")
    return readers.documents_by_year(spark, path, 1996, 1998)


@query("""SELECT p_partkey AS id, p_brand AS source FROM part WHERE p_brand IN ('Brand#11', 'Brand#23', 'Brand#45')""")
def key_partitions(spark, sf):
    path = scratch_path(spark, "keys")
    sinks.write_partitioned(expansions(spark, sf).select("id", "source"), path, "source")
    return readers.by_key(spark, path, "source", ["Brand#11", "Brand#23", "Brand#45"])


def _xml(rows: DataFrame, record: Column) -> str:
    """Gzipped XML files of at most 500 records each, by the rows' id."""
    sets = rows.groupBy(F.floor(F.col("id") / 500).alias("at")).agg(F.collect_list(record).alias("records"))
    body = F.concat(F.lit("<Set>"), F.array_join("records", ""), F.lit("</Set>"))
    return _text(sets, body, "xml", compression="gzip", maxRecordsPerFile=1)


@query("""SELECT CAST(p_partkey AS VARCHAR) AS id, p_name || ' ' || p_type AS abstract FROM part WHERE p_partkey % 10 <> 0""")
def xml_abstract_files(spark, sf):
    part = table(spark, sf, "part")
    abstract = F.concat(F.lit("<Abstract><AbstractText Label='A'>"), "p_name", F.lit("</AbstractText><AbstractText>"), "p_type", F.lit("</AbstractText></Abstract>"))
    body = F.when(F.col("p_partkey") % 10 != 0, abstract).otherwise("")
    line = F.concat(
        F.lit("<PubmedArticle><MedlineCitation><PMID Version='1'>"), F.col("p_partkey").cast("string"), F.lit("</PMID><Article>"), body,
        F.lit("</Article></MedlineCitation></PubmedArticle>"),
    )
    return readers.xml_abstracts(spark, _xml(part.withColumn("id", F.col("p_partkey")), line))


@query(f"""SELECT DISTINCT {SF_SQL} AS sf, p_name AS lf FROM part""")
def abstract_pair_files(spark, sf):
    rows = expansions(spark, sf)
    line = F.concat(
        F.lit("<PubmedArticle><MedlineCitation><PMID Version='1'>"), F.col("id").cast("string"), F.lit("</PMID><Article><Abstract><AbstractText>We saw the "),
        "lf", F.lit(" ("), "sf", F.lit(") here.</AbstractText></Abstract></Article></MedlineCitation></PubmedArticle>"),
    )
    path = _xml(rows, line)
    return readers.from_sources(spark, {"abstracts": ("pubmed", path)}).select("sf", "lf").distinct()


@query("""SELECT n_name || chr(10) AS text FROM nation""")
def text_directory_files(spark, sf):
    return readers.text_directory(spark, _text(table(spark, sf, "nation"), F.col("n_name"), "texts", maxRecordsPerFile=1)).select("text")


@query("""SELECT r_name AS key, CASE WHEN r_regionkey % 2 = 0 THEN lower(n_name) ELSE n_name END AS item FROM nation JOIN region ON n_regionkey = r_regionkey""")
def json_shard_merge(spark, sf):
    """Two shards, in files whose names sort; the second holds every other key again."""
    rows = table(spark, sf, "nation").join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    second = rows.where("r_regionkey % 2 = 0").withColumn("n_name", F.lower("n_name")).withColumn("shard", F.lit(1))
    lists = rows.withColumn("shard", F.lit(0)).unionByName(second).groupBy("shard", "r_name").agg(F.collect_list("n_name").alias("names"))
    shards = lists.groupBy("shard").agg(F.map_from_entries(F.collect_list(F.struct("r_name", "names"))).alias("m"))
    path = _text(shards.repartitionByRange(2, "shard"), F.to_json("m"), "shards")
    return readers.merged_json_shards(spark, path).select("key", F.explode("items").alias("item"))


@query("""SELECT r_regionkey, r_name FROM region""")
def cached_stage(spark, sf):
    """The second call reads what the first one wrote."""
    path, region = scratch_path(spark, "stage"), table(spark, sf, "region").select("r_regionkey", "r_name")
    sinks.stage(spark, path, lambda: region)
    return sinks.stage(spark, path, lambda: region.where("false"))


def _saved(spark, sf) -> tuple[DataFrame, str]:
    """Test vectors, and parameters saved over two iterations; the first ones are wrong."""
    data, params = _model(spark, sf)
    path = scratch_path(spark, "parameters")
    sinks.write_iteration(params.withColumn("mean", F.transform("mean", lambda x: -x)), path, 1, clear=True)
    sinks.write_iteration(params, path, 2)
    return data, path


@query(_MODEL + "SELECT sf, lf, n, round(beta, 9) AS beta, 2 AS iter FROM b")
def parameter_snapshots(spark, sf):
    _, path = _saved(spark, sf)
    return readers.parameters(spark, path).select("sf", "lf", "n", F.round("beta", 9).alias("beta"), "iter")


@query(_MODEL + """, r AS (SELECT id, lf, row_number() OVER (PARTITION BY id ORDER BY logp DESC, lf) AS r FROM l)
SELECT v.id, v.sf, v.lf AS truth, r.lf AS predicted FROM r JOIN v USING (id) WHERE r.r = 1""")
def evaluate_saved(spark, sf):
    _, path = _saved(spark, sf)
    return disambiguate.evaluate(_vectors(spark, sf).where("id % 10 = 0"), readers.parameters(spark, path))
