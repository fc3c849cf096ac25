"""Readers: every path goes to a Spark reader, every schema is explicit. Nothing is fetched from a network."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from glossa.functions.text import standardize_upper
from glossa.operators import abbreviations
from glossa.sources.segments import line_documents

NULL_WORDS = ("", "NA", "N/A", "null", "nan")


def short_form_list(spark: SparkSession, path: str) -> DataFrame:
    """(sf): the first field of each tab-separated line, standardised, longer than one character; repeats stay."""
    lines = spark.read.text(path)
    sf = standardize_upper(F.element_at(F.split("value", "\t"), 1))
    return lines.select(sf.alias("sf")).where(F.length("sf") > 1)


def plain_list(spark: SparkSession, path: str) -> DataFrame:
    """(name): distinct trimmed lines, sorted."""
    return spark.read.text(path).select(F.trim("value").alias("name")).where("name <> ''").distinct().orderBy("name")


def json_map_of_lists(spark: SparkSession, path: str, key: str = "sf", value: str = "lf") -> DataFrame:
    """(key, value): a JSON object of string lists, as rows."""
    whole = spark.read.text(path, wholetext=True).select(F.from_json("value", "map<string,array<string>>").alias("m"))
    return whole.select(F.explode("m").alias(key, "_items")).select(key, F.explode("_items").alias(value))


def json_array(spark: SparkSession, path: str, name: str = "sf") -> DataFrame:
    whole = spark.read.text(path, wholetext=True).select(F.from_json("value", "array<string>").alias("a"))
    return whole.select(F.explode("a").alias(name))


def bar_delimited(spark: SparkSession, path: str, names: list[str]) -> DataFrame:
    """Headerless fields between bars, all strings, unquoted."""
    return spark.read.csv(path, sep="|", schema=", ".join(f"`{n}` string" for n in names), quote="")


def semantic_types(spark: SparkSession, path: str) -> DataFrame:
    return bar_delimited(spark, path, ["abbr", "tui", "name"])


def semantic_groups(spark: SparkSession, path: str) -> DataFrame:
    return bar_delimited(spark, path, ["group_code", "group_name", "tui", "type_name"])


def headered_csv(spark: SparkSession, path: str, schema: str | StructType, fold_nulls: bool = False) -> DataFrame:
    """CSV with a header and a given schema; ``fold_nulls`` turns the usual null words of string columns into nulls."""
    rows = spark.read.csv(path, header=True, schema=schema, multiLine=True, escape='"')
    if not fold_nulls:
        return rows
    fold = {n: F.when(~F.col(n).isin(*NULL_WORDS), F.col(n)) for n, t in rows.dtypes if t == "string"}
    return rows.withColumns(fold)


def csv_directory(spark: SparkSession, path: str, schema: str | StructType) -> DataFrame:
    """All CSV files below a directory, rows without all fields and repeated rows dropped."""
    return headered_csv(spark, path, schema).dropna("any").dropDuplicates()


def in_batches(rows: DataFrame, function: Callable, schema: str | StructType) -> DataFrame:
    """Apply a function of pandas frames to Arrow batches (their size: spark.sql.execution.arrow.maxRecordsPerBatch)."""

    def run(batches):
        for batch in batches:
            yield function(batch)

    return rows.mapInPandas(run, schema)


def marked_documents(spark: SparkSession, path: str, marker: str = "<DOCSTART>", prefix: str = "doc") -> DataFrame:
    """(doc_id, text, file): the lines before each line that starts with the marker, if longer than one character.

    A marker inside a line is text; a line that starts with it is dropped whole. doc_id is <prefix>_<index of the closing
    line>. Lines after the last marker are a document of any length, named by the file's last line. Ids are counted in
    each file.
    """
    docs = line_documents(spark, path, F.col("value").startswith(marker)).where(~F.col("closed") | (F.length("text") > 1))
    return docs.select(F.concat_ws("_", F.lit(prefix), "line").alias("doc_id"), "text", "file")


def blank_line_documents(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, text, file): the lines before each empty line. doc_id is <index of that line>_<file name>.

    Repeated empty lines give no empty documents. Lines after the last empty line are a document too, named by the
    file's last line.
    """
    docs = line_documents(spark, path, F.col("value") == "")
    return docs.select(F.concat_ws("_", "line", F.element_at(F.split("file", "/"), -1)).alias("doc_id"), "text", "file")


def documents_by_year(spark: SparkSession, path: str, first: int, last: int) -> DataFrame:
    """A table partitioned by ``year``; partitions beyond the range are never listed as input."""
    return spark.read.parquet(path).where(F.col("year").between(first, last))


def by_key(spark: SparkSession, path: str, key: str, wanted: list[str]) -> DataFrame:
    """A table written with ``partitionBy(key)``, some keys of it."""
    return spark.read.parquet(path).where(F.col(key).isin(wanted))


def parameters(spark: SparkSession, path: str, iteration: int | None = None) -> DataFrame:
    """Saved model parameters of one iteration, by default the last one."""
    rows = spark.read.parquet(path)
    wanted = rows.agg(F.max("iter")).first()[0] if iteration is None else iteration
    return rows.where(F.col("iter") == F.lit(wanted))


def text_directory(spark: SparkSession, path: str) -> DataFrame:
    """(file, text): each *.txt whole."""
    return spark.read.option("pathGlobFilter", "*.txt").text(path, wholetext=True).select(
        F.col("_metadata.file_name").alias("file"), F.col("value").alias("text")
    )


def merged_json_shards(spark: SparkSession, path: str) -> DataFrame:
    """(key, items): JSON objects of string lists from many files; for each key the file that sorts last wins."""
    shards = spark.read.text(path, wholetext=True).select(
        F.col("_metadata.file_name").alias("file"), F.explode(F.from_json("value", "map<string,array<string>>")).alias("key", "items")
    )
    return shards.groupBy("key").agg(F.max_by("items", "file").alias("items"))


def merged_pairs(spark: SparkSession, path: str) -> DataFrame:
    """(sf, lf) of a term service's saved answers: JSON shards, the last one of a key wins."""
    return merged_json_shards(spark, path).select(F.col("key").alias("sf"), F.explode("items").alias("lf"))


def abstract_pairs(abstracts: DataFrame) -> DataFrame:
    """(sf, lf) that abstracts (id, abstract) define."""
    return abbreviations.extract(abstracts, "id", "abstract").select("sf", "lf")


def xml_abstracts(spark: SparkSession, path: str, row_tag: str = "PubmedArticle") -> DataFrame:
    """(id, abstract): article abstracts of (gzipped) XML; parts of a structured abstract are joined by a space."""
    schema = (
        "MedlineCitation struct<PMID: struct<_VALUE: string>, Article: struct<Abstract: struct<"
        "AbstractText: array<struct<_VALUE: string>>>>>"
    )
    rows = spark.read.format("xml").option("rowTag", row_tag).schema(schema).load(path)
    text = F.array_join(F.col("MedlineCitation.Article.Abstract.AbstractText._VALUE"), " ")
    return rows.select(F.col("MedlineCitation.PMID._VALUE").alias("id"), text.alias("abstract")).where("abstract <> ''")


def lookup_source(terms: DataFrame, table: DataFrame, term: str = "sf") -> DataFrame:
    """What an external term service would answer, from an injected table (term, lf): exact match."""
    return terms.join(table, term).select(term, "lf")


#: Source name to a function of (spark, path) that gives (sf, lf).
SOURCES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "json": json_map_of_lists, "pubmed": lambda spark, path: abstract_pairs(xml_abstracts(spark, path)), "umls": merged_pairs,
}


def from_sources(spark: SparkSession, paths: Mapping[str, tuple[str, str]]) -> DataFrame:
    """(sf, lf, source): rows of several named sources, each read by the reader of its kind."""
    parts = [SOURCES[kind](spark, path).withColumn("source", F.lit(name)) for name, (kind, path) in sorted(paths.items())]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return out


def synthetic_vectors(spark: SparkSession, keys: list[str], n: int, width: int, scale: float, seed: int) -> DataFrame:
    """(row_id, sf, embedding): keys in turn, normal vectors; the same at every run."""
    names = F.array(*[F.lit(k) for k in keys])
    cells = [(F.randn(seed + i) * scale) for i in range(width)]
    rows = spark.range(0, n, 1, 1)
    return rows.select(
        F.col("id").alias("row_id"), F.element_at(names, (F.col("id") % len(keys) + 1).cast("int")).alias("sf"), F.array(*cells).alias("embedding")
    )


def synthetic_documents(spark: SparkSession, words: list[str], n: int, size: int, seed: int = 0) -> DataFrame:
    """(doc_id, text): ``n`` documents of ``size`` words each, scrambled by integer arithmetic: the same everywhere."""
    names = F.array(*[F.lit(w) for w in words])
    at = lambda i: F.pmod((F.col("id") * size + i + seed) * 2654435761 % 1000003, F.lit(len(words))) + 1
    text = F.array_join(F.transform(F.sequence(F.lit(0).cast("long"), F.lit(size - 1).cast("long")), lambda i: F.element_at(names, at(i).cast("int"))), " ")
    return spark.range(n).select(F.col("id").alias("doc_id"), text.alias("text"))


def evaluation_rows(spark: SparkSession, sf: str, lf: str, width: int, n: int = 10) -> DataFrame:
    """(id, sf, lf, embedding): ``n`` equal rows, which any sound evaluation answers alike."""
    ones = F.array_repeat(F.lit(1.0), width)
    return spark.range(n).select("id", F.lit(sf).alias("sf"), F.lit(lf).alias("lf"), ones.alias("embedding"))
