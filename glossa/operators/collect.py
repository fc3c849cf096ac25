"""Contexts of all corpora as one table, with short forms and counts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossa.functions import sets


def form_index(dictionary: DataFrame) -> DataFrame:
    """(form, sf): each long form under the first short form that lists it (by ``pos``); short forms are their own."""
    long_forms = dictionary.groupBy(F.col("lf").alias("form")).agg(F.min_by("sf", "pos").alias("sf"))
    own = dictionary.select(F.col("sf").alias("form"), "sf").distinct()
    return own.unionByName(long_forms.join(own, "form", "left_anti"))


def collect(corpora: dict[str, DataFrame], dictionary: DataFrame) -> DataFrame:
    """(form, doc_id, context, source, sf): distinct rows without nulls; forms that the dictionary lacks are left out."""
    parts = [rows.withColumn("source", F.lit(name)) for name, rows in sorted(corpora.items())]
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    rows = rows.select("form", "doc_id", "context", "source").dropna("any").distinct()
    return rows.join(form_index(dictionary), "form").select("form", "doc_id", "context", "source", "sf")


def unknown_forms(contexts: DataFrame, dictionary: DataFrame) -> DataFrame:
    """(form): forms of contexts that no dictionary entry explains; empty if all is well."""
    return contexts.select("form").distinct().join(form_index(dictionary), "form", "left_anti")


def with_counts(dictionary: DataFrame, contexts: DataFrame) -> DataFrame:
    """``dictionary`` with sf_count and lf_count: how often each form was found, 0 if never."""
    counts = contexts.groupBy("form").agg(F.count("*").alias("n"))
    out = dictionary
    for name, key in (("sf_count", "sf"), ("lf_count", "lf")):
        found = counts.select(F.col("form").alias(key), F.col("n").alias(name))
        out = out.join(found, key, "left").withColumn(name, F.coalesce(name, F.lit(0)))
    return out


def sources_of(rows: DataFrame, *keys: str) -> DataFrame:
    """(keys, source): bar set of the sources of each key."""
    return rows.groupBy(*keys).agg(sets.to_bars(F.collect_set("source")).alias("source"))
