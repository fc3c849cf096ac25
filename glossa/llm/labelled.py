"""The held-out rule, and bounded samples of documents to fit on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def held_out(id_col: str | Column) -> Column:
    """True where crc32 of the id as text leaves 1 when divided by 3; a null id isn't held out."""
    col = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.coalesce(F.crc32(col.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def hashed_sample(ids: DataFrame, n: int, id_col: str = "id") -> DataFrame:
    """At most ``n`` rows, the same at every run: those whose ids hash lowest."""
    return ids.where(F.col(id_col).isNotNull()).orderBy(F.xxhash64(id_col), id_col).limit(n)


def training_labels(labels: DataFrame, label_col: str) -> DataFrame:
    """(id, label): one row per id that isn't held out; null labels are left out, the largest of several stays."""
    rows = labels.select(F.col("doc_id").cast("long").alias("id"), F.col(label_col).cast("int").alias("label"))
    return rows.where(~held_out("id") & F.col("label").isNotNull()).groupBy("id").agg(F.max("label").alias("label"))
