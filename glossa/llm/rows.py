"""Verdicts on rows: a row is known by its id and the 128-bit hash of its own text, not by its id alone."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from glossa.plans.skew import join_hot

SALTS = 16


def text_key(text: str | Column) -> Column:
    """Hash of a whole text; null and empty texts are one."""
    col = F.col(text) if isinstance(text, str) else text
    return F.md5(F.coalesce(col.cast("string"), F.lit("")).cast("binary"))


@contextmanager
def batches_of(spark: SparkSession, n: int) -> Iterator[None]:
    """Arrow batches of at most ``n`` rows for what is run inside: rows of whole texts can be large."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(min(n, int(before)) if int(before) > 0 else n))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def fresh(df: DataFrame, stem: str) -> str:
    """A column name that ``df`` doesn't have."""
    taken, name = {c.lower() for c in df.columns}, f"_{stem}"
    while name in taken:
        name += "_"
    return name


def keep_rows(docs: DataFrame, told: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The rows of ``docs`` that ``told`` (id, key, n, kept: one row for each id and text) keeps, one of repeated rows."""
    own_id, own_key, kept, again = (fresh(docs, s) for s in ("row_id", "row_key", "row_kept", "row_again"))
    rows = docs.withColumns({own_id: F.col(f"`{id_col}`").cast("long"), own_key: text_key(F.col(f"`{text_col}`"))})
    told = told.select(F.col("id").alias(own_id), F.col("key").alias(own_key), F.col("kept").alias(kept), (F.col("n") > 1).alias(again), "n")
    some = told.where(F.col(kept) & F.col(again)).head(1)
    got = join_hot(rows, told.withColumnRenamed("n", fresh(docs, "row_n")), [own_id, own_key], fresh(docs, "row_n")).where(kept)
    if some:
        got = got.where(~F.col(again)).unionByName(got.where(again).dropDuplicates([own_id, own_key]))
    return got.select(*[f"`{c}`" for c in docs.columns])


def drop_texts(docs: DataFrame, keys: DataFrame, text_col: str) -> DataFrame:
    """The rows of ``docs`` whose text's key isn't in ``keys`` (key).

    Where the keys are too many to broadcast, both sides are dealt by key and a salt, so a frequent text has ``SALTS`` tasks.
    """
    key, salt = fresh(docs, "row_key"), fresh(docs, "row_salt")
    rows = docs.withColumns({key: text_key(F.col(f"`{text_col}`")), salt: (F.monotonically_increasing_id() % SALTS).cast("int")})
    told = keys.select(F.col("key").alias("gone"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("s")).distinct()
    return rows.join(told, (rows[key] == told["gone"]) & (rows[salt] == told["s"]), "left_anti").select(*[f"`{c}`" for c in docs.columns])
