"""Training-corpus pipeline: quality, toxicity, near-duplicates, benchmark passages, tokens.

Each stage takes (spark, docs, sf_dir), works on every row it is given, and is written and read again before the next.
All but the last return the columns they were given. A stage that filters keeps a row by a verdict on its own text:
rows of one text share their verdict whatever their ids, rows with null text pass unless the verdict on the empty text
says otherwise. The near-duplicate stage keeps one row of each group; that is operator 6's SimHash and BK-trees, over
five-word shingles and a verified similarity of 0.8, in shards that suit this similarity.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glossa.llm import bpe, decontaminate, near_copies, quality, toxicity
from glossa.llm.rows import drop_texts
from glossa.plans.materialize import materialize, scratch_path
from glossa.sources.tables import table


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that the quality classifier rejects."""
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    return quality.keep(docs, model)


def keep_civil(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that the toxicity classifier rejects."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.keep(docs, model)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document with the smallest id of each group of near copies: five-word shingles, similarity of 0.8 or more."""
    return near_copies.keep_representatives(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that contain a benchmark item, re-parameterised ones included."""
    found = decontaminate.contaminated(docs, table(spark, sf_dir, "benchmark"))
    return drop_texts(docs, materialize(found.select(F.col("text_key").alias("key")).distinct(), "contaminated"), "text")


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids (packed little-endian unsigned 32-bit), ids_sha256, decoded_sha256."""
    return bpe.digests(docs)


STAGES = [
    ("quality", keep_quality),
    ("toxicity", keep_civil),
    ("near_duplicates", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("tokens", tokens),
]
#: Learned models, XXH64 fingerprints and BPE are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = scratch_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
