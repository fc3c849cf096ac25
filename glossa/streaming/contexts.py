"""Contexts of terms in a stream of documents: the batch operators, stateless, on a streaming frame."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from glossa.operators.contexts import WINDOW, tokenise, word_contexts


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, text): one document per line of files that arrive in a folder."""
    lines = spark.readStream.text(path)
    return lines.select(F.xxhash64("value").alias("doc_id"), F.col("value").alias("text"))


def stream_contexts(docs: DataFrame, terms: DataFrame, lengths: list[int], size: int = WINDOW) -> DataFrame:
    """(form, doc_id, pos, context): terms are a static frame, so no state is kept."""
    return word_contexts(tokenise(docs), terms, lengths, size).drop("length")


def write_contexts(contexts: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append to Parquet, each batch once; ends when what has arrived is done."""
    return contexts.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
