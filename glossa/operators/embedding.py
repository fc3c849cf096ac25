"""Vectors of contexts: a pluggable encoder, dimension reduction, checks."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.ml.feature import PCA, StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossa.operators.contexts import word_piece_span

LAYERS = 4


def hashed_layers(pieces: list[list[str]], width: int = 32, layers: int = 6) -> list[np.ndarray]:
    """A stand-in for a language model: for each text, (layers, tokens, width) from hashes of a token and its neighbours."""
    out = []
    for tokens in pieces:
        own = np.zeros((len(tokens), width))
        for i, t in enumerate(tokens):
            h = crc32(t.encode())
            own[i, h % width] += 1 if h >> 16 & 1 else -1
        stack = [own]
        for _ in range(layers - 1):
            last = stack[-1]
            around = np.zeros_like(last)
            around[1:] += last[:-1]
            around[:-1] += last[1:]
            stack.append(0.5 * last + 0.25 * around)
        out.append(np.stack(stack))
    return out


#: Pieces on either side that a piece's hidden layers depend on; what is further needn't be encoded.
hashed_layers.reach = 5


def pieces_of(text: str) -> list[str]:
    """Lower-case words cut into pieces of four letters, continuations marked."""
    return [p for w in text.lower().split() for p in [w[:4], *["##" + w[i : i + 4] for i in range(4, len(w), 4)]]]


#: Tokens of a padded block, padding included: the encoder's memory is that times its layers and width.
BLOCK_TOKENS = 1 << 15
PAD = ""


def hashed_block(block: list[list[str]], width: int = 32, layers: int = 6) -> np.ndarray:
    """``hashed_layers`` of a padded block (texts of one length, filled with ``PAD``): (layers, texts, tokens, width)."""
    known: dict[str, int] = {}
    hashes = np.array([[known[t] if t in known else known.setdefault(t, crc32(t.encode())) for t in row] for row in block], np.int64)
    real = np.array([[t != PAD for t in row] for row in block])
    own = np.zeros((*hashes.shape, width))
    np.put_along_axis(own, (hashes % width)[..., None], np.where(hashes >> 16 & 1, 1.0, -1.0)[..., None], axis=2)
    own *= real[..., None]
    stack = [own]
    for _ in range(layers - 1):
        last = stack[-1]
        around = np.zeros_like(last)
        around[:, 1:] += last[:, :-1]
        around[:, :-1] += last[:, 1:]
        stack.append((0.5 * last + 0.25 * around) * real[..., None])
    return np.stack(stack)


hashed_block.reach = hashed_layers.reach


def _blocks(sizes: np.ndarray) -> Iterator[np.ndarray]:
    """Rows by length, cut so that a block padded to its longest row stays within ``BLOCK_TOKENS``."""
    order = np.argsort(-sizes, kind="stable")
    order = order[sizes[order] > 0]
    at = 0
    while at < len(order):
        n = max(1, BLOCK_TOKENS // int(sizes[order[at]]))
        yield order[at : at + n]
        at += n


_EMBEDDED = "row_idx long, form string, sf string, span array<int>, embedding array<double>"


def embed(
    contexts: DataFrame, encoder: Callable[[list[list[str]]], np.ndarray] = hashed_block, tokenizer: Callable[[str], list[str]] = pieces_of,
    last_layers: int = LAYERS, row_id: str = "row_idx",
) -> DataFrame:
    """(row_idx, form, sf, span, embedding): mean over the short form's first span of pieces, then over the last layers.

    The encoder gets blocks of texts of nearly one length, padded with ``PAD``, once each, and returns (layers, texts, tokens,
    width). If it has a ``reach``, the pieces on either side that a piece's layers depend on, the span and its surroundings
    stand for the text, and texts that share them are encoded once a batch. Rows whose short form isn't found get nulls.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        reach = getattr(encoder, "reach", None)
        for batch in batches:
            spans, starts, slots, texts = [], [], [], {}
            for text, sf in zip(batch.context_trimmed, batch.sf, strict=True):
                pieces = tokenizer(text or "")
                span = word_piece_span(pieces, (sf or "").lower())
                start = 0 if span is None or reach is None else max(0, span[0] - reach)
                spans.append(span)
                starts.append(start)
                cut = () if span is None else tuple(pieces) if reach is None else tuple(pieces[start : span[1] + reach])
                slots.append(None if span is None else texts.setdefault((cut, span[0] - start, span[1] - start), len(texts)))
            keys = list(texts)
            sizes = np.array([len(k[0]) for k in keys], np.int64)
            vectors: list[list[float] | None] = [None] * len(keys)
            for rows in _blocks(sizes):
                longest = int(sizes[rows].max())
                hidden = encoder([[*keys[r][0], *[PAD] * (longest - len(keys[r][0]))] for r in rows])[-last_layers:]
                first, end = (np.array([keys[r][i] for r in rows]) for i in (1, 2))
                inside = (np.arange(longest) >= first[:, None]) & (np.arange(longest) < end[:, None])
                sums = np.einsum("lntw,nt->nw", hidden, inside / (end - first)[:, None])
                for r, v in zip(rows.tolist(), (sums / len(hidden)).tolist(), strict=True):
                    vectors[r] = v
            yield pd.DataFrame({
                "row_idx": batch.row_idx, "form": batch.form, "sf": batch.sf, "span": [None if s is None else list(s) for s in spans],
                "embedding": [None if k is None else vectors[k] for k in slots],
            })

    rows = contexts.select(F.col(row_id).alias("row_idx"), "form", "sf", "context_trimmed")
    return rows.mapInPandas(run, _EMBEDDED)


def embed_with_restart(contexts: DataFrame, path: str, batch: int = 100_000, most: int | None = None, row_id: str = "row_idx", **how: object) -> DataFrame:
    """``embed`` into ``path``, a folder the cluster shares: rows row_idx // ``batch`` are one job and are committed together.

    A stopped run, or one that ends after ``most`` batches, goes on from what is committed and encodes none of it again.
    """
    spark, root = contexts.sparkSession, path.rstrip("/")
    fs = spark._jvm.org.apache.hadoop.fs.Path(root).getFileSystem(spark._jsc.hadoopConfiguration())
    at = F.floor(F.col(row_id) / batch).cast("long")
    wanted = sorted(r.at for r in contexts.where(F.col(row_id).isNotNull()).select(at.alias("at")).distinct().collect())
    done = [k for k in wanted if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{root}/batch={k}/_SUCCESS"))]
    for k in [k for k in wanted if k not in done][:most]:
        mine = contexts.where((F.col(row_id) >= k * batch) & (F.col(row_id) < (k + 1) * batch))
        embed(mine, row_id=row_id, **how).write.mode("overwrite").parquet(f"{root}/batch={k}")
        done.append(k)
    return spark.read.schema(_EMBEDDED).parquet(*[f"{root}/batch={k}" for k in done]) if done else spark.createDataFrame([], _EMBEDDED)


def reduce_dimensions(rows: DataFrame, k: int, vector: str = "embedding", out: str = "pc") -> tuple[DataFrame, list[float]]:
    """``rows`` with the first ``k`` principal components of centred vectors, and their shares of variance."""
    with_vector = rows.withColumn("_v", array_to_vector(F.col(vector).cast("array<double>")))
    centred = StandardScaler(withMean=True, withStd=False, inputCol="_v", outputCol="_c").fit(with_vector).transform(with_vector)
    model = PCA(k=k, inputCol="_c", outputCol="_p").fit(centred)
    got = model.transform(centred).withColumn(out, vector_to_array("_p")).drop("_v", "_c", "_p")
    return got, model.explainedVariance.toArray().tolist()


def bundles(rows: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(key, n, items): all rows of a key as one array; for keys of a bounded size (downsample first)."""
    return rows.groupBy(key).agg(F.count("*").alias("n"), F.collect_list(F.struct(*columns)).alias("items"))


def by_form(rows: DataFrame, own: bool | None = None) -> DataFrame:
    """``rows`` dealt by short form and form, with is_own; only the short form's own rows, or only the others, if asked.

    A form's vectors stay rows, as a form may have any number of them.
    """
    marked = rows.withColumn("is_own", F.col("sf").eqNullSafe(F.col("form")))
    marked = marked if own is None else marked.where(F.col("is_own") == F.lit(own))
    return marked.repartition("sf", "form")


def organised(rows: DataFrame) -> DataFrame:
    """(sf, form, is_own, n): vectors of each short form by form, the short form's own apart."""
    return rows.groupBy("sf", "form").agg(F.count("*").alias("n")).withColumn("is_own", F.col("sf") == F.col("form"))
