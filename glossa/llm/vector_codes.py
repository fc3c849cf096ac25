"""Product codes of vectors: codebooks refined over columnar NumPy blocks by RDD treeAggregate.

Vectors become integers floor(256 * x), cut into ``PARTS`` equal parts. Arrow batches become blocks, written once: one
row holds some thousand vectors as one int32 array per part, dimension by dimension. A round is one treeAggregate over
these blocks: squared distances to the codebook's entries accumulate dimension by dimension, the nearest entry (ties to
the lower index) takes the part's components by np.add.at into int64 sums and counts, and these tensors, of a size that
depends on the codebooks only, merge through a reduction tree. A last pass assigns again and sums errors by label,
partial sums before the shuffle.

Defined cases: null vectors and those with null or non-finite components are dropped; so are those whose length isn't
that of the kept vector with the smallest id, or, where that can't be cut into ``PARTS`` parts, of the first one that
can; with fewer than ``ENTRIES`` vectors a codebook has as many entries; a component beyond 2 ** 28 (after scaling)
counts as 2 ** 28, so that sums stay in 64 bits; repeated rows count each for itself, and of equal ids the smaller
vector starts a codebook; null labels are one label; null ids come before others; an empty table gives an empty result;
other columns are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glossa.plans.materialize import materialize
from glossa.plans.skew import join_hot

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Vectors in a block: the distance array of one part then takes ENTRIES times as many integers, 2 MB.
BLOCK = 4096
MOST = 1 << 28


def kept_vectors(vectors: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """(id, label, vector) of the rows whose vector has components, all of them finite."""
    v = F.col(f"`{vector_col}`").cast("array<double>")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = vectors.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{label_col}`").alias("label"), v.alias("vector"))
    return rows.where(finite & (F.size("vector") > 0))


def scaled(vector: np.ndarray) -> np.ndarray:
    """floor(256 * x) of double components, as 64-bit integers."""
    return np.clip(np.floor(vector * float(SCALE)), -MOST, MOST).astype(np.int64)


def _block_batches(width: int):
    """Blocks of the vectors of ``width`` components: (n, values), values part by part and dimension by dimension."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = matrix(batch.column(0), width)[1]
            for at in range(0, len(got), BLOCK):
                part = scaled(got[at : at + BLOCK]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([len(part)], pa.int32()), pa.array([np.ascontiguousarray(part.T).tobytes()], pa.binary())], ["n", "values"]
                )

    return run


def matrix(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(row numbers, their vectors) of a list column's rows that have ``width`` components."""
    offsets = column.offsets.to_numpy()
    right = np.flatnonzero(np.diff(offsets) == width)
    values = column.values.to_numpy(zero_copy_only=False)
    return right, values[offsets[right][:, None] + np.arange(width)] if len(right) else np.empty((0, width))


def nearest(columns: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(entry, squared distance) of each vector; ``columns`` is dimensions x vectors, ``book`` entries x dimensions."""
    distance = np.zeros((columns.shape[1], len(book)), np.int64)
    for d in range(len(columns)):
        gap = columns[d].astype(np.int64)[:, None] - book[:, d][None, :]
        distance += gap * gap
    entry = distance.argmin(axis=1)
    return entry, distance[np.arange(len(entry)), entry]


def codebooks(blocks: DataFrame, start: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """Codebooks (part, entry, position) after ``rounds`` rounds over ``blocks`` (n, values), from ``start``."""
    parts, entries, width = start.shape
    context = blocks.sparkSession.sparkContext

    def add(seen, row):
        sums, counts = seen
        values = np.frombuffer(row.values_, np.int32).reshape(parts, width, row.n)
        for p in range(parts):
            entry, _ = nearest(values[p], now.value[p])
            np.add.at(counts[p], entry, 1)
            np.add.at(sums[p], entry, values[p].T)
        return sums, counts

    def merge(a, b):
        a[0].__iadd__(b[0])
        a[1].__iadd__(b[1])
        return a

    rows = blocks.withColumnRenamed("values", "values_").rdd  # a Row has a method of that name
    book = start
    for _ in range(rounds):
        now = context.broadcast(book)
        zero = (np.zeros((parts, entries, width), np.int64), np.zeros((parts, entries), np.int64))
        sums, counts = rows.treeAggregate(zero, add, merge, depth=2)
        means = sums // np.maximum(counts, 1)[:, :, None]
        book = np.where(counts[:, :, None] > 0, means, book)
    return book


def digest(book: np.ndarray) -> str:
    """SHA-256 of all components as decimal numbers, by part, entry and position, joined by commas."""
    return hashlib.sha256(",".join(map(str, book.reshape(-1).tolist())).encode()).hexdigest()


def first_vectors(kept: DataFrame, parts: int = PARTS, entries: int = ENTRIES) -> np.ndarray | None:
    """(part, entry, position): the first vectors by id; None where no vector can be cut."""
    width = kept.where(F.size("vector") % parts == 0).select("id", "vector").orderBy("id", "vector").limit(1).collect()
    if not width:
        return None
    size = len(width[0].vector)
    rows = kept.where(F.size("vector") == size).select("id", "vector").orderBy("id", "vector").limit(entries).collect()
    start = scaled(np.array([r.vector for r in rows]))
    return start.reshape(len(rows), parts, size // parts).transpose(1, 0, 2).copy()


def _code_batches(known):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        book = known.value
        parts, _, width = book.shape
        for batch in batches:
            right, found = matrix(batch.column(2), parts * width)
            for at in range(0, len(right), BLOCK):
                values = scaled(found[at : at + BLOCK]).T.reshape(parts, width, -1)
                codes, error = [], np.zeros(values.shape[2], np.int64)
                for p in range(parts):
                    entry, distance = nearest(values[p], book[p])
                    codes.append(entry.astype(np.uint8))
                    error += distance
                rows = pa.array(right[at : at + BLOCK])
                text = np.stack(codes, axis=1)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(rows), batch.column(1).take(rows), pa.array([t.tobytes() for t in text], pa.binary()), pa.array(error)],
                    ["id", "label", "code", "error"],
                )

    return run


def compress(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
    parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS,
) -> tuple[DataFrame, np.ndarray | None]:
    """((id, label, code, error, label_error), codebooks); a code holds one byte per part, so ``entries`` is at most 256."""
    if entries > 256:
        raise ValueError("an entry's index must fit a byte")
    kept = kept_vectors(vectors, id_col, vector_col, label_col)
    start = first_vectors(kept, parts, entries)
    kind = kept.schema["label"].dataType.simpleString()
    schema = f"id long, label {kind}, code binary, error long"
    if start is None:
        return vectors.sparkSession.createDataFrame([], schema + ", label_error long"), None
    width = parts * start.shape[2]
    blocks = materialize(kept.select("vector").mapInArrow(_block_batches(width), "n int, values binary"), "codes-blocks")
    book = codebooks(blocks, start, rounds)
    known = vectors.sparkSession.sparkContext.broadcast(book)
    coded = materialize(kept.mapInArrow(_code_batches(known), schema), "codes-assigned")
    by_label = materialize(coded.groupBy("label").agg(F.sum("error").alias("label_error"), F.count("*").alias("n")), "codes-labels")
    return join_hot(coded, by_label, ["label"]), book


def reconstruct(codes: DataFrame, book: np.ndarray) -> DataFrame:
    """``codes`` with vector: each code's entries, put together and scaled back."""
    parts = [F.array(*[F.array(*[F.lit(float(x) / SCALE) for x in entry]) for entry in part]) for part in book.tolist()]
    return codes.withColumn("vector", F.flatten(F.array(*[F.element_at(p, _byte("code", i) + 1) for i, p in enumerate(parts)])))


def _byte(col: str, i: int) -> Column:
    return F.conv(F.hex(F.substring(col, i + 1, 1)), 16, 10).cast("int")
