"""Documents between boundary lines, from text files of any size.

A file is read in splits. Each task joins the lines of its splits into pieces, cut where boundary lines stand, and writes
them down with how many lines and boundaries each split holds. Sums over the splits before give every piece the index of
its document and of its lines in the file, so one file is spread over as many tasks as it has splits. A piece that
begins after a boundary and ends before one is a document already; only pieces at the edges of splits are shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from glossa.plans.materialize import materialize

_PIECES = "file string, block long, piece long, upto long, closed boolean, text string"
#: Splits (some 150 bytes each) that are broadcast; with more of them pieces are dealt by split.
MOST_SPLITS = 300_000


def _piece_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over (file, block, value, boundary) in the order of the files: the pieces of each split, in order.

    ``upto`` counts the split's lines to the end of a piece, with the boundary line that closes it. A split's last piece is open.
    """
    now, piece, seen, held = None, 0, 0, []

    def rows(out: list[tuple]) -> pa.RecordBatch:
        cols = list(zip(*out, strict=True)) or [()] * 6
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.string())
        names = ["file", "block", "piece", "upto", "closed", "text"]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names)

    for batch in batches:
        out: list[tuple] = []
        file, block, value, boundary = batch.columns
        starts = block.to_numpy()
        changed = np.flatnonzero(starts[1:] != starts[:-1]) + 1 if len(starts) else np.zeros(0, int)
        if len(starts):
            other = pc.not_equal(file.slice(1), file.slice(0, len(file) - 1)).to_numpy(zero_copy_only=False)
            changed = np.union1d(changed, np.flatnonzero(other) + 1)
        marks = np.flatnonzero(boundary.to_numpy(zero_copy_only=False))
        at = 0
        for upto in [*changed.tolist(), len(starts)]:
            if at == upto:
                continue
            split = (file[at].as_py(), int(starts[at]))
            if split != now:
                if now is not None:
                    out.append((*now, piece, seen, False, "".join(held)))
                now, piece, seen, held = split, 0, 0, []
            for mark in marks[np.searchsorted(marks, at) : np.searchsorted(marks, upto)].tolist():
                held += [v + "\n" for v in value.slice(at, mark - at).to_pylist()]
                seen += mark - at + 1
                out.append((*now, piece, seen, True, "".join(held)))
                piece, held, at = piece + 1, [], mark + 1
            held += [v + "\n" for v in value.slice(at, upto - at).to_pylist()]
            seen += upto - at
            at = upto
        yield rows(out)
    if now is not None:
        yield rows([(*now, piece, seen, False, "".join(held))])


def line_documents(spark: SparkSession, path: str, boundary: Column, **options: object) -> DataFrame:
    """(file, line, closed, text): what stands between the lines for which ``boundary`` (over ``value``) holds.

    text holds whole lines, each with its line feed; line is the index in the file of the boundary line that closes the
    document, or for the last document of a file, which no boundary closes, the index of the file's last line. Boundary
    lines belong to no document. Documents without lines are not returned.
    """
    lines = spark.read.options(**options).text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value", boundary.alias("boundary")
    )
    # written once, as another scan might cut its splits elsewhere
    pieces = materialize(lines.mapInArrow(_piece_batches, _PIECES), "segments")
    splits = pieces.groupBy("file", "block").agg(F.max("upto").alias("lines"), F.count_if("closed").alias("marks"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    sums = [F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"{c}_before") for c in ("lines", "marks")]
    splits = materialize(splits.select("file", "block", *sums), "segment-splits")
    if splits.count() <= MOST_SPLITS:
        splits = F.broadcast(splits)
    placed = pieces.join(splits, ["file", "block"]).withColumns(
        {"doc": F.col("marks_before") + F.col("piece"), "line": F.col("lines_before") + F.col("upto") - 1}
    )
    whole = placed.where("closed and piece > 0").select("file", "line", "closed", "text")
    parts = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "text"))), lambda p: p["text"]), "")
    edges = placed.where("not closed or piece = 0").groupBy("file", "doc").agg(
        F.max("line").alias("line"), F.bool_or("closed").alias("closed"), parts.alias("text")
    )
    return whole.unionByName(edges.select("file", "line", "closed", "text")).where("text <> ''")
