"""Merkle manifest of a table: one leaf per row, trees of threes per source, and a tree of the sources' roots.

1. Leaves are hashed where rows are read; what is shuffled is an id, the source and two digests. They are numbered by
   ranges of (source, id, leaf), so a source of any size is spread, and the number of its first leaf names its tree.
2. Large blocks: 3 ** height consecutive leaves of a tree (3 ** 5 to 3 ** 9) are one group of one task, which gives each
   leaf its path inside the block, siblings level by level, and the block one digest. Where more than ``TOP_MOST``
   digests are left, they are reduced as the leaves were; trees that are down to one digest wait, and when all are,
   they form the tree of sources.
3. The driver builds the upper tree from the digests that are left, at most ``TOP_MOST``, and broadcasts the rest of the
   path from each to the root.
4. Executors append that to each leaf's path, hash the proof, and fold each row's present leaf with its siblings.

Defined cases: a null field is written as ``-``; rows of one id are ordered by leaf, repeated rows are leaves of their
own; null ids come first and are never tampered with; one row is its own subroot and root, with an empty proof; an empty
table gives an empty result; columns other than those of ``FIELDS`` are not looked at. A text of any length is hashed
whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glossa.plans.materialize import materialize
from glossa.plans.ranges import numbered
from glossa.plans.skew import join_hot

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
ARITY = 3
#: Levels that one block reduces; the fewest that leave few enough digests.
HEIGHTS = (5, 9)
#: Digests that the driver builds the upper tree from. A path to the root is some 1.4 kB, so the broadcast stays under 90 MB.
TOP_MOST = ARITY**10


def field(value: Column) -> Column:
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(values: dict[str, Column]) -> Column:
    """Digest (binary) of one row's fields."""
    return F.unhex(F.sha2(F.concat(*[field(values[f]) for f in FIELDS]).cast("binary"), 256))


def tampered_text(doc_id: Column, text: Column) -> Column:
    """The text as it is now: without line feeds where the id's checksum is even."""
    even = F.crc32(doc_id.cast("string").cast("binary")) % 2 == 0
    return F.when(even, F.replace(text, F.lit("\n"), F.lit(""))).otherwise(text)


def leaves(docs: DataFrame, now: Column | None = None) -> DataFrame:
    """(doc_id, source, leaf, present): each row's leaf, and that of its present text where it differs.

    ``now`` is the text that is checked against the manifest, by default ``tampered_text``.
    """
    own = {f: F.col(f"`{f}`") for f in FIELDS}
    text = tampered_text(own["doc_id"], own["text"]) if now is None else now
    rows = docs.select(own["doc_id"].cast("long").alias("doc_id"), own["source"].cast("string").alias("source"),
                       leaf(own).alias("leaf"), leaf(own | {"text": text}).alias("present"))
    return rows.withColumn("present", F.when(F.col("present") != F.col("leaf"), F.col("present")))


def planted(rows: DataFrame) -> tuple[DataFrame, int]:
    """``rows`` with tree (number of its source's first leaf), pos and n (leaves of the tree), and the number of all."""
    # equal rows are told apart by where they are read, so that many of them don't fall into one range
    spread = rows.withColumn("tie", F.monotonically_increasing_id())
    got = materialize(numbered(spread, "source", "doc_id", "leaf", "tie").drop("tie"), "merkle-leaves")
    trees = got.groupBy("source").agg(F.min("row_idx").alias("tree"), F.count("*").alias("n"))
    trees = materialize(trees.withColumn("rows", F.col("n")), "merkle-trees")
    told = join_hot(got, trees, ["source"], "rows")
    return told.withColumn("pos", F.col("row_idx") - F.col("tree")).drop("row_idx"), got.count()


def parent(nodes: list[str]) -> str:
    return sha256("".join(nodes).encode()).hexdigest()


def levels_of(n: int, most: int | None = None) -> int:
    """Levels above ``n`` nodes, up to one node."""
    got = 0
    while n > 1 and (most is None or got < most):
        n, got = -(-n // ARITY), got + 1
    return got


def reduce_nodes(nodes: list[str], height: int) -> tuple[str, list[bytes]]:
    """(digest, path of each node) of one block, ``height`` levels up.

    A path holds for each level one byte, 16 * left + right siblings, and the digests of these from left to right.
    """
    stages = [nodes]
    for _ in range(height):
        last = stages[-1]
        stages.append([parent(last[i : i + ARITY]) for i in range(0, len(last), ARITY)])
    if len(stages[-1]) != 1:
        raise ValueError("a block must end in one digest")
    paths = [b""]
    for stage in reversed(stages[:-1]):
        raw, above, paths = [bytes.fromhex(d) for d in stage], paths, []
        for at in range(len(raw)):
            low = at - at % ARITY
            left, right = raw[low:at], raw[at + 1 : low + ARITY]
            paths.append(bytes([16 * len(left) + len(right)]) + b"".join(left) + b"".join(right) + above[at // ARITY])
    return stages[-1][0], paths


def fold(node: str, path: bytes) -> str:
    """The root that a node and its path lead to."""
    at = 0
    while at < len(path):
        left, right = divmod(path[at], 16)
        mid, end = at + 1 + 32 * left, at + 1 + 32 * (left + right)
        node = sha256((path[at + 1 : mid].hex() + node + path[mid:end].hex()).encode()).hexdigest()
        at = end
    return node


def proof(path: bytes) -> str:
    """The digest of all siblings of a path, level by level and from left to right."""
    out, at = [], 0
    while at < len(path):
        end = at + 1 + 32 * sum(divmod(path[at], 16))
        out.append(path[at + 1 : end].hex())
        at = end
    return sha256("".join(out).encode()).hexdigest()


def _block_batches(height: int, size: int):
    """Rows sorted by (tree, pos) get path, and the first of each block the block's digest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        key = None

        def done() -> pa.RecordBatch:
            rows = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            nodes = [d.hex() for d in rows.column("node").to_pylist()]
            digest, paths = reduce_nodes(nodes, levels_of(rows.column("n")[0].as_py(), height))
            first = [bytes.fromhex(digest), *[None] * (len(nodes) - 1)]
            more = [pa.array(paths, pa.binary()), pa.array(first, pa.binary())]
            return pa.RecordBatch.from_arrays([*rows.columns, *more], [*rows.schema.names, "path", "digest"])

        for batch in batches:
            keys = list(zip(batch.column("tree").to_pylist(), [p // size for p in batch.column("pos").to_pylist()], strict=True))
            at = 0
            for i in range(1, len(keys) + 1):
                if i == len(keys) or keys[i] != keys[at]:
                    if held and key != keys[at]:
                        yield done()
                        held = []
                    key = keys[at]
                    held.append(batch.slice(at, i - at))
                    at = i
        if held:
            yield done()

    return run


def reduced(nodes: DataFrame, height: int, name: str) -> tuple[DataFrame, DataFrame]:
    """``nodes`` (tree, pos, n, node, ...) with path and block, written, and the blocks' digests as nodes again."""
    size = ARITY**height
    block = F.floor(F.col("pos") / size).cast("long")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in nodes.schema)
    dealt = nodes.repartition("tree", block).sortWithinPartitions("tree", "pos")
    rows = dealt.mapInArrow(_block_batches(height, size), schema + ", path binary, digest binary")
    rows = materialize(rows.withColumn("block", block), name)
    left = rows.where("digest is not null").select(
        "tree", F.col("block").alias("pos"), F.ceil(F.col("n") / size).cast("long").alias("n"), F.col("digest").alias("node")
    )
    return rows, left


def height_for(n: int, most: int, heights: tuple[int, int] = HEIGHTS) -> int:
    low, high = heights
    return next((h for h in range(low, high) if n // ARITY**h <= most // 2), high)


def top_paths(nodes: list[tuple[int, int, str]]) -> tuple[str, dict[tuple[int, int], tuple[str, bytes]]]:
    """(root, {(tree, pos): (subroot, path to the root)}) of the nodes (tree, pos, digest) that are left."""
    trees: dict[int, list[str]] = {}
    for tree, _, digest in sorted(nodes):
        trees.setdefault(tree, []).append(digest)
    within = {t: reduce_nodes(d, levels_of(len(d))) for t, d in trees.items()}
    root, above = reduce_nodes([within[t][0] for t in sorted(trees)], levels_of(len(trees)))
    out = {}
    for rank, t in enumerate(sorted(trees)):
        sub, paths = within[t]
        for pos, path in enumerate(paths):
            out[t, pos] = (sub, path + above[rank])
    return root, out


def manifest(docs: DataFrame, now: Column | None = None, top_most: int = TOP_MOST, heights: tuple[int, int] = HEIGHTS) -> DataFrame:
    """(doc_id, source, leaf, subroot, root, path, proof_sha256, folded_root, verified), one row per row of ``docs``.

    path is the proof itself: for each level one byte, 16 * left + right siblings, and their digests.
    """
    spark = docs.sparkSession
    start, n = planted(leaves(docs, now))
    rows, nodes = reduced(start.withColumnRenamed("leaf", "node"), height_for(n, top_most, heights), "merkle-blocks")
    rows = rows.withColumn("subroot", F.lit(None).cast("binary"))
    while (left := nodes.count()) > top_most:
        if not nodes.where("n > 1").head(1):
            # every tree is one digest: from here on they are the leaves of the tree of sources
            nodes = materialize(numbered(nodes.withColumnRenamed("tree", "own_tree"), "own_tree"), "merkle-subroots").select(
                F.lit(-1).cast("long").alias("tree"), F.col("row_idx").alias("pos"), F.lit(left).cast("long").alias("n"), "node", "own_tree",
                F.lit(0).cast("long").alias("own_pos"), F.col("node").alias("own_root"),
            )
        else:
            nodes = nodes.withColumns({"own_tree": F.col("tree"), "own_pos": F.col("pos"), "own_root": F.lit(None).cast("binary")})
        upper, nodes = reduced(nodes, height_for(left, top_most, heights), "merkle-upper")
        upper = upper.select(
            "own_tree", "own_pos", "own_root", F.col("path").alias("own_path"), F.col("tree").alias("up_tree"), F.col("block").alias("up_block")
        )
        rows = rows.join(upper, (rows["tree"] == upper["own_tree"]) & (rows["block"] == upper["own_pos"])).select(
            "doc_id", "source", "node", "present", F.concat("path", "own_path").alias("path"), F.col("up_tree").alias("tree"),
            F.col("up_block").alias("block"), F.coalesce("subroot", "own_root").alias("subroot"),
        )
    found = [(r.tree, r.pos, r.node.hex()) for r in nodes.select("tree", "pos", "node").collect()]
    known = spark.sparkContext.broadcast(top_paths(found) if found else ("", {}))
    schema = "doc_id long, source string, leaf string, subroot string, root string, path binary, proof_sha256 string, folded_root string, verified boolean"
    return rows.select("doc_id", "source", "node", "present", "path", "tree", "block", "subroot").mapInArrow(_finish(known), schema)


def _finish(known):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        root, above = known.value
        for batch in batches:
            leaves_, subs, paths, proofs, folded = [], [], [], [], []
            for node, present, path, tree, block, sub in zip(*[batch.column(i).to_pylist() for i in range(2, 8)], strict=True):
                top, rest = above[tree, block]
                path += rest
                leaves_.append(node.hex())
                subs.append(sub.hex() if sub else top)
                paths.append(path)
                proofs.append(proof(path))
                folded.append(fold((present or node).hex(), path))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), batch.column(1), pa.array(leaves_, pa.string()), pa.array(subs, pa.string()),
                    pa.array([root] * len(subs), pa.string()), pa.array(paths, pa.binary()), pa.array(proofs, pa.string()),
                    pa.array(folded, pa.string()), pa.array([f == root for f in folded], pa.bool_()),
                ],
                ["doc_id", "source", "leaf", "subroot", "root", "path", "proof_sha256", "folded_root", "verified"],
            )

    return run
