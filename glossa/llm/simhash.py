"""SimHash near-duplicates linked through sharded BK-trees.

Fingerprints: ASCII-lower-cased words, three-word shingles with repeats, XXH64 (seed 42) of each; a bit is set
where more than half of the shingle hashes set it. Two fingerprints link when at most ``RADIUS`` bits differ.

Shards: with r bits of difference allowed, two linked fingerprints agree on at least one of r + 1 blocks of bits.
Distinct fingerprints are dealt by (block, value), so every link lies inside a shard, and each shard grows its own
BK-tree (children keyed by Hamming distance to the parent; only edges within the radius are followed). A shard tree
is never broadcast and never leaves its task, as all trees together grow with the corpus. A shard of over
``SHARD_MAX`` fingerprints is not gathered: its rows are dealt again by r + 1 blocks of the bits that are still
free, until shards are small; with ``FREE_MIN`` free bits a shard can't hold more than 2 ** FREE_MIN fingerprints.

No key is dealt to one task with all its rows: a hot fingerprint or component is joined where its rows are.

Defined cases: null or blank text has the fingerprint zero and links like any other; fewer than three words form
one shingle; repeated rows stay separate rows with equal results; null ids are ignored when the smallest id is
taken; an empty table gives an empty result; columns other than id and text are not looked at. Where one row of each
group is kept, a row is known by its id and its own text: rows of one id and different texts are judged apart, of
repeated rows one stays, and a row without an id stays only where its group has no id at all.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_digest

from glossa.llm.rows import keep_rows, text_key
from glossa.plans.components import connected_components
from glossa.plans.materialize import materialize
from glossa.plans.skew import join_hot

RADIUS, SHINGLE, SEED = 2, 3, 42
SHARD_MAX, FREE_MIN = 2048, 12
ALL_BITS = (1 << 64) - 1
CHUNK = 1 << 18


def fingerprint(text: str | None) -> int:
    """The unsigned 64-bit fingerprint of one whole text."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    k = min(SHINGLE, len(words))
    spans = list(zip(starts[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist(), strict=True))
    counts = np.zeros(64, np.int64)
    for at in range(0, len(spans), CHUNK):
        digests = b"".join([xxh64_digest(joined[a:b], SEED) for a, b in spans[at : at + CHUNK]])
        counts += np.unpackbits(np.frombuffer(digests, np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > len(spans)).tobytes(), "big")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _fingerprint_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        got = [_signed(fingerprint(t.as_py())) for t in batch.column("text")]
        rest = [c for c in batch.schema.names if c != "text"]
        yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in rest], pa.array(got, pa.int64())], [*rest, "fp"])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keyed: bool = False) -> DataFrame:
    """(id, fp), with ``keyed`` the text's key too: one row per row of ``docs``; fp holds the bits as a signed long."""
    more = [text_key(text_col).alias("key")] if keyed else []
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"), *more)
    return rows.mapInArrow(_fingerprint_batches, f"id long, {'key string, ' if keyed else ''}fp long")


class BKTree:
    """Distinct 64-bit values; ``near`` follows only edges whose distance is within ``radius`` of the query's."""

    def __init__(self) -> None:
        self.values: list[int] = []
        self.edges: list[dict[int, int]] = []

    def add(self, x: int) -> None:
        at = 0
        while self.values:
            d = (x ^ self.values[at]).bit_count()
            if not d:
                return
            step = self.edges[at].get(d)
            if step is None:
                self.edges[at][d] = len(self.values)
                break
            at = step
        self.values.append(x)
        self.edges.append({})

    def near(self, x: int, radius: int) -> list[int]:
        found, todo = [], [0] if self.values else []
        while todo:
            at = todo.pop()
            d = (x ^ self.values[at]).bit_count()
            if d <= radius:
                found.append(self.values[at])
            for edge, child in self.edges[at].items():
                if d - radius <= edge <= d + radius:
                    todo.append(child)
        return found


class LevelTree:
    """The tree that ``BKTree`` grows from an array of distinct 64-bit values in their order, kept level by level.

    Each level has its nodes' places among the values, their parents' places in the level above and the edges' distances,
    so many queries walk down together.
    """

    def __init__(self, values: np.ndarray) -> None:
        self.values = values.view(np.uint64)
        nodes, at, rest = np.zeros(min(1, len(values)), np.int64), np.zeros(max(0, len(values) - 1), np.int64), np.arange(1, len(values))
        self.levels = [(nodes, nodes, nodes)] if len(values) else []
        while len(rest):
            edge = at * 65 + np.bitwise_count(self.values[rest] ^ self.values[nodes[at]])
            steps, first, at = np.unique(edge, return_index=True, return_inverse=True)
            nodes = rest[first]
            self.levels.append((nodes, steps // 65, steps % 65))
            later = np.ones(len(rest), bool)
            later[first] = False
            rest, at = rest[later], at[later]

    def near(self, queries: np.ndarray, radius: int) -> np.ndarray:
        """(queries, values): which values are within ``radius`` bits; only edges within the radius of a query's distance are followed."""
        queries, found = queries.view(np.uint64), np.zeros((len(queries), len(self.values)), bool)
        for depth, (nodes, parents, edges) in enumerate(self.levels):
            follow = np.abs(far[:, parents] - edges) <= radius if depth else np.ones((len(queries), 1), bool)
            query, node = np.nonzero(follow)
            far = np.full(follow.shape, 1000, np.int16)  # not reached: no edge is within a radius of this
            far[query, node] = np.bitwise_count(queries[query] ^ self.values[nodes[node]])
            found[:, nodes] = far <= radius
        return found


def blocks(free: int, n: int) -> list[int]:
    """The set bits of ``free``, highest first, as ``n`` masks of nearly equal width."""
    bits = [1 << i for i in range(63, -1, -1) if free >> i & 1]
    cuts = [len(bits) * i // n for i in range(n + 1)]
    return [sum(bits[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


def shard_links(values: list[int], radius: int) -> list[tuple[int, int]]:
    """A spanning forest of the links within one shard: at most one row less than it has fingerprints."""
    tree, root, links = BKTree(), {}, []

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = x = root[root[x]]
        return x

    for x in values:
        if x in root:
            continue
        root[x] = x
        for y in tree.near(x, radius):
            a, b = find(x), find(y)
            if a != b:
                root[a] = b
                links.append((x, y))
        tree.add(x)
    return links


def _link_batches(radius: int, shard_max: int):
    """Over rows sorted by (mask, value under the mask): links (again = 0), or rows to deal again (again = 1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(mask: int, values: list[int]) -> list[tuple[int, int, int]]:
            if len(values) < 2:
                return []
            return [(0, _signed(a), _signed(b)) for a, b in shard_links(values, radius)]

        def deal(mask: int, values: list[int]) -> list[tuple[int, int, int]]:
            return [(1, _signed(mask | b), _signed(x)) for b in blocks(~mask & ALL_BITS, radius + 1) for x in values]

        key, held, over = None, [], False
        for batch in batches:
            mask, fp = (batch.column(i).to_numpy(zero_copy_only=False).view(np.uint64) for i in (0, 1))
            value = fp & mask
            cut = np.flatnonzero((mask[1:] != mask[:-1]) | (value[1:] != value[:-1])) + 1
            ends = np.append(cut, len(fp))
            starts = np.insert(cut, 0, 0)
            # whole groups of one row that touch no edge of the batch hold no link
            keep = (ends - starts > 1) | (starts == 0) | (ends == len(fp))
            out: list[tuple[int, int, int]] = []
            for a, b in zip(starts[keep].tolist(), ends[keep].tolist(), strict=True):
                now = (int(mask[a]), int(value[a]))
                if now != key:
                    if key is not None and not over:
                        out += done(key[0], held)
                    key, held, over = now, [], False
                rows = fp[a:b].tolist()
                if over:
                    out += deal(now[0], rows)
                else:
                    held += rows
                    if len(held) > shard_max and 64 - now[0].bit_count() > FREE_MIN:
                        out += deal(now[0], held)
                        held, over = [], True
            yield _rows(out)
        if key is not None and not over:
            yield _rows(done(key[0], held))

    return run


def _rows(rows: list[tuple[int, int, int]]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) or [(), (), ()]
    kinds = (pa.int32(), pa.int64(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["again", "a", "b"])


def fingerprint_links(distinct: DataFrame, radius: int = RADIUS, shard_max: int = SHARD_MAX) -> DataFrame:
    """(src, dst): links whose components are those of all links within ``radius`` over the distinct ``fp``."""
    masks = F.array(*[F.lit(_signed(m)) for m in blocks(ALL_BITS, radius + 1)])
    todo, links = distinct.select(F.explode(masks).alias("mask"), "fp"), None
    while todo is not None:
        dealt = todo.repartition("mask", F.col("mask").bitwiseAND(F.col("fp")))
        rows = dealt.sortWithinPartitions("mask", F.col("mask").bitwiseAND(F.col("fp"))).mapInArrow(
            _link_batches(radius, shard_max), "again int, a long, b long"
        )
        rows = materialize(rows, "simhash-links")
        found = rows.where("again = 0").select(F.col("a").alias("src"), F.col("b").alias("dst"))
        links = found if links is None else links.union(found)
        again = rows.where("again = 1")
        todo = again.select(F.col("a").alias("mask"), F.col("b").alias("fp")) if again.head(1) else None
    return links


def named_groups(nodes: DataFrame, links: DataFrame, node: str = "fp") -> DataFrame:
    """``nodes`` (fp, rep, n) with the group of each (its smallest node) and component_id, the group's smallest rep."""
    linked = connected_components(links).withColumnsRenamed({"node": node, "component": "group"})
    named = materialize(nodes.join(linked, node), "groups-named")
    least = named.groupBy("group").agg(F.min("rep").alias("least"), F.count("*").alias("_n"))
    moved = join_hot(named.select(node, "group"), materialize(least, "groups-least"), ["group"], "_n")
    out = nodes.join(moved, node, "left")
    return out.select(node, "n", F.coalesce("group", node).alias("group"), F.when(F.col("group").isNull(), F.col("rep")).otherwise(F.col("least")).alias("component_id"))


def simhash_components(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, shard_max: int = SHARD_MAX
) -> DataFrame:
    """(id, fp, component_id) for every row of ``docs``; component_id is the smallest id reachable by links."""
    fps = materialize(fingerprints(docs, id_col, text_col), "simhash-fingerprints")
    distinct = materialize(fps.groupBy("fp").agg(F.min("id").alias("rep"), F.count("*").alias("n")), "simhash-distinct")
    groups = materialize(named_groups(distinct, fingerprint_links(distinct, radius, shard_max)), "simhash-groups")
    return join_hot(fps, groups.drop("group"), ["fp"]).select("id", "fp", "component_id")


def keep_representatives(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, shard_max: int = SHARD_MAX
) -> DataFrame:
    """One row of each group of linked fingerprints, that with its smallest id, with the columns it came with."""
    fps = materialize(fingerprints(docs, id_col, text_col, keyed=True), "simhash-fingerprints")
    distinct = materialize(fps.groupBy("fp").agg(F.min("id").alias("rep"), F.count("*").alias("n")), "simhash-distinct")
    groups = named_groups(distinct, fingerprint_links(distinct, radius, shard_max))
    return keep_rows(docs, first_rows(fps, groups), id_col, text_col)


def first_rows(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """(id, key, n, kept) of each id and text of ``rows`` (id, key, fp); one of each group (fp, group) is kept.

    That is the one with the smallest id (rows without an id come last), then the smallest key.
    """
    own = materialize(rows.groupBy("fp", "id", "key").agg(F.count("*").alias("n")), "rows-own")
    order = F.struct(F.col("id").isNull().alias("nameless"), "id", "key")
    first = own.groupBy("fp").agg(F.min(order).alias("first")).join(groups.select("fp", "group"), "fp")
    first = first.groupBy("group").agg(F.min("first").alias("first")).select(F.col("first.id").alias("id"), F.col("first.key").alias("key"))
    first = first.withColumn("kept", F.lit(True))
    same = own["id"].eqNullSafe(first["id"]) & (own["key"] == first["key"])
    return materialize(own.join(first, same, "left").select(own["id"], own["key"], own["n"], F.coalesce("kept", F.lit(False)).alias("kept")), "rows-told")
