"""Near-duplicate vectors by NN-descent: refine a neighbour graph, keep its edges above the threshold.

1. Equal vectors of a label are one class; classes are the nodes. Only nodes of one label and length are ever compared.
2. First neighbours: rounds of random hyperplanes. A round sorts each label's nodes by signature and compares them, in
   blocks, within the same signature prefix. Prefix length follows the number of nodes and the number of rounds follows
   from both and the threshold, so that a pair at the threshold meets in some round with probability ``MEET``.
3. Descent: every node hands its neighbours (and those that name it) to each other; each keeps its nearest. Lists hold
   entries down to twice the threshold's angle, ``K`` of them; where a list is saturated with links it is enlarged, up
   to ``K_MOST``. It stops when links hardly grow.
4. A list that ``K_MOST`` links fill may have lost some. A link is lost only if both its ends have such lists, so these
   nodes are covered: each hangs on the linked node with the lowest hash, its leader, and leaders of different components
   within three times the threshold's angle, found in pairs of blocks, put their components into one candidate group.
   Every link then lies inside a group.
5. Links inside a group are counted exactly, in pairs of blocks, without listing them: a pair of blocks gives counts and
   a spanning forest. The forests give the components.
6. Audit: ``AUDIT`` nodes (lowest hashes), or up to ``AUDIT_MOST`` until they have ``AUDIT_LINKS`` links, are compared with all nodes. If less than ``RECALL`` of their links were
   counted, the graph gets as many more rounds and another descent, at most ``RETRIES`` times; after that every label is
   one group, which is exact. The last audit's share is returned with each row.

No step gathers a label, bucket or group in one task: sorted ranges are cut anywhere, and groups are compared in blocks
of ``BLOCK`` rows. Only audit vectors (a fixed number) are broadcast, and vectors that are over a ``HOT``-th of all rows.

Defined cases: vectors that are null, empty, zero, or hold null or non-finite values, or whose label is null, link with
nothing and are their own component; repeated rows link with each other; the smallest non-null id names a component; an
empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from glossa.plans.components import connected_components
from glossa.plans.materialize import discard, materialize
from glossa.plans.skew import join_hot

THRESHOLD, K, K_MOST, BLOCK = 0.98, 8, 32, 1024
BUCKET, MEET, AT_ONCE, SEED = 512, 0.999, 2, 11
STEPS, SLOW = 5, 0.001
AUDIT, RECALL, RETRIES = 200, 0.995, 2
#: Links that an audit should see, and the most nodes it takes for them.
AUDIT_LINKS, AUDIT_MOST = 100, 1600


def _vectors(column: pa.ListArray) -> np.ndarray:
    """Rows of equal length as a matrix."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def _runs(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, pa.RecordBatch]]:
    """Slices of at most ``BLOCK`` rows whose first ``keys`` columns are equal; a group may come in many slices."""
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(keys)]
        change = np.zeros(batch.num_rows - 1, bool)
        for c in cols:
            change |= c[1:] != c[:-1]
        cut = [0, *(np.flatnonzero(change) + 1).tolist(), batch.num_rows]
        for a, b in zip(cut, cut[1:], strict=False):
            for at in range(a, b, BLOCK):
                yield tuple(c[a] for c in cols), batch.slice(at, min(BLOCK, b - at))


def _blocks(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, list[int], np.ndarray]]:
    """(key, nodes, matrix): the groups of sorted rows (keys.., node, unit) in blocks of ``BLOCK`` rows."""
    key, nodes, parts = None, [], []
    for now, part in _runs(batches, keys):
        if key is not None and (now != key or len(nodes) >= BLOCK):
            yield key, nodes, np.concatenate(parts)
            nodes, parts = [], []
        key = now
        nodes += part.column(keys).to_pylist()
        parts.append(_vectors(part.column(keys + 1)))
    if key is not None:
        yield key, nodes, np.concatenate(parts)


def _nearest(left: list[int], right: list[int], sims: np.ndarray, k: int, floor: float) -> list[tuple[int, int, float]]:
    """For each row of ``sims`` its ``k`` largest entries from ``floor`` up."""
    out = []
    for i in np.flatnonzero((sims >= floor).sum(axis=1) > 0):
        hits = np.flatnonzero(sims[i] >= floor)
        if len(hits) > k:
            hits = hits[np.argpartition(-sims[i, hits], k - 1)[:k]]
        out += [(left[i], right[j], float(sims[i, j])) for j in hits]
    return out


def _edges(rows: list[tuple[int, int, float]]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) or [(), (), ()]
    kinds = (pa.int64(), pa.int64(), pa.float64())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], ["node", "other", "sim"])


def _identity() -> list[Column]:
    """128 bits that stand for a row's label and vector."""
    return [F.xxhash64("label", "embedding").alias("h"), F.xxhash64(F.lit("again"), "label", "embedding").alias("g")]


def unit_classes(rows: DataFrame) -> DataFrame:
    """(node, first, n, h, g, label, dim, unit): classes of equal (label, embedding) that can link, written once."""
    grouped = rows.groupBy("label", "embedding").agg(F.min("vec_id").alias("first"), F.count("*").alias("n"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            units = []
            for v in batch.column(4):
                x = np.asarray(v.values.to_numpy(zero_copy_only=False), np.float64)
                x = x / np.abs(x).max()
                units.append(x / np.sqrt(x @ x))
            sizes = pa.array([len(u) for u in units], pa.int32())
            unit = pa.array(units, pa.list_(pa.float64()))
            cols = [batch.column(i) for i in (0, 1, 2, 3)]
            yield pa.RecordBatch.from_arrays([*cols, batch.column(5), sizes, unit], ["first", "n", "h", "g", "label", "dim", "unit"])

    given = grouped.select("first", "n", *_identity(), "embedding", F.col("label").cast("long"))
    units = given.mapInArrow(run, "first long, n long, h long, g long, label long, dim int, unit array<double>")
    return materialize(units.withColumn("node", F.monotonically_increasing_id()), "vector-classes")


def planned_rounds(nodes: int, threshold: float) -> tuple[int, int]:
    """(prefix bits, rounds) for a table of so many nodes."""
    bits = max(0, min(40, math.ceil(math.log2(max(1, nodes) / BUCKET))))
    agree = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, 1 if agree > MEET else math.ceil(math.log(1 - MEET) / math.log(1 - agree))


def first_neighbours(classes: DataFrame, rounds: list[int], bits: int, k: int, floor: float) -> DataFrame:
    """(node, other, sim): nearest nodes met in some rounds of hyperplanes."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            for r in rounds:
                dims = batch.column("dim").to_numpy()
                signature = np.zeros(batch.num_rows, np.uint64)
                for d in np.unique(dims):
                    if (r, d) not in planes:
                        planes[r, d] = np.random.default_rng([SEED, r, d]).normal(size=(d, 62))
                    at = np.flatnonzero(dims == d)
                    side = _vectors(batch.column("unit").take(pa.array(at))) @ planes[r, d] > 0
                    signature[at] = side @ (np.uint64(1) << np.arange(61, -1, -1, dtype=np.uint64))
                whole = signature.astype(np.int64)
                prefix = (signature >> np.uint64(62 - bits)).astype(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(batch.num_rows, r), pa.int32()), batch.column("label"), batch.column("dim"), pa.array(prefix), batch.column("node"), batch.column("unit"), pa.array(whole)],
                    ["round", "label", "dim", "prefix", "node", "unit", "signature"],
                )

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for key, nodes, x in _blocks(batches, 4):
            sims = x @ x.T
            np.fill_diagonal(sims, -1)
            out = _nearest(nodes, nodes, sims, k, floor)
            if last is not None and last[0] == key:
                across = x @ last[2].T
                out += _nearest(nodes, last[1], across, k, floor) + _nearest(last[1], nodes, across.T, k, floor)
            last = (key, nodes, x)
            if out:
                yield _edges(out)

    keys = ["round", "label", "dim", "prefix"]
    signed = classes.select("label", "dim", "node", "unit").mapInArrow(
        sign, "round int, label long, dim int, prefix long, node long, unit array<double>, signature long"
    )
    order = (*keys, "signature", "node")
    dealt = materialize(signed, "vector-signed").repartitionByRange(*order).sortWithinPartitions(*order)
    return dealt.mapInArrow(compare, "node long, other long, sim double")


def nearest_lists(edges: DataFrame, threshold: float, k: int, k_most: int) -> DataFrame:
    """The ``k`` nearest of each node; up to ``k_most`` of them, twice its links, where links saturate the list."""
    per = Window.partitionBy("node")
    ranked = edges.groupBy("node", "other").agg(F.max("sim").alias("sim")).withColumn(
        "rank", F.row_number().over(per.orderBy(F.desc("sim"), F.xxhash64("node", "other")))
    )
    ranked = ranked.where(F.col("rank") <= k_most)
    links = F.sum((F.col("sim") >= threshold).cast("int")).over(per)
    size = F.when(links >= k, F.least(F.lit(k_most), 2 * links)).otherwise(k)
    return ranked.withColumn("size", size).where("rank <= size").select("node", "other", "sim")


def descend(classes: DataFrame, lists: DataFrame, threshold: float, k: int, k_most: int, floor: float) -> DataFrame:
    """One step: the neighbours of each node, and a sample of those that name it, meet each other."""
    both = lists.select("node", "other").union(lists.select(F.col("other").alias("node"), F.col("node").alias("other"))).distinct()
    order = F.row_number().over(Window.partitionBy("node").orderBy(F.xxhash64("other", "node")))
    met = both.withColumn("rank", order).where(F.col("rank") <= 2 * k).select("node", "other")
    given = met.join(classes.select(F.col("node").alias("other"), "unit"), "other").select(F.col("node").alias("at"), "other", "unit")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, nodes, x in _blocks(batches, 1):
            sims = x @ x.T
            np.fill_diagonal(sims, -1)
            out = _nearest(nodes, nodes, sims, k_most, floor)
            if out:
                yield _edges(out)

    found = given.repartition("at").sortWithinPartitions("at").mapInArrow(meet, "node long, other long, sim double")
    return nearest_lists(lists.union(found), threshold, k, k_most)


def in_block_pairs(members: DataFrame, classes: DataFrame, columns: list[str]) -> DataFrame:
    """(group, a, b, own, node, unit, columns..) of members (node, group): each pair of a group's blocks dealt together."""
    sizes = members.groupBy("group").agg(F.count("*").alias("n"))
    sizes = sizes.withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int"))
    rows = join_hot(members, materialize(sizes, "vector-groups"), ["group"])
    rows = rows.join(classes.select("node", "unit", *columns), "node")
    own = F.pmod(F.xxhash64("node"), F.col("blocks").cast("long")).cast("int")
    rows = rows.withColumn("own", own).withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    keys = ("group", "a", "b", "own")
    dealt = rows.select("group", F.least("own", "with").alias("a"), F.greatest("own", "with").alias("b"), "own", "node", "unit", *columns)
    return dealt.repartition("group", "a", "b").sortWithinPartitions(*keys, "node")


def _forest(linked: np.ndarray, left: list[int], right: list[int]) -> list[tuple[int, int]]:
    """Edges that join what ``linked`` (left by right) joins, fewer than nodes."""
    none = len(left)
    rows, cols = np.arange(none), np.full(len(right), none)
    while True:
        new_cols = np.where(linked, rows[:, None], none).min(axis=0, initial=none)
        new_rows = np.minimum(rows, np.where(linked, new_cols[None, :], none).min(axis=1, initial=none))
        if (new_cols == cols).all() and (new_rows == rows).all():
            break
        rows, cols = new_rows, new_cols
    out = [(left[i], left[r]) for i, r in enumerate(rows.tolist()) if i != r]
    return out + [(right[j], left[r]) for j, r in enumerate(cols.tolist()) if r < none and right[j] != left[r]]


def count_links(classes: DataFrame, members: DataFrame, threshold: float) -> DataFrame:
    """(node, links, other): each node's number of links within its group (members: node, group), by the rows that the
    others stand for, and, with no number, the edges of forests that span the links."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[list[int], np.ndarray, np.ndarray]] = []  # blocks of the side that comes first
        pair = None
        for key, nodes, x, n in _weighted(batches):
            counted, links, edges = [], [], []
            if pair != key[:3]:
                pair, held = key[:3], []
            a, b, own = key[1:]
            for other, y, m in held:
                linked = x @ y.T >= threshold
                if linked.any():
                    counted += nodes + other
                    links += (linked @ m).tolist() + (n @ linked).tolist()
                    edges += _forest(linked, nodes, other)
            if a == b:
                linked = x @ x.T >= threshold
                np.fill_diagonal(linked, False)
                counted += nodes
                links += (linked @ n).tolist()
                edges += _forest(linked, nodes, nodes)
            if own == a:
                held.append((nodes, x, n))
            ends = list(zip(*edges, strict=True)) or [(), ()]
            cols = [counted + list(ends[0]), links + [None] * len(edges), [None] * len(counted) + list(ends[1])]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["node", "links", "other"])

    found = in_block_pairs(members, classes, ["n"]).mapInArrow(count, "node long, links long, other long")
    return materialize(found, "vector-links")


def by_label(classes: DataFrame) -> DataFrame:
    """(node, group): one group for each label and length."""
    first = classes.groupBy("label", "dim").agg(F.min("node").alias("group"), F.count("*").alias("n"))
    return join_hot(classes.select("node", "label", "dim"), materialize(first, "vector-labels"), ["label", "dim"]).select("node", "group")


def leader_links(classes: DataFrame, lists: DataFrame, members: DataFrame, threshold: float, k_most: int) -> DataFrame | None:
    """(src, dst): groups that links which full lists have lost may join; nothing if no list is full."""
    links = lists.where(F.col("sim") >= threshold).select("node", "other")
    full = links.groupBy("node").agg(F.count("*").alias("n"), F.min_by("other", F.xxhash64("other")).alias("first")).where(F.col("n") >= k_most)
    leader = F.when(F.xxhash64("first") < F.xxhash64("node"), F.col("first")).otherwise(F.col("node"))
    leaders = materialize(full.select(leader.alias("node")).distinct(), "vector-leaders")
    if not leaders.head(1):
        return None
    wide = math.cos(min(math.pi, 3 * math.acos(threshold)))
    at = leaders.join(by_label(classes), "node")
    homes = classes.join(members.withColumnRenamed("group", "home"), "node")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[list[int], np.ndarray, np.ndarray]] = []
        pair = None
        for key, nodes, x, home in _weighted(batches):
            out: set[tuple[int, int]] = set()
            if pair != key[:3]:
                pair, held = key[:3], []
            a, b, own = key[1:]
            for _, y, theirs in held + ([(nodes, x, home)] if a == b else []):
                i, j = np.nonzero((x @ y.T >= wide) & (home[:, None] != theirs[None, :]))
                out |= set(zip(home[i].tolist(), theirs[j].tolist(), strict=True))
            if own == a:
                held.append((nodes, x, home))
            ends = list(zip(*out, strict=True)) or [(), ()]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in ends], ["src", "dst"])

    found = in_block_pairs(at, homes, ["home"]).mapInArrow(compare, "src long, dst long")
    return materialize(found.distinct(), "vector-leader-links")


def _weighted(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, list[int], np.ndarray, np.ndarray]]:
    key, nodes, parts, weights = None, [], [], []
    for now, part in _runs(batches, 4):
        if key is not None and (now != key or len(nodes) >= BLOCK):
            yield key, nodes, np.concatenate(parts), np.concatenate(weights)
            nodes, parts, weights = [], [], []
        key = now
        nodes += part.column(4).to_pylist()
        parts.append(_vectors(part.column(5)))
        weights.append(part.column(6).to_numpy())
    if key is not None:
        yield key, nodes, np.concatenate(parts), np.concatenate(weights)


def audited(classes: DataFrame, counted: DataFrame, threshold: float) -> float | None:
    """The share of the audit nodes' links, found by comparing them with all nodes, that were counted.

    Nodes are taken until they have ``AUDIT_LINKS`` links, at most ``AUDIT_MOST`` of them; None if they have none at all.
    """
    real = got = taken = 0
    while taken < AUDIT_MOST and real < AUDIT_LINKS:
        size = min(max(AUDIT, taken), AUDIT_MOST - taken)
        chosen = classes.orderBy(F.xxhash64(F.lit("audit"), "node"), "node").limit(taken + size).select("node", "label", "dim", "unit").collect()[taken:]
        if not chosen:
            break
        taken += len(chosen)
        links = _audit(classes, counted, threshold, chosen)
        real, got = real + links[0], got + links[1]
    return got / real if real else None


def _audit(classes: DataFrame, counted: DataFrame, threshold: float, chosen: list[Row]) -> tuple[int, int]:
    """(links, those that were counted) of some nodes."""
    groups: dict[tuple[int, int], tuple[list[int], np.ndarray]] = {}
    for r in chosen:
        groups.setdefault((r.label, r.dim), ([], []))[0].append(r.node)  # type: ignore[arg-type]
        groups[r.label, r.dim][1].append(r.unit)  # type: ignore[union-attr]
    shared = classes.sparkSession.sparkContext.broadcast({g: (ids, np.array(x)) for g, (ids, x) in groups.items()})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, int] = {}
        for batch in batches:
            label, dim = batch.column("label").to_numpy(), batch.column("dim").to_numpy()
            for (lab, d), (ids, x) in shared.value.items():
                at = np.flatnonzero((label == lab) & (dim == d))
                part = batch.take(pa.array(at))
                for i in range(0, len(at), BLOCK):
                    piece = part.slice(i, BLOCK)
                    linked = _vectors(piece.column("unit")) @ x.T >= threshold
                    linked &= piece.column("node").to_numpy()[:, None] != np.array(ids)[None, :]
                    for node, n in zip(ids, (piece.column("n").to_numpy() @ linked).tolist(), strict=True):
                        total[node] = total.get(node, 0) + n
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int64()), pa.array(list(total.values()), pa.int64())], ["node", "real"])

    real = classes.mapInArrow(run, "node long, real long").groupBy("node").agg(F.sum("real").alias("real"))
    got = real.join(counted, "node", "left").agg(F.sum("real"), F.sum(F.coalesce("links", F.lit(0)))).first()
    return got[0] or 0, got[1] or 0


def _groups(classes: DataFrame, lists: DataFrame, threshold: float, k_most: int) -> DataFrame:
    """(node, group): candidate groups that hold every link whose ends aren't both lost to the lists."""
    edges = lists.where(F.col("sim") >= threshold).select(F.col("node").alias("src"), F.col("other").alias("dst"))
    members = materialize(connected_components(edges).withColumnRenamed("component", "group"), "vector-members")
    more = leader_links(classes, lists, members, threshold, k_most)
    if more is None or not more.head(1):
        return members
    merged = connected_components(more).select(F.col("node").alias("group"), "component")
    sizes = materialize(members.groupBy("group").agg(F.count("*").alias("n")).join(merged, "group", "left"), "vector-merged")
    return materialize(join_hot(members, sizes, ["group"]).select("node", F.coalesce("component", "group").alias("group")), "vector-members")


def near_duplicates(
    rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", threshold: float = THRESHOLD
) -> DataFrame:
    """(vec_id, n_links, component_id, audited): one row for every row given; audited is null where the audit saw no link."""
    rows = rows.select(
        F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("embedding"), F.col(label_col).cast("long").alias("label")
    )
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    usable = F.coalesce(F.col("label").isNotNull() & fine & F.exists("embedding", lambda x: x != 0), F.lit(False))
    classes = unit_classes(rows.where(usable))
    n = classes.count()
    bits, rounds = planned_rounds(n, threshold)
    floor = 2 * threshold**2 - 1
    lists, links, counted, recall = None, -1, None, None
    for attempt in range(RETRIES + 2 if n else 0):
        if attempt <= RETRIES:
            for at in range(attempt * rounds, (attempt + 1) * rounds, AT_ONCE):
                todo = list(range(at, min(at + AT_ONCE, (attempt + 1) * rounds)))
                found = first_neighbours(classes, todo, bits, K, floor)
                lists = _step(nearest_lists(found if lists is None else lists.union(found), threshold, K, K_MOST), lists)
            for _ in range(STEPS):
                before, links = links, lists.where(F.col("sim") >= threshold).count()
                if links <= before * (1 + SLOW) or not links:
                    break
                lists = _step(descend(classes, lists, threshold, K, K_MOST, floor), lists)
            members = _groups(classes, lists, threshold, K_MOST)
        else:  # the graph is not good enough: labels are compared whole
            members = materialize(by_label(classes), "vector-members")
        counted = count_links(classes, members, threshold)
        per = materialize(counted.where("links is not null").groupBy("node").agg(F.sum("links").alias("links")), "vector-counts")
        recall = audited(classes, per, threshold)
        if recall is None or recall >= RECALL:
            break
    own = [F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(recall).cast("double").alias("audited")]
    lone = rows.where(~usable).select("vec_id", *own)
    if not n:
        return lone
    edges = counted.where("links is null").select(F.col("node").alias("src"), F.col("other").alias("dst"))
    named = materialize(connected_components(edges).join(classes.select("node", "first"), "node"), "vector-components")
    least = named.groupBy("component").agg(F.min("first").alias("least"), F.count("*").alias("n"))
    moved = join_hot(named, materialize(least, "vector-least"), ["component"]).select("node", "least")
    told = classes.join(moved, "node", "left").join(per, "node", "left").select(
        "h", "g", "n", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"),
        F.when(F.col("least").isNotNull(), F.col("least")).otherwise(F.col("first")).alias("component_id"),
    )
    named_rows = materialize(rows.where(usable).select("vec_id", *_identity()), "vector-rows")
    out = join_hot(named_rows, materialize(told, "vector-results"), ["h", "g"])
    return out.select("vec_id", "n_links", "component_id", own[-1]).unionByName(lone)


def _step(new: DataFrame, old: DataFrame | None) -> DataFrame:
    out = materialize(new, "vector-lists")
    if old is not None:
        discard(old)
    return out
