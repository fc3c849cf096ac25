"""SimHash near copies by similarity: texts whose five-word shingle sets have a Jaccard similarity of 0.8 or more link.

1. Texts of the same ASCII-lower-cased words are one class (64-bit hash of the words); classes are the nodes. Each has a
   64-bit SimHash of its distinct shingles.
2. Shards: equal bits of a SimHash say too little at this similarity (a pair at 0.8 differs in 10 of 64 bits on average),
   so shards are dealt by ``BANDS`` min-hash keys of ``WIDTH`` minima each. A pair at ``SIMILARITY`` shares a shard with
   probability 1 - (1 - 0.8 ** 5) ** 24 = 0.99993, and a more similar pair with a higher one.
3. Chains: the members of a shard are sorted, by SimHash and then by a hash, and neighbours within ``RADIUS`` bits are
   compared. Sorted ranges may cut a shard anywhere, so no shard is gathered, and copies of one text soon hang together.
4. BK-trees: a shard whose members still lie in different components grows operator 6's tree keyed by Hamming distance,
   level by level in arrays; members look up what is within ``RADIUS`` bits (99.99 % of pairs at ``SIMILARITY``), of a
   fitting size and in another component. A shard of over ``SHARD_MAX`` members is cut into blocks, and each pair of
   blocks is a task of its own: a tree of the one, looked up by the other. What a tree finds must also agree by sketch,
   the ``SKETCH`` least shingles: sets of fewer are known whole, and of larger ones the share of common values is an
   estimate, of which ``SLACK`` deviations are allowed (4.5: a pair at ``SIMILARITY`` passes but for 4e-6).
5. Every candidate of 3 and 4 is verified on the two shingle sets before it counts.

Defined cases: null or blank text is one class, linked with nothing else; fewer than five words form one shingle; rows
are known by their id and their own text, as in ``simhash``; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from glossa.llm.rows import batches_of, keep_rows, text_key
from glossa.llm.simhash import LevelTree, first_rows, named_groups
from glossa.plans.components import connected_components
from glossa.plans.materialize import discard, materialize
from glossa.plans.skew import join_hot

SHINGLE, SIMILARITY, RADIUS, SHARD_MAX = 5, 0.8, 24, 2048
BANDS, WIDTH, SEED = 24, 5, 7
SKETCH, SLACK = 256, 4.5
#: Members that walk down a tree together.
ROWS = 128
CHUNK, KEPT, HOT_TEXTS, BATCH = 2048, 100_000, 64, 500
_MULTIPLIERS = np.array([xxh64_intdigest(f"shingle {i}") | 1 for i in range(SHINGLE)], np.uint64)
_LENGTHS = np.array([xxh64_intdigest(f"words {i}") for i in range(SHINGLE + 1)], np.uint64)
_DRAWS = np.random.default_rng(SEED).integers(0, 1 << 63, (3, BANDS * WIDTH), np.uint64) * np.uint64(2) + np.uint64(1)
_MIX = np.uint64(xxh64_intdigest("mix") | 1)
_NONE = np.uint32(0xFFFFFFFF)


class Words(dict):
    """Hash of each word, kept up to ``KEPT`` words."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > KEPT:
            self.clear()
        got = self[word] = xxh64_intdigest(word)
        return got

    def of(self, text: str | None) -> tuple[int, np.ndarray]:
        """(class, distinct shingles) of one text."""
        words = (text or "").encode("utf-8", "replace").lower().split()
        if not words:
            return 0, np.zeros(0, np.uint64)
        hashes = np.fromiter(map(self.__getitem__, words), np.uint64, len(words))
        k = min(SHINGLE, len(words))
        n = len(words) - k + 1
        out = np.full(n, _LENGTHS[k], np.uint64)
        for i in range(k):
            out += hashes[i : i + n] * _MULTIPLIERS[i]
        return xxh64_intdigest(hashes.tobytes()), np.unique(out)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def simhash(shingles: np.ndarray) -> int:
    """Signed SimHash of a set of shingles: a bit is set where more than half of them set it."""
    mixed = (shingles ^ (shingles >> np.uint64(32))) * _MIX
    mixed ^= mixed >> np.uint64(29)
    counts = np.zeros(64, np.int64)
    for at in range(0, len(mixed), CHUNK):
        counts += np.unpackbits(mixed[at : at + CHUNK].view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > len(mixed)).tobytes(), "big", signed=True)


def band_keys(shingles: np.ndarray) -> np.ndarray:
    """``BANDS`` signed keys of one shingle set."""
    least = np.full(BANDS * WIDTH, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(shingles), CHUNK):
        part = shingles[at : at + CHUNK, None] * _DRAWS[0] + _DRAWS[1]
        least = np.minimum(least, part.min(axis=0))
    return ((least * _DRAWS[2]).reshape(BANDS, WIDTH).sum(axis=1, dtype=np.uint64)).view(np.int64)


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two sets of distinct values."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both) if both else 0.0


def sketch(shingles: np.ndarray) -> np.ndarray:
    """High halves of the ``SKETCH`` least of sorted shingles; ``_NONE`` fills the slots of a smaller set."""
    out = np.full(SKETCH, _NONE, np.uint32)
    least = shingles[:SKETCH] >> np.uint64(32)
    out[: len(least)] = np.minimum(least, _NONE - 1)
    return out


def may_be_similar(one: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Whether a sketch allows ``SIMILARITY`` with each row of a matrix of sketches."""
    known = np.minimum(one[-1], others[:, -1])  # both sets are known up to this value
    limit = np.minimum(known, _NONE - 1)
    at = np.minimum(np.searchsorted(one, others), SKETCH - 1)
    both = ((one[at] == others) & (others != _NONE)).sum(axis=1)
    either = np.searchsorted(one, limit, "right") + (others <= limit[:, None]).sum(axis=1) - both
    slack = np.where(known == _NONE, 0, SLACK * np.sqrt(SIMILARITY * (1 - SIMILARITY) * either))
    return both + slack + 1 >= SIMILARITY * either  # 1: high halves of two shingles may be equal


def _sketch_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    words = Words()
    for batch in batches:
        got = pa.array([sketch(words.of(t.as_py())[1]).tobytes() for t in batch.column(1)], pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column(0), got], ["fp", "sketch"])


def _digest_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    words = Words()
    for batch in batches:
        classes, sims, sizes, bands = [], [], [], []
        for text in batch.column("text"):
            cls, shingles = words.of(text.as_py())
            classes.append(_signed(cls))
            sims.append(simhash(shingles))
            sizes.append(len(shingles))
            bands.append(band_keys(shingles) if len(shingles) else np.zeros(0, np.int64))
        got = pa.array(classes, pa.int64()), pa.array(sims, pa.int64()), pa.array(sizes, pa.int64()), pa.array(bands, pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([*batch.columns, *got], [*batch.schema.names, "fp", "sim", "size", "bands"])


def _fit(n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Whether sizes allow the similarity."""
    return np.minimum(n, m) >= SIMILARITY * np.maximum(n, m)


def _pairs(src: list, dst: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(src, pa.int64()), pa.array(dst, pa.int64())], ["src", "dst"])


def _shared_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of sorted (.., band, key), the rows beside one of their band and key; the ends of a range, whose neighbours are elsewhere, stay."""
    held, before = None, True
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = batch if held is None else pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
        band, key = (rows.column(c).to_numpy() for c in ("band", "key"))
        same = (band[1:] == band[:-1]) & (key[1:] == key[:-1])
        beside = np.append(before, same)
        yield rows.slice(0, len(same)).filter(pa.array(beside[:-1] | same))
        held, before = rows.slice(len(same)), beside[-1]
    if held is not None:
        yield held


def _chain_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over sorted (band, key, fp, sim, size): neighbours of one shard that may be similar."""
    last = None
    for batch in batches:
        cols = [c.to_numpy(zero_copy_only=False) for c in batch.columns[:5]]
        if last is not None:
            cols = [np.append(a, c) for a, c in zip(last, cols, strict=True)]
        last = [c[-1:] for c in cols]
        band, key, fp, sim, size = cols
        same = (band[1:] == band[:-1]) & (key[1:] == key[:-1]) & (np.bitwise_count((sim[1:] ^ sim[:-1]).view(np.uint64)) <= RADIUS) & _fit(size[1:], size[:-1])
        at = np.flatnonzero(same)
        yield _pairs(fp[at], fp[at + 1])


def _candidates(shard: list[int], members: tuple[np.ndarray, ...]) -> pa.RecordBatch:
    """Members of a shard's two blocks, or of its one, that lie in different components and may be similar, by a BK-tree of the first."""
    own, fp, sim, size, component, sketches = members
    one, other = (np.flatnonzero(own == b) for b in shard[2:])
    src, dst = [], []
    _, first, value = np.unique(sim[one], return_index=True, return_inverse=True)
    place = np.argsort(np.argsort(first))  # values in the order of their first members
    tree, node = LevelTree(sim[one][np.sort(first)]), place[value]
    for at in range(0, len(other), ROWS):
        rows = other[at : at + ROWS]
        may = tree.near(sim[rows], RADIUS)[:, node] & _fit(size[rows][:, None], size[one][None, :])
        may &= component[rows][:, None] != component[one][None, :]
        if shard[2] == shard[3]:
            may &= one[None, :] < rows[:, None]
        for i in np.flatnonzero(may.any(axis=1)).tolist():
            near = one[may[i]]
            near = near[may_be_similar(sketches[rows[i]], sketches[near])]
            src.append(np.full(len(near), fp[rows[i]]))
            dst.append(fp[near])
    return _pairs(np.concatenate(src) if src else [], np.concatenate(dst) if dst else [])


def _block_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over (band, key, a, b, own, fp, sim, size, component, sketch) sorted by shard and blocks: candidates of each pair of blocks."""
    shard, held = None, []

    def done() -> pa.RecordBatch:
        return _candidates(shard, tuple(np.concatenate(c) for c in zip(*held, strict=True)))

    for batch in batches:
        keys = np.stack([batch.column(i).to_numpy() for i in range(4)], axis=1)
        cuts = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1
        cols = [batch.column(i).to_numpy() for i in range(4, 9)]
        cols.append(np.frombuffer(b"".join(batch.column(9).to_pylist()), np.uint32).reshape(-1, SKETCH))
        for low, high in zip([0, *cuts.tolist()], [*cuts.tolist(), len(keys)], strict=True):
            if low == high:
                continue
            now = keys[low].tolist()
            if now != shard:
                if held:
                    yield done()
                shard, held = now, []
            held.append([c[low:high] for c in cols])
    if held:
        yield done()


def _verify_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    words, last = Words(), (None, None)
    for batch in batches:
        keep = []
        for a, x, y in zip(*(batch.column(i) for i in (0, 2, 3)), strict=True):
            if last[0] != a.as_py():
                last = (a.as_py(), words.of(x.as_py())[1])
            keep.append(similarity(last[1], words.of(y.as_py())[1]) >= SIMILARITY)
        yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))


def _texts(wanted: DataFrame, rows: DataFrame, nodes: DataFrame, name: str) -> DataFrame:
    """(fp, text, n): one text of each class in ``wanted``, and how often the class is there."""
    wanted = wanted.groupBy("fp").agg(F.count("*").alias("times"))
    wanted = materialize(wanted.join(nodes.select("fp", "n"), "fp"), f"{name}-wanted")
    texts = join_hot(rows.select("fp", "text"), wanted, ["fp"]).groupBy("fp").agg(F.first("text").alias("text"), F.first("times").alias("n"))
    texts = materialize(texts, f"{name}-texts")
    discard(wanted)
    return texts


def _verified(pairs: DataFrame, rows: DataFrame, nodes: DataFrame, name: str) -> DataFrame:
    """The (src, dst) of ``pairs`` whose texts are similar."""
    pairs = materialize(pairs.where("src <> dst").select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct(), name)
    texts = _texts(pairs.select(F.explode(F.array("src", "dst")).alias("fp")), rows, nodes, name)
    left = texts.select(F.col("fp").alias("src"), F.col("text").alias("x"), "n")
    right = texts.select(F.col("fp").alias("dst"), F.col("text").alias("y"), "n")
    both = join_hot(join_hot(pairs, right, ["dst"], hot=HOT_TEXTS), left, ["src"], hot=HOT_TEXTS).select("src", "dst", "x", "y")
    with batches_of(rows.sparkSession, BATCH):
        out = materialize(both.mapInArrow(_verify_batches, "src long, dst long"), f"{name}-links")
    for done in (texts, pairs):
        discard(done)
    return out


def chained(keys: DataFrame, order: str) -> DataFrame:
    """(src, dst): neighbours in the order of an expression, shard by shard."""
    rows = keys.select("band", "key", "fp", "sim", "size", F.expr(order).alias("at"))
    sort = ("band", "key", "at", "fp")
    return rows.repartitionByRange(*sort).sortWithinPartitions(*sort).mapInArrow(_chain_batches, "src long, dst long")


def across(keys: DataFrame, linked: DataFrame, rows: DataFrame, nodes: DataFrame, shard_max: int) -> DataFrame:
    """(src, dst): candidates in different components of ``linked`` (node, component), by pairs of blocks of each shard, and sketches."""
    named = keys.join(linked.withColumnRenamed("node", "fp"), "fp", "left")
    named = materialize(named.withColumn("component", F.coalesce("component", "fp")), "copies-named")
    split = named.groupBy("band", "key").agg(F.min("component").alias("a"), F.max("component").alias("b"), F.count("*").alias("n"))
    split = split.where("a <> b").select("band", "key", "n", F.ceil(F.col("n") / shard_max).cast("long").alias("blocks"))
    members = materialize(join_hot(named, materialize(split, "copies-split"), ["band", "key"]), "copies-members")
    texts = _texts(members.select("fp"), rows, nodes, "copies-members")
    with batches_of(rows.sparkSession, BATCH):
        sketches = materialize(texts.select("fp", "text").mapInArrow(_sketch_batches, "fp long, sketch binary"), "copies-sketches")
    discard(texts)
    own = F.pmod(F.xxhash64("fp"), "blocks")
    dealt = members.join(sketches, "fp").withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    dealt = dealt.select(
        "band", "key", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"), "own", "fp", "sim", "size", "component", "sketch"
    )
    dealt = dealt.repartition("band", "key", "a", "b").sortWithinPartitions("band", "key", "a", "b", "own", "fp")
    return dealt.mapInArrow(_block_batches, "src long, dst long")


def _grouped(docs: DataFrame, id_col: str, text_col: str, shard_max: int) -> tuple[DataFrame, DataFrame]:
    """Rows (id, key, text, fp, ..) and groups (fp, n, group, component_id)."""
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), text_key(f"`{text_col}`").alias("key"), F.col(f"`{text_col}`").cast("string").alias("text"))
    schema = "id long, key string, text string, fp long, sim long, size long, bands array<long>"
    with batches_of(docs.sparkSession, BATCH):
        rows = materialize(rows.mapInArrow(_digest_batches, schema), "copies-rows")
    nodes = rows.groupBy("fp").agg(F.min("id").alias("rep"), F.count("*").alias("n"), *[F.first(c).alias(c) for c in ("sim", "size", "bands")])
    nodes = materialize(nodes, "copies-nodes")
    keys = nodes.select("fp", "sim", "size", F.posexplode("bands").alias("band", "key"))
    sort = ("band", "key", "sim", "fp")
    ranged = keys.repartitionByRange(*sort).sortWithinPartitions(*sort)
    keys = materialize(ranged.mapInArrow(_shared_batches, "fp long, sim long, size long, band int, key long"), "copies-keys")
    links = _verified(chained(keys, "sim").union(chained(keys, "xxhash64(fp)")), rows, nodes, "copies-chain")
    linked = materialize(connected_components(links), "copies-linked")
    links = links.union(_verified(across(keys, linked, rows, nodes, shard_max), rows, nodes, "copies-tree"))
    return rows, named_groups(nodes.select("fp", "rep", "n"), links)


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shard_max: int = SHARD_MAX) -> DataFrame:
    """(id, fp, component_id) for every row of ``docs``; fp is the class, component_id the smallest id reachable."""
    rows, groups = _grouped(docs, id_col, text_col, shard_max)
    return join_hot(rows.select("id", "fp"), materialize(groups.drop("group"), "copies-groups"), ["fp"])


def keep_representatives(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shard_max: int = SHARD_MAX) -> DataFrame:
    """One row of each group of near copies, that with its smallest id, with the columns it came with."""
    rows, groups = _grouped(docs, id_col, text_col, shard_max)
    return keep_rows(docs, first_rows(rows.select("id", "key", "fp"), groups), id_col, text_col)
