"""Mixture-controlled packing: deficit round-robin over source queues fills windows to target token proportions.

1. Every document is encoded, an end id is added, and rows are written with the tokens that precede each in its task
   and source. Sums of each task and source, added up by range, give the place of each document in its source's queue.
2. Round r of the round-robin adds a quantum, the source's share of one window, to each queue's deficit; a queue sends
   as many whole grains of ``GRAIN`` tokens as its deficit holds and carries the rest. Shares are whole numbers of
   2 ** -20, so after r rounds a queue has sent ``min(all, r * share * grains a window // 2 ** 20)`` grains, whatever
   task asks: deficits carry over windows and partitions without a walk through the rounds before. What the queues
   send, round by round and in queue order inside a round, is one stream; windows are its consecutive cuts.
3. A queue that is empty sends no more, and the others go on in their own proportions. The last, incomplete window is
   cut into sequences of powers of two, so nothing is padded.

So while all queues hold tokens a window departs from its targets by at most some grains of each source, and a source
with a share under one grain a window sends a grain every few windows. The ``QUEUES - 1`` sources with the most tokens
have queues of their own, the others share the last one: the driver and each task know the queues' sums only.

Defined cases: null text is the empty text, one end id; null sources are one source; repeated rows are packed each for
itself; a text of any length is encoded whole and cut where its grains end; an empty table gives an empty result;
columns other than id, text and source are not looked at. The order inside a queue is that of tasks and their rows.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossa.plans.materialize import materialize
from glossa.plans.ranges import running_sums

WINDOW, GRAIN, END_ID = 4096, 64, 2
QUEUES = 256
#: A share of 1, in the whole numbers that shares are rounded to; a share is at least 1.
UNIT = 1 << 20
KEPT_WORDS, KEPT_LENGTH = 500_000, 64
#: Unknown words that the library reads as one text.
JOINED = 2000
#: Tokens of rows that leave a task in one batch.
BATCH_TOKENS = 1 << 20
#: The words that the vocabulary's rules make of lower-cased text in plain Latin letters.
NUMBER = "0-9\u00b2\u00b3\u00b9\u00bc-\u00be"
WORD = rf"[^\W_{NUMBER}]+|'(?:s|t|re|ve|m|ll|d)|[{NUMBER}]|(?:[^\w\s]|_)+"
#: Beyond plain Latin letters, normalising and lower-casing are left to the library; so are characters that are white
#: space to Python only, and what may be an added token.
SEPARATORS = re.compile("[\x1c-\x1f]")
OTHER = re.compile("[^\x00-\x1b\x20-\u024f]|<\\|")


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class WordEncoder:
    """Ids of texts by the tokenizers library, which is asked once for each word.

    The vocabulary's rules drop white space, and neither its normaliser nor its pattern reaches across it, so a text's
    ids are those of its words. Ids are packed as little-endian unsigned 16-bit integers.
    """

    def __init__(self, spec: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks are the parallelism
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_str(spec)
        self.library.no_truncation()
        self.library.no_padding()
        if self.library.get_vocab_size() > 1 << 16:
            raise ValueError("ids must fit 16 bits")
        self.ends = np.zeros(1 << 16, bool)
        self.ends[[i for t, i in self.library.get_vocab().items() if t.endswith("</w>")]] = True
        self.words = re.compile(WORD).findall
        self.kept: dict[str, bytes] = {}
        self.others: set[str] = set()

    def _ask(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u2").tobytes() for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _ask_words(self, words: list[str]) -> list[bytes]:
        """Ids of single words, read as one text and cut where words end."""
        ids = np.frombuffer(self._ask([" ".join(words)])[0], "<u2")
        ends = np.flatnonzero(self.ends[ids]) + 1
        if len(ends) != len(words):
            return self._ask(words)
        raw, cuts = ids.tobytes(), [0, *(2 * ends).tolist()]
        return [raw[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]

    def _split(self, text: str | None) -> list[str]:
        if not text:
            return []
        if not OTHER.search(text):
            return self.words(text.lower())
        out: list[str] = []
        for part in [text] if SEPARATORS.search(text) else text.split():
            if OTHER.search(part):
                self.others.add(part)
                out.append(part)
            else:
                out += self.words(part.lower())
        return out

    def encode(self, texts: list[str | None]) -> list[bytes]:
        if len(self.kept) > KEPT_WORDS:
            self.kept.clear()
        split, kept = [self._split(t) for t in texts], self.kept
        unknown = {w for words in split for w in words if w not in kept}
        plain, rest = list(unknown - self.others), list(unknown & self.others)
        self.others.clear()
        for at in range(0, len(plain), JOINED):
            part = plain[at : at + JOINED]
            kept.update(zip(part, self._ask_words(part), strict=True))
        kept.update(zip(rest, self._ask(rest), strict=True))
        out = [b"".join(map(kept.__getitem__, words)) for words in split]
        for w in unknown:
            if len(w) > KEPT_LENGTH:
                del kept[w]
        return out


def encode(docs: DataFrame, id_col: str, text_col: str, source_col: str, tokenizer: str | None) -> DataFrame:
    """(id, source, part, start, n, ids): one written row per document; start counts the source's tokens before it in its task.

    n counts the end id, which ids (unsigned 16-bit) leave out. The tokenizer file (a few MB) is read by the driver and broadcast.
    """
    with open(tokenizer or default_path(), encoding="utf-8") as f:
        spec = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, before, part = WordEncoder(spec.value), {}, TaskContext.get().partitionId()
        for batch in batches:
            texts, at = batch.column("text").to_pylist(), 0
            sizes = np.cumsum([len(t or "") + 1 for t in texts])
            while at < len(texts):
                upto = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + 4 * BATCH_TOKENS)))
                ids = encoder.encode(texts[at:upto])
                n = [len(i) // 2 + 1 for i in ids]
                starts = []
                for source, size in zip(batch.column("source").slice(at, upto - at).to_pylist(), n, strict=True):
                    starts.append(before.get(source, 0))
                    before[source] = starts[-1] + size
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("id").slice(at, upto - at), batch.column("source").slice(at, upto - at),
                        pa.array([part] * len(ids), pa.int32()), pa.array(starts, pa.int64()), pa.array(n, pa.int64()),
                        pa.array(ids, pa.binary()),
                    ],
                    ["id", "source", "part", "start", "n", "ids"],
                )
                at = upto

    rows = docs.select(
        F.col(id_col).cast("long").alias("id"), F.col(source_col).cast("string").alias("source"), F.col(text_col).cast("string").alias("text")
    )
    return materialize(rows.mapInArrow(run, "id long, source string, part int, start long, n long, ids binary"), "packing-tokens")


class RoundRobin:
    """What each queue has sent after any number of rounds, and so the place of every token in the stream.

    ``tokens`` are the queues' sizes, ``shares`` their parts of a window (any scale).
    """

    def __init__(self, tokens: list[int], shares: list[float], window: int = WINDOW, grain: int = GRAIN) -> None:
        self.window, self.grain = window, grain
        self.tokens = np.array(tokens, np.int64)
        whole = np.array(shares, float)
        self.share = np.maximum(1, np.rint(whole / (whole.sum() or 1) * UNIT)).astype(np.int64)
        self.per_round = window // grain
        self.grains = -(-self.tokens // grain)
        self.last_round = -(-(self.grains * UNIT) // (self.share * self.per_round))
        total = int(self.tokens.sum())
        self.full = total // window
        rest = total - self.full * window
        tail = [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]
        #: Where the sequences after the full windows start, and where the last ends.
        self.tail = self.full * window + np.concatenate(([0], np.cumsum(tail))).astype(np.int64)

    def sent(self, rounds: np.ndarray, queue: int | np.ndarray | slice = slice(None)) -> np.ndarray:
        """Grains sent by ``queue`` (or by each, one column a queue) in the first ``rounds`` rounds."""
        if isinstance(queue, slice):
            rounds = rounds[:, None]
        done = np.minimum(rounds, self.last_round[queue]) * (self.share[queue] * self.per_round) // UNIT
        return np.minimum(self.grains[queue], done)

    def deficit(self, rounds: int) -> np.ndarray:
        """Tokens (as a fraction) that each queue carries after ``rounds`` rounds; an empty queue carries none."""
        earned = rounds * self.share * self.per_round
        carried = (earned - self.sent(np.array([rounds]))[0] * UNIT) / UNIT * self.grain
        return np.where(rounds >= self.last_round, 0.0, carried)

    def rounds(self, queue: np.ndarray, grain: np.ndarray) -> np.ndarray:
        """The round (from 1) that sends a queue's grain."""
        return -(-(grain + 1) * UNIT // (self.share[queue] * self.per_round))

    def places(self, queue: np.ndarray, grain: np.ndarray, rounds: np.ndarray) -> np.ndarray:
        """The stream position of the first token of each grain."""
        known, at = np.unique(rounds, return_inverse=True)
        before, after = (np.minimum(self.tokens, self.sent(r) * self.grain) for r in (known - 1, known))
        ahead = np.cumsum(after - before, axis=1) - (after - before)
        start = before.sum(axis=1)[:, None] + ahead
        return start[at, queue] + (grain - self.sent(rounds - 1, queue)) * self.grain

    def sequence_of(self, place: np.ndarray) -> np.ndarray:
        late = self.full + np.searchsorted(self.tail, place, side="right") - 1
        return np.where(place < self.tail[0], place // self.window, late)

    def sequence_start(self, sequence: np.ndarray) -> np.ndarray:
        late = self.tail[np.clip(sequence - self.full, 0, len(self.tail) - 1)]
        return np.where(sequence < self.full, sequence * self.window, late)

    def cut(self, queue: np.ndarray, start: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, ...]:
        """(row, start in the document, length, sequence, offset) of the pieces of documents at ``start`` of their queues."""
        first, count = start // self.grain, (start + n - 1) // self.grain - start // self.grain + 1
        row = np.repeat(np.arange(len(n)), count)
        grain = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + first[row]
        rounds = self.rounds(queue[row], grain)
        new = np.ones(len(row), bool)
        new[1:] = (row[1:] != row[:-1]) | (rounds[1:] != rounds[:-1])
        at = np.flatnonzero(new)
        stop = np.append(at[1:], len(row)) - 1
        row_, a = row[at], np.maximum(start[row[at]], grain[at] * self.grain)
        b = np.minimum(start[row_] + n[row_], (grain[stop] + 1) * self.grain)
        place = self.places(queue[row_], grain[at], rounds[at]) + a - grain[at] * self.grain
        # what no other queue comes between stays in one piece
        joined = np.zeros(len(at), bool)
        joined[1:] = (row_[1:] == row_[:-1]) & (place[1:] == place[:-1] + (b - a)[:-1])
        keep = np.flatnonzero(~joined)
        b = b[np.append(keep[1:], len(at)) - 1] if len(keep) else b[:0]
        row_, a, place = row_[keep], a[keep], place[keep]
        low, high = self.sequence_of(place), self.sequence_of(place + (b - a) - 1)
        spans = high - low + 1
        piece = np.repeat(np.arange(len(row_)), spans)
        sequence = np.arange(spans.sum()) - np.repeat(np.cumsum(spans) - spans, spans) + low[piece]
        opens = self.sequence_start(sequence)
        left = np.maximum(place[piece], opens)
        right = np.minimum((place + b - a)[piece], self.sequence_start(sequence + 1))
        return row_[piece], (a - start[row_])[piece] + left - place[piece], right - left, sequence, left - opens


def shares_of(tokens: Mapping[str | None, int], targets: Mapping[str | None, float] | None) -> dict[str | None, float]:
    """Each source's share of a window: its target, or of what the targets leave, its part by tokens."""
    targets = {s: v for s, v in (targets or {}).items() if s in tokens}
    left = max(0.0, 1.0 - sum(targets.values())) if targets else 1.0
    rest = sum(n for s, n in tokens.items() if s not in targets) or 1
    return {s: targets[s] if s in targets else left * n / rest for s, n in tokens.items()}


def pack(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
    targets: Mapping[str | None, float] | None = None, tokenizer: str | None = None,
    window: int = WINDOW, grain: int = GRAIN, queues: int = QUEUES,
) -> DataFrame:
    """One row per piece: id, source, start, length, ids (unsigned 32-bit), doc_tokens, sequence_id, offset.

    ``targets`` gives shares of a window by source, by default the corpus' own; ``window`` is a multiple of ``grain``.
    """
    spark = docs.sparkSession
    rows = encode(docs, id_col, text_col, source_col, tokenizer)
    sums = materialize(rows.groupBy("source", "part").agg(F.sum("n").alias("n")), "packing-sums")
    largest = sums.groupBy("source").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), F.asc_nulls_first("source"))
    own = {r.source: r.n for r in largest.limit(queues - 1).collect()}
    total = sums.agg(F.sum("n")).first()[0] or 0
    rest = total - sum(own.values())
    tokens, shares = [*own.values(), rest], shares_of(own | ({_REST: rest} if rest else {}), targets)
    robin = RoundRobin(tokens, [*[shares[s] for s in own], shares.get(_REST, 0.0)], window, grain)
    names = spark.createDataFrame([(i, s) for i, s in enumerate(own)], "queue int, name string")
    told = sums.join(F.broadcast(names), sums["source"].eqNullSafe(names["name"]), "left").drop("name")
    told = told.withColumn("queue", F.coalesce("queue", F.lit(len(own))))
    opens = np.concatenate(([0], np.cumsum(tokens)[:-1])).tolist()
    begin = F.element_at(F.array(*[F.lit(int(o)).cast("long") for o in opens]), F.col("queue") + 1)
    bases = running_sums(told, ["n"], "queue", "source", "part").select(
        F.col("source").alias("_source"), F.col("part").alias("_part"), "queue", (F.col("upto_n") - F.col("n") - begin).alias("base")
    )
    placed = rows.join(bases, rows["source"].eqNullSafe(bases["_source"]) & (rows["part"] == bases["_part"]))
    placed = placed.select("id", "source", "n", "ids", "queue", (F.col("base") + F.col("start")).alias("start"))
    known = spark.sparkContext.broadcast(robin)
    return placed.mapInArrow(
        _pieces(known), "id long, source string, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
    )


_REST = "\x00rest"


def _pieces(known):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        robin: RoundRobin = known.value
        for batch in batches:
            queue, start, n = (batch.column(c).to_numpy().astype(np.int64) for c in ("queue", "start", "n"))
            whole, at = np.cumsum(n), 0
            while at < len(n):
                upto = max(at + 1, int(np.searchsorted(whole, (whole[at - 1] if at else 0) + BATCH_TOKENS)))
                row, begin, length, sequence, offset = robin.cut(queue[at:upto], start[at:upto], n[at:upto])
                packed = [np.append(np.frombuffer(i.as_py(), "<u2"), END_ID).astype("<u4").tobytes() for i in batch.column("ids").slice(at, upto - at)]
                ids = [packed[r][4 * a : 4 * (a + k)] for r, a, k in zip(row.tolist(), begin.tolist(), length.tolist(), strict=True)]
                take = pa.array(row + at)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("id").take(take), batch.column("source").take(take), pa.array(begin), pa.array(length),
                        pa.array(ids, pa.binary()), pa.array(n[at + row]), pa.array(sequence), pa.array(offset),
                    ],
                    ["id", "source", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"],
                )
                at = upto

    return run


def sequences(pieces: DataFrame) -> DataFrame:
    """(sequence_id, n_tokens, ids, parts): each sequence's ids in order, and where each document's piece lies in it.

    A sequence holds at most a window of tokens, so the group that is gathered is bounded.
    """
    part = F.struct("offset", "id", "source", "start", "length", "ids")
    got = pieces.groupBy("sequence_id").agg(F.array_sort(F.collect_list(part)).alias("parts"), F.sum("length").alias("n_tokens"))
    ids = F.unhex(F.array_join(F.transform("parts", lambda p: F.hex(p["ids"])), ""))
    return got.select("sequence_id", "n_tokens", ids.alias("ids"), F.transform("parts", lambda p: p.dropFields("ids")).alias("parts"))


def mixture(pieces: DataFrame) -> DataFrame:
    """(sequence_id, source, tokens, share) of each sequence's tokens."""
    got = pieces.groupBy("sequence_id", "source").agg(F.sum("length").alias("tokens"))
    whole = pieces.groupBy("sequence_id").agg(F.sum("length").alias("all_tokens"))
    return got.join(whole, "sequence_id").select("sequence_id", "source", "tokens", (F.col("tokens") / F.col("all_tokens")).alias("share"))
