import random
import struct
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from glossa.llm import packing as P
from glossa.llm import queries

SPEC = open(P.default_path(), encoding="utf-8").read()
LIB = Tokenizer.from_str(SPEC)
OWN = P.WordEncoder(SPEC)
CASES = [
    None, "", " ", "\n\t ", "Hello World's  END ", "ÀÉ ciónñ é́ É", "a" * 5000, "x y " * 3000, "<|endoftext|>", "a<|endoftext|> b<|startoftext|>c",
    "a\x1cb \x1d c", "a\x85b\xa0c d e f　g", "́ ́a é", "ΑΣ ΌΣΟΣ Σ İI", "日本語 😀👩‍👩‍👧", "don't we'll 123 4.5%%",
    "ᅠᅡ 각", "\x00\x0b\x0c z",
]


def ids_of(text):
    return LIB.encode(text or "", add_special_tokens=False).ids


def unpack(raw):
    return np.frombuffer(raw, "<u2").tolist()


def test_words_give_the_ids_of_the_text():
    assert [unpack(i) for i in OWN.encode(CASES)] == [ids_of(t) for t in CASES]


@settings(max_examples=400, deadline=None)
@given(st.text(max_size=60))
def test_any_text(text):
    assert unpack(OWN.encode([text])[0]) == ids_of(text)


def simulate(tokens, share, per_round, grain, unit):
    """The round-robin walked round by round: (queue, token) in the order of the stream."""
    deficit, sent, out = [0] * len(tokens), [0] * len(tokens), []
    while any(s < t for s, t in zip(sent, tokens, strict=True)):
        for q, t in enumerate(tokens):
            if sent[q] >= t:
                continue
            deficit[q] += share[q] * per_round
            while deficit[q] >= unit and sent[q] < t:
                deficit[q] -= unit
                for _ in range(min(grain, t - sent[q])):
                    out.append((q, sent[q]))
                    sent[q] += 1
    return out


@pytest.mark.parametrize("seed", range(12))
def test_places_equal_a_walk_through_the_rounds(seed):
    rng = random.Random(seed)
    tokens = [rng.choice([0, 1, 7, 8, 63, 500, 3000]) for _ in range(rng.randrange(1, 7))]
    shares = [rng.choice([0.001, 0.1, 1, 5]) for _ in tokens]
    robin = P.RoundRobin(tokens, shares, 64, 8)
    stream = simulate(tokens, robin.share.tolist(), 8, 8, P.UNIT)
    assert len(stream) == sum(tokens)
    docs = []
    for q, t in enumerate(tokens):
        at = 0
        while at < t:
            n = min(t - at, rng.randrange(1, 200))
            docs.append((q, at, n))
            at += n
    rng.shuffle(docs)
    got = {}
    if docs:
        for row, start, length, seq, offset in zip(*[a.tolist() for a in robin.cut(*np.array(docs).T)], strict=True):
            q, at, _ = docs[row]
            for i in range(length):
                got[seq, offset + i] = (q, at + start + i)
    assert [got[k] for k in sorted(got)] == stream
    sizes = defaultdict(int)
    for seq, _ in got:
        sizes[seq] += 1
    full = len(stream) // 64
    assert [sizes[s] for s in range(full)] == [64] * full
    assert all(n & (n - 1) == 0 for s, n in sizes.items() if s >= full) and sorted(sizes) == list(range(len(sizes)))


def test_deficits_are_what_the_walk_carries():
    robin = P.RoundRobin([10_000, 4_000, 300], [5, 3, 0.2], 64, 8)
    for r in (1, 3, 50):
        sent = robin.sent(np.array([r]))[0]
        for q in range(3):
            earned = r * int(robin.share[q]) * 8
            want = 0 if r >= robin.last_round[q] else (earned - int(sent[q]) * P.UNIT) / P.UNIT * 8
            assert robin.deficit(r)[q] == pytest.approx(want) and 0 <= robin.deficit(r)[q] < 8


def check(docs, pieces, window=P.WINDOW):
    """Every id once, sequences without gaps, nothing padded."""
    want = defaultdict(int)
    for i, t, s in docs:
        want[i, s, tuple([*ids_of(t), P.END_ID])] += 1
    held, sequences = defaultdict(list), defaultdict(list)
    for p in pieces:
        held[p.id, p.source].append(p)
        sequences[p.sequence_id].append((p.offset, p.length))
        assert len(p.ids) == 4 * p.length > 0
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at == window or at & (at - 1) == 0 and at < window
    assert sorted(sequences) == list(range(len(sequences)))
    assert sum(p.length for p in pieces) == sum(len(k[2]) * n for k, n in want.items())
    return held, want


def test_table(spark):
    rng = random.Random(1)
    words = "alpha beta gamma delta naïve über".split()
    docs = [(i, " ".join(rng.choices(words, k=rng.randrange(400))), rng.choice(["a", "a", "b", None])) for i in range(200)]
    docs += [(300 + i, t, "c") for i, t in enumerate(CASES)] + [(999, "x y z " * 4000, "d"), (None, "no id", "d")]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string").selectExpr("*", "1 as ids", "2 as queue", "3 as part", "4 as n")
    got = P.pack(df.repartition(5)).collect()
    held, want = check(docs, got)
    for (i, s, ids), n in want.items():
        parts = sorted(held[i, s], key=lambda p: p.start)
        assert n == 1 and {p.doc_tokens for p in parts} == {len(ids)}
        assert b"".join(p.ids for p in parts) == struct.pack(f"<{len(ids)}I", *ids)
        assert [p.start for p in parts] == np.cumsum([0, *[p.length for p in parts[:-1]]]).tolist()
    assert P.pack(df.limit(0)).count() == 0


def test_repeated_rows_and_many_sources(spark):
    docs = [(5, "same text here", "s")] * 300 + [(i, "other words", f"src{i}") for i in range(60)]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string").repartition(4)
    got = P.pack(df, queues=8).collect()
    _, want = check(docs, got)
    assert sum(p.start == 0 for p in got) == 360


def test_windows_keep_the_targets(spark):
    docs = [(i, "one two three four five six seven eight " * 20, "big" if i % 4 else "small") for i in range(1200)]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string").repartition(7)
    for targets, share in ((None, 0.25), ({"small": 0.5}, 0.5)):
        pieces = P.pack(df, targets=targets)
        seen = {(r.sequence_id, r.source): r.share for r in P.mixture(pieces).collect()}
        last = max(s for s, source in seen if source == "small")
        # as long as the small source lasts, each window is within two grains of its target
        full = pieces.agg({"length": "sum"}).first()[0] // P.WINDOW
        assert last > 20
        for s in range(min(last, full)):
            assert abs(seen[s, "small"] - share) <= 2 * P.GRAIN / P.WINDOW
        whole = P.sequences(pieces).collect()
        assert all(len(r.ids) == 4 * r.n_tokens and sum(p.length for p in r.parts) == r.n_tokens for r in whole)


def test_query(spark, sf):
    got = queries.op11_mixture_packing(spark, sf).collect()
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    import zlib

    ids = {r.doc_id: [*ids_of(r.text), P.END_ID] for r in docs}
    covered = defaultdict(int)
    for p in got:
        raw = struct.pack(f"<{p.length}I", *ids[p.doc_id][p.start : p.start + p.length])
        assert p.ids_crc32 == zlib.crc32(raw) and p.doc_tokens == len(ids[p.doc_id])
        covered[p.doc_id] += p.length
    assert covered == {k: len(v) for k, v in ids.items()}
