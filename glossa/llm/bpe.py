"""Byte-pair encoding by backtracking over longest token matches, and decoding through an offset table.

An Aho-Corasick automaton over the vocabulary finds, in one pass, the longest token that starts at each byte of a
pre-token. The encoder takes the longest match, keeps it only if it is compatible with the token before it, else
tries that match's longest proper prefix that is a token, and steps back one token where no prefix is left. A pair
is compatible if encoding its joined bytes by merges would give that very pair; only then do the merges of a whole
text agree with its neighbouring pairs. A position that was given up is never entered again, so the work is linear
in the bytes. Pre-tokens repeat, so each worker keeps a bounded table of those it has encoded.

Decoding gathers token bytes by numpy from one buffer with an offset for each id.

Defined cases: null text is the empty text with no tokens; added tokens in a text (as ``<|endoftext|>``) are one
token, as in the library's default; repeated rows give repeated results; an empty table gives an empty result;
columns other than id and text are not looked at. A text of any length is encoded whole.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The pre-token pattern of byte-level BPE with regular expressions on.
PRETOKEN = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+"
    r"|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
)
KEPT_WORDS, KEPT_PAIRS, KEPT_LENGTH = 400_000, 1_000_000, 64
BATCH_BYTES = 4 << 20


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _byte_alphabet() -> dict[str, int]:
    """The printable character that byte-level vocabularies write for each byte, to that byte."""
    plain = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class _Kept(dict):
    """Pre-token to packed ids; forgets all when full, and never keeps long ones."""

    def __init__(self, make: Callable[[str], bytes], most: int) -> None:
        super().__init__()
        self.make, self.most = make, most

    def __missing__(self, word: str) -> bytes:
        got = self.make(word)
        if len(word) <= KEPT_LENGTH:
            if len(self) >= self.most:
                self.clear()
            self[word] = got
        return got


class ByteBPE:
    """A byte-level BPE vocabulary. Inside, tokens are numbered by merge rank: bytes 0-255, then merges in order."""

    def __init__(self, spec: bytes) -> None:
        whole = json.loads(spec)
        model, alphabet = whole["model"], _byte_alphabet()
        vocab: dict[str, int] = model["vocab"]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        number = {c: b for c, b in alphabet.items()}
        self.split: list[tuple[int, int]] = [(i, i) for i in range(256)]
        self.merged: dict[tuple[int, int], int] = {}
        texts = sorted(alphabet, key=alphabet.__getitem__)
        for left, right in merges:
            n = number.setdefault(left + right, len(self.split))
            if n == len(self.split):
                self.split.append((number[left], number[right]))
                texts.append(left + right)
            self.merged[number[left], number[right]] = n
        raw = ["".join(chr(alphabet[c]) for c in t) for t in texts]
        self.length = [len(r) for r in raw]
        self.packed = [vocab[t].to_bytes(4, "little") for t in texts]
        self.automaton = ahocorasick.Automaton()
        known = {r: n for n, r in enumerate(raw)}
        for r, n in known.items():
            self.automaton.add_word(r, (n, len(r)))
        self.automaton.make_automaton()
        #: Longest proper prefix that is a token itself, or -1.
        self.shorter = [next((known[r[:k]] for k in range(len(r) - 1, 0, -1) if r[:k] in known), -1) for r in raw]
        self.pairs: dict[tuple[int, int], bool] = {}
        #: Whether merging a token's own bytes gives the token. Halves have lower numbers, so one pass is enough.
        self.whole = [True] * 256
        for n in range(256, len(texts)):
            left, right = self.split[n]
            self.whole.append(self.whole[left] and self.whole[right] and self._apart(left, right, n))
        self.words = _Kept(self._encode_word, KEPT_WORDS)
        self.added = {t["content"]: t["id"] for t in whole.get("added_tokens", ())}
        names = sorted(self.added, key=len, reverse=True)
        self.added_pattern = regex.compile("|".join(map(regex.escape, names))) if names else None
        self.find = regex.compile(PRETOKEN).findall
        by_id = {vocab[t]: r.encode("latin-1") for t, r in zip(texts, raw, strict=True)}
        by_id |= {i: c.encode() for c, i in self.added.items()}
        pieces = [by_id.get(i, b"") for i in range(max(by_id) + 1)]
        self.table = np.frombuffer(b"".join(pieces), np.uint8)
        self.sizes = np.array([len(p) for p in pieces], np.int64)
        self.offsets = np.concatenate(([0], np.cumsum(self.sizes)[:-1]))

    def compatible(self, left: int, right: int) -> bool:
        """Whether merging the joined bytes of two tokens in rank order ends in these two.

        Undo the later of the two tokens' merges step by step, each time down to the half at the seam; if the halves
        that meet have a merge that comes before what was undone, merging would have joined across the seam.
        """
        got = self.pairs.get((left, right))
        if got is None:
            if len(self.pairs) >= KEPT_PAIRS:
                self.pairs.clear()
            self.pairs[left, right] = got = self._apart(left, right, len(self.split))
        return got

    def _apart(self, left: int, right: int, bound: int) -> bool:
        """No merge of a rank below ``bound`` crosses the seam before the tokens beside it are made."""
        merged, split = self.merged, self.split
        while True:
            across = merged.get((left, right))
            if across is not None and across < bound:
                return False
            if left < 256 and right < 256:
                return True
            # on a tie of ranks merging goes from the left, so the left one was made first
            if left > right:
                bound, left = left, split[left][1]
            else:
                bound, right = right + 1, split[right][0]

    def _encode_word(self, word: str) -> bytes:
        raw = word.encode("utf-8").decode("latin-1")
        n, whole, packed, length, shorter, compatible = len(raw), self.whole, self.packed, self.length, self.shorter, self.compatible
        # the automaton's longest matches, one after the other; it is set anew only where the encoder left its track
        matches, due = self.automaton.iter_long(raw), 0
        tokens: list[int] = []
        open_at = bytearray(b"\x01") * (n + 1)
        at, token, last = 0, -1, -1
        while at < n:
            if token < 0:
                if at != due:
                    matches = self.automaton.iter_long(raw, at)
                token, size = next(matches)[1]
                due = at + size
            while token >= 0:
                if open_at[at + length[token]] and (last < 0 or compatible(last, token)) and whole[token]:
                    break
                token = shorter[token]
            if token >= 0:
                tokens.append(token)
                at += length[token]
                last, token = token, -1
            else:
                open_at[at] = 0
                at -= length[last]
                token = shorter[tokens.pop()]
                last = tokens[-1] if tokens else -1
                while token < 0:
                    open_at[at] = 0
                    at -= length[last]
                    token = shorter[tokens.pop()]
                    last = tokens[-1] if tokens else -1
        return b"".join([packed[t] for t in tokens])

    def forget(self) -> None:
        """Drop what was kept of past texts."""
        self.words.clear()
        self.pairs.clear()

    def encode(self, text: str | None) -> bytes:
        """Ids of a whole text as little-endian unsigned 32-bit integers."""
        if not text:
            return b""
        if self.added_pattern is None or not self.added_pattern.search(text):
            return b"".join(map(self.words.__getitem__, self.find(text)))
        out, at = [], 0
        for m in self.added_pattern.finditer(text):
            out += map(self.words.__getitem__, self.find(text[at : m.start()]))
            out.append(self.added[m[0]].to_bytes(4, "little"))
            at = m.end()
        out += map(self.words.__getitem__, self.find(text[at:]))
        return b"".join(out)

    def decode(self, ids: bytes) -> str:
        """The text of packed ids, added tokens included; bytes that are no UTF-8 become U+FFFD."""
        out = []
        for at in range(0, len(ids), BATCH_BYTES):
            part = np.frombuffer(ids[at : at + BATCH_BYTES], "<u4")
            sizes = self.sizes[part]
            ends = np.cumsum(sizes)
            where = np.repeat(self.offsets[part] - ends + sizes, sizes)
            where += np.arange(len(where))
            out.append(self.table[where].tobytes())
        return b"".join(out).decode("utf-8", "replace")


_loaded: dict[int, ByteBPE] = {}


def load(spec: bytes) -> ByteBPE:
    """One vocabulary a worker process, built once."""
    key = hash(spec)
    if key not in _loaded:
        _loaded.clear()
        _loaded[key] = ByteBPE(spec)
    return _loaded[key]


def encode_decode(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None
) -> DataFrame:
    """(id, ids, decoded): ids as a binary of little-endian unsigned 32-bit integers, decoded the text of these ids.

    The vocabulary file (of a fixed size, under 2 MB) is read by the driver and broadcast.
    """
    spark = docs.sparkSession
    with open(tokenizer or default_path(), "rb") as f:
        spec = spark.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(spec.value)
        for batch in batches:
            ids: list[bytes] = []
            texts: list[str] = []
            size = first = 0
            for row, text in enumerate(batch.column(1)):
                ids.append(bpe.encode(text.as_py()))
                texts.append(bpe.decode(ids[-1]))
                size += len(ids[-1])
                if size >= BATCH_BYTES or row + 1 == batch.num_rows:
                    names = batch.column(0).slice(first, row + 1 - first)
                    yield pa.RecordBatch.from_arrays(
                        [names, pa.array(ids, pa.binary()), pa.array(texts, pa.string())], ["id", "ids", "decoded"]
                    )
                    ids, texts, size, first = [], [], 0, row + 1
        bpe.forget()  # the worker may run other operators next

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "id long, ids binary, decoded string")


def digests(docs: DataFrame, **names: str) -> DataFrame:
    """doc_id, n_tokens, ids, ids_sha256, decoded_sha256 of ``encode_decode``."""
    got = encode_decode(docs, **names)
    return got.select(
        F.col("id").alias("doc_id"), (F.length("ids") / 4).cast("long").alias("n_tokens"), "ids",
        F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
