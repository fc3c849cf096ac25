import hashlib
import random
import struct

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from glossa.llm import bpe as B

LIB = Tokenizer.from_file(B.default_path())
OWN = B.load(open(B.default_path(), "rb").read())
CASES = [
    "", " ", "\n\n  a", "Hello world's  end  ", "ÀÉ ciónñ é́", "x" * 3000, "ab" * 2000, "<|endoftext|>", "a<|endoftext|> b <|endoftext|",
    "  <|endoftext|>  ", "日本語テキスト 😀👩‍👩‍👧", "\x00\x01\x1c\x1d\x85  z", "1234567 89.5%%% &&& ***", "don't we'll I'M they'D", "  x", "THTHER!! ONERSTAN!!",
    "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa" * 40, "=-=-=-=" * 50, "\t" * 100,
]


def same(text):
    ids = list(struct.unpack(f"<{len(OWN.encode(text)) // 4}I", OWN.encode(text)))
    want = LIB.encode(text, add_special_tokens=False).ids
    assert ids == want, text
    assert OWN.decode(OWN.encode(text)) == LIB.decode(want, skip_special_tokens=False)


@pytest.mark.parametrize("text", CASES)
def test_cases(text):
    same(text)


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=80))
def test_any_text(text):
    same(text)


def test_random_letters():
    rng = random.Random(2)
    for _ in range(1500):
        same("".join(rng.choices("aeinorstldhu ", k=rng.randrange(1, 60))))
        same("".join(rng.choices("abc!*-_= \n\t", k=rng.randrange(1, 60))))


def test_decode_of_broken_bytes():
    ids = LIB.encode("é😀").ids[:-1]
    assert OWN.decode(struct.pack(f"<{len(ids)}I", *ids)) == LIB.decode(ids, skip_special_tokens=False)


def test_table(spark):
    rows = [(i, t) for i, t in enumerate(CASES)] + [(None, None), (5, None), (5, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as ids", "2 as decoded")
    got = B.digests(df).collect()
    assert len(got) == len(rows)
    by = {(r.doc_id, r.ids_sha256, r.decoded_sha256, r.n_tokens) for r in got}
    for i, t in rows:
        ids = LIB.encode(t or "", add_special_tokens=False).ids
        packed = struct.pack(f"<{len(ids)}I", *ids)
        assert (i, hashlib.sha256(packed).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest(), len(ids)) in by
    assert B.digests(df.limit(0)).count() == 0
