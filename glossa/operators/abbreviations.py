"""Abbreviation-definition pairs in running text, after the algorithm of Schwartz and Hearst (2003)."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_PAREN = re.compile(r"\(([^()]*)\)")
_SENTENCE = re.compile(r"(?<=[.!?])\s+|\n")


def is_short_form(s: str) -> bool:
    """Two to ten characters, at most two words, a letter in it, a letter or digit first."""
    return 2 <= len(s) <= 10 and len(s.split()) <= 2 and any(c.isalpha() for c in s) and s[0].isalnum()


def definition(short: str, before: str) -> str | None:
    """The shortest text at the end of ``before`` that holds the short form's letters in order.

    Letters are matched from the right; the first must begin a word. The text has at most min(n + 5, 2n) words.
    """
    words = before.split()
    most = min(len(short) + 5, len(short) * 2)
    text = " ".join(words[-most:])
    at = len(text)
    for i in range(len(short) - 1, -1, -1):
        c = short[i].lower()
        if not c.isalnum():
            continue
        at -= 1
        while at >= 0 and (text[at].lower() != c or (i == 0 and at > 0 and text[at - 1].isalnum())):
            at -= 1
        if at < 0:
            return None
    start = text.rfind(" ", 0, at) + 1
    found = text[start:]
    if len(found) <= len(short) or short.lower() in (w.lower() for w in found.split()):
        return None
    return found


def pairs(text: str | None) -> list[tuple[str, str]]:
    """(short form, long form) of a text, in order; both 'long (short)' and 'short (long)'."""
    out = []
    for sentence in _SENTENCE.split(text or ""):
        for m in _PAREN.finditer(sentence):
            inside, before = re.split("[,;]", m[1].strip(), maxsplit=1)[0].strip(), sentence[: m.start()].rstrip()
            if is_short_form(inside):
                found = definition(inside, before)
                if found:
                    out.append((inside, found))
            elif before:
                last = before.split()[-1]
                if is_short_form(last) and definition(last, inside):
                    out.append((last, definition(last, inside)))
    return out


def extract(docs: DataFrame, doc_id: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, sf, lf): every pair of every document."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(d, s, lf) for d, t in zip(batch.doc_id, batch.text, strict=True) for s, lf in pairs(t)]
            yield pd.DataFrame(rows, columns=["doc_id", "sf", "lf"])

    rows = docs.select(F.col(doc_id).cast("string").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInPandas(run, "doc_id string, sf string, lf string")


def by_short_form(found: DataFrame) -> DataFrame:
    """(sf, lfs): all long forms of each short form, repeats kept, sorted."""
    return found.groupBy("sf").agg(F.array_sort(F.collect_list("lf")).alias("lfs"))
