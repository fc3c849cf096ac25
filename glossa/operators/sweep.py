"""One pass over a document's words for a whole dictionary, with inflections: the rows of ``contexts.extract`` for all terms.

Every word of every variant stands for a class of surfaces (the word, its singular and plural, their possessives). A trie
over these classes is as long as the dictionary's variants, whatever the number of surfaces; a document's words lead
through it once, and a word that begins no variant costs one look-up. Of the variants of one form that begin at a word the
one with the most words is taken, then the earlier one, then the earlier surface, and matches of a form don't overlap.
That is what the regular expressions of ``contexts.pattern`` find, one by one.

A dictionary of over ``MOST_TERMS`` forms is dealt by form, and each part has a pass of its own over the documents: no
document and no occurrence is shuffled. Forms that don't begin with a letter, digit or underscore have no place in a
trie over words; they are found by their expressions.

Defined cases: null text is the empty text; forms that are null, blank or hold an empty variant are not searched for;
repeated terms count once; a form may be a short and a long one.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce
from itertools import product

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossa.functions.inflect import forms
from glossa.operators.contexts import TARGET, WINDOW, ContextType, TermType, check_config, context_of, pattern_contexts

MOST_TERMS = 200_000
_WORD, _SPACE = re.compile(r"\w+"), re.compile(r"\s+")
#: Occurrences that leave a task in one batch.
BATCH = 2_000


def surfaces(word: str, kind: TermType, inflect: bool) -> list[str]:
    """What a word of a term may look like, in the order of preference."""
    if kind is TermType.LONG_FORM:
        return forms(word, inflect)
    return [word + "s", word + "'s", word + "s'", word] if inflect else [word]


def _cut(surface: str) -> tuple[tuple[str, ...], tuple[str, ...]]:
    """(words, what stands after each of them) of a surface that begins with a word."""
    at = list(_WORD.finditer(surface))
    ends = [*[m.start() for m in at[1:]], len(surface)]
    return tuple(m[0] for m in at), tuple(surface[m.end() : e] for m, e in zip(at, ends, strict=True))


class Trie:
    """Variants of terms as paths of word classes."""

    def __init__(self, terms: list[tuple[str, TermType]], inflect: bool, ignore_case: bool) -> None:
        self.ignore_case = ignore_case
        self.classes: dict[tuple[str, TermType], int] = {}
        #: First word of a surface: its (class, order of preference, further words, what stands between and after).
        self.by_word: dict[str, list[tuple[int, int, tuple[str, ...], tuple[str, ...]]]] = {}
        self.edges: list[dict[int, int]] = [{}]
        self.ends: list[list[tuple[str, TermType, int]]] = [[]]
        for form, kind in dict.fromkeys(terms):
            folded = form.lower() if ignore_case else form
            variants = [[folded]] if kind is TermType.SHORT_FORM else sorted((v.split() for v in folded.split("|")), key=len, reverse=True)
            for order, words in enumerate(variants):
                self._add(form, kind, order, words, inflect)

    def _add(self, form: str, kind: TermType, order: int, words: list[str], inflect: bool) -> None:
        node = 0
        for word in words:
            cls = self.classes.get((word, kind))
            if cls is None:
                cls = self.classes[word, kind] = len(self.classes)
                for rank, surface in enumerate(surfaces(word, kind, inflect)):
                    parts, gaps = _cut(surface)
                    self.by_word.setdefault(parts[0], []).append((cls, rank, parts[1:], gaps))
            step = self.edges[node].get(cls)
            if step is None:
                step = self.edges[node][cls] = len(self.edges)
                self.edges.append({})
                self.ends.append([])
            node = step
        self.ends[node].append((form, kind, order))

    def _walk(self, words: list[str], gaps: list[str], at: int, node: int, ranks: tuple[int, ...], out: dict) -> None:
        for cls, rank, more, between in self.by_word.get(words[at], ()):
            step = self.edges[node].get(cls)
            if step is None:
                continue
            last = at + len(more)
            if more and (last >= len(words) or tuple(words[at + 1 : last + 1]) != more or tuple(gaps[at:last]) != between[:-1]):
                continue
            tail = between[-1]
            if self.ends[step] and gaps[last].startswith(tail):
                for form, kind, order in self.ends[step]:
                    key = (order, *ranks, rank)
                    if (form, kind) not in out or key < out[form, kind][0]:
                        out[form, kind] = (key, last + 1, len(tail))
            if self.edges[step] and last + 1 < len(words):
                gap = gaps[last]
                if gap.startswith(tail) and (gap[len(tail) :].isspace() or gap == tail != ""):
                    self._walk(words, gaps, last + 1, step, (*ranks, rank), out)

    def find(self, text: str) -> Iterator[tuple[str, TermType, int, int, int, int]]:
        """(form, kind, first character, end, first word, end word) of all matches, by first word."""
        folded = text.lower() if self.ignore_case else text
        at = list(_WORD.finditer(folded))
        words = [m[0] for m in at]
        known = self.by_word
        gaps: list[str] | None = None
        busy: dict[tuple[str, TermType], int] = {}
        for i, word in enumerate(words):
            if word not in known:
                continue
            if gaps is None:
                starts = [*[m.start() for m in at[1:]], len(folded)]
                gaps = [folded[m.end() : s] for m, s in zip(at, starts, strict=True)]
            found: dict = {}
            self._walk(words, gaps, i, 0, (), found)
            for key, (_, end, tail) in found.items():
                if busy.get(key, 0) <= i:
                    busy[key] = end
                    yield *key, at[i].start(), at[end - 1].end() + tail, i, end


def _with_space(text: str, start: int, end: int, kind: TermType, free: int) -> tuple[int, int]:
    """A match with the white space that belongs to it: one character for a short form, all for a long one, from ``free`` on."""
    most = 1 if kind is TermType.SHORT_FORM else len(text)
    low, high = max(free, start - most), min(len(text), end + most)
    while start > low and text[start - 1].isspace():
        start -= 1
    while end < high and text[end].isspace():
        end += 1
    return start, end


def phrases(terms: list[tuple[str, TermType]], inflect: bool, ignore_case: bool) -> list[tuple[str, str, int, str, int]]:
    """(form, first word, words, phrase, rank) of all that terms match, as plain data: white space is one blank.

    Of the phrases of a form that begin at a word, that of the lowest rank matches. There are as many as the surfaces of
    a variant's words multiply to, so this is for small dictionaries, tests and SQL.
    """
    out = []
    for form, kind in terms:
        folded, rank = form.lower() if ignore_case else form, 0
        variants = [[folded]] if kind is TermType.SHORT_FORM else sorted((v.split() for v in folded.split("|")), key=len, reverse=True)
        for words in variants:
            for chosen in product(*[surfaces(w, kind, inflect) for w in words]):
                rank += 1
                cut = [_cut(s) for s in chosen]
                if cut[-1][1][-1]:
                    continue  # what ends in an apostrophe comes after the surface without it
                spelled = [""]
                for i, (parts, gaps) in enumerate(cut):
                    body = "".join(map("".join, zip(parts, gaps, strict=True)))
                    ends = [""] if i + 1 == len(cut) else [" ", ""] if gaps[-1] else [" "]
                    spelled = [s + body + e for s in spelled for e in ends]
                out += [(form, cut[0][0][0], sum(len(p) for p, _ in cut), s, rank) for s in spelled]
    return out


def _words_around(text: str, at: list[re.Match[str]], words: list[str], first: int, end: int, stop: int, kind: TermType, size: int, left_mode: str) -> str:
    """``context_of`` for words, from the document's list of words; the match is words ``first`` to ``end``, up to character ``stop``.

    A lone underscore is a sign to ``context_of``, which drops one where only white space that belongs to the match
    parts them, and one that begins or ends the document.
    """

    def absorbed(gap: str) -> bool:
        return gap.isspace() and (kind is TermType.LONG_FORM or len(gap) == 1)

    low, high = first, end
    if first and words[first - 1] == "_" and absorbed(text[at[first - 1].end() : at[first].start()]):
        low -= 1
    if end < len(words) and words[end] == "_" and absorbed(text[stop : at[end].start()]):
        high += 1
    open_ = int(low > 0 and words[0] == "_" and at[0].start() == 0)
    close = len(words) - int(high < len(words) and words[-1] == "_" and at[-1].end() == len(text))
    n = low - open_
    left = min(n, size)
    if left_mode == "compat" and n < size:
        left = min(n, size - n)
    return " ".join([*words[low - left : low], TARGET, *words[high : max(high, min(close, high + size))]])


def _plain(form: str) -> bool:
    """Whether all words of all variants begin with a word character, so that the trie can hold them."""
    return all(v.split() and all(_WORD.match(w) for w in v.split()) for v in form.split("|"))


def _sound(form: str | None, kind: TermType) -> bool:
    parts = [form] if kind is TermType.SHORT_FORM else (form or "").split("|")
    return bool(form) and all(p.strip() for p in parts)


def _one_pass(docs: DataFrame, trie: Trie, context: ContextType, size: int, left_mode: str) -> DataFrame:
    known = docs.sparkSession.sparkContext.broadcast(trie)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = known.value
        out: list[tuple[str, str, str]] = []

        def rows() -> pa.RecordBatch:
            cols = list(zip(*out, strict=True)) or [(), (), ()]
            return pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in cols], ["form", "doc_id", "context"])

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                body, at, seen, upto = text.as_py() or "", None, set(), {}
                for form, kind, start, end, first, stop in finder.find(body):
                    if context is ContextType.DOCUMENT:
                        if (form, kind) not in seen:
                            out.append((form, doc, body))
                            seen.add((form, kind))
                    elif context is ContextType.PARAGRAPH:
                        start, end = _with_space(body, start, end, kind, upto.get((form, kind), 0))
                        upto[form, kind] = end
                        out.append((form, doc, context_of(body, start, end, context, size)))
                    else:
                        if at is None:
                            at = list(_WORD.finditer(body))
                            words = [m[0] for m in at]
                        out.append((form, doc, _words_around(body, at, words, first, stop, end, kind, size, left_mode)))
                    if len(out) >= BATCH:
                        yield rows()
                        out.clear()
        yield rows()

    return docs.mapInArrow(run, "form string, doc_id string, context string")


def dictionary_contexts(
    docs: DataFrame, terms: DataFrame, context: ContextType = ContextType.WORD, size: int = WINDOW, inflect: bool = True, ignore_case: bool = True,
    left_mode: str = "intended", doc_id: str = "doc_id", text_col: str = "text", most_terms: int = MOST_TERMS,
) -> DataFrame:
    """(form, doc_id, context): ``contexts.extract`` of every term (form, kind 'sf' or 'lf') in every document."""
    check_config(context, size)
    rows = docs.select(F.col(doc_id).cast("string").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    wanted = terms.select("form", "kind").distinct()
    parts = max(1, -(-wanted.count() // most_terms))
    found = []
    for part in range(parts):
        mine = wanted.where(F.pmod(F.xxhash64("form"), F.lit(parts)) == part).collect()  # some ``most_terms`` of them
        kinds = sorted(((r.form or "", r.kind) for r in mine))
        dealt = [(f, TermType(k)) for f, k in kinds if _sound(f, TermType(k))]
        held = [(f, k) for f, k in dealt if (_plain(f) if k is TermType.LONG_FORM else _WORD.match(f) and not _SPACE.search(f))]
        odd = sorted(set(dealt) - set(held), key=str)
        found.append(_one_pass(rows, Trie(held, inflect, ignore_case), context, size, left_mode))
        if odd:
            found.append(pattern_contexts(rows, odd, context, size, inflect, ignore_case))
    return reduce(DataFrame.unionByName, found)
