"""Where terms occur in documents and in what words.

The fast path tokenises each document once and looks its n-grams up in the dictionary, all terms at once. The pattern
path keeps regular-expression semantics (inflections, white space absorbed by a match) in an Arrow UDF.
"""

from __future__ import annotations

import enum
import re
from collections.abc import Callable, Iterable, Iterator
from itertools import islice

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glossa.functions import sets, text
from glossa.functions.inflect import forms
from glossa.plans.materialize import materialize
from glossa.plans.skew import HOT

TARGET = "TARGETWORD"
WINDOW, TRIM = 25, 10
#: Phrases that are compared inside a projection; a longer dictionary is joined.
LITERALS = 5_000
#: Bits by which n-grams that are in no longer dictionary are told before anything is shuffled.
SLOTS = 1 << 20
#: A window that any line fits in.
WHOLE_LINE = 1 << 30
#: What str.splitlines documents as line boundaries.
_BOUNDARIES = "\n\r\v\f\x1c\x1d\x1e\x85\u2028\u2029"
#: Characters of words, line ends and white space, as classes of Java's expressions.
_WORD_CLASS = r"[\p{L}\p{N}_]"
_BOUNDARY_CLASS = r"\n\r\x0B\f\x1C-\x1E\x85\u2028\u2029"
_SPACE_CLASS = r"\s\x0B\x1C-\x1F\x85\p{Z}"


class ContextType(enum.Enum):
    WORD = "word"
    PARAGRAPH = "paragraph"
    DOCUMENT = "document"


class TermType(enum.Enum):
    SHORT_FORM = "sf"
    LONG_FORM = "lf"


def check_config(kind: ContextType, size: int) -> None:
    if not isinstance(kind, ContextType):
        raise ValueError(f"not a context type: {kind!r}")
    if type(size) is not int or size < 1:
        raise ValueError(f"a context size is a whole number from 1 on, not {size!r}")


def tokenise(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with its words as the array ``words``.

    The one-element explode keeps the optimizer from moving the split into later lambdas, where it would run once for
    every element.
    """
    kept = [c for c in docs.columns if c != "words"]
    return docs.select(*kept, F.explode(F.array(text.words(F.col(text_col)))).alias("words"))


def n_grams(words: Column, n: int) -> Column:
    """array<struct<pos, length, gram>>: each run of n words, pos from 0."""
    if n == 1:
        return F.transform(words, lambda w, i: F.struct(i.alias("pos"), F.lit(1).alias("length"), w.alias("gram")))
    runs = words
    for k in range(1, n):
        # the k-th word after; where there is none the run is null, and dropped
        rest = F.slice(words, F.lit(k + 1), F.greatest(F.size(words), F.lit(1)))
        runs = F.zip_with(runs, rest, lambda a, b: F.concat(a, F.lit(" "), b))
    placed = F.transform(runs, lambda g, i: F.struct(i.alias("pos"), F.lit(n).alias("length"), g.alias("gram")))
    return F.filter(placed, lambda g: g["gram"].isNotNull())


def window(words: Column, pos: Column, length: Column, size: int, left_mode: str = "intended") -> Column:
    """``size`` words on either side of a match, the match as TARGETWORD.

    'compat' keeps the left rule where fewer than ``size`` words precede: min(n, size - n) of the n words.
    """
    n = pos
    left = F.least(n, F.lit(size))
    if left_mode == "compat":
        left = F.when(n < size, F.least(n, F.lit(size) - n)).otherwise(F.lit(size))
    before = F.slice(words, n - left + 1, left)
    after = F.slice(words, pos + length + 1, F.lit(size))
    return F.array_join(F.concat(before, F.array(F.lit(TARGET)), after), " ")


def variants(forms_table: DataFrame) -> DataFrame:
    """(form, phrase): the variants of bar-set forms."""
    return forms_table.select("form", F.explode(sets.from_bars(F.col("form"))).alias("phrase"))


def _keyed(terms: DataFrame, ignore_case: bool) -> DataFrame:
    return terms.select("form", (F.lower("phrase") if ignore_case else F.col("phrase")).alias("phrase")).distinct()


def with_hits(tokenised: DataFrame, terms: DataFrame, lengths: list[int], ignore_case: bool = False, most_literals: int | None = None) -> DataFrame:
    """``tokenised`` with hits array<struct<pos, length, phrase>>, empty or missing where a document has none.

    ``lengths`` are the numbers of words that phrases have. Up to ``LITERALS`` phrases are looked up in a hash set inside
    the projection: no n-gram leaves its document. More phrases are joined as a table: n-grams that fail a test of
    ``SLOTS`` bits are dropped where they are, the rest is written narrow, frequent ones meet a broadcast of fewer than
    ``HOT`` phrases, others are dealt by phrase. Then a hit tells its ``forms`` too, and windows are never joined.
    """
    keyed, most = _keyed(terms, ignore_case), LITERALS if most_literals is None else most_literals
    grams = F.concat(*[n_grams(F.col("words"), n) for n in lengths])
    named = lambda g: F.struct(g["pos"].alias("pos"), g["length"].alias("length"), (F.lower(g["gram"]) if ignore_case else g["gram"]).alias("phrase"))
    some = [r.phrase for r in keyed.select("phrase").distinct().limit(most + 1).collect()]
    if len(some) <= most:
        none = F.array().cast("array<struct<pos:int,length:int,phrase:string>>")
        hits = F.filter(F.transform(grams, named), lambda h: h["phrase"].isin(some)) if some else none
        firsts = sorted({p.split(" ")[0] for p in some if p})
        if firsts and not ignore_case:  # a document without any phrase's first word builds no n-grams
            hits = F.when(F.arrays_overlap("words", F.array(*map(F.lit, firsts))), hits).otherwise(none)
        return tokenised.withColumn("hits", hits)
    # hits follow from the words alone, so rows are known by 128 bits of these: ids may repeat or be null
    same = [F.xxhash64("words").alias("_w1"), F.xxhash64(F.lit("again"), "words").alias("_w2")]
    likely = _likely(keyed)
    some_grams = F.filter(F.transform(grams, named), lambda h: likely(h["phrase"]))
    cells = materialize(tokenised.select(*same, F.explode(some_grams).alias("h")).select("_w1", "_w2", "h.*"), "likely-hits")
    forms_of = keyed.groupBy("phrase").agg(F.sort_array(F.collect_set("form")).alias("forms"))
    # a phrase of over a HOT-th of all rows, of the dictionary or not, stays where its rows are
    counts = cells.groupBy("phrase").agg(F.count("*").alias("n"))
    frequent = materialize(counts.where(F.col("n") * HOT > cells.count()).join(forms_of, "phrase", "left").drop("n"), "frequent-phrases")
    held = cells.join(F.broadcast(frequent.where("forms is not null")), "phrase")
    rest = cells.join(F.broadcast(frequent.select("phrase")), "phrase", "left_anti").join(forms_of, "phrase")
    found = held.unionByName(rest).groupBy("_w1", "_w2").agg(F.array_sort(F.collect_set(F.struct("pos", "length", "phrase", "forms"))).alias("hits"))
    return tokenised.select("*", *same).join(found, ["_w1", "_w2"]).drop("_w1", "_w2")


def _likely(keyed: DataFrame) -> Callable[[Column], Column]:
    """A test that every phrase of a dictionary passes and few others: a table of ``SLOTS`` bits, whatever the dictionary's size."""
    place = lambda phrase: F.pmod(F.xxhash64(phrase), F.lit(SLOTS)).cast("int")
    bits = keyed.select(place(F.col("phrase")).alias("at")).groupBy((F.col("at") / 64).cast("int").alias("word"))
    words = [0] * (SLOTS // 64)
    for r in bits.agg(F.bit_or(F.expr("shiftleft(1L, at % 64)")).alias("bits")).collect():
        words[r["word"]] = r["bits"]
    table = F.split(F.lit(",".join(map(str, words))), ",").cast("array<bigint>")
    return lambda phrase: F.getbit(F.get(table, (place(phrase) / 64).cast("int")), place(phrase) % 64) == 1


def _with_forms(rows: DataFrame, terms: DataFrame, ignore_case: bool) -> DataFrame:
    """Rows of hits with ``form``: from the hit where it tells its forms, else by its phrase from a small dictionary."""
    if "forms" in rows.columns:
        return rows.withColumn("form", F.explode("forms"))
    return rows.join(_keyed(terms, ignore_case), "phrase")


def word_contexts(
    tokenised: DataFrame, terms: DataFrame, lengths: list[int], size: int = WINDOW, left_mode: str = "intended", ignore_case: bool = False, doc_id: str = "doc_id",
    most_literals: int | None = None,
) -> DataFrame:
    """(form, doc_id, pos, length, context): the words around every match. Windows are cut before rows are made."""
    check_config(ContextType.WORD, size)
    docs = with_hits(tokenised, terms, lengths, ignore_case, most_literals)
    cut = F.transform(
        "hits",
        lambda h: F.struct(h.alias("hit"), window(F.col("words"), h["pos"], h["length"], size, left_mode).alias("context")),
    )
    rows = docs.select(doc_id, F.explode(cut).alias("c")).select(doc_id, "c.context", "c.hit.*")
    return _with_forms(rows, terms, ignore_case).select("form", doc_id, "pos", "length", "context")


def longest_only(found: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """Without matches that begin where a longer match of the same form does."""
    best = F.max(F.struct("length", "context")).alias("best")
    return found.groupBy("form", doc_id, "pos").agg(best).select("form", doc_id, "pos", "best.length", "best.context")


def document_contexts(tokenised: DataFrame, terms: DataFrame, lengths: list[int], ignore_case: bool = False, doc_id: str = "doc_id", text_col: str = "text", most_literals: int | None = None) -> DataFrame:
    """(form, doc_id, context): a whole document once for each form in it."""
    docs = with_hits(tokenised, terms, lengths, ignore_case, most_literals)
    hits = F.transform("hits", lambda h: h.dropFields("pos", "length"))
    found = docs.select(doc_id, F.col(text_col).alias("context"), F.explode(F.array_distinct(hits)).alias("hit")).select(doc_id, "context", "hit.*")
    return _with_forms(found, terms, ignore_case).select("form", doc_id, "context").distinct()


def line_contexts(docs: DataFrame, terms: DataFrame, lengths: list[int], ignore_case: bool = False, doc_id: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(form, doc_id, line, pos, context): where a line is a paragraph, the line with the match as TARGETWORD."""
    lines = docs.select(doc_id, F.posexplode(F.split(text_col, "\n")).alias("line", "text")).where("trim(text) <> ''")
    cells = tokenise(lines).select(F.struct(doc_id, "line").alias("at"), "words")
    found = word_contexts(cells, terms, lengths, WHOLE_LINE, ignore_case=ignore_case, doc_id="at")
    return found.select("form", F.col(f"at.{doc_id}").alias(doc_id), F.col("at.line").alias("line"), "pos", "context")


def blank_line_contexts(
    docs: DataFrame, terms: DataFrame, size: int, ignore_case: bool = False, doc_id: str = "doc_id", text_col: str = "text", most_literals: int | None = None,
) -> DataFrame:
    """(form, doc_id, pos, context): the paragraphs between blank lines around each match of a one-word phrase.

    Gives what ``extract`` gives, without Python: a document is its words and the gaps between them, blank lines lie in
    gaps, and their places bound what is read around a match: ``size`` blank lines and a few more on both sides, or all
    where there are fewer. Lines of that stretch alone are split. Null and empty texts have no matches.
    """
    check_config(ContextType.PARAGRAPH, size)
    tokenised = tokenise(docs.select(F.col(doc_id), F.col(text_col).alias("text")))
    found = with_hits(tokenised, terms, [1], ignore_case, most_literals)
    # one-element explodes keep what is read more than once from being computed anew for each reader
    met = found.select(doc_id, "text", "words", F.explode(F.array("hits")).alias("hits")).where("size(hits) > 0")
    parted = met.select(doc_id, "words", "hits", F.explode(F.array(F.split("text", _WORD_CLASS + "+", -1))).alias("gaps"))
    places = F.flatten(F.transform("gaps", lambda g, i: F.array_repeat(i, _whole_blank_lines(g))))
    placed = parted.select("*", F.explode(F.array(places)).alias("blanks"))
    # how many blank lines lie up to each gap, so that a hit looks its own up by place
    steps = F.zip_with(F.concat(F.array(F.lit(0)), "blanks"), F.concat("blanks", F.array(F.size("words") + 1)), lambda a, b: b - a)
    placed = placed.select("*", F.explode(F.array(F.flatten(F.transform(steps, lambda n, i: F.array_repeat(i, n))))).alias("upto"))
    # trimming takes up to two lines off either end, blank ones too (a lone tab, then an empty line)
    spans = placed.select(doc_id, "words", "gaps", F.explode(F.array(F.transform("hits", lambda h: _span(h, size + 5)))).alias("spans"))
    cut = F.transform("spans", lambda s: F.struct(s["hit"].alias("hit"), *_around(s["hit"], s["low"], s["high"], ignore_case)))
    rows = spans.select(doc_id, F.explode(cut).alias("c")).select(doc_id, "c.before", "c.after", "c.hit.*")
    for side in ("before", "after"):
        rows = rows.withColumn(side, F.split(side, f"[{_BOUNDARY_CLASS}] *", -1))
        for _ in range(2):  # off the start, then off the end
            rows = rows.withColumn(side, F.reverse(F.slice(side, _spare_lines(side) + 1, F.size(side))))
        if side == "before":
            rows = rows.withColumn(side, F.reverse(side))
        blank = F.filter(F.transform(side, lambda x, i: F.when(~x.rlike(f"[^{_SPACE_CLASS}]"), i)), lambda i: i.isNotNull())
        rows = rows.withColumn("blank", blank)
        last = F.get("blank", F.size("blank") - 1) if side == "after" else F.get("blank", F.lit(0))
        kept = F.when(F.size("blank") == 0, F.size(side)).when(F.size("blank") > size, F.get("blank", F.lit(size - 1))).otherwise(last)
        rows = rows.withColumn(side, F.slice(side, F.lit(1), kept)).drop("blank")
    context = F.array_join(F.concat(F.reverse("before"), F.array(F.lit(TARGET)), "after"), " ")
    return _with_forms(rows.withColumn("context", context), terms, ignore_case).select("form", doc_id, "pos", "context")


def _whole_blank_lines(gap: Column) -> Column:
    """How many blank lines lie in a gap from one end to the other."""
    lines = F.split(gap, f"[{_BOUNDARY_CLASS}] *", -1)
    inner = F.slice(lines, F.lit(2), F.greatest(F.size(lines) - 2, F.lit(0)))
    count = F.size(F.filter(inner, lambda x: ~x.rlike(f"[^{_SPACE_CLASS}]")))
    ends = F.length(gap) - F.length(F.translate(gap, _BOUNDARIES, ""))
    return F.when(F.length(gap) < 2, 0).when(ends < 2, 0).otherwise(count)


def _span(hit: Column, need: int) -> Column:
    """A hit with the gaps that hold the ``need``-th blank line before and after it, or the document's ends."""
    upto = F.get("upto", hit["pos"])
    low = F.when(upto >= need, F.get("blanks", upto - need)).otherwise(0)
    return F.struct(hit.alias("hit"), low.alias("low"), F.coalesce(F.get("blanks", upto + need - 1), F.size("words")).alias("high"))


def _around(hit: Column, low: Column, high: Column, ignore_case: bool) -> tuple[Column, Column]:
    """What stands before and after a hit, between two gaps; one white-space character on each side is the match's.

    Where words of one phrase stand one such character apart, it is the earlier match's.
    """
    words, gaps, p = F.col("words"), F.col("gaps"), hit["pos"]
    head, tail = F.get(gaps, p), F.get(gaps, p + 1)
    earlier = F.get(words, p - 1)
    taken = F.coalesce((F.length(head) == 1) & ((F.lower(earlier) if ignore_case else earlier) == hit["phrase"]), F.lit(False))
    head = F.when(head.rlike(f"[{_SPACE_CLASS}]$") & ~taken, F.substring(head, F.lit(1), F.length(head) - 1)).otherwise(head)
    tail = F.when(tail.rlike(f"^[{_SPACE_CLASS}]"), F.substring(tail, F.lit(2), F.length(tail))).otherwise(tail)
    before = F.zip_with(F.slice(gaps, low + 1, p - low), F.slice(words, low + 1, p - low), lambda g, w: F.concat(g, w))
    n = F.greatest(high - p - 1, F.lit(0))
    after = F.zip_with(F.slice(words, p + 2, n), F.slice(gaps, p + 3, n), lambda w, g: F.concat(w, g))
    return F.concat(F.array_join(before, ""), head).alias("before"), F.concat(tail, F.array_join(after, "")).alias("after")


def _spare_lines(lines: str) -> Column:
    """How many lines a match leaves at the start: a lone sign, if there is one, then an empty line, if there is one."""
    first = F.get(lines, F.lit(0))
    sign = F.when((F.length(first) == 1) & ~first.rlike(r"[\p{L}\p{N}]"), 1).otherwise(0)
    return sign + F.when(F.get(lines, sign) == "", 1).otherwise(0)


def trim_context(rows: DataFrame, size: int = TRIM) -> DataFrame:
    """Adds context_trimmed (``size`` tokens around the first TARGETWORD, every TARGETWORD as the short form) and tgt_idx.

    Rows without a TARGETWORD get nulls.
    """
    tokens = F.split("context", " ")
    at = F.array_position(tokens, TARGET).cast("int") - 1
    start = F.greatest(at - size, F.lit(0))
    cut = F.slice(tokens, start + 1, at - start + 1 + size)
    found = at >= 0
    return rows.withColumns({
        "context_trimmed": F.when(found, F.replace(F.array_join(cut, " "), F.lit(TARGET), F.col("sf"))), "tgt_idx": F.when(found, at - start),
    })


# -- pattern path ----------------------------------------------------------------------------------------------------

_LINES = re.compile(f"[{_BOUNDARIES}] *")
_WORDS = re.compile(r"\W+")


def pattern(term: str, kind: TermType, inflect: bool, ignore_case: bool) -> re.Pattern[str]:
    """The expression for a short form, or for the bar-separated variants of a long form, most words first."""
    term = term.lower() if ignore_case else term
    if kind is TermType.SHORT_FORM:
        endings = "(?:s|'s|s')?" if inflect else ""
        return re.compile(rf"(?:\s|\b)(?<!\w){re.escape(term)}{endings}(?!\w)(?:\s|\b|(?=\W)|$)")
    ordered = sorted((v.split() for v in term.split("|")), key=len, reverse=True)
    choices = []
    for words in ordered:
        parts = ["(?:" + "|".join(map(re.escape, forms(w, inflect))) + ")" for w in words]
        choices.append(r"(?:\s+|\b)" + r"(?:\s+|\b)".join(parts) + r"(?:\s+|\b)")
    return re.compile("|".join(choices))


def _trim(parts: list[str]) -> list[str]:
    """``parts`` less what a match leaves at an end: a lone sign, if there is one, then an empty string, if there is one."""

    def spare(ordered: Iterable[str]) -> int:
        few = list(islice(ordered, 2))
        signs = int(bool(few) and len(few[0]) == 1 and not few[0].isalnum())
        return signs + (few[signs : signs + 1] == [""])

    parts = parts[spare(parts) :]
    return parts[: len(parts) - spare(reversed(parts))]


def _nearby(document: str, start: int, end: int, size: int) -> tuple[list[str], list[str]]:
    """Words before and after a match: all of them, or at least ``size`` where there are more. Reads no further."""
    reach = 16 * size
    while True:
        left, right = max(0, start - reach), min(len(document), end + reach)
        before, after = _WORDS.split(document[left:start]), _WORDS.split(document[end:right])
        short = left > 0 and len(before) < size + 4, right < len(document) and len(after) < size + 4
        if not any(short):
            # a cut may go through a word; that word is beyond the window
            return _trim(before if left == 0 else before[1:]), _trim(after if right == len(document) else after[:-1])
        reach *= 2


def context_of(document: str, start: int, end: int, kind: ContextType, size: int, left_mode: str = "intended") -> str:
    """The words, or the paragraphs between blank lines, around a match."""
    if kind is ContextType.WORD:
        before, after = _nearby(document, start, end, size)
        n = len(before)
        left = min(n, size)
        if left_mode == "compat" and n < size:
            left = min(n, size - n)
        return " ".join([*before[n - left :], TARGET, *after[:size]])
    before, after = _trim(_LINES.split(document[:start])), _trim(_LINES.split(document[end:]))
    before = before[len(before) - _blank(before[::-1], size, False) :]
    return " ".join([*before, TARGET, *after[: _blank(after, size, True)]])


def _blank(lines: list[str], n: int, farthest: bool) -> int:
    """How many lines stand before the n-th blank one; with at most n blank lines, before the last or the first of them.

    Without a blank line, all lines.
    """
    blank = [i for i, line in enumerate(lines) if not line.strip()]
    if not blank:
        return len(lines)
    return blank[n - 1] if n < len(blank) else blank[-1 if farthest else 0]


def extract(
    term: str, kind: TermType, document: str, context: ContextType, size: int, inflect: bool = False, ignore_case: bool = True, left_mode: str = "intended"
) -> list[str]:
    """All contexts of one term in one document."""
    check_config(context, size)
    searched = document.lower() if ignore_case else document
    matches = pattern(term, kind, inflect, ignore_case).finditer(searched)
    if context is ContextType.DOCUMENT:
        return [document] if next(matches, None) else []
    return [context_of(document, m.start(), m.end(), context, size, left_mode) for m in matches if m.end() > m.start()]


def pattern_contexts(
    docs: DataFrame, terms: list[tuple[str, TermType]], context: ContextType, size: int, inflect: bool = False, ignore_case: bool = True,
    doc_id: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """(form, doc_id, context): ``extract`` of a dictionary over all documents; expressions are compiled once a task."""
    check_config(context, size)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        compiled = [(t, pattern(t, k, inflect, ignore_case)) for t, k in terms]
        for batch in batches:
            out = []
            for doc, body in zip(batch["doc_id"], batch["text"], strict=True):
                searched = (body or "").lower() if ignore_case else body or ""
                for term, expression in compiled:
                    for m in expression.finditer(searched):
                        if context is ContextType.DOCUMENT:
                            out.append((term, doc, body))
                            break
                        if m.end() > m.start():
                            out.append((term, doc, context_of(body, m.start(), m.end(), context, size)))
            yield pd.DataFrame(out, columns=["form", "doc_id", "context"])

    rows = docs.select(F.col(doc_id).cast("string").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInPandas(run, "form string, doc_id string, context string")


def word_piece_span(pieces: list[str], target: str) -> tuple[int, int] | None:
    """First run of word pieces (continuations begin with ##) that spell a target, as (start, end)."""
    for start in range(len(pieces)):
        spelled = ""
        for end in range(start, len(pieces)):
            spelled += pieces[end].removeprefix("##")
            if spelled == target and not (end + 1 < len(pieces) and pieces[end + 1].startswith("##")):
                if not pieces[start].startswith("##"):
                    return start, end + 1
            if not target.startswith(spelled):
                break
    return None


def assemble_documents(lines: DataFrame, group: str, order: str, is_boundary: Column, text_col: str = "text") -> DataFrame:
    """(group, doc, text): lines of a group cut before each boundary line, joined by line feeds in order.

    Documents of a group are numbered from 0; lines before the first boundary are document 0 and boundaries then count
    from 1. A group (a file, a conversation) is the unit that must be read in order.
    """
    upto = Window.partitionBy(group).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    first = F.first(is_boundary).over(upto)
    doc = F.sum(is_boundary.cast("int")).over(upto) - F.when(first, 1).otherwise(0)
    cells = lines.select(group, doc.alias("doc"), F.struct(F.col(order).alias("o"), F.col(text_col).alias("t")).alias("cell"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list("cell")), lambda c: c["t"]), "\n")
    return cells.groupBy(group, "doc").agg(joined.alias("text"))
