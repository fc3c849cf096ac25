"""Benchmark decontamination by template windows.

Text becomes tokens; numbers, names (capitalised words inside a sentence) and units (known words after a number)
become typed placeholders. Each window of ``WINDOW`` tokens has its template as one form and, where that has
placeholders, its plain lower-case words as another. A capitalised word that begins a sentence may be a name or not, so
its windows also have the form in which it is one. A template with under ``LITERALS`` plain words says too little and
counts by its words alone. Documents' windows are hash-joined to the items' windows, on a 64-bit key and then on
the form itself. Matches of one document and item that lie on one diagonal (document position less item position)
must fill slots consistently: a value of the item always turns into the same value; else only windows with equal
values count. A document is contaminated by an item if matched windows cover ``COVERAGE`` of the item's windows.

Only keys of the items' windows are broadcast, and only up to ``MOST_KEYS`` of them; they sift out windows that can't
match before anything is shuffled. A larger benchmark is joined without the sift.

Defined cases: null or blank text has no windows and never matches; text of fewer than ``WINDOW`` tokens is one window
of all of them, so it matches only texts of the same few tokens; a document is an id (null too) and its own text, so
fully repeated rows count once and rows of one id with different texts are judged apart; items without an id are passed
by, of an item's different texts the best match counts; an empty table on either side gives an empty result; other
columns are not looked at.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from glossa.llm.rows import text_key
from glossa.plans.materialize import materialize

WINDOW, LITERALS, COVERAGE, MOST_KEYS, KEPT, SIFT_BITS = 5, 2, 0.8, 1_000_000, 300_000, 22
FIND = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*|[.!?\n]|\d+(?:[.,]\d+)*").findall
#: The same tokens of texts in ASCII, found faster.
FIND_ASCII = re.compile(r"[A-Za-z]+(?:'[A-Za-z]+)*|[.!?\n]|[0-9]+(?:[.,][0-9]+)*").findall
#: Units of measure, money and time, in the corpus languages.
UNITS = frozenset(
    "mm cm dm m km in ft yd mi g kg mg t oz lb lbs l ml cl s sec min h hr hrs ms kb mb gb tb w kw v a hz khz mhz ghz c f k "
    "meter meters metre metres inch inches foot feet yard yards mile miles gram grams kilogram kilograms pound pounds "
    "ounce ounces ton tons liter liters litre litres second seconds minute minutes hour hours day days week weeks month "
    "months year years percent degree degrees dollar dollars euro euros cent cents usd eur gbp "
    "mètre mètres heure heures jour jours mois an ans livre livres stunde stunden tag tage woche wochen monat monate jahr "
    "jahre pfund metro metros hora horas día días año años libra libras".split()
)
_NUMBER, _NAME, _UNIT = (xxh64_intdigest(x) for x in ("<number>", "<name>", "<unit>"))
_TYPES = np.array([0, _NUMBER, _NAME, _UNIT], np.uint64)
_SHIFT = np.uint64(64 - SIFT_BITS)
_KIND_BITS = 4
_LABEL = {1: "<number>", 2: "<name>", 3: "<unit>"}
_MULTIPLIERS = np.array([xxh64_intdigest(f"window {i}") | 1 for i in range(WINDOW)], np.uint64)
_ONES = np.ones(WINDOW, np.int64)
_LENGTHS = np.array([xxh64_intdigest(f"length {i}") for i in range(WINDOW + 1)], np.uint64)


class Vocabulary(dict):
    """Token to the hash of its lower-case form, whose last bits are its kind (break, number, title, unit)."""

    def __missing__(self, token: str) -> int:
        low = token.lower()
        title = len(token) > 1 and token[0].isupper() and token[1:].islower()
        kind = (token in ".!?\n") | (token[0].isdigit() << 1) | (title << 2) | ((low in UNITS) << 3)
        got = self[token] = xxh64_intdigest(low) >> _KIND_BITS << _KIND_BITS | kind
        return got

    def windows(self, text: str | None) -> tuple[list[str], np.ndarray, list[tuple[np.ndarray, np.ndarray, np.ndarray]]]:
        """Tokens, places of words among them, and (first words of windows, their keys, slot kind of each word or 0) of
        each kind of form: plain words, template, template with a capitalised first word of a sentence as a name too.
        """
        if len(self) > KEPT:
            self.clear()
        text = text or ""
        tokens = FIND_ASCII(text) if text.isascii() else FIND(text)
        plain = np.fromiter(map(self.__getitem__, tokens), np.uint64, len(tokens))
        kinds = plain.astype(np.uint8)
        breaks = (kinds & 1) > 0
        before = np.append(True, breaks[:-1]) if len(tokens) else breaks
        after_number = np.append(False, (kinds[:-1] & 2) > 0) if len(tokens) else breaks
        slot = np.zeros(len(tokens), np.uint8)
        slot[((kinds & 4) > 0) & ~before] = 2
        slot[((kinds & 8) > 0) & after_number] = 3
        slot[(kinds & 2) > 0] = 1
        words = np.flatnonzero(~breaks)
        first = (((kinds & 4) > 0) & before & (slot == 0))[words]
        slot, plain = slot[words], plain[words] >> np.uint64(_KIND_BITS)
        k = min(WINDOW, len(words))
        if not k:
            return tokens, words, []
        wide = np.where(first, np.uint8(2), slot)
        none = np.zeros_like(slot)
        by_words, _ = self._keys(plain, none, k)
        by_type, telling = self._keys(plain, slot, k)
        by_wide, wider = self._keys(plain, wide, k)
        wider &= np.correlate(first.astype(np.int64), _ONES[:k], "valid") > 0
        typed, named = np.flatnonzero(telling), np.flatnonzero(wider)
        return tokens, words, [(np.arange(len(by_words)), by_words, none), (typed, by_type[typed], slot), (named, by_wide[named], wide)]

    @staticmethod
    def _keys(plain: np.ndarray, slot: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Key of each window of ``k`` words with some slots, and whether it has any slot and enough plain words."""
        filled = slot > 0
        keys = np.correlate(np.where(filled, _TYPES[slot], plain), _MULTIPLIERS[:k], "valid") + _LENGTHS[k]
        slots = np.correlate(filled.astype(np.int64), _ONES[:k], "valid")
        return keys, (slots > 0) & (k - slots >= LITERALS)


class Sift:
    """Which keys are among some sorted ones: the leading bits are looked up first, survivors are searched for."""

    def __init__(self, keys: np.ndarray) -> None:
        self.keys, self.leading = keys, np.zeros(1 << SIFT_BITS, bool)
        self.leading[keys >> _SHIFT] = True

    def __call__(self, got: np.ndarray) -> np.ndarray:
        at = np.flatnonzero(self.leading[got >> _SHIFT])
        if not len(at):
            return at
        near = np.minimum(np.searchsorted(self.keys, got[at]), len(self.keys) - 1)
        return at[self.keys[near] == got[at]]


_SCHEMA = "id long, text_key string, at int, key long, form string, words array<string>, slots array<boolean>"


def windows(rows: DataFrame, keys=None) -> DataFrame:
    """Windows of (id, text_key, text), those whose key is in the broadcast sorted ``keys`` if given."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, sift = Vocabulary(), None if keys is None else Sift(keys.value)
        for batch in batches:
            out: list[tuple] = []
            for doc, own, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                tokens, words, forms = vocabulary.windows(text.as_py())
                k = min(WINDOW, len(words))
                for places, got, slot in forms:
                    for hit in (range(len(got)) if sift is None else sift(got).tolist()):
                        p, key = int(places[hit]), int(got[hit])
                        low = [tokens[i].lower() for i in words[p : p + k]]
                        kinds = slot[p : p + k].tolist()
                        form = [_LABEL[s] if s else w for w, s in zip(low, kinds, strict=True)]
                        out.append((doc, own, p, key - (1 << 64) if key >> 63 else key, " ".join(form), low, [s > 0 for s in kinds]))
                    if len(out) > 5000:
                        yield _batch(out)
                        out = []
            yield _batch(out)

    return rows.mapInArrow(run, _SCHEMA)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.string(), pa.list_(pa.string()), pa.list_(pa.bool_()))
    cols = list(zip(*rows, strict=True)) or [()] * 7
    return pa.RecordBatch.from_arrays(
        [pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["id", "text_key", "at", "key", "form", "words", "slots"]
    )


def contaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    coverage: float = COVERAGE,
    most_keys: int = MOST_KEYS,
) -> DataFrame:
    """(id, text_key, item_id, n_windows, coverage, reparameterised): one row for each document and item that it contains.

    A document is an id and its own text; ``text_key`` is that of ``rows.text_key``.
    """
    spark = docs.sparkSession
    items = benchmark.select(F.col(item_col).cast("long").alias("id"), text_key("text").alias("text_key"), F.col("text").cast("string").alias("text"))
    items = materialize(windows(items.where("id is not null").distinct()), "benchmark-windows")
    total = items.groupBy(F.col("id").alias("item_id"), F.col("text_key").alias("item_key")).agg(F.countDistinct("at").alias("total"))
    keys = None
    if items.count() <= most_keys:
        found = np.array([r.key for r in items.select("key").distinct().collect()], np.int64)
        keys = spark.sparkContext.broadcast(np.sort(found.view(np.uint64)))
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), text_key(f"`{text_col}`").alias("text_key"), F.col(f"`{text_col}`").cast("string").alias("text"))
    ours = windows(rows, keys)
    theirs = items.select(
        F.col("id").alias("item_id"), F.col("text_key").alias("item_key"), F.col("at").alias("item_at"), "key", "form", F.col("words").alias("item_words")
    )
    both = ours.join(theirs, ["key", "form"]).select(
        "id", "text_key", "item_id", "item_key", "item_at", (F.col("at") - F.col("item_at")).alias("diagonal"),
        F.expr(
            "filter(transform(slots, (s, i) -> if(s, struct(item_words[i] as a, words[i] as b), null)), p -> p is not null)"
        ).alias("pairs"),
    )
    pair = ["id", "text_key", "item_id", "item_key"]
    runs = both.groupBy(*pair, "diagonal").agg(
        F.collect_set("item_at").alias("all_at"),
        F.collect_set(F.when(F.expr("forall(pairs, p -> p.a = p.b)"), F.col("item_at"))).alias("equal_at"),
        F.array_distinct(F.flatten(F.collect_set("pairs"))).alias("pairs"),
    )
    consistent = F.expr("size(array_distinct(transform(pairs, p -> p.a))) = size(pairs)")
    other = consistent & F.expr("exists(pairs, p -> p.a <> p.b)")
    per = runs.groupBy(*pair).agg(
        F.array_distinct(F.flatten(F.collect_set(F.when(consistent, F.col("all_at")).otherwise(F.col("equal_at"))))).alias("at"),
        F.max(other).alias("reparameterised"),
    )
    share = F.size("at") / F.col("total")
    got = per.join(total, ["item_id", "item_key"]).where(share >= coverage)
    best = F.max_by(F.struct(F.size("at").alias("n_windows"), share.alias("coverage"), "reparameterised"), share).alias("best")
    return got.groupBy("id", "text_key", "item_id").agg(best).select("id", "text_key", "item_id", "best.*")
