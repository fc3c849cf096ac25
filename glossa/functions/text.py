"""String functions: Column in, Column out, all inside code generation."""

from __future__ import annotations

import string

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Unicode word characters; everything between is a separator.
NOT_WORD = r"[^\p{L}\p{N}_]+"


def strip_punctuation(s: Column) -> Column:
    """Delete the 32 ASCII punctuation characters, the underscore included."""
    return F.translate(s, string.punctuation, "")


def standardize_upper(s: Column) -> Column:
    return F.upper(F.trim(strip_punctuation(s)))


def standardize_lower(s: Column) -> Column:
    return F.lower(F.trim(strip_punctuation(s)))


def ascii_only(s: Column) -> Column:
    """Delete every character beyond ASCII."""
    return F.regexp_replace(s, r"[^\x00-\x7F]", "")


def strip_non_word(s: Column) -> Column:
    return F.regexp_replace(s, NOT_WORD, "")


def collapse_space(s: Column) -> Column:
    return F.trim(F.regexp_replace(s, r"\s+", " "))


def strip_parenthesised(s: Column) -> Column:
    """Delete parenthesised groups of words, white space and bars, then trim."""
    return F.trim(F.regexp_replace(s, r"\([\p{L}\p{N}_|\s]+\)", ""))


def words(s: Column) -> Column:
    """Unicode words, without the empty strings that a split leaves at the ends."""
    return F.filter(F.split(s, NOT_WORD), lambda w: w != "")


def space_tokens(s: Column) -> Column:
    """Tokens between single spaces, empty ones dropped."""
    return F.filter(F.split(s, " "), lambda w: w != "")


def initials(s: Column) -> Column:
    return F.array_join(F.transform(space_tokens(s), lambda w: F.substring(w, 1, 1)), "")


def initials_distance(sf: Column, lf: Column) -> Column:
    """Edit distance between a short form and the initials of a long form, case folded."""
    return F.levenshtein(F.lower(sf), F.lower(initials(lf)))


def stopword_count(s: Column, stopwords: frozenset[str]) -> Column:
    known = F.array(*[F.lit(w) for w in sorted(stopwords)])
    return F.size(F.filter(space_tokens(s), lambda w: F.array_contains(known, w)))


def list_literal(s: Column) -> Column:
    """'[a,b]' to an array of its items; an empty list is an empty array."""
    inside = F.substring(s, F.lit(2), F.length(s) - 2)
    return F.when(inside == "", F.array().cast("array<string>")).otherwise(F.split(inside, ","))


def base_form(s: Column, lemmas: dict[str, str] | None, stopwords: frozenset[str]) -> Column:
    """ASCII-only, lemmatised by an injected table, without stopword lemmas, joined by spaces.

    Without a table, a word of over three letters loses a plural ending (ies -> y, sses -> ss, s -> nothing but after
    s, u and i).
    """
    tokens = space_tokens(ascii_only(s))
    if lemmas is None:
        stem = lambda w: (
            F.when(F.length(w) <= 3, w)
            .when(w.rlike("ies$"), F.regexp_replace(w, "ies$", "y"))
            .when(w.rlike("sses$"), F.regexp_replace(w, "es$", ""))
            .when(w.rlike("[^sui]s$"), F.regexp_replace(w, "s$", ""))
            .otherwise(w)
        )
    else:
        table = F.create_map(*[F.lit(x) for pair in sorted(lemmas.items()) for x in pair])
        stem = lambda w: F.coalesce(F.try_element_at(table, w), w)
    drop = F.array(*[F.lit(w) for w in sorted(stopwords)])
    return F.array_join(F.filter(F.transform(tokens, stem), lambda w: ~F.array_contains(drop, w)), " ")


def split_listing(sf: Column, line: Column) -> Column:
    """Long forms that a listing line offers: text before the first comma, cut at '/', 'or' and 'and', lower-cased.

    Pieces of one character and the short form itself are dropped; parenthesised groups are deleted. Sorted, distinct.
    """
    head = F.trim(F.element_at(F.split(F.lower(line), ","), 1))
    parts = F.transform(F.split(head, r"/|(?<![\p{L}\p{N}_])(?:or|and)(?![\p{L}\p{N}_])"), lambda p: F.trim(p))
    kept = F.filter(parts, lambda p: (F.length(p) > 1) & (p != F.lower(sf)))
    return F.array_sort(F.array_distinct(F.transform(kept, strip_parenthesised)))
