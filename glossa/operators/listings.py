"""Long forms from disambiguation pages: find the section on medicine, read its lines."""

from __future__ import annotations

import re
from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glossa.functions.text import split_listing

#: What the title of a wanted section contains.
CUES = ("medical", "medicine", "biological", "biology", "scientific", "science")


def is_medical(title: Column, cues: tuple[str, ...] = CUES) -> Column:
    found = F.lit(False)
    for cue in cues:
        found = found | F.contains(F.lower(title), F.lit(cue))
    return found


def wanted_section(sections: list[tuple[int, int | None, str, str]], cues: tuple[str, ...] = CUES) -> str | None:
    """Text of the first wanted childless section of (ord, parent, title, text).

    Sections wait in a line and are taken from its end, so last ones first; a wanted section with parts isn't read:
    its parts join the line at its head, and must be wanted too.
    """
    parts: dict[int | None, list[tuple[int, str, str]]] = {}
    for order, parent, title, body in sorted(sections, key=lambda s: s[0]):
        parts.setdefault(parent, []).append((order, title, body))
    line = deque(parts.get(None, ()))
    while line:
        order, title, body = line.pop()
        if not any(cue in title.lower() for cue in cues):
            continue
        if order not in parts:
            return body
        line.extendleft(parts[order])
    return None


def section_lines(sections: DataFrame, cues: tuple[str, ...] = CUES) -> DataFrame:
    """(page, line): lines of each page's wanted section; ``sections`` has (page, ord, parent, title, text)."""
    grouped = sections.groupBy("page").agg(F.collect_list(F.struct("ord", "parent", "title", "text")).alias("s"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for page, items in zip(batch.page, batch.s, strict=True):
                rows = [(i["ord"], None if pd.isna(i["parent"]) else int(i["parent"]), i["title"] or "", i["text"] or "") for i in items]
                body = wanted_section(rows, cues)
                out += [(page, line) for line in body.split("\n")] if body is not None else []
            yield pd.DataFrame(out, columns=["page", "line"])

    return grouped.select(F.col("page").cast("string").alias("page"), "s").mapInPandas(run, "page string, line string")


def flat_section_lines(pages: DataFrame, cues: tuple[str, ...] = CUES, tag: str = "p") -> DataFrame:
    """(page, line): text of each paragraph of pages (page, html) whose headline has a cue. Catalyst only."""
    title = F.regexp_extract("html", r"(?s)<h1>(.*?)</h1>", 1)
    body = F.regexp_extract_all(F.col("html"), F.lit(rf"(?s)<{tag}>([^<]*)</{tag}>"), F.lit(1))
    return pages.where(is_medical(title, cues)).select("page", F.explode(body).alias("line"))


def listing_pairs(lines: DataFrame) -> DataFrame:
    """(sf, lf): long forms that lines (sf, line) offer, distinct."""
    return lines.select("sf", F.explode(split_listing(F.col("sf"), F.col("line"))).alias("lf")).distinct()


_HEAD = re.compile(r"^(=+)\s*(.*?)\s*\1$")


def parse_sections(page: str) -> list[tuple[int, int | None, str, str]]:
    """(ord, parent, title, text) of wiki markup: '== Title ==' lines, deeper with more signs."""
    out: list[list] = []
    open_at: list[tuple[int, int]] = []
    for line in page.split("\n"):
        head = _HEAD.match(line)
        if head:
            level = len(head[1])
            while open_at and open_at[-1][0] >= level:
                open_at.pop()
            out.append([len(out), open_at[-1][1] if open_at else None, head[2], ""])
            open_at.append((level, len(out) - 1))
        elif out and line.strip():
            out[-1][3] += ("\n" if out[-1][3] else "") + line
    return [tuple(s) for s in out]
