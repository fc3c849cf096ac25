"""URL filters: fixed host/path rules first, then association rules that FP-growth mines from labels.

A url becomes a set of typed tokens (scheme, host suffixes and host words, path words, file ending, query keys,
fragment). Tokens that stand in exactly the same labelled pages (as suffixes of one host do) are one for mining, the
longest of them, so item sets don't multiply. Labelled pages, as transactions of these and a label token, go through
Spark's FP-growth; rules whose
consequent is the low label and that have at least ``SUPPORT`` (a share of the labelled pages, and ``LEAST`` of them)
and ``CONFIDENCE`` are kept, unless a rule of fewer of the same tokens is as sure. Rules are matched by an inverted
index: each is filed under its rarest token, and only rules filed under a url's tokens are compared with it.

A page is labelled through the document that it shows: the number that ends its path is the document's id. The model
(all pruned rules) is broadcast; mining itself is distributed and covers all training labels. Most redundant rules go
before the driver sees any, by a join of each rule with the rules of one token less.

Fixed rules are (verdict, host/path): a rule fits its host and all subdomains where the url's path starts with the
rule's path, and the longest one wins.

Defined cases: a null url, or one without ``://``, has an empty host and path, no tokens and the verdict allow; A-Z of
hosts are lower-cased and nothing else is changed; repeated rows stay repeated; without labels there are no mined
rules; an empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.ml.fpm import FPGrowth
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from glossa.llm.labelled import training_labels
from glossa.plans.materialize import materialize

SUPPORT, LEAST, CONFIDENCE = 0.002, 20, 0.6
LOW, HIGH = "label:low", "label:high"
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
_END = re.compile("[/?#]")
_WORDS = re.compile(r"[^\W\d_]{2,}")
_DOCUMENT = re.compile(r"/(\d{1,18})(?:\.\w+)?/?$")


def host_and_path(url: str | None) -> tuple[str, str]:
    _, mark, rest = (url or "").partition("://")
    if not mark:
        return "", ""
    end = _END.search(rest)
    host, rest = (rest[: end.start()], rest[end.start() :]) if end else (rest, "")
    return host.translate(_LOWER), re.split("[?#]", rest, maxsplit=1)[0]


def tokens(url: str | None) -> list[str]:
    """Sorted typed tokens of one url."""
    if not url or "://" not in url:
        return []
    host, path = host_and_path(url)
    out = {"scheme:" + url.partition("://")[0].lower()}
    labels = host.split(":")[0].split(".")
    out |= {"host:" + ".".join(labels[i:]) for i in range(len(labels)) if labels[-1]}
    out |= {"hostword:" + w for x in labels for w in _WORDS.findall(x)}
    out |= {"path:" + w.lower() for w in _WORDS.findall(path)}
    last = path.rsplit("/", 1)[-1]
    if "." in last:
        out.add("ending:" + last.rsplit(".", 1)[-1].lower())
    tail = url.partition("://")[2]
    if "#" in tail:
        out.add("fragment")
    query = tail.partition("#")[0].partition("?")[2]
    out |= {"query:" + p.partition("=")[0] for p in query.split("&") if p}
    return sorted(out)


class FixedRules:
    """Host/path rules, looked up by host suffix."""

    def __init__(self, rules: Sequence[tuple[str, str]]) -> None:
        self.by_host: dict[str, list[tuple[str, str, str]]] = {}
        for verdict, rule in rules:
            host, _, path = rule.partition("/")
            self.by_host.setdefault(host, []).append(("/" + path, rule, verdict))

    def find(self, host: str, path: str) -> tuple[str, str] | None:
        """(rule, verdict) of the longest rule that fits."""
        fits, at = [], 0
        while host and at >= 0:
            fits += [(len(r), r, v) for p, r, v in self.by_host.get(host[at:], ()) if path.startswith(p)]
            at = host.find(".", at) + 1 or -1
        return max(fits)[1:] if fits else None


class MinedRules:
    """(tokens, confidence) rules in an inverted index: each under its rarest token."""

    def __init__(self, rules: Sequence[tuple[Sequence[str], float]]) -> None:
        count: dict[str, int] = {}
        for items, _ in rules:
            for t in items:
                count[t] = count.get(t, 0) + 1
        self.index: dict[str, list[tuple[frozenset[str], float]]] = {}
        for items, sure in rules:
            self.index.setdefault(min(items, key=lambda t: (count[t], t)), []).append((frozenset(items), sure))

    def confidence(self, url: str | None) -> float | None:
        """The confidence of the surest rule whose tokens all stand in the url."""
        if not self.index:
            return None
        have = set(tokens(url))
        return max((sure for t in have for items, sure in self.index.get(t, ()) if items <= have), default=None)


def labelled_transactions(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """(items): tokens and label token of each page whose document has a training label."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            urls = batch.column(0).to_pylist()
            ids = [(m := _DOCUMENT.search(host_and_path(u)[1])) and int(m[1]) for u in urls]
            items = pa.array([tokens(u) for u in urls], pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), items], ["id", "tokens"])

    rows = pages.select(F.col("url").cast("string")).mapInArrow(run, "id long, tokens array<string>")
    known = training_labels(labels, "quality")
    label = F.when(F.col("label") == 1, HIGH).otherwise(LOW)
    return rows.where("id is not null").join(known, "id").select(F.concat("tokens", F.array(label)).alias("items"))


def collapsed(rows: DataFrame, need: int) -> DataFrame:
    """``rows`` (items) without tokens of fewer than ``need`` rows, and of tokens that stand in the same rows the longest.

    Rows are told apart by a hash of their position; equal counts and equal sums of two hashes are taken as the same rows.
    There are at most (tokens of a url) / support such tokens, whatever the number of rows.
    """
    at = F.monotonically_increasing_id()
    placed = materialize(rows.withColumn("at", at), "url-transactions")
    seen = placed.select(F.explode("items").alias("token"), "at").where(~F.col("token").isin(LOW, HIGH))
    marks = [F.sum(F.xxhash64(F.lit(i), "at").cast("decimal(38,0)")).alias(f"m{i}") for i in (1, 2)]
    tokens_ = seen.groupBy("token").agg(F.count("*").alias("n"), *marks).where(F.col("n") >= need)
    kept = tokens_.groupBy("n", "m1", "m2").agg(F.max(F.struct(F.length("token"), "token")).alias("best")).select(F.col("best.token").alias("token"))
    labels = rows.sparkSession.createDataFrame([(LOW,), (HIGH,)], "token string")
    told = placed.select("at", F.explode("items").alias("token")).join(F.broadcast(kept.union(labels)), "token")
    return told.groupBy("at").agg(F.array_sort(F.collect_set("token")).alias("items")).select("items")


def mine(
    pages: DataFrame, labels: DataFrame, support: float = SUPPORT, least: int = LEAST, confidence: float = CONFIDENCE
) -> list[tuple[tuple[str, ...], float]]:
    """Pruned rules for the low label, surest first."""
    rows = labelled_transactions(pages, labels).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        n = rows.count()
        if not n:
            return []
        share = min(1.0, max(support, least / n))
        items = collapsed(rows, math.ceil(share * n - 1e-9))
        found = FPGrowth(itemsCol="items", minSupport=share, minConfidence=confidence).fit(items).associationRules
        low = found.where(F.col("consequent")[0] == LOW).where(~F.array_contains("antecedent", HIGH))
        low = materialize(low.select(F.array_sort("antecedent").alias("items"), "confidence"), "url-rules")
        return pruned([(tuple(r["items"]), r["confidence"]) for r in without_longer(low).collect()])
    finally:
        rows.unpersist()


def without_longer(rules: DataFrame) -> DataFrame:
    """``rules`` (items, confidence) without those that have a part of one token less which is a rule as sure."""
    part = F.explode(F.transform("items", lambda t: F.array_remove("items", t)))
    parts = rules.where(F.size("items") > 1).select("items", F.col("confidence").alias("own"), part.alias("part"))
    shorter = rules.select(F.col("items").alias("part"), F.col("confidence").alias("sure"))
    longer = parts.join(shorter, "part").where("sure >= own").select("items").distinct()
    return rules.join(longer, "items", "left_anti")


def pruned(rules: Sequence[tuple[tuple[str, ...], float]]) -> list[tuple[tuple[str, ...], float]]:
    """Without rules that have a part which is a rule as sure."""
    kept: list[tuple[tuple[str, ...], float]] = []
    index: dict[str, list[tuple[frozenset[str], float]]] = {}
    for items, sure in sorted(rules, key=lambda r: (len(r[0]), r[0])):
        have = set(items)
        if any(part <= have and other >= sure for t in items for part, other in index.get(t, ())):
            continue
        kept.append((items, sure))
        index.setdefault(items[0], []).append((frozenset(items), sure))
    return sorted(kept, key=lambda r: (-r[1], r[0]))


def judge(pages: DataFrame, fixed: Sequence[tuple[str, str]], mined: Sequence[tuple[Sequence[str], float]]) -> DataFrame:
    """(page_id, url, host, path, rule, verdict, confidence, decided_by) for every row of ``pages``.

    ``decided_by`` is fixed, mined or default.
    """
    shared = pages.sparkSession.sparkContext.broadcast((FixedRules(fixed), MinedRules(mined)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, learned = shared.value
        for batch in batches:
            rows = []
            for url in batch.column(1).to_pylist():
                host, path = host_and_path(url)
                rule, verdict = own.find(host, path) or (None, None)
                sure = learned.confidence(url)
                by = "fixed" if rule else "default" if sure is None else "mined"
                rows.append((host, path, rule, verdict or ("allow" if sure is None else "block"), sure, by))
            cols = list(zip(*rows, strict=True)) or [()] * 6
            kinds = (*[pa.string()] * 4, pa.float64(), pa.string())
            out = [pa.array(c, k) for c, k in zip(cols, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), *out], ["page_id", "url", "host", "path", "rule", "verdict", "confidence", "decided_by"]
            )

    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"))
    return rows.mapInArrow(
        run, "page_id long, url string, host string, path string, rule string, verdict string, confidence double, decided_by string"
    )
