"""The dictionary of short and long forms: merge sources, standardise, attach concepts."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glossa.functions import sets, text
from glossa.functions.stopwords import ENGLISH
from glossa.plans.materialize import scratch_path

#: A source's answer when it has none.
NO_RESULT = "no results"
#: The concept of a row that the tagger failed on.
ERROR = "error"
NOT_CLINICAL = ["Genes & Molecular Sequences"]


def merge_sources(pairs: DataFrame, wanted: DataFrame | None = None, stopwords: frozenset[str] = ENGLISH) -> DataFrame:
    """(sf, lf, source): standardised pairs of (sf, lf, source), sources of a pair as a bar set.

    Long forms that are stopwords, empty, or the short form itself go; ``wanted`` (sf) keeps only its short forms.
    """
    rows = pairs.select(text.standardize_upper(F.col("sf")).alias("sf"), text.standardize_lower(F.col("lf")).alias("lf"), "source").dropna("any")
    rows = rows.where(~F.col("lf").isin(*sorted(stopwords), NO_RESULT) & (F.col("lf") != F.lower("sf")) & (F.col("lf") != ""))
    if wanted is not None:
        rows = rows.join(wanted.select("sf").distinct(), "sf", "left_semi")
    return rows.groupBy("sf", "lf").agg(sets.to_bars(F.collect_set("source")).alias("source"))


def standardize(rows: DataFrame, lf_base: Column, position: Column | None = None) -> DataFrame:
    """(sf, lf, lf_base, source): rows whose base forms agree but for non-word characters, as one.

    ``lf_base`` is the base form of each row; the longest of a group is kept (of equal ones the last by ``position``).
    Empty base forms and those equal to the short form go.
    """
    position = F.col("lf") if position is None else position
    based = rows.dropna("any").withColumns({"lf_base": lf_base, "_at": position})
    based = based.withColumn("_key", text.strip_non_word(F.col("lf_base"))).where((F.lower("sf") != F.col("lf_base")) & (F.col("lf_base") != ""))
    return based.groupBy("sf", "_key").agg(
        sets.merge_bars(F.col("lf")).alias("lf"), sets.longest(F.col("lf_base"), F.col("_at")).alias("lf_base"), sets.merge_bars(F.col("source")).alias("source"),
    ).drop("_key")


def semantic_lookup(concepts: DataFrame, types: DataFrame, groups: DataFrame) -> DataFrame:
    """(idx, cui, abbr, type_name, group_name): types of each concept through two lookups.

    ``concepts`` has (idx, cui, semtypes as '[a,b]'); the lookup tables are small and of a fixed size.
    """
    rows = concepts.select("idx", "cui", F.explode(text.list_literal(F.col("semtypes"))).alias("abbr"))
    names = types.select("abbr", F.col("name").alias("type_name"))
    return rows.join(names, "abbr", "left").join(groups.select("type_name", "group_name"), "type_name", "left")


def concept_sets(looked_up: DataFrame) -> DataFrame:
    """(idx, cui, semtypes, semgroups): bar sets of all concepts of each row."""
    return looked_up.groupBy("idx").agg(
        sets.to_bars(F.collect_set("cui")).alias("cui"), sets.to_bars(F.collect_set("type_name")).alias("semtypes"),
        sets.to_bars(F.collect_set("group_name")).alias("semgroups"),
    )


def group_counts(looked_up: DataFrame) -> DataFrame:
    """(group_name, n): every (concept, type) counts, repeats included."""
    return looked_up.where("group_name is not null").groupBy("group_name").agg(F.count("*").alias("n"))


def with_concepts(rows: DataFrame, concepts: DataFrame) -> DataFrame:
    """Rows with (idx) left-joined to their concept sets; rows without a concept get nulls."""
    return rows.join(concepts, "idx", "left")


def tag_concepts(rows: DataFrame, table: DataFrame) -> DataFrame:
    """(idx, cui, semtypes): concepts of each row by its base form, then, where that finds none, by its long form.

    ``table`` (phrase, cui, semtypes) stands for a concept tagger.
    """
    first = rows.join(table, rows["lf_base"] == table["phrase"]).select("idx", "cui", "semtypes")
    rest = rows.join(first.select("idx").distinct(), "idx", "left_anti")
    return first.unionByName(rest.join(table, rest["lf"] == table["phrase"]).select("idx", "cui", "semtypes"))


def group_by_concept(rows: DataFrame) -> DataFrame:
    """(sf, cui, lf, lf_base, source, semtypes, semgroups): rows of one concept set as one; null is a concept set too."""
    return rows.groupBy("sf", "cui").agg(
        *[sets.merge_bars(F.col(c)).alias(c) for c in ("lf", "lf_base", "source")], F.min("semtypes").alias("semtypes"), F.min("semgroups").alias("semgroups"),
    )


def is_clinical(groups: Column, excluded: list[str] = NOT_CLINICAL) -> Column:
    return F.coalesce(sets.any_outside(groups, excluded), F.lit(False))


def usable_long_forms(rows: DataFrame, lexicon: DataFrame) -> DataFrame:
    """Rows with a clinical group whose long form stands in a lexicon (lf)."""
    return rows.where(is_clinical(F.col("semgroups"))).join(lexicon.select("lf").distinct(), "lf", "left_semi")


def has_annotation(rows: DataFrame) -> DataFrame:
    """Without rows that have neither group nor type."""
    return rows.where(~(F.col("semgroups").isNull() & F.col("semtypes").isNull()))


def find_term(rows: DataFrame, term: str, part: str = "lf") -> DataFrame:
    """(column, found): whether any row of each column whose name holds ``part`` contains a term."""
    names = [c for c in rows.columns if part in c]
    found = rows.agg(*[F.coalesce(F.max(F.contains(F.col(c).cast("string"), F.lit(term))), F.lit(False)).alias(c) for c in names])
    return found.select(F.explode(F.map_from_arrays(F.array(*map(F.lit, names)), F.array(*names))).alias("column", "found"))


def vocabulary(rows: DataFrame, position: str) -> DataFrame:
    """(sf, lf, lf_id, support): ids from 0 in order of first position; zero-support long forms share one last entry.

    ``rows`` has (sf, lf, support, <position>). The shared entry is '$' joined long forms (just '$' if there are none).
    """
    firsts = rows.where("support > 0").groupBy("sf", "lf").agg(F.min(position).alias("_at"), F.max("support").alias("support"))
    order = Window.partitionBy("sf").orderBy("_at", "lf")
    known = firsts.withColumn("lf_id", F.row_number().over(order) - 1).select("sf", "lf", "lf_id", "support")
    zero = F.array_sort(F.collect_set(F.when(F.col("support") == 0, F.col("lf"))))
    rest = rows.groupBy("sf").agg(zero.alias("zero"), F.countDistinct(F.when(F.col("support") > 0, F.col("lf"))).alias("n"))
    rest = rest.select("sf", F.concat(F.lit("$"), F.array_join("zero", "$")).alias("lf"), F.col("n").cast("int").alias("lf_id"), F.lit(0).cast("long").alias("support"))
    return known.withColumn("support", F.col("support").cast("long")).unionByName(rest)


def token_ids(tokens: DataFrame, vocab: DataFrame) -> DataFrame:
    """(sf, lf, lf_id, support): ids of (sf, lf); -1 and a null support where unknown."""
    return tokens.join(vocab, ["sf", "lf"], "left").withColumn("lf_id", F.coalesce("lf_id", F.lit(-1)))


def last_attributes(rows: DataFrame, columns: list[str], position: str) -> DataFrame:
    """(sf, lf, columns..): for each long form of a short form the attributes of its last row."""
    last = F.max_by(F.struct(*columns), F.col(position)).alias("last")
    return rows.groupBy("sf", "lf").agg(last).select("sf", "lf", "last.*")


def _tagged(tagger: Callable[[list[str]], list[str | None]], batch: pd.DataFrame) -> list[str | None]:
    """Concepts of one batch by its base forms; if that fails, of its rows one by one by their long forms."""

    def one(phrase: str) -> str | None:
        try:
            return tagger([phrase])[0]
        except Exception:  # whatever a service raises marks the row, not the job
            return ERROR

    try:
        return tagger(batch.lf_base.tolist())
    except Exception:
        return [one(x) for x in batch.lf]


def tag_in_batches(rows: DataFrame, tagger: Callable[[list[str]], list[str | None]], size: int = 1000) -> DataFrame:
    """(idx, cui): concepts from a tagger that takes lists of at most ``size`` phrases and may fail.

    Base forms go in batches; the rows of a batch that failed are tried one by one by their long form; what fails again
    has the concept ``ERROR``. Each Spark task holds one client, and a lost task is run again.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for whole in batches:
            found = [_tagged(tagger, whole.iloc[at : at + size]) for at in range(0, len(whole), size)]
            yield pd.DataFrame({"idx": whole.idx.to_numpy(), "cui": [c for part in found for c in part]})

    return rows.select(F.col("idx").cast("long").alias("idx"), "lf_base", "lf").mapInPandas(run, "idx long, cui string")


def tag_with_restart(
    rows: DataFrame, tagger: Callable[[list[str]], list[str | None]], path: str, size: int = 1000, wave: int = 256, most_waves: int | None = None
) -> DataFrame:
    """(idx, batch, cui): ``tag_in_batches`` into ``path``, a folder the cluster shares, so that a stopped run goes on where it was.

    Row idx belongs to batch idx // ``size``, whatever the run; its rows are tagged by one call. ``wave`` batches are one job
    and are committed together: a later run with the same arguments skips what is committed, asks again for no batch of it,
    and at most one wave is done twice. ``most_waves`` ends a run early. Rows without idx are not tagged; a batch is held in
    one task, and repeated rows are tagged each for itself.
    """
    spark, root = rows.sparkSession, path.rstrip("/")
    todo = scratch_path(spark, "tag-rows")
    batch = F.floor(F.col("idx") / size).cast("long")
    dealt = rows.where("idx is not null").select(F.col("idx").cast("long").alias("idx"), "lf_base", "lf").withColumn("batch", batch)
    dealt.withColumn("wave", F.floor(F.col("batch") / wave).cast("long")).repartition("batch").write.partitionBy("wave").parquet(todo)
    waves = sorted(r.wave for r in spark.read.schema("wave long").parquet(todo).select("wave").distinct().collect())
    fs = spark._jvm.org.apache.hadoop.fs.Path(root).getFileSystem(spark._jsc.hadoopConfiguration())
    done = {w for w in waves if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{root}/wave={w}/_SUCCESS"))}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []

        def flush() -> pd.DataFrame:
            mine = pd.concat(held)
            return pd.DataFrame({"idx": mine.idx.to_numpy(), "batch": mine.batch.to_numpy(), "cui": _tagged(tagger, mine)})

        for part in batches:
            for key, mine in part.groupby("batch", sort=True):
                if held and held[0].batch.iat[0] != key:
                    yield flush()
                    held = []
                held.append(mine)
        if held:
            yield flush()

    columns, schema = "idx long, batch long, lf_base string, lf string", "idx long, batch long, cui string"
    for w in [w for w in waves if w not in done][:most_waves]:
        mine = spark.read.schema(columns).parquet(f"{todo}/wave={w}")  # its own folder: no wave lists those of all others
        tagged = mine.repartition("batch").sortWithinPartitions("batch", "idx").mapInPandas(run, schema)
        tagged.write.mode("overwrite").parquet(f"{root}/wave={w}")
        done.add(w)
    parts = [f"{root}/wave={w}" for w in sorted(done)]
    return spark.read.schema(schema).parquet(*parts) if parts else spark.createDataFrame([], schema)


def untagged(rows: DataFrame, tagged: DataFrame) -> DataFrame:
    """Rows that a stopped run hasn't tagged: a rerun takes these."""
    return rows.join(tagged.select("idx"), "idx", "left_anti")
