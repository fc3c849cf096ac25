"""Accuracy metrics as aggregations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossa.plans.ranges import running_sums


def classification_report(rows: DataFrame, truth: str = "truth", predicted: str = "predicted") -> DataFrame:
    """(label, precision, recall, f1, support): per class, then 'macro avg', 'weighted avg' and 'accuracy'.

    Undefined ratios are 0. One pass makes a confusion table; the rest runs on that.
    """
    cells = rows.groupBy(F.col(truth).cast("string").alias("t"), F.col(predicted).cast("string").alias("p")).agg(F.count("*").alias("n"))
    sides = cells.select(F.explode(F.array(
        F.struct(F.col("t").alias("label"), F.col("n").alias("actual"), F.lit(0).cast("long").alias("called"), F.when(F.col("t") == F.col("p"), F.col("n")).otherwise(0).alias("hit")),
        F.struct(F.col("p").alias("label"), F.lit(0).cast("long").alias("actual"), F.col("n").alias("called"), F.lit(0).cast("long").alias("hit")),
    )).alias("s")).select("s.*")
    per = sides.groupBy("label").agg(*[F.sum(c).alias(c) for c in ("actual", "called", "hit")])
    ratio = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))
    per = per.withColumns({"precision": ratio(F.col("hit"), F.col("called")), "recall": ratio(F.col("hit"), F.col("actual"))})
    per = per.withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))
    classes = per.select("label", "precision", "recall", "f1", F.col("actual").alias("support"))
    names = ("precision", "recall", "f1")
    macro = per.agg(*[F.avg(c).alias(c) for c in names], F.sum("actual").alias("support")).select(F.lit("macro avg").alias("label"), *names, "support")
    weighted = per.agg(*[ratio(F.sum(F.col(c) * F.col("actual")), F.sum("actual")).alias(c) for c in names], F.sum("actual").alias("support"))
    hits = ratio(F.sum("hit"), F.sum("actual"))
    overall = per.agg(hits.alias("precision"), hits.alias("recall"), hits.alias("f1"), F.sum("actual").alias("support"))
    return classes.unionByName(macro).unionByName(weighted.withColumn("label", F.lit("weighted avg"))).unionByName(overall.withColumn("label", F.lit("accuracy")))


def _by_score(rows: DataFrame, label: str, score: str) -> DataFrame:
    """(threshold, pos, n, upto_pos, upto_n): counts of each distinct score, and of all scores from the highest down to it."""
    per = rows.groupBy(F.col(score).alias("threshold")).agg(F.sum(label).cast("long").alias("pos"), F.count("*").alias("n"))
    return running_sums(per, ["pos", "n"], F.desc("threshold"))


def roc_curve(rows: DataFrame, label: str = "label", score: str = "score") -> DataFrame:
    """(threshold, tpr, fpr, youden): one row per distinct score; equal scores move together."""
    per = _by_score(rows, label, score)
    pos, n = per.agg(F.sum("pos"), F.sum("n")).first()
    tpr = F.try_divide(F.col("upto_pos").cast("double"), F.lit(float(pos or 0)))
    fpr = F.try_divide((F.col("upto_n") - F.col("upto_pos")).cast("double"), F.lit(float((n or 0) - (pos or 0))))
    return per.select("threshold", tpr.alias("tpr"), fpr.alias("fpr"), (tpr - fpr).alias("youden"))


def roc_auc(rows: DataFrame, label: str = "label", score: str = "score") -> DataFrame:
    """(auc): pairs of a positive and a negative in order, equal scores for half; null without both classes."""
    per = _by_score(rows, label, score)
    neg = (F.col("n") - F.col("pos")).cast("double")
    above = (F.col("upto_pos") - F.col("pos")).cast("double")
    return per.agg(F.try_divide(F.sum(neg * (above + F.col("pos") / 2)), F.sum("pos") * F.sum(neg)).alias("auc"))


def roc_auc_by(rows: DataFrame, by: str, label: str = "label", score: str = "score") -> DataFrame:
    """(by, n, auc): ``roc_auc`` of each group, all groups in one pass; null where a group has one class only."""
    per = rows.groupBy(by, F.col(score).alias("score")).agg(F.sum(F.col(label).cast("long")).alias("pos"), F.count("*").alias("n"))
    told = running_sums(per, ["pos"], by, "score")
    # positives with a lower score, counted from where the group begins
    before = told.groupBy(by).agg(F.min(F.col("upto_pos") - F.col("pos")).alias("open"), F.sum("pos").alias("all_pos"), F.sum("n").alias("all_n"))
    cells = told.join(before, told[by].eqNullSafe(before[by])).drop(before[by])
    below = (F.col("upto_pos") - F.col("pos") - F.col("open")).cast("double")
    neg = (F.col("n") - F.col("pos")).cast("double")
    above = F.col("all_pos") - below - F.col("pos")
    got = cells.groupBy(by).agg(F.sum(neg * (above + F.col("pos") / 2)).alias("won"), F.first("all_pos").alias("p"), F.first("all_n").alias("n"))
    return got.select(by, "n", F.try_divide("won", F.col("p").cast("double") * (F.col("n") - F.col("p"))).alias("auc"))


def fold_average(rows: DataFrame, key: str, probability: str = "p", threshold: float = 0.5) -> DataFrame:
    """(key, p, predicted): mean probability of a row over the folds that tested it."""
    return rows.groupBy(key).agg(F.avg(probability).alias("p")).withColumn("predicted", (F.col("p") >= threshold).cast("int"))


def mispredicted(rows: DataFrame, truth: str = "truth", predicted: str = "predicted") -> DataFrame:
    return rows.where(~F.col(truth).eqNullSafe(F.col(predicted)))


def label_counts(rows: DataFrame, accurate: str = "is_accurate", relevant: str = "is_clinical_relevant") -> DataFrame:
    """(positive, negative): rows that are both accurate and relevant, and the others."""
    both = (F.col(accurate) == 1) & (F.col(relevant) == 1)
    return rows.agg(F.count_if(both).alias("positive"), F.count_if(~F.coalesce(both, F.lit(False))).alias("negative"))
