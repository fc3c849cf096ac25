"""Is a mined pair valid? Binary set features and a few measures, a forest or logistic regression, a filter."""

from __future__ import annotations

from functools import reduce
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import CountVectorizer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossa.functions import sets, text
from glossa.functions.stopwords import ENGLISH
from glossa.operators import sampling
from glossa.plans.materialize import materialize

NUMERIC = ("support", "distance", "base_distance", "base_length", "stopwords", "from_pubmed")


def numeric_features(rows: DataFrame, stopwords: frozenset[str] = ENGLISH) -> DataFrame:
    """Adds the numeric features of (sf, lf, lf_base, source)."""
    return rows.withColumns({
        "support": sets.parts_count(F.col("lf")), "distance": text.initials_distance(F.col("sf"), F.col("lf")),
        "base_distance": text.initials_distance(F.col("sf"), F.col("lf_base")), "base_length": F.length("lf_base"),
        "stopwords": text.stopword_count(F.col("lf"), stopwords), "from_pubmed": (F.col("source") == "pubmed").cast("int"),
    })


def featurise(rows: DataFrame) -> DataFrame:
    """Numeric features, and semantic types and groups as one array of names."""
    names = F.concat(*[F.coalesce(sets.from_bars(F.col(c)), F.array().cast("array<string>")) for c in ("semtypes", "semgroups")])
    return numeric_features(rows).withColumn("names", F.array_distinct(names))


def fit(rows: DataFrame, label: str = "label", kind: str = "forest", trees: int = 200, seed: int = 0) -> PipelineModel:
    """Names unseen in training get no feature; there are no fixed feature positions."""
    ends = {
        "forest": RandomForestClassifier(labelCol=label, featuresCol="features", numTrees=trees, seed=seed),
        "logistic": LogisticRegression(labelCol=label, featuresCol="features"),
    }
    stages = [
        CountVectorizer(inputCol="names", outputCol="name_flags", binary=True, minDF=1.0),
        VectorAssembler(inputCols=["name_flags", *NUMERIC], outputCol="features"), ends[kind],
    ]
    return Pipeline(stages=stages).fit(featurise(rows))


def predict(model: PipelineModel, rows: DataFrame) -> DataFrame:
    """``rows`` with p (probability of validity) and is_valid."""
    got = model.transform(featurise(rows))
    p = F.element_at(vector_to_array("probability"), 2)
    return got.select(*rows.columns, p.alias("p"), F.col("prediction").cast("int").alias("is_valid"))


def keep_valid(model: PipelineModel, rows: DataFrame) -> DataFrame:
    return predict(model, rows).where("is_valid = 1").select(*rows.columns)


def cross_validate(
    rows: DataFrame, key: str, label: str = "label", folds: int = 99, test_share: float = 0.2, kind: str = "forest", trees: int = 200, seed: int = 0, parallelism: int = 4
) -> DataFrame:
    """(fold, key, label, p): the probability of every test row of every stratified fold, by a model fitted on the fold's other rows.

    Each fold's fit is a Spark job over the fold's rows, ``parallelism`` of them at a time; models are small and features
    are learned from training rows alone. What a fold predicts is written before its model is let go.
    """
    given = rows.select(key, label, "sf", "lf", "lf_base", "source", "semtypes", "semgroups")
    dealt = materialize(sampling.stratified_folds(given, label, folds, test_share, key), "folds")

    def one(fold: int) -> DataFrame:
        mine = dealt.where(F.col("fold") == fold)
        model = fit(mine.where("is_test = 0"), label, kind, trees, seed + fold)
        return materialize(predict(model, mine.where("is_test = 1")).select("fold", key, label, "p"), "fold-predicted")

    with ThreadPool(min(parallelism, folds)) as pool:
        found = pool.map(inheritable_thread_target(rows.sparkSession)(one), range(folds))
    return reduce(DataFrame.unionByName, found)


def merge_scores(pairs: DataFrame) -> DataFrame:
    """``pairs`` (lf_1, lf_2) with the Jaccard similarity of their lower-case tokens."""
    tokens = [text.space_tokens(F.lower(F.col(c))) for c in ("lf_1", "lf_2")]
    return pairs.withColumn("similarity", sets.jaccard(*tokens))
