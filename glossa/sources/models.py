"""Fitted pipelines in a folder that the cluster shares: a version for each save, with the columns the model was fitted on."""

from __future__ import annotations

import json

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


def _folder(spark: SparkSession, path: str):
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()), folder


def versions(spark: SparkSession, path: str) -> list[int]:
    """Versions that are whole: a version's columns are written last."""
    fs, folder = _folder(spark, path)
    if not fs.exists(folder):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(folder)]
    at = [int(n.removeprefix("version=")) for n in names if n.startswith("version=")]
    return sorted(v for v in at if fs.exists(_folder(spark, f"{path}/version={v}/columns/_SUCCESS")[1]))


def save_model(model: PipelineModel, rows: DataFrame, path: str) -> int:
    """Write ``model`` and the columns of ``rows``, which it takes, as the next version; returns that."""
    spark = rows.sparkSession
    fs, folder = _folder(spark, path)
    taken = [s.getPath().getName() for s in fs.listStatus(folder)] if fs.exists(folder) else []
    version = max([int(n.removeprefix("version=")) for n in taken if n.startswith("version=")], default=0) + 1
    model.write().save(f"{path}/version={version}/model")
    spark.createDataFrame([(json.dumps(rows.schema.jsonValue()),)], "value string").coalesce(1).write.text(f"{path}/version={version}/columns")
    return version


def load_model(spark: SparkSession, path: str, rows: DataFrame, version: int | None = None) -> PipelineModel:
    """A version of the model in ``path``, by default the last whole one.

    An error if ``rows`` lacks a column that the model was fitted on, or has it with another type; columns may be in
    another order, and there may be more.
    """
    found = versions(spark, path)
    if not found or version is not None and version not in found:
        raise FileNotFoundError(f"no whole version {'' if version is None else version} in {path}; there are {found}")
    chosen = found[-1] if version is None else version
    wanted = StructType.fromJson(json.loads(spark.read.text(f"{path}/version={chosen}/columns", wholetext=True).first().value))
    has = {f.name: f.dataType for f in rows.schema}
    wrong = [f"{f.name} {f.dataType.simpleString()}" for f in wanted if has.get(f.name) != f.dataType]
    if wrong:
        raise ValueError(f"version {chosen} of the model in {path} needs {', '.join(wrong)}")
    return PipelineModel.load(f"{path}/version={chosen}/model")
