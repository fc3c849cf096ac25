"""Writers. Parquet is the table format between stages; CSV and JSON are for exchange."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_csv(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def write_json_map(rows: DataFrame, path: str, key: str = "sf", value: str = "lf", per_file: int | None = None) -> None:
    """One JSON object per key and line, {key: [values]}; at most ``per_file`` keys in a file."""
    lists = rows.groupBy(key).agg(F.array_sort(F.collect_set(value)).alias("v"))
    lines = lists.select(F.to_json(F.create_map(key, "v")).alias("value"))
    writer = lines.write.mode("overwrite")
    (writer.option("maxRecordsPerFile", per_file) if per_file else writer).text(path)


def write_partitioned(rows: DataFrame, path: str, key: str) -> None:
    """One directory per key; a rerun replaces only the keys that it writes."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(key).parquet(path)


def write_iteration(params: DataFrame, path: str, iteration: int, clear: bool = False) -> None:
    """Parameters of one iteration as the partition iter=<n>; ``clear`` removes what an earlier run left."""
    if clear:
        old = params.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
        old.getFileSystem(params.sparkSession._jsc.hadoopConfiguration()).delete(old, True)
    write_partitioned(params.withColumn("iter", F.lit(iteration)), path, "iter")


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a complete table stands there: Spark's marker file is the last thing a job writes."""
    marker = spark._jvm.org.apache.hadoop.fs.Path(path + "/_SUCCESS")
    return marker.getFileSystem(spark._jsc.hadoopConfiguration()).exists(marker)


def stage(spark: SparkSession, path: str, make: Callable[[], DataFrame], use_cached: bool = True) -> DataFrame:
    """A stage's table: read if complete and wanted, else made and written. Partial output is made again."""
    if not (use_cached and exists(spark, path)):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def scatter(reduced: DataFrame, group: str = "sf", label: str = "form", vector: str = "pc") -> DataFrame:
    """(group, label, x, y): the first two components of each vector, for a plot made elsewhere."""
    return reduced.select(group, label, F.element_at(vector, 1).alias("x"), F.element_at(vector, 2).alias("y"))
