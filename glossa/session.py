"""Session defaults. Nothing here is needed on a cluster that sets its own."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def local_session(cpus: int | str = 8, **conf: str) -> SparkSession:
    """A local session for tests and benchmarks; AQE on, UTC, Arrow on."""
    builder = SparkSession.builder.master(f"local[{cpus}]").appName("glossa")
    defaults = {
        "spark.sql.shuffle.partitions": str(cpus),
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": os.environ.get("GLOSSA_DRIVER_MEMORY", "8g"),
    }
    spark = builder.config(map=defaults | conf).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
