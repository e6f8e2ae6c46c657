"""Session defaults for local runs; on a cluster the submit configuration wins."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def build_session(app: str = "cairnspark", cpus: int | None = None) -> SparkSession:
    """A session with UTC, ANSI left on, and AQE with skew-join splitting (Spark's defaults, stated here)."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    if cpus is not None:
        builder = (
            builder.master(f"local[{cpus}]")
            .config("spark.sql.shuffle.partitions", str(cpus))
            .config("spark.driver.memory", os.environ.get("SPARK_DRIVER_MEMORY", "8g"))
        )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
