"""Session builder for tests, the bench and local work. On a cluster, bring your own session."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def local_session(name: str = "helixlake", cores: str | int | None = None, memory: str = "6g", partitions: int = 8) -> SparkSession:
    cores = cores or os.environ.get("BENCH_CPUS", "*")
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark
