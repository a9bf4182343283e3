"""A session with the settings the operators are written for."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def local_session(cores: str | int | None = None, app: str = "basketlens") -> SparkSession:
    """Session for tests and the benchmark; on a cluster the submitter owns these settings."""
    cores = cores or os.environ.get("BENCH_CPUS", "8")
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("BENCH_DRIVER_MEMORY", "8g"))
        # Call sites of every column expression cost more than the plans of small queries.
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
