"""Session builder for local work and the table reader used by the queries."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession


def build_session(master: str | None = None, shuffle_partitions: int = 8, app: str = "gramoflow") -> SparkSession:
    """A session in UTC with adaptive execution. On a cluster, pass the cluster's own session to the operators instead."""
    builder = (
        SparkSession.builder.appName(app)
        .master(master or f"local[{os.environ.get('BENCH_CPUS', '*')}]")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "4g")
    )
    return builder.getOrCreate()


def table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{directory}/{name}.parquet")
