"""Versioned Parquet tables and logs (SNK-01..05, MUT-01 apply side, STR-02)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class VersionedTable:
    """A folder of numbered versions and a log of what published them. A version becomes visible by its log row.

    Publishing with a key that the log already holds does nothing, so a batch that is run twice counts once."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    def _fs(self):
        hadoop = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return hadoop.getFileSystem(self.spark._jsc.hadoopConfiguration()), self.spark._jvm.org.apache.hadoop.fs.Path

    def log(self) -> DataFrame | None:
        fs, path = self._fs()
        if not fs.exists(path(f"{self.path}/log")):
            return None
        return self.spark.read.schema("version bigint, batch_key string").json(f"{self.path}/log")

    def version(self) -> int:
        log = self.log()
        return 0 if log is None else int(log.agg(F.coalesce(F.max("version"), F.lit(0)).alias("v")).first().v)

    def published(self, batch_key: str) -> bool:
        log = self.log()
        return log is not None and not log.filter(F.col("batch_key") == batch_key).isEmpty()

    def read(self, version: int | None = None) -> DataFrame | None:
        v = self.version() if version is None else version
        return self.spark.read.parquet(f"{self.path}/v={v}") if v else None

    def publish(self, df: DataFrame, batch_key: str) -> int:
        if self.published(batch_key):
            return self.version()
        v = self.version() + 1
        df.write.mode("overwrite").parquet(f"{self.path}/v={v}")  # an unfinished former attempt is replaced
        self.spark.createDataFrame([(v, batch_key)], "version bigint, batch_key string").coalesce(1).write.mode("append").json(f"{self.path}/log")
        return v


def append_errors(errors: DataFrame, path: str) -> None:
    """One JSON line an error."""
    errors.write.mode("append").json(path)


def write_index(posted: DataFrame, lengths: DataFrame, path: str, files: int = 64) -> None:
    """Postings sorted by term within files, so that a query's terms skip most row groups, and the lengths."""
    posted.repartitionByRange(files, "term").sortWithinPartitions("term").write.mode("overwrite").parquet(f"{path}/postings")
    lengths.write.mode("overwrite").parquet(f"{path}/lengths")


def read_index(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{path}/postings"), spark.read.parquet(f"{path}/lengths")


def as_json(df: DataFrame, column: str = "json") -> DataFrame:
    """One JSON object a row, with nulls (SNK-04)."""
    return df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias(column))


class Freshness:
    """When an index became stale and why; the first time is kept until it is rebuilt (FTS-09)."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path

    def mark(self, at: str, reason: str) -> None:
        self.spark.createDataFrame([("stale", at, reason)], "event string, at string, reason string").coalesce(1).write.mode("append").json(self.path)

    def rebuilt(self, at: str) -> None:
        self.spark.createDataFrame([("rebuilt", at, None)], "event string, at string, reason string").coalesce(1).write.mode("append").json(self.path)

    def state(self) -> DataFrame:
        """stale_since, reason; nulls if fresh."""
        log = self.spark.read.schema("event string, at string, reason string").json(self.path)
        done = log.filter("event = 'rebuilt'").agg(F.coalesce(F.max("at"), F.lit("")).alias("_done")).first()._done
        return log.filter((F.col("event") == "stale") & (F.col("at") > done)).agg(F.min("at").alias("stale_since"), F.max_by("reason", "at").alias("reason"))


def generated(spark: SparkSession, rows: int, seed: int = 1, **columns: list[str]) -> DataFrame:
    """id and one column a list, its values drawn by hash: the same rows for the same seed (SNK-05)."""
    df = spark.range(rows)
    for i, (name, values) in enumerate(columns.items()):
        df = df.withColumn(name, F.element_at(F.array(*[F.lit(v) for v in values]), (F.pmod(F.xxhash64("id", F.lit(seed), F.lit(i)), F.lit(len(values))) + 1).cast("int")))
    return df
