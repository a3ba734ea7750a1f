"""Helpers that keep plans sound at any size: staged tables, size-checked joins, spread input.

* ``stage`` cuts lineage by writing a Parquet table into the shared checkpoint folder, so that a lost executor
  costs a re-read and not a re-computation.
* ``sized_join`` broadcasts the small side only when its row count is proven to be under a bound; past the bound
  it salts the join so that one key holding a large share of the rows is spread over many tasks.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes of values that a broadcast side may have.
BROADCAST_ROWS, BROADCAST_BYTES = 200_000, 64 << 20
#: Part of the driver's heap that a broadcast may take where several are alive at once, and what a row takes besides its values
#: (measured: 125 bytes with two keys and one text).
HEAP_SHARE, ROW_BYTES = 64, 128
#: Ways in which a key is split when the small side is too large to broadcast: at least so many, and one for SALT_TASKS
#: tasks that run at a time, so that a key with a third of all rows keeps the cluster busy.
SALT, SALT_TASKS = 16, 8


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; a temporary one only where nothing is set and the master is local."""
    sc = spark.sparkContext
    conf = sc.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if conf:
        return conf.rstrip("/")
    known = sc._jsc.sc().getCheckpointDir()
    if known.isDefined():
        return str(known.get()).rstrip("/")
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="gramoflow-"))
    return str(sc._jsc.sc().getCheckpointDir().get()).rstrip("/")


def stage(df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write df as Parquet into the shared folder and read it back."""
    path = f"{_own_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    writer = df.write.mode("error")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _own_dir(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/staged-{spark.sparkContext.applicationId}"


def clear_staged(spark: SparkSession) -> None:
    """Deletes what this application has staged; call it once no result is needed any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(_own_dir(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def heap_share(spark: SparkSession) -> int:
    """Bytes for one broadcast by the driver's heap: it collects the rows, builds the table and serves its blocks."""
    return min(BROADCAST_BYTES, spark._jvm.java.lang.Runtime.getRuntime().maxMemory() // HEAP_SHARE)


def within(df: DataFrame, rows: int, size: int = BROADCAST_BYTES, row_bytes: int = 0) -> bool:
    """True if df has at most so many rows and bytes of values, with row_bytes for each row; each task adds up its own, and only the sums are moved."""
    plain = ("boolean", "byte", "short", "int", "bigint", "float", "double", "date", "timestamp", "timestamp_ntz")
    wide = [F.coalesce(F.octet_length(f"`{f.name}`" if f.dataType.simpleString() in ("string", "binary") else F.to_json(F.struct(F.col(f"`{f.name}`")))), F.lit(0)) for f in df.schema.fields if f.dataType.simpleString() not in plain]
    one = sum(wide, F.lit(8 * (len(df.columns) - len(wide))))
    r = df.agg(F.count("*").alias("n"), F.coalesce(F.sum(one), F.lit(0)).alias("b")).first()
    return r.n <= rows and r.b + r.n * row_bytes <= size


def sized_join(
    big: DataFrame,
    small: DataFrame,
    keys: list[str],
    how: str = "inner",
    rows: int = BROADCAST_ROWS,
    salt: int | None = None,
    counted: DataFrame | None = None,
    size: int | None = None,
) -> DataFrame:
    """Join on equal keys, where ``small`` holds each key once (or a few times) and ``big`` may be skewed.

    ``counted`` is a cheaper frame with as many rows as ``small`` for the size check. Null keys match nothing.
    ``size``: bytes that the broadcast may take in the driver, with ROW_BYTES for each row; else BROADCAST_BYTES of values.
    """
    if within(counted if counted is not None else small, rows, *((BROADCAST_BYTES,) if size is None else (size, ROW_BYTES))):
        return big.join(F.broadcast(small), keys, how)
    if salt is None:
        salt = max(SALT, big.sparkSession.sparkContext.defaultParallelism // SALT_TASKS)
    # The salt comes from the row itself, so that a task run again after a loss sends its rows the same way.
    slots = F.explode(F.array(*[F.lit(i) for i in range(salt)]))
    plain = [F.col(f"`{f.name}`") for f in big.schema.fields if "map<" not in f.dataType.simpleString()]
    spread = big.withColumn("_salt", F.pmod(F.xxhash64(*plain), F.lit(salt)).cast("int"))
    # Spark judges the split side by the size of its files, without the split, and would broadcast it after all.
    return spread.join(small.withColumn("_salt", slots).hint("merge"), [*keys, "_salt"], how).drop("_salt")


def spread(df: DataFrame, least_rows_a_task: int = 2_000) -> DataFrame:
    """Give CPU-heavy Python steps enough tasks: files can be few while cores are many."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= 2 * cores:
        return df
    return df.repartition(3 * cores)
