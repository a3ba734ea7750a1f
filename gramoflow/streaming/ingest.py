"""Micro-batch ingestion of dumps and records (STR-01..05, 07, 08; MUT-16)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from gramoflow.operators import upsert
from gramoflow.sources.tables import VersionedTable, append_errors


def record_stream(spark: SparkSession, folder: str, schema: str, files_a_batch: int = 8) -> DataFrame:
    """JSON or Parquet files that land in a folder, a bounded number a micro-batch (STR-01, STR-03)."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_batch).json(folder)


def apply_batch(table: VersionedTable, batch: DataFrame, key: str, hash_column: str, order: str, batch_key: str, runs: str, fail: bool = False) -> None:
    """Publishes the next version once for each batch key and logs the counts. fail: throw before publishing (tests of restarts)."""
    if table.published(batch_key):
        return
    current = table.read()
    if current is None:
        current = batch.limit(0)
    following, tally = upsert.ingest(current, batch, key, hash_column, order)
    if fail:
        raise RuntimeError("failure on purpose")
    table.publish(following, batch_key)
    append_errors(tally.withColumn("batch_key", F.lit(batch_key)), runs)


def ingest_stream(records: DataFrame, table: VersionedTable, key: str, hash_column: str, order: str, checkpoint: str, runs: str, name: str = "ingest") -> StreamingQuery:
    """Upserts a stream into a versioned table; a restart continues behind the last published batch (STR-02, STR-08).

    The batch key is the query's name and the batch number, so a batch that Spark runs again after a failure counts once."""

    def each(batch: DataFrame, number: int) -> None:
        apply_batch(table, batch, key, hash_column, order, f"{name}-{number}", runs)

    return records.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).queryName(name).trigger(availableNow=True).start()


def first_of_key(records: DataFrame, key: str, at: str, late: str = "1 hour") -> DataFrame:
    """Replayed keys are dropped as long as the watermark remembers them (STR-07)."""
    return records.withWatermark(at, late).dropDuplicatesWithinWatermark([key])


def resolved_stream(facts: DataFrame, dimension: VersionedTable, target: VersionedTable, fk: str, ext: str, dim_id: str, dim_ext: str, checkpoint: str, name: str = "resolve") -> StreamingQuery:
    """Facts join the table with their references resolved; those whose record arrives later are resolved by the next batch (STR-05)."""

    def each(batch: DataFrame, number: int) -> None:
        batch_key = f"{name}-{number}"
        if target.published(batch_key):
            return
        held = target.read()
        rows = batch if held is None else held.unionByName(batch)
        dim = dimension.read()
        target.publish(rows if dim is None else upsert.resolve(rows, dim, fk, ext, dim_id, dim_ext), batch_key)

    return facts.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).queryName(name).trigger(availableNow=True).start()


def progress(query: StreamingQuery) -> list[dict]:
    """Of the last batches: number, rows, rows a second, milliseconds by phase (STR-04)."""
    return [{"batch": p["batchId"], "rows": p["numInputRows"], "rate": p["processedRowsPerSecond"], "ms": dict(p["durationMs"])} for p in query.recentProgress]
