"""The queries of the general problems over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gramoflow.operators import error_parse, nested, references, segment, snapshots
from gramoflow.session import table

#: Artist ids that stand for no artist.
PLACEHOLDER_ARTISTS = (194, 355, 118760)


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return error_parse.error_parse(table(spark, d, "csv_rows")).filter("reason IS NOT NULL").select("file_id", "row_number", "reason")


def p1_loaded(spark: SparkSession, d: str) -> DataFrame:
    loaded = error_parse.load_valid(table(spark, d, "csv_rows")).drop("more")
    return loaded.withColumn("date_added", F.date_format("date_added", "yyyy-MM-dd HH:mm:ss"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    credits, labels, masters = table(spark, d, "credits"), table(spark, d, "label_records"), table(spark, d, "master_records")
    artists = references.snapshot_holdings(table(spark, d, "artist_snapshots"), "discogs_id", "snapshot_date")
    label_log = references.log_holdings(labels, "discogs_id", "dump_date", "load_id", F.col("deleted"))
    release_log = references.log_holdings(table(spark, d, "release_records"), "discogs_id", "dump_date", "load_id", F.col("status") == "Deleted")
    parts = [
        ("credits", references.orphans(references.references(credits, "credit_id", "discogs_artist_id", "dump_date", PLACEHOLDER_ARTISTS), artists, True)),
        ("label_records", references.orphans(references.references(labels, "discogs_id", "parent_discogs_id", "dump_date"), label_log, False)),
        ("master_records", references.orphans(references.references(masters, "discogs_id", "main_release_discogs_id", "dump_date"), release_log, False)),
    ]
    out = None
    for name, part in parts:
        part = part.select(F.lit(name).alias("ref_table"), "rec_id", "period", "ref_id", "reason")
        out = part if out is None else out.unionByName(part)
    return out


def p2_counts(spark: SparkSession, d: str) -> DataFrame:
    return references.counts(p2_found(spark, d))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    artists = snapshots.record_changes(table(spark, d, "artist_snapshots"), "snapshot_date", "discogs_id", ["loaded_at"])
    rows = snapshots.row_changes(table(spark, d, "parsed_rows"), ["library_id"], "batch_date", "identity_key", "row_number", "content_hash")
    a = artists.select(F.lit("artist").alias("entity"), F.lit(0).cast("bigint").alias("library_id"), "rec_key", "snapshot", "change")
    return a.unionByName(rows.select(F.lit("row").alias("entity"), F.col("library_id").cast("bigint"), "rec_key", "snapshot", "change"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    masters = table(spark, d, "master_records").select("discogs_id", "artists").distinct()
    snaps = table(spark, d, "artist_snapshots")
    newest = snaps.agg(F.max("snapshot_date").alias("newest"))
    last = snaps.join(F.broadcast(newest), F.col("snapshot_date") == F.col("newest"), "left_semi").select("discogs_id", "aliases").distinct()
    parts = [
        ("master_records", nested.flatten_list(masters, "discogs_id", F.col("artists.artist"), "artists", "name")),
        ("artist_snapshots", nested.flatten_list(last, "discogs_id", F.col("aliases.name"), "aliases", "_VALUE")),
        ("xnode_records", nested.flatten_trees(table(spark, d, "xnode_records"), "rec_id", "node_json")),
    ]
    out = None
    for name, part in parts:
        part = part.select(F.lit(name).alias("src_table"), "rec_id", "path", "parent_path", "name")
        out = part if out is None else out.unionByName(part)
    return out


def known_names(spark: SparkSession, d: str) -> DataFrame:
    """Clean names with delimiters of the catalog's labels."""
    return segment.dictionary(table(spark, d, "label_records").select("name"), table(spark, d, "release_records").select("label_name"))


def packed_fields(spark: SparkSession, d: str) -> DataFrame:
    """src_table, row_key, field, text of the fields that may hold several values."""
    rows = table(spark, d, "collection_rows")
    parts = [
        rows.select(F.lit("collection_rows").alias("src_table"), F.col("row_id").alias("row_key"), F.lit("format_raw").alias("field"), F.col("format_raw").alias("text")),
        rows.select(F.lit("collection_rows").alias("src_table"), F.col("row_id").alias("row_key"), F.lit("label").alias("field"), F.col("label").alias("text")),
        table(spark, d, "release_records").select(F.lit("release_records").alias("src_table"), F.col("load_id").alias("row_key"), F.lit("format_details").alias("field"), F.col("format_details").alias("text")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.withColumn("row_key", F.col("row_key").cast("bigint"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    fields = packed_fields(spark, d).filter(segment.has_delimiter("text"))  # a field without any delimiter holds one value
    return segment.values(segment.segment_fields(fields, known_names(spark, d)), least=2)


def queries() -> dict:
    return {f.__name__: f for f in (p1_found, p1_loaded, p2_found, p2_counts, p3_found, p5_found, p6_found)}
