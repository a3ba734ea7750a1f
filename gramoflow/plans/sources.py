"""Queries of the file sources: files are written from the test tables into the shared folder and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gramoflow.operators import relational
from gramoflow.operators.scale import shared_dir
from gramoflow.plans.catalog import query
from gramoflow.session import table
from gramoflow.sources import dumps, exports

#: Rows of one written file.
FILE_ROWS = 500
_QUOTED = "concat('\"', replace(coalesce({}, ''), '\"', '\"\"'), '\"')"
_LINE = f"concat({_QUOTED.format('artist')}, ',', {_QUOTED.format('title')}, ',', {_QUOTED.format('notes')}, CASE WHEN row_id % 7 = 0 THEN ',12\" mix' WHEN row_id % 11 = 0 THEN concat(',\"line one', chr(10), 'line two\"') WHEN row_id % 13 = 0 THEN ',\"open' ELSE ',x' END)"


@query(f"""WITH r AS (SELECT DISTINCT row_id, artist, title, notes FROM collection_rows WHERE NOT contains(coalesce(artist, '') || coalesce(title, '') || coalesce(notes, ''), chr(13))), l AS (SELECT row_id, {_LINE} AS raw_text FROM r), n AS (SELECT row_id % 1000 AS file_id, raw_text, row_number() OVER (PARTITION BY row_id % 1000 ORDER BY row_id % 13 = 0 AND row_id % 7 <> 0 AND row_id % 11 <> 0, row_id) AS row_number FROM l)
SELECT file_id, row_number, raw_text FROM n UNION ALL SELECT DISTINCT file_id, 0, 'Artist,Title,Notes,Extra' FROM n""")
def q_csv_records(spark: SparkSession, d: str) -> DataFrame:  # SRC-08: stray quotes, line ends in quotes, quotes that never end
    r = table(spark, d, "collection_rows").select("row_id", "artist", "title", "notes").distinct()
    r = r.filter("NOT contains(coalesce(artist, '') || coalesce(title, '') || coalesce(notes, ''), chr(13))")
    open_end = F.expr("row_id % 13 = 0 AND row_id % 7 <> 0 AND row_id % 11 <> 0")  # they come last, as a later quote would end them
    lines = r.select(F.col("row_id"), (F.col("row_id") % 1000).alias("file_id"), open_end.alias("o"), F.expr(_LINE).alias("raw_text"))
    body = lines.groupBy("file_id").agg(F.array_sort(F.collect_list(F.struct("o", "row_id", "raw_text"))).alias("x"))  # a file
    end = F.when(F.col("file_id") % 3 == 0, "\r\n").when(F.col("file_id") % 3 == 1, "\n").otherwise("\r")
    text = F.concat(F.lit("﻿Artist,Title,Notes,Extra"), end, F.aggregate("x", F.lit(""), lambda a, e: F.concat(a, e["raw_text"], end)))
    return exports.split_records(body.select("file_id", text.alias("content")))


def _written_labels(spark: SparkSession, d: str) -> str:
    newest = relational.last_wins(table(spark, d, "label_records").select("discogs_id", "name", "profile", "parent_discogs_id", "parent_name", "dump_date", "load_id"), ["discogs_id"], ["dump_date", "load_id"])
    parent = F.when(F.col("parent_discogs_id") > 0, F.struct(F.col("parent_name").alias("_VALUE"), F.col("parent_discogs_id").cast("string").alias("_id")))
    path = f"{shared_dir(spark)}/dump-{uuid.uuid4().hex}"
    xml = newest.select(F.when(F.col("discogs_id") % 17 != 0, F.col("discogs_id").cast("string")).alias("id"), F.when(F.col("discogs_id") % 19 != 0, F.col("name")).alias("name"), "profile", parent.alias("parentLabel"))
    xml.repartitionByRange(4, F.col("id")).write.format("xml").option("rowTag", "label").option("rootTag", "labels").save(path)
    return path


_NEWEST = "n AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY discogs_id ORDER BY dump_date DESC, load_id DESC) AS rn FROM label_records) WHERE rn = 1)"


@query(f"WITH {_NEWEST} SELECT discogs_id AS ext_id, name, trim(regexp_replace(profile, '\\s+', ' ', 'g')) AS profile, CASE WHEN parent_discogs_id > 0 THEN parent_discogs_id END AS parent FROM n WHERE discogs_id % 17 <> 0 AND discogs_id % 19 <> 0")
def q_dump_records(spark: SparkSession, d: str) -> DataFrame:  # SRC-01, SRC-03, SRC-05, SRC-09, SNK-05: labels written as a dump and read again
    good, _ = dumps.checked_records(dumps.read_dump(spark, _written_labels(spark, d), "label"), "name")
    return good.select("ext_id", "name", F.trim(F.regexp_replace("profile", r"\s+", " ")).alias("profile"), F.col("parentLabel._id").cast("bigint").alias("parent"))


@query(f"WITH {_NEWEST} SELECT CASE WHEN discogs_id % 17 <> 0 THEN CAST(discogs_id AS VARCHAR) END AS id, CASE WHEN discogs_id % 17 = 0 THEN 'no id' ELSE 'no name' END AS reason FROM n WHERE discogs_id % 17 = 0 OR discogs_id % 19 = 0")
def q_dump_errors(spark: SparkSession, d: str) -> DataFrame:  # SRC-06, SNK-02: records without an id or a name
    return dumps.checked_records(dumps.read_dump(spark, _written_labels(spark, d), "label"), "name")[1].select("id", "reason")


@query(f"WITH {_NEWEST} SELECT count(*) AS records, true AS without_gaps, count(*) FILTER (parent_discogs_id > 0) AS with_parent, CAST(sum(1 + CASE WHEN discogs_id % 17 <> 0 THEN 1 ELSE 0 END + CASE WHEN discogs_id % 19 <> 0 THEN count_name ELSE 0 END + count_profile + CASE WHEN parent_discogs_id > 0 THEN 2 + count_parent ELSE 0 END) AS BIGINT) AS nodes FROM (SELECT *, (name IS NOT NULL)::INT AS count_name, (profile IS NOT NULL)::INT AS count_profile, (parent_name IS NOT NULL)::INT AS count_parent FROM n)")
def q_dump_ordinals(spark: SparkSession, d: str) -> DataFrame:  # SRC-07, SRC-16: places within files have no gaps; nodes are counted
    r = dumps.read_dump(spark, _written_labels(spark, d), "label")
    files = r.groupBy("source_file").agg(F.count("*").alias("n"), F.count_distinct("record_index").alias("k"), F.min("record_index").alias("a"), F.max("record_index").alias("z"), F.count("parentLabel").alias("p"), F.sum("n_nodes").alias("nodes"))
    whole = (F.col("a") == 0) & (F.col("z") == F.col("n") - 1) & (F.col("k") == F.col("n"))
    return files.agg(F.sum("n").alias("records"), F.bool_and(whole).alias("without_gaps"), F.sum("p").alias("with_parent"), F.sum("nodes").cast("bigint").alias("nodes"))
