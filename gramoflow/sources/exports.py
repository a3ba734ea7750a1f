"""User exports: delimited collection files and DJ-library XML (SRC-08, 10, 11, 12; QRY-26)."""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gramoflow.functions import parsing, text
from gramoflow.operators import error_parse
from gramoflow.operators.reconcile import hints
from gramoflow.sources.guards import refuse_unsafe

# Header names of each field, compared without case, spaces and underscores.
COLLECTION_COLUMNS = {
    "catno": ("catalog#", "catalognumber", "catno", "catalog"), "artist": ("artist", "artists"), "title": ("title",), "label": ("label", "labels"), "format_raw": ("format", "formats"), "rating": ("rating",), "released": ("released", "year"), "release_id": ("releaseid", "discogsreleaseid"),
    "folder": ("collectionfolder", "folder"), "date_added": ("dateadded", "added"), "media": ("collectionmediacondition", "mediacondition"), "sleeve": ("collectionsleevecondition", "sleevecondition"), "notes": ("collectionnotes", "notes"),
}


_CELL = r'(?:"(?:[^"]+|"")*+"[^,\r\n]*+|[^,\r\n]*+)'
_RECORD = re.compile(rf"({_CELL}(?:,{_CELL})*+)(?:\r\n|[\r\n]|\Z)")


def split_records(texts: DataFrame) -> DataFrame:
    """file_id, content -> file_id, row_number, raw_text: records of delimited files; line ends inside quotes stay, blank lines go.

    Line ends may be CRLF, LF or CR; row 0 is the header. A quote opens a value only at its start; elsewhere it is text, so
    that it spoils its own record only. A value whose quote never ends is taken as unquoted: its line is the record, which
    ``error_parse`` reports, and the lines behind it are read."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows: list[tuple[int, int, str]] = []
            for fid, body in zip(pdf["file_id"], pdf["content"], strict=True):
                body, no = (body or "").removeprefix("\ufeff"), 0
                for m in _RECORD.finditer(body):
                    if m.group(1).strip():
                        rows.append((fid, no, m.group(1)))
                        no += 1
                        if len(rows) > 50_000:
                            yield pd.DataFrame(rows, columns=["file_id", "row_number", "raw_text"])
                            rows = []
            yield pd.DataFrame(rows, columns=["file_id", "row_number", "raw_text"])

    return texts.select(F.col("file_id").cast("bigint"), "content").mapInPandas(run, "file_id bigint, row_number bigint, raw_text string")


def collection_rows(records: DataFrame) -> DataFrame:
    """Parsed rows of collection exports with errors, warnings, identity key, content hash and the columns nobody knows.

    records: file_id, row_number, raw_text."""
    parsed = error_parse.error_parse(records)
    col = lambda f: F.coalesce(*[error_parse.cell(a) for a in COLLECTION_COLUMNS[f]])
    known = [a for names in COLLECTION_COLUMNS.values() for a in names]
    others = F.map_from_entries(F.transform(F.filter(F.arrays_zip("header", "cells"), lambda x: ~x["header"].isin(*known)), lambda x: F.struct(x["header"], x["cells"])))
    fields = parsed.select(
        "file_id", "row_number", "reason", "edits",
        F.when(F.lower(col("catno")) != "none", col("catno")).alias("catno"), *[col(f).alias(f) for f in ("artist", "title", "label", "format_raw", "rating", "folder", "notes")],
        parsing.year_in(col("released"), 1900, 2100).alias("released"), col("release_id").alias("release_id"), parsing.date_added(col("date_added")).alias("date_added"),
        parsing.grade(col("media")).alias("media_condition"), parsing.grade(col("sleeve")).alias("sleeve_condition"), parsing.typed_format_group(col("format_raw")).alias("format_group"),
        F.array_compact(F.array(F.when(~parsing.grade_is_known(col("media")), "media condition"), F.when(~parsing.grade_is_known(col("sleeve")), "sleeve condition"))).alias("warnings"),
        F.when(F.col("reason").isNull(), others).alias("others"),
    )
    hashed = ("catno", "artist", "title", "label", "format_raw", "released", "release_id", "folder", "media_condition", "sleeve_condition", "notes")
    ident = text.identity_key(F.col("release_id"), F.col("artist"), F.col("title"), F.col("catno"))
    return fields.withColumn("others_text", F.to_json("others")).withColumn("content_hash", text.content_hash(*hashed, "others_text")).withColumn("identity_key", ident).drop("others_text").withColumn(
        "target", F.when(F.col("format_group") == "Digital", "digital").otherwise("physical")
    )


_TRACK_SCHEMA = (
    "_TrackID string, _Name string, _Artist string, _Mix string, _Album string, _Label string, _Genre string, _Tonality string, _Comments string, _Year string, _AverageBpm string, _Rating string, _Kind string, _Location string, "
    "_Size string, _TotalTime string, _BitRate string, _SampleRate string, _PlayCount string, _DateAdded string, _Key string, "
    "TEMPO array<struct<_Inizio:string,_Bpm:string,_Metro:string,_Battito:string>>, POSITION_MARK array<struct<_Name:string,_Type:string,_Start:string,_End:string,_Num:string>>"
)


def _file(c: Column) -> Column:
    """A path as the readers agree on it: they differ in the slashes behind the scheme."""
    return F.regexp_replace(c, "^([a-z0-9]+):/+", "$1:/")


def dj_tracks(spark: SparkSession, path: str) -> DataFrame:
    """Tracks of DJ-library files: typed fields, beat grid and cues, fingerprints, errors."""
    refuse_unsafe(spark, path)
    raw = spark.read.format("xml").option("rowTag", "TRACK").schema(_TRACK_SCHEMA).load(path).filter("_TrackID IS NOT NULL").withColumn("source_file", _file(F.input_file_name()))
    b = lambda c: text.blank_to_null(F.col(c))
    location = parsing.location_path(b("_Location"))
    title = F.coalesce(b("_Name"), F.nullif(F.regexp_extract(F.coalesce(location, F.lit("")), r"([^/]+?)(?:\.[A-Za-z0-9]{2,5})?$", 1), F.lit("")))
    seconds = parsing.whole_number(F.col("_TotalTime"))
    out = raw.select(
        "source_file", F.col("_TrackID").alias("external_id"), title.alias("title"), F.coalesce(b("_Artist"), F.lit("Unknown artist")).alias("artist"), b("_Mix").alias("mix"), b("_Album").alias("album"), b("_Label").alias("label"), b("_Genre").alias("genre"),
        b("_Tonality").alias("tonality"), b("_Comments").alias("comments"), parsing.year_in(F.col("_Year"), 1900, 2100).alias("year"), parsing.bpm_x100(F.col("_AverageBpm")).alias("bpm_x100"), parsing.stars(F.col("_Rating")).alias("rating"),
        parsing.file_format(F.col("_Kind"), location).alias("file_format"), location.alias("location"), *[parsing.whole_number(F.col(f"_{c}")).alias(n) for c, n in (("Size", "size"), ("BitRate", "bit_rate"), ("SampleRate", "sample_rate"), ("PlayCount", "play_count"))],
        seconds.alias("seconds"), parsing.date_added(F.col("_DateAdded")).alias("date_added"), F.coalesce("TEMPO", F.array()).alias("tempos"), F.coalesce("POSITION_MARK", F.array()).alias("cues"),
    )
    again = F.row_number().over(Window.partitionBy("source_file", "external_id").orderBy("title", "artist", "location")) > 1
    out = out.withColumn("errors", F.array_compact(F.array(F.when(again, "track id given twice"), F.when(F.col("title").isNull(), "no title"))))
    return out.withColumn("hints", hints(F.col("location"), F.col("size"), F.col("artist"), F.col("title"), F.col("mix"), F.col("seconds"))).withColumn("content_hash", text.content_hash("title", "artist", "mix", "album", "label", "genre", "year", "bpm_x100", "rating", "comments", "location"))


def playlists(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Playlist nodes (source_file, node, parent, pos, name, kind, key_type) and their entries (source_file, node, pos, key)."""
    refuse_unsafe(spark, path)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for name, body in zip(pdf["path"], pdf["content"], strict=True):
                root = ET.fromstring(body).find("PLAYLISTS")
                rows: list[tuple] = []
                top = list(root) if root is not None else []
                if len(top) == 1 and top[0].get("Name") == "ROOT":
                    top = list(top[0])
                todo = [(n, str(i + 1), None, i + 1) for i, n in enumerate(top)]
                while todo:
                    node, at, parent, pos = todo.pop()
                    leaf = node.get("Type") == "1"
                    rows.append((name, at, parent, pos, node.get("Name"), "playlist" if leaf else "folder", {"0": "id", "1": "location"}.get(node.get("KeyType") or "0", "id"), [t.get("Key") for t in node.findall("TRACK")] if leaf else []))
                    todo += [(c, f"{at}.{i + 1}", at, i + 1) for i, c in enumerate(node.findall("NODE"))]
                yield pd.DataFrame(rows, columns=["source_file", "node", "parent", "pos", "name", "kind", "key_type", "keys"])

    files = spark.read.format("binaryFile").load(path).select(_file(F.col("path")).alias("path"), "content")
    nodes = files.mapInPandas(run, "source_file string, node string, parent string, pos int, name string, kind string, key_type string, keys array<string>")
    entries = nodes.select("source_file", "node", "key_type", F.posexplode("keys").alias("p", "key")).withColumn("pos", F.col("p") + 1).drop("p")
    return nodes.drop("keys"), entries


def resolved_entries(entries: DataFrame, tracks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Entries whose track is known, renumbered within their playlist, and the unresolved ones (QRY-26)."""
    by = tracks.select("source_file", F.col("external_id").alias("_id"), F.col("location").alias("_loc"))
    keyed = by.select("source_file", F.lit("id").alias("key_type"), F.col("_id").alias("key"), F.col("_id").alias("track")).unionByName(by.filter("_loc IS NOT NULL").select("source_file", F.lit("location").alias("key_type"), F.col("_loc").alias("key"), F.col("_id").alias("track")))
    look = entries.withColumn("key", F.when(F.col("key_type") == "location", parsing.location_path(F.col("key"))).otherwise(F.col("key")))
    joined = look.join(keyed.groupBy("source_file", "key_type", "key").agg(F.min("track").alias("track")), ["source_file", "key_type", "key"], "left")
    good = joined.filter("track IS NOT NULL")
    return good.withColumn("position", F.row_number().over(Window.partitionBy("source_file", "node").orderBy("pos"))).select("source_file", "node", "position", "track"), joined.filter("track IS NULL").select("source_file", "node", "pos", "key")
