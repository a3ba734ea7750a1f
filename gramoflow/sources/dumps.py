"""Catalog dumps in XML as typed nested records and their flat tables (SRC-01, 03, 13, 16; MUT-02; WIN-08)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gramoflow.functions import parsing, text
from gramoflow.operators.scale import sized_join, stage
from gramoflow.sources import guards

CREDIT = "struct<id:string,name:string,anv:string,join:string,role:string,tracks:string>"
_LINKS = "struct<name:array<struct<_VALUE:string,_id:string>>>"
_TRACK = f"position:string,title:string,duration:string,artists:struct<artist:array<{CREDIT}>>,extraartists:struct<artist:array<{CREDIT}>>"
SCHEMAS = {
    "artist": f"id string, _id string, name string, realname string, profile string, data_quality string, urls struct<url:array<string>>, namevariations struct<name:array<string>>, aliases {_LINKS}, members {_LINKS}, groups {_LINKS}",
    "label": "id string, _id string, name string, profile string, contactinfo string, data_quality string, urls struct<url:array<string>>, parentLabel struct<_VALUE:string,_id:string>",
    "master": f"_id string, id string, main_release string, title string, year string, data_quality string, notes string, artists struct<artist:array<{CREDIT}>>, genres struct<genre:array<string>>, styles struct<style:array<string>>",
    "release": (
        "_id string, id string, _status string, title string, released string, country string, notes string, data_quality string, master_id struct<_VALUE:string,_is_main_release:string>, "
        f"artists struct<artist:array<{CREDIT}>>, extraartists struct<artist:array<{CREDIT}>>, "
        "labels struct<label:array<struct<_name:string,_catno:string,_id:string>>>, series struct<series:array<struct<_name:string,_catno:string,_id:string>>>, "
        "companies struct<company:array<struct<id:string,name:string,catno:string,entity_type:string,entity_type_name:string>>>, "
        "formats struct<format:array<struct<_name:string,_qty:string,_text:string,descriptions:struct<description:array<string>>>>>, "
        "genres struct<genre:array<string>>, styles struct<style:array<string>>, "
        f"tracklist struct<track:array<struct<{_TRACK},sub_tracks:struct<track:array<struct<{_TRACK}>>>>>>, "
        "identifiers struct<identifier:array<struct<_type:string,_value:string,_description:string>>>, videos struct<video:array<struct<_src:string,title:string>>>"
    ),
}
# Elements a dump's record may repeat.
RECORDS = {"artists": "artist", "labels": "label", "masters": "master", "releases": "release"}


def read_dump(spark: SparkSession, path: str, record: str, checked: bool = True, most_text: int = guards.MOST_TEXT) -> DataFrame:
    """The records of a dump with record_index (their place within the file, from 0), source_file, corrupt (what could not
    be read), n_nodes, and clipped (whether a text was cut to most_text characters).

    A document type is refused before anything is read. Record types hold no element below a fixed depth, so that a record's
    depth is bounded by its schema."""
    if checked:
        guards.refuse_unsafe(spark, path)
    schema = f"{SCHEMAS[record]}, _corrupt string"
    raw = spark.read.format("xml").option("rowTag", record).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").schema(schema).load(path)
    fields = [f for f in raw.schema.fields if f.name != "_corrupt"]
    whole, kind = F.struct(*[F.col(f.name) for f in fields]), T.StructType(fields)
    long = guards.longest_text(whole, kind) > most_text
    cut = [F.when(long, guards.clipped_texts(F.col(f.name), f.dataType, most_text)).otherwise(F.col(f.name)).alias(f.name) for f in fields]
    out = raw.select(*cut, F.col("_corrupt").alias("corrupt"), guards.node_count(whole, kind).alias("n_nodes"), long.alias("clipped"), F.input_file_name().alias("source_file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_at"))
    return _numbered(stage(out, "dump"))


def _numbered(records: DataFrame) -> DataFrame:
    """record_index from the order within a file's blocks and the counts of the blocks before: no task sees a whole file."""
    of_file = Window.partitionBy("source_file").orderBy("_block")
    before = records.groupBy("source_file", "_block").agg(F.count("*").alias("_n"))  # one row a block
    before = before.withColumn("_first", F.sum("_n").over(of_file) - F.col("_n")).drop("_n")
    placed = records.withColumn("_in", F.row_number().over(Window.partitionBy("source_file", "_block").orderBy("_at")))
    return sized_join(placed, before, ["source_file", "_block"]).withColumn("record_index", F.col("_first") + F.col("_in") - 1).drop("_first", "_in", "_block", "_at")


def record_id(df: DataFrame) -> Column:
    """The id from the attribute or the element."""
    parts = [F.nullif(F.trim(F.col(c)), F.lit("")) for c in ("_id", "id") if c in df.columns]
    return F.coalesce(*parts)


def checked_records(df: DataFrame, required: str) -> tuple[DataFrame, DataFrame]:
    """Valid records with their numeric ``ext_id``, and errors (record_index, source_file, id, reason)."""
    rid = record_id(df)
    number = parsing.external_id(rid)
    reason = (
        F.when(F.col("corrupt").isNotNull(), "malformed record")
        .when(F.col("n_nodes") > guards.MOST_NODES, "too many nodes")
        .when(rid.isNull(), "no id")
        .when(number.isNull(), F.coalesce(parsing.external_id_error(rid), F.lit("id 0")))
        .when(text.blank_to_null(F.col(required)).isNull(), f"no {required}")
    )
    judged = df.withColumn("ext_id", number).withColumn("_reason", reason).withColumn("_rid", rid)
    errors = judged.filter("_reason IS NOT NULL").select("record_index", "source_file", F.col("_rid").alias("id"), F.col("_reason").alias("reason"))
    return judged.filter("_reason IS NULL").drop("_reason", "_rid", "corrupt"), errors


def children(records: DataFrame, items: str, keep: dict[str, str]) -> DataFrame:
    """ext_id, position and the named fields of a list inside each record, null elements left out."""
    flat = records.select("ext_id", F.posexplode(F.expr(items)).alias("p", "x")).filter("x IS NOT NULL")
    return flat.select("ext_id", (F.col("p") + 1).alias("position"), *[text.blank_to_null(F.col("x").getField(f)).alias(n) for n, f in keep.items()])


def credits(records: DataFrame, items: str) -> DataFrame:
    """ext_id, position, artist_ext_id, name, anv, join_text, role, tracks."""
    flat = children(records, items, {"artist_id": "id", "name": "name", "anv": "anv", "join_text": "join", "role": "role", "tracks": "tracks"})
    return flat.withColumn("artist_ext_id", parsing.external_id(F.col("artist_id"))).drop("artist_id")


def tracks(releases: DataFrame) -> DataFrame:
    """ext_id, sequence (pre-order), parent_sequence, track_type, position, title, duration, seconds."""
    top = releases.select("ext_id", F.posexplode("tracklist.track").alias("p", "t")).filter("t IS NOT NULL")
    subs = F.coalesce(F.filter("t.sub_tracks.track", lambda s: s.isNotNull()), F.array())
    head = F.struct(F.lit(0).alias("s"), F.col("t.position").alias("position"), F.col("t.title").alias("title"), F.col("t.duration").alias("duration"))
    tail = F.transform(subs, lambda x, i: F.struct((i + 1).alias("s"), x["position"].alias("position"), x["title"].alias("title"), x["duration"].alias("duration")))
    rows = top.select("ext_id", "p", (F.size(subs) > 0).alias("has_sub"), F.explode(F.concat(F.array(head), tail)).alias("x"))
    kept = rows.filter("coalesce(trim(x.title), '') <> '' OR coalesce(trim(x.position), '') <> ''")
    w = Window.partitionBy("ext_id").orderBy("p", "x.s")
    numbered = kept.withColumn("sequence", F.row_number().over(w))
    parent = F.max(F.when(F.col("x.s") == 0, F.col("sequence"))).over(Window.partitionBy("ext_id", "p"))
    kind = parsing.track_type(F.col("has_sub") & (F.col("x.s") == 0), F.col("x.s") > 0, F.col("x.position"), F.col("x.duration"))
    return numbered.select("ext_id", "sequence", F.when(F.col("x.s") > 0, parent).alias("parent_sequence"), kind.alias("track_type"), "x.position", "x.title", "x.duration", parsing.duration_seconds(F.col("x.duration")).alias("seconds"))


def formats(releases: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Formats (ext_id, position, name, qty, note, format_group) and their descriptions (ext_id, position, description_no, description)."""
    flat = releases.select("ext_id", F.posexplode("formats.format").alias("p", "x")).filter("x IS NOT NULL")
    f = flat.select("ext_id", (F.col("p") + 1).alias("position"), F.col("x._name").alias("name"), parsing.whole_number(F.col("x._qty")).alias("qty"), text.blank_to_null(F.col("x._text")).alias("note"), parsing.format_group(F.col("x._name")).alias("format_group"))
    d = flat.select("ext_id", (F.col("p") + 1).alias("position"), F.posexplode("x.descriptions.description").alias("i", "description"))
    return f, d.select("ext_id", "position", (F.col("i") + 1).alias("description_no"), "description")


def release_tables(releases: DataFrame) -> dict[str, DataFrame]:
    """The flat tables of valid releases by name."""
    f, d = formats(releases)
    label = F.get("labels.label", F.lit(0))
    code = F.when(F.lower(F.trim(label["_catno"])) != "none", text.blank_to_null(label["_catno"]))
    main = releases.select(
        "ext_id", "title", text.normalize_name(F.col("title")).alias("normalized_title"), F.col("_status").alias("status"), "released", parsing.year_in(F.col("released"), 1850, 2100, at_start=True).alias("year"), "country",
        parsing.external_id(F.col("master_id._VALUE")).alias("master_ext_id"), F.coalesce(F.col("master_id._is_main_release") == "true", F.lit(False)).alias("is_main"), label["_name"].alias("label_name"), code.alias("catalog_number"), text.normalize_code(code).alias("catalog_number_norm"),
    )
    videos = children(releases, "videos.video", {"src": "_src", "title": "title"}).withColumn("video", parsing.video_id(F.col("src"))).filter("video IS NOT NULL").drop("src")
    ids = children(releases, "identifiers.identifier", {"type": "_type", "value": "_value", "description": "_description"}).withColumn("normalized_value", text.normalize_code(F.col("value")))
    link = lambda items: children(releases, items, {"label_id": "_id", "name": "_name", "catno": "_catno"}).withColumn("label_ext_id", parsing.external_id(F.col("label_id"))).drop("label_id").withColumn("catno_norm", text.normalize_code(F.col("catno")))
    companies = children(releases, "companies.company", {"company_id": "id", "name": "name", "catno": "catno", "entity_type": "entity_type", "role": "entity_type_name"}).withColumn("company_ext_id", parsing.external_id(F.col("company_id"))).drop("company_id")
    words = lambda items, name: releases.select("ext_id", F.posexplode(items).alias("p", name)).filter(f"{name} IS NOT NULL").select("ext_id", (F.col("p") + 1).alias("position"), name)
    return {
        "releases": main, "release_artists": credits(releases, "artists.artist"), "release_extra_artists": credits(releases, "extraartists.artist"), "release_labels": link("labels.label"), "release_series": link("series.series"),
        "release_companies": companies, "release_formats": f, "release_format_descriptions": d, "release_tracks": tracks(releases), "release_identifiers": ids, "release_media_links": videos,
        "release_genres": words("genres.genre", "genre"), "release_styles": words("styles.style", "style"),
    }
