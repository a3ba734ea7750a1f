"""Nested records of the catalog and the documents of its search index (QRY-03, 07..10, FTS-01, SNK-04)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gramoflow.functions import ordering, text
from gramoflow.operators import relational
from gramoflow.operators.scale import stage


def with_children(parents: DataFrame, key: str, **children: tuple[DataFrame, list[str]]) -> DataFrame:
    """Each parent with arrays of its child rows: name = (child rows, their columns in sort order).

    Children are collected per parent before the join; a parent without any gets an empty array. A parent's children
    must fit into one row, as they do in the record itself."""
    out = parents
    for name, (rows, columns) in children.items():
        grouped = rows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*columns))).alias(name))
        out = out.join(grouped, key, "left").withColumn(name, F.coalesce(name, F.expr(f"cast(array() AS {grouped.schema[name].dataType.simpleString()})")))
    return out


def hierarchy(records: DataFrame, key: str, parent: str, name: str) -> DataFrame:
    """key, name, parent_name, children: each record with its parent's name and its sub-records' names in order (QRY-08)."""
    records = records.select(key, name, parent)
    up = records.select(F.col(key).alias("_p"), F.col(name).alias("parent_name"))
    down = records.filter(F.col(parent).isNotNull()).groupBy(F.col(parent).alias("_c")).agg(F.array_sort(F.collect_list(F.struct(F.col(name).alias("n"), F.col(key).alias("i")))).alias("_s"))
    joined = records.join(up, F.col(parent) == F.col("_p"), "left").join(down, F.col(key) == F.col("_c"), "left")
    return joined.select(key, name, "parent_name", F.transform(F.coalesce("_s", F.expr("cast(array() AS array<struct<n:string,i:bigint>>)")), lambda x: x["n"]).alias("children"))


def contributions(credits: DataFrame, artist: str, owner: str, role: str) -> DataFrame:
    """artist, owner, role: what an artist took part in, "Main artist" where no role is given (QRY-07)."""
    return credits.filter(F.col(artist).isNotNull()).select(artist, owner, F.coalesce(text.blank_to_null(F.col(role)), F.lit("Main artist")).alias("role")).distinct()


def _joined(*parts: Column) -> Column:
    return F.concat_ws(" ", *parts)


def release_documents(releases: DataFrame, credits: DataFrame, codes: DataFrame, labels: DataFrame) -> DataFrame:
    """ext_id, title, people, codes, extra: what the index holds of a release (FTS-01).

    releases: ext_id, title, year, country, format; credits: ext_id, credit; codes: ext_id, code; labels: ext_id, name."""
    people = credits.groupBy("ext_id").agg(_joined(F.array_sort(F.collect_set("credit"))).alias("people"))
    both = codes.filter("code IS NOT NULL").select("ext_id", F.explode(F.array_compact(F.array("code", text.normalize_code(F.col("code"))))).alias("c"))
    code = both.groupBy("ext_id").agg(_joined(F.array_sort(F.collect_set("c"))).alias("codes"))
    names = labels.groupBy("ext_id").agg(_joined(F.array_sort(F.collect_set("name"))).alias("names"))
    out = releases.join(people, "ext_id", "left").join(code, "ext_id", "left").join(names, "ext_id", "left")
    return out.select("ext_id", "title", F.coalesce("people", F.lit("")).alias("people"), F.coalesce("codes", F.lit("")).alias("codes"), _joined("names", F.col("year").cast("string"), "country", "format").alias("extra"))


def master_documents(masters: DataFrame, credits: DataFrame) -> DataFrame:
    """ext_id, title, people, codes, extra of masters: their credits, and genres, styles and year as the rest (FTS-01).

    masters: ext_id, title, year, genres, styles array<string>; credits: ext_id, credit."""
    people = credits.groupBy("ext_id").agg(_joined(F.array_sort(F.collect_set("credit"))).alias("people"))
    listed = lambda c: F.array_compact(F.coalesce(c, F.array().cast("array<string>")))
    return masters.join(people, "ext_id", "left").select("ext_id", "title", F.coalesce("people", F.lit("")).alias("people"), F.lit("").alias("codes"), _joined(listed(F.col("genres")), listed(F.col("styles")), F.col("year").cast("string")).alias("extra"))


def browse(releases: DataFrame, hits: DataFrame | None = None, terms: DataFrame | None = None, wanted: list[str] = (), every: bool = False, formats: list[str] = (), countries: list[str] = (), years: tuple[int | None, int | None] = (None, None), number: int = 1, size: int = 24, most_hits: int = 5_000) -> DataFrame:
    """work, title, n, year, total, truncated: one page of works, by title (QRY-01).

    releases: discogs_id, master_discogs_id, title, year, country, format_name; hits: discogs_id, score, the best of which
    count; terms: master_discogs_id, term. Empty conditions ask for nothing. total counts all works found, truncated tells
    that there were more hits than looked at."""
    truncated = F.lit(False)
    if hits is not None:
        best, more = relational.capped_candidates(hits, [F.col("score"), F.col("discogs_id")], most_hits)
        releases, truncated = releases.join(F.broadcast(best.select("discogs_id")), "discogs_id", "left_semi"), F.lit(more)  # most_hits rows
    if wanted:
        releases = relational.with_terms(releases, terms, "master_discogs_id", list(wanted), every)
    if formats:
        releases = releases.filter(F.col("format_name").isin(*formats))
    if countries:
        releases = releases.filter(F.col("country").isin(*countries))
    least, most = years
    if least is not None:
        releases = releases.filter(F.col("year") >= least)
    if most is not None:
        releases = releases.filter(F.col("year") <= most)
    work = F.coalesce(F.concat(F.lit("m"), "master_discogs_id"), F.concat(F.lit("r"), "discogs_id"))
    works = stage(releases.groupBy(work.alias("work")).agg(F.min_by("title", "discogs_id").alias("title"), F.count("*").alias("n"), F.min("year").alias("year")), "works")
    total = works.count()
    return ordering.page(works, [ordering.folded(F.col("title")), F.col("work")], number, size).select("work", "title", "n", "year", F.lit(total).cast("bigint").alias("total"), truncated.alias("truncated"))


def artist_documents(artists: DataFrame, most: int = 20) -> DataFrame:
    """ext_id, title, people, codes, extra of artists: name, then variations and aliases up to a number, then the real name.

    artists: ext_id, name, realname, variations array<string>, aliases array<string>."""
    listed = lambda c: F.slice(F.array_compact(F.coalesce(c, F.array().cast("array<string>"))), 1, most)
    return artists.select("ext_id", F.col("name").alias("title"), _joined(listed(F.col("variations")), listed(F.col("aliases"))).alias("people"), F.lit("").alias("codes"), F.coalesce("realname", F.lit("")).alias("extra"))
