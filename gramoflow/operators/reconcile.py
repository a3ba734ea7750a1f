"""Repeated exports against what is known: multiset and id-with-hints matching (REC-01..07, JOI-14, JOI-15, SET-05)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def multiset(rows: DataFrame, known: DataFrame) -> DataFrame:
    """rows: row_number, identity_key, content_hash, invalid; known: entry_id, identity_key, content_hash
    -> row_number, class, entry_id, candidates.

    Equal (key, hash) pairs are matched one to one: both sides are numbered within the pair and joined on the number. Rows
    left over are ambiguous if entries of their key are left over, else new."""
    pair = Window.partitionBy("identity_key", "content_hash")
    good = rows.filter(~F.coalesce("invalid", F.lit(False)))
    r = good.withColumn("rn", F.row_number().over(pair.orderBy("row_number")))
    e = known.withColumn("rn", F.row_number().over(pair.orderBy("entry_id")))
    matched = r.join(e.select("identity_key", "content_hash", "rn", "entry_id"), ["identity_key", "content_hash", "rn"], "left")
    left = known.join(matched.filter("entry_id IS NOT NULL").select("entry_id"), "entry_id", "left_anti")
    spare = left.groupBy("identity_key").agg(F.array_sort(F.collect_list("entry_id")).alias("candidates"))
    out = matched.join(spare, "identity_key", "left")
    cls = F.when(F.col("entry_id").isNotNull(), "existing").when(F.col("candidates").isNotNull(), "ambiguous").otherwise("new")
    out = out.select("row_number", cls.alias("class"), "entry_id", F.when(cls == "ambiguous", F.col("candidates")).otherwise(F.array().cast("array<bigint>")).alias("candidates"))
    bad = rows.filter(F.coalesce("invalid", F.lit(False))).select("row_number", F.lit("invalid").alias("class"), F.lit(None).cast("bigint").alias("entry_id"), F.array().cast("array<bigint>").alias("candidates"))
    return out.unionByName(bad)


def by_hints(rows: DataFrame, known: DataFrame) -> DataFrame:
    """rows: row_number, external_id, content_hash, hints, invalid; known: entry_id, external_id, content_hash, hints
    -> row_number, class, entry_id, candidates."""
    none = F.array().cast("array<bigint>")
    good = rows.filter(~F.coalesce("invalid", F.lit(False)))
    e = known.filter("external_id IS NOT NULL").select("external_id", F.col("entry_id").alias("_e"), F.col("content_hash").alias("_h"), F.col("hints").alias("_hints"))
    same = good.join(e, "external_id", "left")
    shared = F.coalesce(F.arrays_overlap("hints", "_hints"), F.lit(False))
    by_id = same.filter("_e IS NOT NULL").select(
        "row_number",
        F.when(F.col("_h") == F.col("content_hash"), "existing").when(shared, "changed").otherwise("ambiguous").alias("class"),
        F.when((F.col("_h") == F.col("content_hash")) | shared, F.col("_e")).alias("entry_id"),
        F.when((F.col("_h") == F.col("content_hash")) | shared, none).otherwise(F.array("_e")).alias("candidates"),
    )
    strange = same.filter("_e IS NULL").select("row_number", "hints")
    present = good.filter("external_id IS NOT NULL").select("external_id").distinct()
    absent = known.join(present, "external_id", "left_anti").select("entry_id", F.explode("hints").alias("hint"))
    found = strange.select("row_number", F.explode("hints").alias("hint")).join(absent, "hint").groupBy("row_number").agg(F.array_sort(F.collect_set("entry_id")).alias("candidates"))
    rest = strange.join(found, "row_number", "left").select(
        "row_number", F.when(F.col("candidates").isNotNull(), "ambiguous").otherwise("new").alias("class"), F.lit(None).cast("bigint").alias("entry_id"), F.coalesce("candidates", none).alias("candidates")
    )
    bad = rows.filter(F.coalesce("invalid", F.lit(False))).select("row_number", F.lit("invalid").alias("class"), F.lit(None).cast("bigint").alias("entry_id"), none.alias("candidates"))
    return by_id.unionByName(rest).unionByName(bad)


def missing(known: DataFrame, result: DataFrame, count_candidates: bool = False) -> DataFrame:
    """entry_id of the entries that no row used (and, if asked, that no row may mean)."""
    used = result.filter("entry_id IS NOT NULL").select("entry_id")
    if count_candidates:
        used = used.unionByName(result.select(F.explode("candidates").alias("entry_id")))
    return known.select("entry_id").join(used.distinct(), "entry_id", "left_anti")


def hints(location: Column, size: Column, artist: Column, title: Column, mix: Column, seconds: Column) -> Column:
    """Fingerprints of a file: where it is and how large, and what it says (REC-04)."""
    from gramoflow.functions.text import norm_key

    loc = F.when(location.isNotNull() & size.isNotNull(), F.concat(F.lit("loc:"), location, F.lit("|"), size.cast("string")))
    meta = F.when(seconds.isNotNull(), F.concat(F.lit("meta:"), F.concat_ws("|", norm_key(artist), norm_key(title), norm_key(mix), seconds.cast("string"))))
    return F.array_compact(F.array(loc, meta))


def decide_links(result: DataFrame, group: str) -> DataFrame:
    """row_number, entry_id: each ambiguous row takes its first free candidate, in row order (REC-05).

    Rows compete only within a group (the identity key), so groups run in parallel; a group's rows are one key's copies."""
    import pandas as pd

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        taken: set[int] = set()
        out = []
        for r in pdf.sort_values("row_number").itertuples():
            free = next((c for c in r.candidates if c not in taken), None)
            if free is not None:
                taken.add(free)
                out.append((r.row_number, free))
        return pd.DataFrame(out, columns=["row_number", "entry_id"]).astype("int64")

    return result.filter("class = 'ambiguous'").select("row_number", group, "candidates").groupBy(group).applyInPandas(run, "row_number bigint, entry_id bigint")


def same_file(batches: DataFrame, sha256: str) -> DataFrame:
    """The latest committed batch with this file (REC-07)."""
    return batches.filter((F.col("sha256") == sha256) & (F.col("status") == "committed")).orderBy(F.col("committed_at").desc(), "batch_id").limit(1)


def matched(rows: DataFrame, catalog: DataFrame, ext: str, dim_id: str, dim_ext: str, name: str = "catalog_id") -> DataFrame:
    """rows with the catalog's id of their external id, null where it has none (REC-06)."""
    d = catalog.select(F.col(dim_ext).alias("_x"), F.col(dim_id).alias(name))
    return rows.join(d, F.col(ext) == F.col("_x"), "left").drop("_x")


def preview(result: DataFrame, rows: DataFrame | None = None, absent: DataFrame | None = None, by: list[str] | None = None) -> DataFrame:
    """Counts (QRY-24), in one row or one for each ``by``: total and by class; with rows (row_number, target, warnings,
    catalog_id) also physical, digital, with warnings and matched with the catalog; with absent (by) the entries missing
    from the export."""
    names, by = ("new", "existing", "changed", "ambiguous", "invalid"), by or []
    counts = [F.count("*").alias("total"), *[F.count_if(F.col("class") == n).alias(n) for n in names]]
    if rows is not None:
        result = result.join(rows, "row_number", "left")
        counts += [F.count_if(F.col("target") == t).alias(t) for t in ("physical", "digital")]
        counts += [F.count_if(F.size("warnings") > 0).alias("with_warnings"), F.count_if(F.col("catalog_id").isNotNull()).alias("matched_catalog")]
    out = result.groupBy(*by).agg(*counts)
    if absent is not None:
        gone = absent.groupBy(*by).agg(F.count("*").alias("_gone"))
        out = (out.join(gone, by, "left") if by else out.join(gone)).withColumn("missing_from_export", F.coalesce("_gone", F.lit(0))).drop("_gone")  # without by one row each
    return out
