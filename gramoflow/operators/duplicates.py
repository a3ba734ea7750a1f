"""Duplicate candidates by explainable scores (SCL-19, SCL-20, QRY-05)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Points of each reason and the least score.
POINTS = {"same_code": 5, "similar_code": 2, "same_work": 1, "same_format": 2, "same_year": 1, "same_label": 1}
LEAST_SCORE, MOST = 2, 8


def score(a: str = "a", b: str = "b") -> tuple[Column, Column]:
    """(score, reasons) of two aliased records with code, work, format, country, year, label."""
    x, y = (lambda c: F.col(f"{a}.{c}")), (lambda c: F.col(f"{b}.{c}"))
    both = x("code").isNotNull() & y("code").isNotNull()
    same_code = both & (x("code") == y("code"))
    similar = both & ~same_code & ((F.levenshtein(x("code"), y("code")) == 1) | x("code").startswith(y("code")) | y("code").startswith(x("code")))
    work = F.coalesce(x("work") == y("work"), F.lit(False))
    form = work & F.coalesce(x("format").eqNullSafe(y("format")), F.lit(False)) & (F.coalesce(x("country"), F.lit("")) == F.coalesce(y("country"), F.lit("")))
    year = work & F.coalesce(x("year") == y("year"), F.lit(False))
    flags = {"same_code": same_code, "similar_code": similar, "same_work": work, "same_format": form, "same_year": year}
    base = sum((F.when(c, POINTS[n]).otherwise(0) for n, c in flags.items()), F.lit(0))
    label = (base >= LEAST_SCORE) & F.coalesce(x("label") == y("label"), F.lit(False))
    reasons = F.array_compact(F.array(*[F.when(c, n) for n, c in flags.items() if n != "same_work"], F.when(label, "same_label")))
    return base + F.when(label, POINTS["same_label"]).otherwise(0), reasons


def candidates(wanted: DataFrame, records: DataFrame, most: int = MOST) -> DataFrame:
    """wanted and records: id, code, work, format, country, year, label -> id, other, score, reasons: the best few of each wanted record.

    Blocks are the work and the prefix of the code without its last two signs, at least three long."""
    prefix = lambda c: F.substring(c, 1, 3)
    by_work = wanted.filter("work IS NOT NULL").select(F.col("id").alias("wid"), "work").join(records.select(F.col("id").alias("rid"), "work"), "work").select("wid", "rid")
    w = wanted.filter(F.length("code") >= 3).select(F.col("id").alias("wid"), prefix(F.col("code")).alias("p"), F.expr("left(code, greatest(3, length(code) - 2))").alias("begin"))
    by_code = w.join(records.filter(F.length("code") >= 3).select(F.col("id").alias("rid"), prefix(F.col("code")).alias("p"), "code"), "p").filter(F.expr("startswith(code, begin)")).select("wid", "rid")
    pool = by_work.unionByName(by_code).distinct().filter("wid <> rid")
    pairs = pool.join(wanted.alias("a"), F.col("a.id") == F.col("wid")).join(records.alias("b"), F.col("b.id") == F.col("rid"))
    total, reasons = score()
    scored = pairs.select(F.col("wid").alias("id"), F.col("rid").alias("other"), total.alias("score"), reasons.alias("reasons")).filter((F.col("score") >= LEAST_SCORE) & (F.size("reasons") > 0))
    best = F.row_number().over(Window.partitionBy("id").orderBy(F.col("score").desc(), "other"))
    return scored.withColumn("_r", best).filter(F.col("_r") <= most).drop("_r")
