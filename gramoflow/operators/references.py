"""References to records that do not exist.

The distinct non-null (key, period) pairs of a referring table go through a left anti join against what the parent
table holds at that period; the few pairs left get their reason and are joined back to the referring rows.

Parents come as a log of (id, period, live): a snapshot table is live only in its own period, a change log is live
from a row until the next row of that id. A parent key that holds a large share of all references costs nothing
special, as pairs are aggregated before the shuffle; the join back is broadcast if it takes a small share of the driver's
heap, as those of several tables are alive at once, else salted.

Cases: ids that are null, 0 or a listed placeholder are no reference; rows without period resolve nowhere and are
left out, as there is no period to report them under; rows delivered twice come out once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gramoflow.operators.scale import heap_share, sized_join, stage


def references(rows: DataFrame, rec_id: str, ref_id: str, period: str, placeholders: tuple[int, ...] = ()) -> DataFrame:
    """rec_id, period, ref_id of the rows that refer to something."""
    out = rows.select(F.col(rec_id).cast("bigint").alias("rec_id"), F.col(period).cast("string").alias("period"), F.col(ref_id).cast("bigint").alias("ref_id"))
    return out.filter(F.col("ref_id").isNotNull() & F.col("period").isNotNull() & ~F.col("ref_id").isin(0, *placeholders))


def snapshot_holdings(rows: DataFrame, key: str, period: str) -> DataFrame:
    """ref_id, since, until: what full copies hold. Each copy counts for its own period only."""
    return rows.filter(F.col(key).isNotNull()).select(F.col(key).cast("bigint").alias("ref_id"), F.col(period).cast("string").alias("since")).distinct().withColumns({"until": F.col("since"), "live": F.lit(True)})


def log_holdings(rows: DataFrame, key: str, period: str, order: str, deleted) -> DataFrame:
    """ref_id, since, until, live: a log's newest row holds until the next one; of rows of one period the last counts."""
    log = rows.filter(F.col(key).isNotNull() & F.col(period).isNotNull()).select(
        F.col(key).cast("bigint").alias("ref_id"), F.col(period).cast("string").alias("since"), F.struct(F.col(order).alias("o"), F.coalesce(deleted, F.lit(False)).alias("dead")).alias("s")
    )
    last = log.groupBy("ref_id", "since").agg(F.max("s").alias("s"))
    until = F.lead("since").over(Window.partitionBy("ref_id").orderBy("since"))
    return last.select("ref_id", "since", until.alias("next"), (~F.col("s.dead")).alias("live"))


def orphans(refs: DataFrame, holdings: DataFrame, snapshot: bool) -> DataFrame:
    """rec_id, period, ref_id, reason of the references that do not resolve at their period."""
    pairs = refs.select("ref_id", "period").distinct()
    if snapshot:
        held = holdings.select("ref_id", F.col("since").alias("period"))
        left = pairs.join(held, ["ref_id", "period"], "left_anti")
    else:
        p, h = pairs.alias("p"), holdings.filter("live").alias("h")
        span = (F.col("p.ref_id") == F.col("h.ref_id")) & (F.col("p.period") >= F.col("h.since")) & (F.col("h.next").isNull() | (F.col("p.period") < F.col("h.next")))
        left = p.join(h, span, "left_anti")
    first = holdings.groupBy("ref_id").agg(F.min("since").alias("first"))
    reason = F.when(F.col("first").isNull(), "missing").when(F.col("first") <= F.col("period"), "deleted").otherwise("later")
    explained = stage(left.join(first, "ref_id", "left").select("ref_id", "period", reason.alias("reason")), "orphans")
    return sized_join(refs, explained, ["ref_id", "period"], size=heap_share(refs.sparkSession)).select("rec_id", "period", "ref_id", "reason").distinct()


def counts(found: DataFrame) -> DataFrame:
    """ref_table, period, reason, n_records, n_targets of the orphans of any number of tables."""
    return found.groupBy("ref_table", "period", "reason").agg(F.count("*").alias("n_records"), F.count_distinct("ref_id").alias("n_targets"))
