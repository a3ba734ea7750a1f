from pyspark.sql import functions as F

from gramoflow.operators import references as ref
from gramoflow.operators import scale


def test_snapshot_and_log_reasons(spark):
    refs = spark.createDataFrame([(1, "d2", 10), (1, "d2", 10), (2, "d2", 11), (3, "d2", 12), (4, "d2", 13), (5, "d2", 0), (6, "d2", None), (7, None, 10), (8, "d2", 194), (9, "d3", 11)], "id bigint, day string, ref bigint")
    snaps = spark.createDataFrame([(10, "d2"), (10, "d1"), (11, "d1"), (11, "d3"), (12, "d3"), (None, "d2")], "k bigint, day string")
    r = ref.references(refs, "id", "ref", "day", (194,))
    got = {(x.rec_id, x.reason) for x in ref.orphans(r, ref.snapshot_holdings(snaps, "k", "day"), True).collect()}
    assert got == {(2, "deleted"), (3, "later"), (4, "missing")}
    log = spark.createDataFrame([(10, "d1", 1, False), (11, "d1", 2, False), (11, "d2", 3, True), (12, "d3", 4, False), (13, "d1", 5, None), (13, "d1", 6, True)], "k bigint, day string, load bigint, dead boolean")
    held = ref.log_holdings(log, "k", "day", "load", F.col("dead"))
    got = {(x.rec_id, x.reason) for x in ref.orphans(r, held, False).collect()}
    assert got == {(2, "deleted"), (3, "later"), (4, "deleted"), (9, "deleted")}


def test_empty_and_hot_key(spark):
    refs = spark.range(3000).select(F.col("id"), F.lit("d1").alias("day"), F.lit(5).cast("bigint").alias("ref"), F.lit("x").alias("reason"))
    empty = spark.createDataFrame([], "k bigint, day string")
    r = ref.references(refs, "id", "ref", "day")
    assert ref.orphans(r, ref.snapshot_holdings(empty, "k", "day"), True).groupBy("reason").count().collect()[0]["count"] == 3000
    assert ref.orphans(r.limit(0), ref.snapshot_holdings(empty, "k", "day"), True).count() == 0


def test_orphans_beyond_the_drivers_share_are_not_broadcast(spark, monkeypatch):
    refs = spark.range(3000).select("id", F.lit("d1").alias("day"), (F.col("id") % 900 + 1).alias("ref"))
    snaps = spark.createDataFrame([(i, d) for i in range(1, 700) for d in ("d1", "d2") if i % 3 or d == "d2"], "k bigint, day string")
    r, held = ref.references(refs, "id", "ref", "day"), ref.snapshot_holdings(snaps, "k", "day")
    plain = sorted(map(str, ref.orphans(r, held, True).collect()))
    monkeypatch.setattr(scale, "HEAP_SHARE", 1 << 40, raising=False)
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = ref.orphans(r, held, True)
        assert "Broadcast" not in out._jdf.queryExecution().executedPlan().toString()
        assert plain and sorted(map(str, out.collect())) == plain
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
