from pyspark.sql import functions as F

from gramoflow.operators import scale


def test_salted_join_equals_plain_join(spark):
    big = spark.range(2000).select(F.when(F.col("id") % 3 == 0, 1).otherwise(F.col("id") % 50).alias("k"), "id")
    big = big.unionByName(spark.createDataFrame([(None, -1)], "k bigint, id bigint"))
    small = spark.range(40).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    for how in ("inner", "left", "left_semi", "left_anti"):
        plain = sorted(map(str, big.join(small, "k", how).collect()))
        assert sorted(map(str, scale.sized_join(big, small, ["k"], how, rows=0, salt=4).collect())) == plain
        assert sorted(map(str, scale.sized_join(big, small, ["k"], how).collect())) == plain


def test_stage_keeps_rows_and_schema(spark):
    df = spark.createDataFrame([(1, [("a", None)]), (2, None)], "i int, x array<struct<a:string,b:int>>")
    staged = scale.stage(df, "t")
    assert staged.schema == df.schema and sorted(map(str, staged.collect())) == sorted(map(str, df.collect()))
    assert scale.within(df, 2) and not scale.within(df, 1)
