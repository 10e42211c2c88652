"""The skew helpers give the same rows with hot keys as plain joins and windows do."""

from pyspark.sql import Window, functions as F

from tidemark.operators.skew import exact_median, hot_keys, salted_join, totals_before


def rows(spark, n=3000):
    # a third of all rows belong to key 0, some keys are null
    key = F.when(F.col("id") % 3 == 0, 0).when(F.col("id") % 50 == 1, None).otherwise(F.col("id") % 17)
    return spark.range(n).select(F.col("id"), key.cast("bigint").alias("k"), (F.col("id") * 7919 % 101).alias("v"))


def test_hot_keys_are_few(spark):
    counts = rows(spark).groupBy("k").agg(F.count("*").alias("n"))
    hot = {r.k: r["__salts"] for r in hot_keys(counts, ["k"], "n", rows_per_salt=200).collect()}
    assert hot[0] == 6 and len(hot) == 1


def test_salted_join_equals_join(spark):
    left = rows(spark)
    right = spark.range(10).select(F.col("id").alias("k"), (F.col("id") * 10).alias("w"))
    for how in ("inner", "left"):
        plain = left.join(right, "k", how).select("id", "k", "v", "w")
        salted = salted_join(left, right, ["k"], "id", how, rows_per_salt=100).select("id", "k", "v", "w")
        assert salted.exceptAll(plain).isEmpty() and plain.exceptAll(salted).isEmpty()


def test_rows_with_null_keys_stay_where_they_are(spark):
    left = spark.range(0, 4000, 1, 8).select("id", F.when(F.col("id") % 10 == 0, F.col("id") % 7).alias("k"))
    right = spark.range(5).select(F.col("id").alias("k"), (F.col("id") * 10).alias("w"))
    salted = salted_join(left, right, ["k"], "id", "left", rows_per_salt=50)
    plain = left.join(right, "k", "left").select(*salted.columns)
    assert salted.exceptAll(plain).isEmpty() and plain.exceptAll(salted).isEmpty()
    per_task = salted.where("k is null").groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]
    assert per_task <= 1000  # of 3600


def test_totals_before_equals_window(spark):
    df = rows(spark).where("k is not null").withColumn("bucket", F.floor(F.col("v") / 10))
    w = Window.partitionBy("k").orderBy("v", "id").rowsBetween(Window.unboundedPreceding, -1)
    want = df.withColumn("want", F.coalesce(F.sum("id").over(w), F.lit(0)))
    got = totals_before(want, ["k"], [["bucket"], ["v"], ["id"]], ["id"])
    assert got.where("id__before <> want").count() == 0 and got.count() == df.count()


def test_exact_median(spark):
    df = rows(spark).where("k is not null")
    want = {r.k: r.m for r in df.groupBy("k").agg(F.median("v").alias("m")).collect()}
    got = {r.k: r.median for r in exact_median(df, ["k"], "v", 10.0).collect()}
    assert got == want
    assert exact_median(df, [], "v", 10.0).first().median == df.agg(F.median("v")).first()[0]
