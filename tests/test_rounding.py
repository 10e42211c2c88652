import random

from pyspark.sql import functions as F

from tidemark.functions.scores import fixed, fixed3_sql, percent, round_exact


def test_rounding_is_that_of_printf(spark):
    random.seed(7)
    values = [0.0625, 0.0375, 0.0125, 1.0, 2.5, 3.0005, 0.1235, 0.0] + [random.random() * 3 for _ in range(3000)] + [k / 2000 for k in range(2001)]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    v = F.col("v")
    for r in df.select("v", round_exact(v, 3).alias("a"), round_exact(v, 6).alias("b"), fixed(v, 3).alias("c"), F.expr(fixed3_sql("v")).alias("d"),
                       percent(v).alias("e")).collect():
        assert (r.a, r.b, r.c, r.d, r.e) == (round(r.v, 3), round(r.v, 6), f"{r.v:.3f}", f"{r.v:.3f}", f"{r.v:.0%}")
