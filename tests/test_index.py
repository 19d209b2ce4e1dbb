"""Dense row numbers over data whose range borders are sampled."""

from pyspark.sql import functions as F

from surveyqc.functions.columns import dense_index


def test_index_with_sampled_borders(spark):
    df = spark.range(300_000).withColumn("k", F.pmod(F.xxhash64("id"), F.lit(1 << 40)))
    got = dense_index(df, ["k"])
    row = got.agg(F.count("*"), F.count_distinct("index"), F.min("index"), F.max("index")).first()
    assert tuple(row) == (300_000, 300_000, 0, 299_999)
    wrong = got.alias("a").join(got.alias("b"), F.expr("a.index + 1 = b.index")).where("a.k > b.k").count()
    assert wrong == 0
