"""Descriptive profiles of columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from surveyqc.functions.columns import long_form, percent
from surveyqc.functions.quantiles import with_quantiles


def summary_stats(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """column_name, n, missing, missing_pct (1 dp), mean, median, std, min, max, q1, q3 (midpoints), skewness (n >= 3), kurtosis (n >= 4; excess), 4 dp."""
    cells = long_form(df, [], names)
    v = F.col("value")
    plain = cells.groupBy("column_name").agg(
        F.count(v).alias("n"), F.count_if(v.isNull()).alias("missing"), F.round(percent(F.count_if(v.isNull()), F.count("*")), 1).alias("missing_pct"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"), F.min(v).alias("min"), F.max(v).alias("max"),
        F.when(F.count(v) >= 3, F.skewness(v)).alias("skewness"), F.when(F.count(v) >= 4, F.kurtosis(v)).alias("kurtosis"),
    )
    found = with_quantiles(plain, cells, ["column_name"], "value", {"median": 0.5, "q1": 0.25, "q3": 0.75}, "midpoint")
    return found.select("column_name", "n", "missing", "missing_pct", *[F.round(k, 4).alias(k) for k in ("mean", "median", "std", "min", "max", "q1", "q3", "skewness", "kurtosis")])


def histogram(df: DataFrame, column: str, bins: int = 20) -> DataFrame:
    """bin, low, high, n of equal-width bins, empty ones too; the last one has its upper border."""
    v = df.select(F.col(column).try_cast("double").alias("v")).where("v IS NOT NULL")
    span = v.agg(F.min("v").alias("a"), F.max("v").alias("b")).where("a IS NOT NULL")
    span = span.select(F.when(F.col("a") == F.col("b"), F.col("a") - 0.5).otherwise(F.col("a")).alias("a"), F.when(F.col("a") == F.col("b"), F.col("b") + 0.5).otherwise(F.col("b")).alias("b"))
    width = (F.col("b") - F.col("a")) / bins
    counted = v.crossJoin(F.broadcast(span)).select(F.least(F.floor((F.col("v") - F.col("a")) / width), F.lit(bins - 1)).cast("int").alias("bin")).groupBy("bin").agg(F.count("*").alias("n"))  # one row
    spine = span.select("a", width.alias("w"), F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    return spine.join(counted, "bin", "left").select("bin", (F.col("a") + F.col("bin") * F.col("w")).alias("low"), (F.col("a") + (F.col("bin") + 1) * F.col("w")).alias("high"), F.coalesce("n", F.lit(0)).alias("n"))


def value_counts(df: DataFrame, column: str, n: int = 20) -> DataFrame:
    """The n most frequent values (null is one) and their % of all rows, 1 dp."""
    by = df.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))
    return by.crossJoin(by.agg(F.sum("n").alias("all_"))).select("value", "n", F.round(percent(F.col("n"), F.col("all_")), 1).alias("pct")).orderBy(F.desc("n"), F.asc_nulls_last("value")).limit(n)  # one row


def codebook(df: DataFrame, names: Sequence[str] | None = None, samples: int = 5) -> DataFrame:
    """column_name, type, n, missing, n_distinct (null counts as one), the first sample values in order.

    Cells are counted by value before anything is ranked, and each column's smallest values are found by partial aggregates.
    """
    names = list(names or df.columns)
    types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    cells = long_form(df, [], names, "string").groupBy("column_name", "value").agg(F.count("*").alias("n"))
    counted = cells.groupBy("column_name").agg(F.sum(F.when(F.col("value").isNotNull(), F.col("n")).otherwise(0)).alias("n"), F.sum(F.when(F.col("value").isNull(), F.col("n")).otherwise(0)).alias("missing"), F.count("*").alias("n_distinct"))
    salted = Window.partitionBy("column_name", F.pmod(F.xxhash64("value"), F.lit(64))).orderBy("value")
    few = cells.where("value IS NOT NULL").withColumn("nth_", F.row_number().over(salted)).where(F.col("nth_") <= samples)  # at most 64 x samples a column
    sample = few.groupBy("column_name").agg(F.slice(F.sort_array(F.collect_list("value")), 1, samples).alias("samples"))
    kinds = F.create_map(*[F.lit(x) for n in names for x in (n, types[n])])
    joined = counted.join(sample, "column_name", "left")
    return joined.select("column_name", F.element_at(kinds, F.col("column_name")).alias("type"), "n", "missing", "n_distinct", F.array_join(F.coalesce("samples", F.array().cast("array<string>")), ", ").alias("samples"))


def sample_values(df: DataFrame, column: str, n: int = 5) -> DataFrame:
    return df.select(F.col(column).alias("value")).where("value IS NOT NULL").distinct().orderBy("value").limit(n)
