"""Repeated ids and values."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from surveyqc.functions.columns import long_form, percent
from surveyqc.functions.skew import join_counted


def _with_counts(df: DataFrame, column: str) -> DataFrame:
    """df with rows_ (rows of the value) and n_ (0 for null). Counted before they are joined: a common value costs no large task."""
    counts = df.groupBy(column).agg(F.count("*").alias("rows_"), F.count(column).alias("n_"))
    return join_counted(df, column, counts, "rows_").where("rows_ > 1")


def id_duplicates(df: DataFrame, survey_id: str) -> DataFrame:
    """All rows of repeated ids with their count and its % of all rows. Null ids repeat too, but count 0."""
    total = df.agg(F.count("*").alias("all_"))
    found = _with_counts(df, survey_id).crossJoin(total)  # one row
    return found.withColumns({"duplicate_count": F.col("n_"), "duplicate_pct": percent(F.col("n_"), F.col("all_"))}).drop("rows_", "n_", "all_").orderBy(F.desc(survey_id), "duplicate_count")


def column_duplicates(df: DataFrame, column: str, ids: Sequence[str]) -> DataFrame:
    """ids, the column and its count for all rows whose value repeats; most frequent first."""
    found = _with_counts(df.select(*ids, column), column)
    return found.withColumn("duplicate_count", F.col("n_")).drop("rows_", "n_").orderBy(F.desc("duplicate_count"), column)


def nonblank_duplicates(df: DataFrame, column: str, ids: Sequence[str]) -> DataFrame:
    return column_duplicates(df.where(F.col(column).isNotNull() & (F.col(column).cast("string") != "")), column, ids)


def duplicate_statistics(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Columns checked, repeated rows over all of them, columns with and without any."""
    counts = long_form(df, [], names, "string").groupBy("column_name", "value").agg(F.count("*").alias("n"))
    by = counts.groupBy("column_name").agg(F.sum(F.when(F.col("n") > 1, F.col("n")).otherwise(0)).alias("n"))
    return by.agg(F.count("*").alias("columns_checked"), F.sum("n").alias("duplicate_rows"), F.count_if(F.col("n") > 0).alias("columns_with"), F.count_if(F.col("n") == 0).alias("columns_without"))


def id_duplicate_metrics(df: DataFrame, survey_id: str, resolved: DataFrame | None = None) -> DataFrame:
    """Rows of repeated ids, rows without an id, repeated ids that the corrected table no longer has."""
    repeated = df.groupBy(survey_id).agg(F.count("*").alias("n"))
    found = repeated.agg(F.sum(F.when(F.col(survey_id).isNotNull() & (F.col("n") > 1), F.col("n")).otherwise(0)).alias("duplicate_rows"), F.coalesce(F.sum(F.when(F.col(survey_id).isNull(), F.col("n"))), F.lit(0)).alias("missing_id"))
    if resolved is None:
        return found.withColumn("resolved", F.lit(0).cast("long"))
    left = resolved.groupBy(survey_id).agg(F.count("*").alias("left_")).where("left_ > 1")
    gone = repeated.where(F.col(survey_id).isNotNull() & (F.col("n") > 1)).join(left, survey_id, "left_anti")
    return found.crossJoin(gone.agg(F.count("*").alias("resolved")))  # one row


def dedupe_keep(df: DataFrame, survey_id: str, keep: str, order: Sequence[str]) -> DataFrame:
    """The first or last row of each id in a declared order, or (none) only ids that occur once."""
    if keep == "none":
        return anti_duplicates(df, survey_id)
    by = [F.asc_nulls_first(o) if keep == "first" else F.desc_nulls_last(o) for o in order]
    return df.withColumn("nth_", F.row_number().over(Window.partitionBy(survey_id).orderBy(*by))).where("nth_ = 1").drop("nth_")


def anti_duplicates(df: DataFrame, survey_id: str) -> DataFrame:
    repeated = df.groupBy(survey_id).agg(F.count("*").alias("n_")).where("n_ > 1").withColumnRenamed(survey_id, "value_")
    return df.join(repeated, F.col(survey_id).eqNullSafe(F.col("value_")), "left_anti")


def count_over(df: DataFrame, column: str, name: str = "count") -> DataFrame:
    """Rows of the row's value as a column (null values: 0)."""
    counts = df.groupBy(column).agg(F.count("*").alias("rows_"), F.count(column).alias(name))
    return join_counted(df, column, counts, "rows_").drop("rows_")


def is_duplicated(df: DataFrame, column: str, name: str = "is_duplicated") -> DataFrame:
    counts = df.groupBy(column).agg(F.count("*").alias("rows_"), (F.count("*") > 1).alias(name))
    return join_counted(df, column, counts, "rows_").drop("rows_")
