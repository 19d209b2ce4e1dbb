"""Joins with a row a key where some keys are in a large share of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from surveyqc.functions.shared import written


def join_counted(df: DataFrame, column: str, counts: DataFrame, rows: str) -> DataFrame:
    """df joined (null-safe) on its column with counts(column, ...), a row a value; `rows`: counts' column with the rows of the value.

    Values with over a quarter of an even partition are hot: four for each partition at most, so they are broadcast and their rows
    stay where they are. All other rows are shuffled by value, none of which can make a large task. So df is read twice where a value is hot.
    """
    told = written(counts.withColumnRenamed(column, "value_"), "value-rows")
    same = F.col(column).eqNullSafe(F.col("value_"))
    most = (told.agg(F.sum(rows)).first()[0] or 0) / (4 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    hot, cold = told.where(F.col(rows) > most), told.where(F.col(rows) <= most)
    if hot.isEmpty():
        return df.join(told, same).drop("value_")
    others = df.join(F.broadcast(hot.select("value_")), same, "left_anti")
    return df.join(F.broadcast(hot), same).drop("value_").unionByName(others.join(cold, same).drop("value_"))
