"""Keyed corrections: a log of modified and removed values and removed rows, replayed by one join."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from surveyqc.functions.columns import dense_index

#: seq orders the entries; action is "modify value", "remove value" or "remove row".
LOG = "seq long, key string, action string, column string, new_value string, reason string"


def apply_corrections(df: DataFrame, log: DataFrame, key: str) -> DataFrame:
    """df after all entries, as if replayed in order: the last entry of a cell wins, a removed row is gone whatever else its key has.

    Entries are condensed to one row a key before the join. A new value that the column's type can't hold makes it null where
    the type is not text.
    """
    cells = log.where("action <> 'remove row'").groupBy("key", "column").agg(F.max_by(F.struct("action", "new_value"), "seq").alias("last"))
    names = [f.name for f in df.schema.fields if f.name != key]
    value = lambda n: F.max(F.when(F.col("column") == n, F.struct((F.col("last.action") == "modify value").alias("set"), F.col("last.new_value").alias("v")))).alias(f"fix_{i_of[n]}")
    i_of = {n: i for i, n in enumerate(names)}
    fixes = cells.groupBy("key").agg(*[value(n) for n in names]).withColumnRenamed("key", "key_")
    gone = log.where("action = 'remove row'").select(F.col("key").alias("key_")).distinct()
    kept = df.join(gone, F.col(key).cast("string") == F.col("key_"), "left_anti")
    joined = kept.join(fixes, F.col(key).cast("string") == F.col("key_"), "left")
    changed = [F.when(F.col(f"fix_{i_of[f.name]}").isNull(), F.col(f.name)).otherwise(F.when(F.col(f"fix_{i_of[f.name]}.set"), F.col(f"fix_{i_of[f.name]}.v").try_cast(f.dataType))).alias(f.name) if f.name != key else F.col(key) for f in df.schema.fields]
    return joined.select(*changed)


def remove_correction(log: DataFrame, position: int) -> DataFrame:
    """The log without its position-th entry (0-based, by seq); replay it with apply_corrections."""
    nth = dense_index(log, ["seq"], "nth_")
    return nth.where(F.col("nth_") != position).drop("nth_")


def validate_corrections(df: DataFrame, log: DataFrame, key: str) -> DataFrame:
    """Entries that can't be applied: seq, problem."""
    known = df.select(F.col(key).cast("string").alias("key"), F.lit(True).alias("known_")).distinct()
    columns = F.array(*[F.lit(c) for c in df.columns])
    modify = F.col("action") == "modify value"
    problem = (
        F.when(~F.col("action").isin("modify value", "remove value", "remove row"), "unknown action")
        .when(F.col("known_").isNull(), "unknown key")
        .when((F.col("action") != "remove row") & ~F.coalesce(F.array_contains(columns, F.col("column")), F.lit(False)), "unknown column")
        .when(modify & F.col("new_value").isNull(), "no new value")
    )
    return log.join(known, "key", "left").select("seq", problem.alias("problem")).where("problem IS NOT NULL")


def correction_summary(log: DataFrame) -> DataFrame:
    """Entries by action, and how many keys they are of."""
    return log.groupBy("action").agg(F.count("*").alias("entries"), F.count_distinct("key").alias("keys"))


def correction_descriptions(log: DataFrame) -> DataFrame:
    told = F.when(F.col("action") == "modify value", F.concat(F.lit("Set "), "column", F.lit(" to "), F.coalesce("new_value", F.lit("")), F.lit(" for "), "key")).when(F.col("action") == "remove value", F.concat(F.lit("Clear "), "column", F.lit(" for "), "key")).otherwise(F.concat(F.lit("Remove row "), "key"))
    return log.select("seq", "action", told.alias("description"))
