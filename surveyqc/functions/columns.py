"""Columns by type and by name, safe casts, the long form, missing tokens."""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from surveyqc.functions.shared import written

# Texts that stand for a missing value.
MISSING_TOKENS = (
    "", "   ", "\t", "\n", "NULL", "null", "Null", "None", "none", "NONE", "N/A", "n/a", "NA", "na", "#N/A", "N/a", "-", "--", ".", "?", "???",
    "Missing", "missing", "MISSING", "Unknown", "unknown", "UNKNOWN", "NaN", "NAN", "nan", "NaT",
)


def column_types(df: DataFrame) -> dict[str, list[str]]:
    """Names of the string, integer, numeric, datetime, boolean and categorical columns; nested ones are in none."""
    found: dict[str, list[str]] = {k: [] for k in ("string", "integer", "numeric", "datetime", "boolean", "categorical")}
    for f in df.schema.fields:
        kind = f.dataType
        if isinstance(kind, T.StringType):
            found["string"].append(f.name)
        elif isinstance(kind, T.IntegralType):
            found["integer"].append(f.name)
        elif isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
            found["datetime"].append(f.name)
        elif isinstance(kind, T.BooleanType):
            found["boolean"].append(f.name)
        if isinstance(kind, T.NumericType):
            found["numeric"].append(f.name)
        if isinstance(kind, (T.StringType, T.IntegralType)):
            found["categorical"].append(f.name)
    return found


def match_columns(columns: Iterable[str], pattern: str, how: str = "exact", anchored: bool = False) -> list[str]:
    """Names that a pattern picks: exact, startswith, endswith, contains or regex (anchored: it must begin the name)."""
    tests = {
        "exact": lambda c: c == pattern,
        "startswith": lambda c: c.startswith(pattern),
        "endswith": lambda c: c.endswith(pattern),
        "contains": lambda c: pattern in c,
        "regex": lambda c: bool((re.match if anchored else re.search)(pattern, c)),
    }
    return [c for c in columns if tests[how](c)]


def require(df: DataFrame, names: Sequence[str]) -> None:
    if missing := [n for n in names if n not in df.columns]:
        raise ValueError(f"unknown columns: {missing}")


def number(column: str | Column) -> Column:
    """A double, or null where the value is no number."""
    return (F.col(column) if isinstance(column, str) else column).try_cast("double")


def safe_to_numeric(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: number(n) for n in names})


def standardize_missing(df: DataFrame, names: Sequence[str] | None = None) -> DataFrame:
    """Strings lose the white space around them; what then reads as missing, in any column, is null."""
    text = set(column_types(df)["string"])
    cleaned = {}
    for n in names or df.columns:
        value = F.regexp_replace(n, r"(?U)^\s+|\s+$", "") if n in text else F.col(n)
        cleaned[n] = F.when(value.cast("string").isin(*MISSING_TOKENS), None).otherwise(value)
    return df.withColumns(cleaned)


def long_form(df: DataFrame, ids: Sequence[str], names: Sequence[str], kind: str = "double") -> DataFrame:
    """ids, column_name, value: one row for each cell of the named columns."""
    cells = df.select(*ids, *[F.col(n).try_cast(kind).alias(n) for n in names])
    return cells.unpivot(list(ids), list(names), "column_name", "value")


def any_of(conditions: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def all_of(conditions: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions)


def percent(part: Column, whole: Column) -> Column:
    return F.try_divide(part * 100.0, whole)


def n_unique(column: str) -> Column:
    """Distinct values; null counts as one."""
    return F.count_distinct(column) + F.coalesce(F.max(F.col(column).isNull().cast("int")), F.lit(0))


def dense_index(df: DataFrame, order: Sequence[str], name: str = "index") -> DataFrame:
    """0-based row number in a declared order, without sorting in one task.

    A range sort deals the rows; the counts of the parts (as many as shuffle partitions) give their offsets. The dealt rows are
    written first: range borders are sampled, and counts and rows must come from the same ones. Ties in `order` are told apart
    by all other columns.
    """
    rest = [c for c in df.columns if c not in order]
    dealt = written(df.repartitionByRange(*order).withColumn("part_", F.spark_partition_id()), "index")
    sizes = dealt.groupBy("part_").agg(F.count("*").alias("n_"))
    offsets = sizes.withColumn("before_", F.sum("n_").over(Window.orderBy("part_")) - F.col("n_")).drop("n_")  # a row a part
    own = F.row_number().over(Window.partitionBy("part_").orderBy(*order, *rest)) - 1
    return dealt.withColumn("own_", own).join(F.broadcast(offsets), "part_").withColumn(name, (F.col("before_") + F.col("own_")).cast("long")).drop("part_", "own_", "before_")
