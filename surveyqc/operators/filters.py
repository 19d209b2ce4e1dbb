"""Row and column removal, conditions, look-ups. A row stays where the keep predicate is true; null drops it."""

from __future__ import annotations

import datetime
from collections.abc import Sequence
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from surveyqc.functions.columns import all_of, any_of, column_types, dense_index, match_columns, require


def remove_rows_by_index(df: DataFrame, positions: Sequence[int | str], order: Sequence[str]) -> DataFrame:
    """Removes rows by 0-based position in a declared order; "a:b" is a range with both ends."""
    spans = [(int(a), int(b or a)) for p in positions if p not in (None, ",") for a, _, b in [str(p).partition(":")]]
    at = any_of([F.col("index_").between(a, b) for a, b in spans]) if spans else F.lit(False)
    return dense_index(df, order, "index_").where(~at).drop("index_")


def remove_if_missing(df: DataFrame, names: Sequence[str]) -> DataFrame:
    return df.where(all_of([F.col(n).isNotNull() for n in names]))


def remove_if_not_missing(df: DataFrame, names: Sequence[str]) -> DataFrame:
    return df.where(any_of([F.col(n).isNull() for n in names]))


def keep_equal(df: DataFrame, names: Sequence[str], values: Sequence[Any]) -> DataFrame:
    return df.where(any_of([F.col(n).isin(*values) for n in names]))


def keep_not_equal(df: DataFrame, names: Sequence[str], values: Sequence[Any]) -> DataFrame:
    return df.where(any_of([~F.col(n).isin(*values) for n in names]))


def remove_compared(df: DataFrame, names: Sequence[str], how: str, value: Any) -> DataFrame:
    """Removes what is gt, ge, lt or le the value in all named columns."""
    keep = {"gt": lambda c: c <= value, "ge": lambda c: c < value, "lt": lambda c: c >= value, "le": lambda c: c > value}[how]
    return df.where(any_of([keep(F.col(n)) for n in names]))


def remove_between(df: DataFrame, names: Sequence[str], low: Any, high: Any) -> DataFrame:
    return df.where(any_of([~F.col(n).between(low, high) for n in names]))


def remove_not_between(df: DataFrame, names: Sequence[str], low: Any, high: Any) -> DataFrame:
    return df.where(any_of([F.col(n).between(low, high) for n in names]))


def remove_like(df: DataFrame, names: Sequence[str], pattern: str) -> DataFrame:
    """Keeps rows none of whose named columns has the pattern."""
    return df.where(all_of([~F.col(n).cast("string").rlike(pattern) for n in names]))


def remove_not_like(df: DataFrame, names: Sequence[str], pattern: str) -> DataFrame:
    return df.where(any_of([F.col(n).cast("string").rlike(pattern) for n in names]))


def numeric_condition(c: Column, how: str, value: Any) -> Column:
    """=, ≠, >, ≥, <, ≤, includes, excludes, in range; dates are compared as dates. None asks for missing values."""
    some = value[0] if isinstance(value, (list, tuple)) and value else value
    if isinstance(some, datetime.date):
        c = F.to_date(c)
    tests = {
        "=": lambda: c.isNull() if value is None else c == value, "!=": lambda: c.isNotNull() if value is None else c != value,
        ">": lambda: c > value, ">=": lambda: c >= value, "<": lambda: c < value, "<=": lambda: c <= value,
        "includes": lambda: c.isin(*value), "excludes": lambda: ~c.isin(*value), "in range": lambda: c.between(*value),
    }
    return tests[how]()


def string_condition(c: Column, how: str, value: Any) -> Column:
    """=, ≠, starts with, ends with, contains (a pattern), includes, excludes."""
    tests = {
        "=": lambda: c == value, "!=": lambda: c != value, "starts with": lambda: c.startswith(value), "ends with": lambda: c.endswith(value),
        "contains": lambda: c.rlike(value), "includes": lambda: c.isin(*value), "excludes": lambda: ~c.isin(*value),
    }
    return tests[how]()


def coerce_condition_value(df: DataFrame, column: str, value: Any) -> Any:
    """Text to the column's type: date, whole or decimal number; an error where it can't be."""
    if isinstance(value, (list, tuple)):
        return [coerce_condition_value(df, column, v) for v in value]
    if not isinstance(value, str):
        return value
    kind = df.schema[column].dataType
    if isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return datetime.date.fromisoformat(value)
    return int(value) if isinstance(kind, T.IntegralType) else float(value) if isinstance(kind, T.NumericType) else value


def filter_on_condition(df: DataFrame, column: str | None, how: str = "=", value: Any = None, or_missing: bool = False) -> DataFrame:
    """Rows that meet the condition (or_missing: or lack the value); all rows if there is no condition."""
    if column is None:
        return df
    require(df, [column])
    value = coerce_condition_value(df, column, value)
    condition = (string_condition if column in column_types(df)["string"] and value is not None else numeric_condition)(F.col(column), how, value)
    return df.where(condition | F.col(column).isNull() if or_missing else condition)


def category_filter(df: DataFrame, column: str, values: Sequence[Any]) -> DataFrame:
    return df.where(F.col(column).isin(*values)) if values else df


def nonmissing_coordinates(df: DataFrame, latitude: str, longitude: str) -> DataFrame:
    return df.where(F.col(latitude).isNotNull() & F.col(longitude).isNotNull())


def lookup_by_key(df: DataFrame, key: str, value: Any, column: str | None = None) -> DataFrame:
    rows = df.where(F.col(key) == value)
    return rows.select(column) if column else rows


def keys(df: DataFrame, key: str) -> DataFrame:
    return df.select(key).where(F.col(key).isNotNull()).distinct()


def remove_columns(df: DataFrame, names: Sequence[str]) -> DataFrame:
    require(df, names)
    return df.drop(*names)


def add_constant(df: DataFrame, name: str, text: str) -> DataFrame:
    """The text as a decimal number if it has a point, else as a whole one, else as it is."""
    try:
        value: Any = float(text) if "." in text else int(text)
    except ValueError:
        value = text
    return df.withColumn(name, F.lit(value))


def add_index(df: DataFrame, name: str, order: Sequence[str]) -> DataFrame:
    return dense_index(df, order, name)


def add_uuid(df: DataFrame, name: str, project: str, order: Sequence[str]) -> DataFrame:
    """SHA-256 of project_row, by position in a declared order."""
    return dense_index(df, order, "index_").withColumn(name, F.sha2(F.concat_ws("_", F.lit(project), "index_"), 256)).drop("index_")


def add_random(df: DataFrame, name: str, seed: int, key: str) -> DataFrame:
    """Uniform in [0, 1), the same for a key however the rows are dealt."""
    return df.withColumn(name, F.pmod(F.xxhash64(F.lit(seed), F.col(key)), F.lit(1 << 53)) / float(1 << 53))


def columns_by_pattern(df: DataFrame, pattern: str, how: str, anchored: bool = False) -> DataFrame:
    return df.select(*match_columns(df.columns, pattern, how, anchored))


def append_context_columns(result: DataFrame, df: DataFrame, key: str, names: Sequence[str]) -> DataFrame:
    """Columns of the survey beside a check's result; of a name that the result has, the result's column stays."""
    fresh = [n for n in names if n not in result.columns]
    return result.join(df.select(key, *fresh), key, "left").distinct()


def validate_key(df: DataFrame, key: str) -> DataFrame:
    found = df.agg(F.count("*").alias("rows"), F.count_if(F.col(key).isNull()).alias("nulls"), F.count(key).alias("n_"), F.count_distinct(key).alias("distinct"))
    repeats = F.col("n_") - F.col("distinct")
    return found.select("rows", "nulls", repeats.alias("repeats"), ((F.col("nulls") == 0) & (repeats == 0)).alias("valid"))
