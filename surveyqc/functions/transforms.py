"""Functions of prep steps: transformed columns and columns made of several others."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from surveyqc.functions.columns import number

DATE_PARTS = {
    "day of month": F.dayofmonth, "day of week": lambda c: F.weekday(c) + 1, "day of year": F.dayofyear, "date": F.to_date, "week": F.weekofyear,
    "month": F.month, "year": F.year, "quarter": F.quarter, "hour": F.hour, "minute": F.minute, "second": F.second,
}
ROUNDING = {"floor": F.floor, "ceil": F.ceil, "round": lambda c: F.round(c, 0), "absolute": F.abs}
TEXT = {"trim": F.trim, "lower": F.lower, "upper": F.upper, "to number": number}

# The date forms that are tried, in this order; the first that all values have is used.
DATE_FORMS = (
    (r"^\d{1,2}[a-zA-Z]{3}\d{4} \d{2}:\d{2}:\d{2}$", "dMMMyyyy HH:mm:ss"),
    (r"^\d{1,2}-[a-zA-Z]{3}-\d{4} \d{2}:\d{2}:\d{2}$", "d-MMM-yyyy HH:mm:ss"),
    (r"^\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}$", "yyyy-MM-dd HH:mm:ss"),
    (r"^\d{1,2}/\d{1,2}/\d{4} \d{2}:\d{2}:\d{2}$", "M/d/yyyy HH:mm:ss"),
    (r"^\d{1,2}/\d{1,2}/\d{4} \d{2}:\d{2}:\d{2}$", "d/M/yyyy HH:mm:ss"),
    (r"^\d{4}-\d{2}-\d{2}$", "yyyy-MM-dd"),
    (r"^\d{1,2}/\d{1,2}/\d{4}$", "M/d/yyyy"),
    (r"^\d{1,2}-\d{1,2}-\d{4}$", "d-M-yyyy"),
)
#: Further forms, tried after those.
MORE_DATE_FORMS = (
    (r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}$", "yyyy-MM-dd'T'HH:mm:ss"),
    (r"^[A-Z][a-z]{2} \d{2}, \d{4}$", "MMM dd, yyyy"),
    (r"^[A-Z][a-z]{2} \d{2}, \d{4} \d{2}:\d{2}:\d{2}$", "MMM dd, yyyy HH:mm:ss"),
    (r"^\d{1,2}[a-zA-Z]{3}\d{4}$", "dMMMyyyy"),
)


def arithmetic(column: str, operation: str, value: float) -> Column:
    c, v = F.col(column), F.lit(value)
    return {"add": c + v, "subtract": c - v, "multiply": c * v, "divide": F.try_divide(c.cast("double"), v.cast("double"))}[operation]


def replace_first(column: str, pattern: str, new: str) -> Column:
    """The first match of a regular expression is replaced."""
    return F.regexp_replace(column, f"(?s)^(.*?)(?:{pattern})", "$1" + new.replace("\\", "\\\\").replace("$", "\\$"))


def substring(column: str, start: int, end: int) -> Column:
    """Characters start to end - 1, counted from 0."""
    return F.substring(column, start + 1, end - start)


def extract(column: str, pattern: str) -> Column:
    """Group 1 of the first match, else null."""
    re.compile(pattern)
    return F.when(F.regexp_like(column, F.lit(pattern)), F.regexp_extract(column, pattern, 1))


def parse_dates(df: DataFrame, column: str) -> DataFrame:
    """Texts of one of the known forms to timestamps; the first form that all non-null values have and are dates in; else an error.

    So day/month/year with a time is reached where a day over 12 shows that it isn't month/day/year.
    """
    forms = DATE_FORMS + MORE_DATE_FORMS
    has = lambda p, f: F.regexp_like(column, F.lit(p)) & F.try_to_timestamp(F.col(column), F.lit(f)).isNotNull()
    tests = [F.coalesce(F.bool_and(F.when(F.col(column).isNotNull(), has(p, f))), F.lit(True)).alias(str(i)) for i, (p, f) in enumerate(forms)]
    fits = df.agg(*tests).first()
    form = next((f for i, (_, f) in enumerate(forms) if fits[i]), None)
    if form is None:
        raise ValueError(f"{column}: no known date form fits all values")
    return df.withColumn(column, F.try_to_timestamp(F.col(column), F.lit(form)))


def dummies(df: DataFrame, column: str, most: int = 100) -> DataFrame:
    """One 0/1 column for each value, named column_value, instead of the column. More than `most` values are an error."""
    values = sorted(r[0] for r in df.select(F.col(column).cast("string")).where(F.col(column).isNotNull()).distinct().limit(most + 1).collect())
    if len(values) > most:
        raise ValueError(f"{column} has over {most} values")
    return df.withColumns({f"{column}_{v}": F.coalesce(F.col(column).cast("string") == v, F.lit(False)).cast("byte") for v in values}).drop(column)


def across(method: str, names: Sequence[str]) -> Column:
    """A value of several columns of a row. Nulls are ignored by sum, mean, min, max, median, std and var."""
    cells = F.array(*[F.col(n).cast("double") for n in names])
    full = F.array_compact(cells)
    n = F.size(full)
    total = F.aggregate(full, F.lit(0.0), lambda a, x: a + x)
    mean = F.try_divide(total, n.cast("double"))
    var = F.when(n > 1, F.aggregate(full, F.lit(0.0), lambda a, x: a + (x - mean) * (x - mean)) / (n - 1))
    ordered = F.sort_array(full)
    middle = F.when(n > 0, (F.get(ordered, F.floor((n - 1) / 2).cast("int")) + F.get(ordered, F.floor(n / 2).cast("int"))) / 2)
    if method in ("quotient", "diff") and len(names) != 2:
        raise ValueError(f"{method} takes two columns")
    first = lambda: cells.getItem(0)
    made = {
        "sum": lambda: total, "mean": lambda: mean, "min": lambda: F.array_min(full), "max": lambda: F.array_max(full),
        "median": lambda: middle, "var": lambda: var, "std": lambda: F.sqrt(var),
        "first": first, "last": lambda: cells.getItem(len(names) - 1), "count": lambda: F.lit(len(names)), "count_non_null": lambda: n, "nunique": lambda: F.size(F.array_distinct(cells)),
        "product": lambda: F.aggregate(cells, F.lit(1.0), lambda a, x: a * x), "quotient": lambda: F.try_divide(cells.getItem(0), cells.getItem(1)), "diff": lambda: cells.getItem(0) - cells.getItem(1),
        "mode": lambda: _mode(full),
    }
    return made[method]()


def _mode(full: Column) -> Column:
    """The most frequent value, the smallest of several."""
    counted = F.transform(F.array_distinct(full), lambda v: F.struct(F.size(F.filter(full, lambda x: x == v)).alias("n"), (-v).alias("low")))
    return -F.array_max(counted)["low"]


def strip(column: str, characters: str) -> Column:
    return F.btrim(F.col(column), F.lit(characters))


def clean_label(column: str | Column) -> Column:
    """Tags out, white space to one space, trimmed."""
    c = F.col(column) if isinstance(column, str) else column
    return F.trim(F.regexp_replace(F.regexp_replace(c, r"<[^>]*>", " "), r"\s+", " "))


def days_between(later: str, earlier: str) -> Column:
    return F.date_diff(F.to_date(later), F.to_date(earlier))
