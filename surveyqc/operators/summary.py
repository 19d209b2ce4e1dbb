"""Submission summary: counts by period, progress against a target, data quality."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from surveyqc.functions.columns import column_types, n_unique, percent
from surveyqc.functions.periods import auto_period, period_label, period_labels, period_start


def period_tests(date: str, as_of: str) -> dict[str, tuple[Column, Column]]:
    """Whether a row is of the day, the last 7 days, the last month; and of the one before that."""
    day, now = F.to_date(date), F.lit(as_of).cast("date")
    spans = {"today": (F.date_sub(now, 1), F.date_sub(now, 2)), "week": (F.date_sub(now, 7), F.date_sub(now, 14)), "month": (F.add_months(now, -1), F.add_months(now, -2))}
    return {k: ((day > a) & (day <= now), (day > b) & (day <= a)) for k, (a, b) in spans.items()}


def submission_metrics(df: DataFrame, date: str, as_of: str) -> DataFrame:
    """First and last date; rows of the day, the last 7 days and the last month with their change in %; all rows."""
    day, spans = F.to_date(date), period_tests(date, as_of)
    counts = [F.count_if(test).alias(name) for k, tests in spans.items() for name, test in zip((k, f"before_{k}"), tests, strict=True)]
    found = df.agg(F.min(day).alias("first_date"), F.max(day).alias("last_date"), F.count("*").alias("total"), *counts)
    change = [F.coalesce(percent(F.col(k) - F.col(f"before_{k}"), F.col(f"before_{k}")), F.lit(0.0)).alias(f"{k}_change") for k in spans]
    return found.select("first_date", "last_date", "total", *spans, *change)


def submissions_by_date(df: DataFrame, date: str) -> DataFrame:
    return df.groupBy(F.to_date(date).alias("date")).agg(F.count("*").alias("submissions")).orderBy("date")


def progress_metrics(df: DataFrame, date: str, target: int | None = None) -> DataFrame:
    """Rows, % of the target, mean rows of the days, weeks and months that have any."""
    each = [F.try_divide(F.count(date), F.count_distinct(period_start(date, p))).alias(f"per_{p.lower()}") for p in ("Day", "Week", "Month")]
    return df.agg(F.count("*").alias("submissions"), percent(F.count("*"), F.lit(target)).alias("target_pct"), *each)


def progress_by_column(df: DataFrame, date: str, column: str, period: str = "Auto", first: str = "Monday", most: int = 1000, between: tuple[str, str] | None = None) -> DataFrame:
    """Rows by category and period, one column a period (0 where there are none): of the periods that have rows, or of all between two dates."""
    if period == "Auto":
        a, b = df.agg(F.min(F.to_date(date)), F.max(F.to_date(date))).first()
        period = auto_period((b - a).days + 1 if a else 0)
    labels = period_labels(df, date, period, first, most, between)
    dated = df.where(F.col(date).isNotNull()).withColumn("period_", period_label(date, period, first))
    return dated.groupBy(column).pivot("period_", labels).agg(F.count(F.lit(1))).fillna(0)


def data_quality_metrics(df: DataFrame, survey_id: str, outliers: DataFrame | None = None, backchecks: DataFrame | None = None) -> DataFrame:
    """% repeated ids, % null cells; % outliers of checked cells and % back-checked ids where those tables are given."""
    cells = sum((F.col(c).isNull().cast("int") for c in df.columns), F.lit(0))
    found = df.agg(
        percent(F.count("*") - n_unique(survey_id), F.count("*")).alias("duplicate_pct"),
        percent(F.sum(cells), F.count("*") * len(df.columns)).alias("missing_pct"),
    )
    if outliers is not None:
        found = found.crossJoin(outliers.agg(percent(F.count_if(F.col("reason") != "no outlier"), F.count("*")).alias("outlier_pct")))  # one row each
    if backchecks is not None:
        ids = backchecks.select(survey_id).distinct()
        checked = df.select(survey_id).distinct().join(ids.withColumn("checked_", F.lit(1)), survey_id, "left")
        found = found.crossJoin(checked.agg(percent(F.count("checked_"), F.count("*")).alias("backcheck_pct")))
    return found


def data_summary(df: DataFrame) -> dict[str, int]:
    """Number of columns of each type."""
    return {k: len(v) for k, v in column_types(df).items()}
