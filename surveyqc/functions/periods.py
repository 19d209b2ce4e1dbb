"""Days, weeks with a chosen first day, months; their labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WEEKDAYS = ("Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday")


def week_start(date: Column, first: str = "Monday") -> Column:
    return F.date_sub(date, F.pmod(F.weekday(date) - WEEKDAYS.index(first), F.lit(7)))


def period_start(date: str | Column, period: str, first: str = "Monday") -> Column:
    """First date of the day, week or month."""
    day = F.to_date(F.col(date) if isinstance(date, str) else date)
    return {"Day": day, "Week": week_start(day, first), "Month": F.trunc(day, "month")}[period]


def period_label(date: str | Column, period: str, first: str = "Monday") -> Column:
    """Day "Jan 05, 2024", week "Jan 01, 2024 to Jan 07, 2024", month "January 2024"."""
    start, day = period_start(date, period, first), "MMM dd, yyyy"
    if period == "Month":
        return F.date_format(start, "MMMM yyyy")
    own = F.date_format(start, day)
    return own if period == "Day" else F.concat_ws(" to ", own, F.date_format(F.date_add(start, 6), day))


def auto_period(days: int) -> str:
    return "Day" if days < 20 else "Week" if days < 140 else "Month"


def period_labels(df: DataFrame, date: str, period: str, first: str = "Monday", most: int = 1000, between: tuple[str, str] | None = None) -> list[str]:
    """Labels in order of the periods that df has rows in, or of all periods between two dates. Over `most` are an error, not a cut."""
    if between:
        step = {"Day": "INTERVAL 1 DAY", "Week": "INTERVAL 7 DAYS", "Month": "INTERVAL 1 MONTH"}[period]
        ends = [period_start(F.lit(d).cast("date"), period, first) for d in between]
        dates = df.sparkSession.range(1).select(F.explode(F.sequence(*ends, F.expr(step))).alias("start_"))
    else:
        dates = df.where(F.col(date).isNotNull()).select(period_start(date, period, first).alias("start_")).distinct()
    rows = dates.orderBy("start_").limit(most + 1).select(period_label("start_", period, first).alias("label")).collect()
    if len(rows) > most:
        raise ValueError(f"over {most} periods")
    return [r["label"] for r in rows]
