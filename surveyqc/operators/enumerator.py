"""Enumerator performance."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from surveyqc.functions.columns import all_of, long_form, n_unique, percent
from surveyqc.functions.periods import period_label, period_labels, period_start
from surveyqc.functions.quantiles import quantiles, with_quantiles
from surveyqc.functions.scans import running_sum
from surveyqc.operators.missing import missing_encode

STATS = ("count", "min", "mean", "median", "max", "std", "p25", "p75")


def consent_outcome_flags(df: DataFrame, consent: str | None, consent_values: Sequence[Any], outcome: str | None, outcome_values: Sequence[Any]) -> DataFrame:
    """0/1 columns consent_flag and outcome_flag; 1 where no column is set."""
    flag = lambda c, values: F.coalesce(F.col(c).isin(*values), F.lit(False)).cast("int") if c else F.lit(1)
    return df.withColumns({"consent_flag": flag(consent, consent_values), "outcome_flag": flag(outcome, outcome_values)})


def enumerator_overview(df: DataFrame, date: str, enumerator: str, as_of: str, team: str | None = None) -> DataFrame:
    """Rows, enumerators, teams, enumerators of the last 7 days and their %, rows per enumerator and active day (truncated)."""
    day = F.to_date(date)
    active = F.when((day > F.date_sub(F.lit(as_of).cast("date"), 7)) & (day <= F.lit(as_of).cast("date")), F.col(enumerator))
    all_ = df.agg(F.count("*").alias("submissions"), n_unique(enumerator).alias("enumerators"), (n_unique(team) if team else F.lit(None).cast("long")).alias("teams"), F.count_distinct(active).alias("active"))
    daily = df.groupBy(day, enumerator).agg(F.count("*").alias("n")).agg(*[f("n").cast("long").alias(f"{k}_per_day") for k, f in (("min", F.min), ("max", F.max), ("mean", F.avg))])
    return all_.crossJoin(daily).withColumn("active_pct", percent(F.col("active"), F.col("enumerators")))  # one row each


def _missing_shares(df: DataFrame, codes: Mapping[str, Sequence[str]], names: Sequence[str]) -> list[Column]:
    kinds = {"null": 1} | {label: i + 2 for i, label in enumerate(codes)}
    share = lambda test: F.avg(sum((test(F.col(f"code_{n}")).cast("int") for n in names), F.lit(0)) * 100.0 / len(names))
    return [*[share(lambda c, k=k: c == k).alias(f"pct_{label}") for label, k in kinds.items()], share(lambda c: c > 0).alias("pct_missing")]


def enumerator_missing(df: DataFrame, codes: Mapping[str, Sequence[str]], by: Sequence[str], names: Sequence[str]) -> DataFrame:
    """Mean % of null, coded and all missing cells by enumerator or team."""
    coded = missing_encode(df.select(*by, *[F.col(n).alias(f"code_{n}") for n in names]), codes, [f"code_{n}" for n in names])
    return coded.groupBy(*by).agg(*_missing_shares(coded, codes, names))


def enumerator_summary(df: DataFrame, date: str, by: Sequence[str], as_of: str, formversion: str, duration: str, codes: Mapping[str, Sequence[str]], names: Sequence[str]) -> DataFrame:
    """First and last date, rows of all, today, this week and month, active days, % missing, durations, form versions, consent and completion.

    df has consent_flag and outcome_flag. An outdated form is one below the newest of its day.
    """
    day, now = F.to_date(date), F.lit(as_of).cast("date")
    newest = df.groupBy(day.alias("day_")).agg(F.max(formversion).alias("newest_"))
    kept = df.select("*", day.alias("day_"), *[F.col(n).alias(f"code_{n}") for n in names])
    rows = missing_encode(kept, codes, [f"code_{n}" for n in names]).join(newest, "day_", "left")
    d = F.col(duration)
    found = rows.groupBy(*by).agg(
        F.min("day_").alias("first_date"), F.max("day_").alias("last_date"), F.count("*").alias("submissions"), n_unique("day_").alias("active_days"),
        F.count_if(F.col("day_") == now).alias("today"), F.count_if((F.col("day_") >= period_start(now, "Week")) & (F.col("day_") <= now)).alias("this_week"), F.count_if((F.col("day_") >= period_start(now, "Month")) & (F.col("day_") <= now)).alias("this_month"),
        _missing_shares(rows, codes, names)[-1], F.min(d).alias("min_duration"), F.avg(d).alias("mean_duration"), F.max(d).alias("max_duration"),
        n_unique(formversion).alias("form_versions"), F.max(formversion).alias("latest_form"), F.count_if(F.col(formversion) < F.col("newest_")).alias("outdated_forms"),
        F.avg("consent_flag").alias("mean_consent"), F.avg("outcome_flag").alias("mean_completion"),
    )
    return with_quantiles(found, df, by, duration, {"median_duration": 0.5})


def staff_productivity(df: DataFrame, date: str, by: Sequence[str], period: str = "Week", first: str = "Monday", most: int = 1000, between: tuple[str, str] | None = None) -> DataFrame:
    """Rows by staff and period, one column a period, 0 where there are none: of the periods that have rows, or of all between two dates.

    Serves enumerators and back-checkers.
    """
    labels = period_labels(df, date, period, first, most, between)
    dated = df.where(F.col(date).isNotNull()).select(*by, period_label(date, period, first).alias("period_"))
    return dated.groupBy(*by).pivot("period_", labels).agg(F.count(F.lit(1))).fillna(0)


_QUANTILES = {"median": 0.5, "p25": 0.25, "p75": 0.75}


def _stat(column: str, stat: str) -> Column:
    c = F.col(column)
    made = {"count": F.count, "min": F.min, "mean": F.avg, "max": F.max, "std": F.stddev_samp, "missing": lambda c: F.avg(c.isNull().cast("double")) * 100}
    return made[stat](c)


def enumerator_statistics(df: DataFrame, by: Sequence[str], names: Sequence[str], stats: Sequence[str] = STATS) -> DataFrame:
    ordered = {s: q for s, q in _QUANTILES.items() if s in stats}
    plain = df.groupBy(*by).agg(F.count("*").alias("rows_"), *[_stat(n, s).alias(f"{n}_{s}") for n in names for s in stats if s not in ordered])
    if ordered:
        found = quantiles(long_form(df, by, names), [*by, "column_name"], "value", ordered)
        wide = found.groupBy(*[F.col(b).alias(f"{b}__") for b in by]).agg(*[F.max(F.when(F.col("column_name") == n, F.col(s))).alias(f"{n}_{s}") for n in names for s in ordered])
        plain = plain.join(wide, all_of([F.col(b).eqNullSafe(F.col(f"{b}__")) for b in by]), "left")
    return plain.select(*by, *[f"{n}_{s}" for n in names for s in stats])


def enumerator_statistics_overtime(df: DataFrame, date: str, by: Sequence[str], column: str, stat: str, period: str = "Month", first: str = "Monday", most: int = 1000, between: tuple[str, str] | None = None) -> DataFrame:
    """One statistic of one column by group, one column a period, null where there is nothing: of the periods that have rows, or of all between two dates."""
    periods = period_labels(df, date, period, first, most, between)
    dated = df.where(F.col(date).isNotNull()).withColumn("period_", period_label(date, period, first))
    if stat not in _QUANTILES:
        return dated.groupBy(*by).pivot("period_", periods).agg(_stat(column, stat))
    told = with_quantiles(dated.groupBy(*by, "period_").agg(F.count("*").alias("rows_")), dated, [*by, "period_"], column, {"told_": _QUANTILES[stat]})
    return told.groupBy(*by).pivot("period_", periods).agg(F.max("told_"))


def enumerator_duration_zscore(df: DataFrame, enumerator: str, duration: str) -> DataFrame:
    """Mean duration and its distance from the mean over enumerators, in their standard deviations."""
    by = df.groupBy(enumerator).agg(F.avg(duration).alias("mean_duration"))
    return by.crossJoin(by.agg(F.avg("mean_duration").alias("m_"), F.stddev_samp("mean_duration").alias("s_"))).select(enumerator, "mean_duration", F.try_divide(F.col("mean_duration") - F.col("m_"), F.col("s_")).alias("zscore"))  # one row


def enumerator_consent_rate(df: DataFrame, enumerator: str, consent: str, values: Sequence[Any]) -> DataFrame:
    return df.groupBy(enumerator).agg(F.count("*").alias("persons"), F.count_if(F.col(consent).isin(*values)).alias("consenting")).withColumn("consent_pct", percent(F.col("consenting"), F.col("persons")))


def interviews_per_enumerator_day(df: DataFrame, enumerator: str, date: str) -> DataFrame:
    """Rows per active day of each enumerator, beside the mean over enumerators and days."""
    daily = df.groupBy(enumerator, F.to_date(date).alias("day_")).agg(F.count("*").alias("n"))
    by = daily.groupBy(enumerator).agg(F.sum("n").alias("interviews"), F.count("*").alias("days"), F.avg("n").alias("per_day"))
    return by.crossJoin(daily.agg(F.avg("n").alias("overall_per_day")))  # one row


def daily_max_over(df: DataFrame, date: str, column: str, name: str = "daily_max") -> DataFrame:
    most = df.groupBy(F.to_date(date).alias("day_")).agg(F.max(column).alias(name))
    return df.withColumn("day_", F.to_date(date)).join(most, "day_", "left").drop("day_")


def running_total(df: DataFrame, by: str, order: str, value: str, name: str = "running_total") -> DataFrame:
    """The value summed over the group's rows so far: a scan over parts, so that a group of any size spreads over tasks."""
    return running_sum(df, [by], [order], value, name)
