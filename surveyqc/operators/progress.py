"""Progress of the survey: targets, periods, consent, attempts."""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from surveyqc.functions.columns import percent
from surveyqc.functions.periods import period_start
from surveyqc.functions.scans import fill_both_ways


def progress_summary(df: DataFrame, target: int) -> DataFrame:
    return df.agg(F.count("*").alias("submissions"), F.lit(target).alias("target"), percent(F.count("*"), F.lit(target)).alias("progress_pct"))


def progress_overtime(df: DataFrame, date: str, period: str = "Day", first: str = "Monday") -> DataFrame:
    return df.groupBy(period_start(date, period, first).alias("period")).agg(F.count("*").alias("submissions")).orderBy("period")


def average_interviews(periods: DataFrame, target: float | None = None) -> DataFrame:
    """Each period beside the mean and whether it reaches the target (else the mean)."""
    mean = periods.agg(F.avg("submissions").alias("average"))
    goal = F.col("average") if target is None else F.lit(target)
    return periods.crossJoin(mean).withColumn("reached", F.col("submissions") >= goal)  # one row


def consent_completion(df: DataFrame, consent: str, consent_values: Sequence[Any], outcome: str, outcome_values: Sequence[Any]) -> DataFrame:
    share = lambda c, v: percent(F.count_if(F.col(c).isin(*v)), F.count("*"))
    return df.agg(share(consent, consent_values).alias("consent_pct"), share(outcome, outcome_values).alias("completed_pct"))


def fill_within_id(df: DataFrame, survey_id: str, date: str, names: Sequence[str], key: str) -> DataFrame:
    """First row of each id by date (then key) with columns filled forward, then backward, within the id: each column's first value that isn't null."""
    first = [F.min_by(n, F.when(F.col(n).isNotNull(), F.struct(date, key))).alias(n) for n in names]
    return df.groupBy(survey_id).agg(*first)


def fill_over(df: DataFrame, by: str, order: Sequence[str], names: Sequence[str]) -> DataFrame:
    """df with columns filled forward, then backward, within `by`: a scan over parts, so that a group of any size spreads over tasks."""
    return fill_both_ways(df, [by], order, names)


def attempted_interviews(df: DataFrame, survey_id: str, date: str, most: int = 50) -> DataFrame:
    """Rows of each id, its last date and attempt dates 1 to n as columns. Over `most` attempts are an error, not a cut."""
    by = df.where(F.col(survey_id).isNotNull()).groupBy(survey_id).agg(F.count("*").alias("attempts"), F.max(F.to_date(date)).alias("last_date"))
    n = by.agg(F.max("attempts")).first()[0] or 0
    if n > most:
        raise ValueError(f"an id has {n} attempts, over {most}")
    dates = df.where(F.col(survey_id).isNotNull()).groupBy(survey_id).agg(F.count("*").alias("attempts"), F.max(F.to_date(date)).alias("last_date"), F.sort_array(F.collect_list(F.to_date(date))).alias("dates"))
    return dates.select(survey_id, "attempts", "last_date", *[F.get("dates", i).alias(f"attempt_{i + 1}") for i in range(n)])


def attempt_totals(attempts: DataFrame) -> DataFrame:
    return attempts.agg(F.count("*").alias("ids"), F.sum("attempts").alias("attempts"), F.min("attempts").alias("least"), F.max("attempts").alias("most"))


def attempt_distribution(df: DataFrame, survey_id: str) -> DataFrame:
    """Ids by number of attempts, and their %."""
    by = df.where(F.col(survey_id).isNotNull()).groupBy(survey_id).agg(F.count("*").alias("attempts")).groupBy("attempts").agg(F.count("*").alias("ids"))
    return by.crossJoin(by.agg(F.sum("ids").alias("all_"))).select("attempts", "ids", percent(F.col("ids"), F.col("all_")).alias("pct"))  # one row


def consent_by_unique_id(df: DataFrame, survey_id: str, consent: str) -> DataFrame:
    return df.groupBy(consent).agg(F.count_distinct(survey_id).alias("ids"))


def attempts_per_id(df: DataFrame, survey_id: str, key: str) -> DataFrame:
    return df.groupBy(survey_id).agg(F.count_distinct(key).alias("attempts")).groupBy("attempts").agg(F.count("*").alias("ids"))


def cumulative_submissions(df: DataFrame, enumerator: str, date: str) -> DataFrame:
    daily = df.groupBy(enumerator, F.to_date(date).alias("date")).agg(F.count("*").alias("submissions"))
    return daily.withColumn("cumulative", F.sum("submissions").over(Window.partitionBy(enumerator).orderBy("date").rowsBetween(Window.unboundedPreceding, Window.currentRow)))


def date_enumerator_spine(df: DataFrame, enumerator: str, date: str) -> DataFrame:
    """Every enumerator on every date that has rows: rows of the day (0 filled) and so far (carried forward)."""
    daily = df.groupBy(enumerator, F.to_date(date).alias("date")).agg(F.count("*").alias("submissions"))
    # Dates are bounded by the survey's days; a spine is what is asked for.
    spine = daily.select(enumerator).distinct().crossJoin(F.broadcast(daily.select("date").distinct()))
    full = spine.join(daily, [enumerator, "date"], "left").fillna(0, ["submissions"])
    return full.withColumn("cumulative", F.sum("submissions").over(Window.partitionBy(enumerator).orderBy("date").rowsBetween(Window.unboundedPreceding, Window.currentRow)))
