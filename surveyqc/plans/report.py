"""The quality report of a survey as one tidy table, and the refresh of a dataset."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from surveyqc.functions.columns import percent
from surveyqc.functions.shared import written
from surveyqc.operators import corrections, missing, outliers, summary
from surveyqc.plans.prep import Step, apply_prep
from surveyqc.sources.forms import incremental_append


def refresh(stored: DataFrame, fresh: DataFrame, date: str, steps: Sequence[Step], log: DataFrame, key: str) -> DataFrame:
    """stored and what is newer in fresh, prepared and corrected: one lazy plan."""
    return corrections.apply_corrections(apply_prep(incremental_append(stored, fresh, date), steps), log, key)


def counts_by_id(survey: DataFrame, codes: Mapping[str, Sequence[str]], cells: Sequence[str], bounds: Mapping[str, outliers.Bounds], as_of: str) -> DataFrame:
    """survey_id, enumerator and all counts of the report that add up: one pass over the survey."""
    kept = survey.select("survey_id", "enumerator", "survey_date", "consent", "outcome", outliers.breaches(bounds).alias("breaches"), *[F.col(c).alias(f"code_{c}") for c in cells])
    rows = missing.missing_encode(kept, codes, [f"code_{c}" for c in cells])
    spans = {k: tests[0] for k, tests in summary.period_tests("survey_date", as_of).items()}
    broken = lambda k: F.size(F.filter("breaches", lambda b: F.get(b["breached"], F.lit(0)) == k if k else F.size(b["breached"]) > 0))
    counts = {"n": F.count("*"), **{k: F.count_if(test) for k, test in spans.items()}}
    counts |= {"consenting": F.count_if(F.col("consent") == "yes"), "completed": F.count_if(F.col("outcome") == "complete")}
    counts |= {"missing": F.sum(sum(((F.col(f"code_{c}") > 0).cast("int") for c in cells), F.lit(0)))}
    counts |= {"broken": F.sum(broken(None))} | {k: F.sum(broken(k)) for k in ("hard_min", "soft_min", "soft_max", "hard_max")}
    return rows.groupBy("survey_id", "enumerator").agg(*[c.alias(k) for k, c in counts.items()])


def quality_report(survey: DataFrame, visits: DataFrame, codes: Mapping[str, Sequence[str]], cells: Sequence[str], bounds: Mapping[str, outliers.Bounds], as_of: str) -> DataFrame:
    """check_name, metric, value of all configured checks of a survey.

    The survey is read twice: once for counts by id and enumerator, of which all metrics but the outliers' are sums, and once for those.
    """
    by_id = written(counts_by_id(survey, codes, cells, bounds, as_of), "report-counts")
    sums = [c for c in by_id.columns if c not in ("survey_id", "enumerator")]
    staff = by_id.groupBy("enumerator").agg(*[F.sum(c).alias(c) for c in sums])
    active = F.count_if((F.col("week") > 0) & F.col("enumerator").isNotNull()).alias("active")
    one = staff.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in sums], F.count("*").alias("enumerators"), active)
    ids = by_id.groupBy("survey_id").agg(F.sum("n").alias("n"))
    repeated, missing_id = F.sum(F.when((F.col("n") > 1) & F.col("survey_id").isNotNull(), F.col("n")).otherwise(0)), F.sum(F.when(F.col("survey_id").isNull(), F.col("n")).otherwise(0))
    one = one.crossJoin(ids.agg(*[F.coalesce(c, F.lit(0)).alias(k) for k, c in (("duplicate_rows", repeated), ("missing_id", missing_id))]))  # one row each
    one = one.crossJoin(outliers.outlier_metrics_of(survey, ["age", "income", "duration"], "enumerator").withColumnRenamed("total", "outliers")).crossJoin(visits.agg(F.count("*").alias("backchecks")))
    n = F.col("n")
    metrics = {
        "summary": {"total": n, "today": F.col("today"), "week": F.col("week"), "month": F.col("month")},
        "progress": {"consent_pct": percent(F.col("consenting"), n), "completed_pct": percent(F.col("completed"), n)},
        "missing": {"mean_missing_pct": percent(F.col("missing"), n * len(cells))},
        "duplicates": {c: F.col(c) for c in ("duplicate_rows", "missing_id")},
        "outliers": {"total": F.col("outliers")} | {c: F.col(c) for c in ("columns_checked", "columns_with", "enumerators_with")},
        "constraints": {"total": F.col("broken")} | {c: F.col(c) for c in ("hard_min", "soft_min", "soft_max", "hard_max")},
        "enumerators": {"enumerators": F.col("enumerators"), "active": F.col("active")},
        "backchecks": {"backchecks": F.col("backchecks"), "coverage_pct": percent(F.col("backchecks"), n)},
    }
    told = [F.struct(F.lit(check).alias("check_name"), F.lit(k).alias("metric"), c.cast("double").alias("value")) for check, own in metrics.items() for k, c in own.items()]
    return one.select(F.explode(F.array(*told)).alias("m")).select("m.*")


#: The same report for DuckDB, over the tables of plans.fixtures.
SQL = """
WITH m AS (
SELECT 'summary' AS check_name, {{'total': count(*), 'today': count(*) FILTER (survey_date > {day} - 1 AND survey_date <= {day}), 'week': count(*) FILTER (survey_date > {day} - 7 AND survey_date <= {day}), 'month': count(*) FILTER (survey_date > DATE '2001-07-01' AND survey_date <= {day})}}::MAP(VARCHAR, DOUBLE) AS v FROM survey
UNION ALL SELECT 'progress', {{'consent_pct': count(*) FILTER (consent = 'yes') * 100.0::DOUBLE / count(*), 'completed_pct': count(*) FILTER (outcome = 'complete') * 100.0::DOUBLE / count(*)}}::MAP(VARCHAR, DOUBLE) FROM survey
UNION ALL SELECT 'missing', {{'mean_missing_pct': avg({cells}) * 100 / 4}}::MAP(VARCHAR, DOUBLE) FROM coded
UNION ALL SELECT 'duplicates', {{'duplicate_rows': sum(n), 'missing_id': 0}}::MAP(VARCHAR, DOUBLE) FROM (SELECT count(*) AS n FROM survey GROUP BY survey_id HAVING n > 1)
UNION ALL SELECT 'outliers', {{'columns_checked': count(DISTINCT column_name), 'columns_with': count(DISTINCT column_name) FILTER (reason <> 'no outlier'), 'total': count(*) FILTER (reason <> 'no outlier'), 'enumerators_with': count(DISTINCT enumerator) FILTER (reason <> 'no outlier')}}::MAP(VARCHAR, DOUBLE) FROM {flags}
UNION ALL SELECT 'constraints', {{'total': count(*), 'hard_min': count(*) FILTER (b[1] = 'hard_min'), 'soft_min': count(*) FILTER (b[1] = 'soft_min'), 'soft_max': count(*) FILTER (b[1] = 'soft_max'), 'hard_max': count(*) FILTER (b[1] = 'hard_max')}}::MAP(VARCHAR, DOUBLE) FROM {broken} WHERE len(b) > 0
UNION ALL SELECT 'enumerators', {{'enumerators': count(DISTINCT enumerator), 'active': count(DISTINCT enumerator) FILTER (survey_date > {day} - 7 AND survey_date <= {day})}}::MAP(VARCHAR, DOUBLE) FROM survey
UNION ALL SELECT 'backchecks', {{'backchecks': (SELECT count(*) FROM visits), 'coverage_pct': (SELECT count(*) FROM visits) * 100.0::DOUBLE / count(*)}}::MAP(VARCHAR, DOUBLE) FROM survey)
SELECT check_name, e.key AS metric, e.value AS value FROM (SELECT check_name, unnest(map_entries(v)) AS e FROM m)
"""
