"""Back-checks: survey values against those of a second visit."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from surveyqc.functions.columns import percent
from surveyqc.functions.stats import normal_two_sided, signed_rank_two_sided, student_two_sided
from surveyqc.operators.duplicates import dedupe_keep

SUFFIX = "__BCCL"


@dataclass(frozen=True)
class Compared:
    """A column to compare. ok_range: ("number" | "percentage", low, high) of survey minus back-check."""

    column: str
    category: int = 1
    ok_range: tuple[str, float, float] | None = None


@dataclass(frozen=True)
class TextOptions:
    case: str | None = None
    trim: bool = False
    no_symbols: bool = False
    no_difference: tuple[str, ...] = ()
    exclude: tuple[str, ...] = ()


def backcheck_merge(survey: DataFrame, visits: DataFrame, survey_id: str) -> DataFrame:
    """Inner join on the id; columns of the visit that the survey has too get the suffix."""
    renamed = visits.select(*[F.col(c).alias(c if c == survey_id or c not in survey.columns else c + SUFFIX) for c in visits.columns])
    return survey.join(renamed, survey_id)


def normalise_text(c: Column, options: TextOptions) -> Column:
    if options.case:
        c = F.lower(c) if options.case == "lower" else F.upper(c)
    if options.trim:
        c = F.trim(c)
    return F.regexp_replace(c, r"[^\w\s]", "") if options.no_symbols else c


def match_status(survey: Column, visit: Column, options: TextOptions) -> Column:
    inside = lambda c, values: F.coalesce(c.isin(*values), F.lit(False)) if values else F.lit(False)
    return (
        F.when(inside(survey, options.exclude) | inside(visit, options.exclude), "excluded")
        .when(inside(survey, options.no_difference) & inside(visit, options.no_difference), "no_difference")
        .when(survey.isNull() | visit.isNull(), "missing")
        .when(survey == visit, "match")
        .otherwise("mismatch")
    )


def numeric_difference(survey: Column, visit: Column) -> Column:
    return survey.try_cast("double") - visit.try_cast("double")


def within_ok_range(survey: Column, visit: Column, ok_range: tuple[str, float, float] | None) -> Column:
    """Whether survey minus back-check (percentage: in % of |survey|) is from low to high; null without a range."""
    if ok_range is None:
        return F.lit(None).cast("boolean")
    kind, low, high = ok_range
    difference = numeric_difference(survey, visit)
    if kind == "percentage":
        difference = F.try_divide(difference * 100, F.abs(survey.try_cast("double")))
    return difference.between(low, high)


def backcheck_compare(survey: DataFrame, visits: DataFrame, survey_id: str, survey_key: str, compared: Sequence[Compared], options: TextOptions | None = None, keep: str | None = None, order: Sequence[str] = ()) -> DataFrame:
    """One row a pair and column: id, keys, column_name, category, values as text, status, difference, within_range."""
    options = options or TextOptions()
    if keep:
        survey, visits = dedupe_keep(survey, survey_id, keep, order), dedupe_keep(visits, survey_id, keep, order)
    merged = backcheck_merge(survey, visits, survey_id)
    rows = []
    for x in compared:
        a, b = (normalise_text(F.col(c).cast("string"), options) for c in (x.column, x.column + SUFFIX))
        cell = F.struct(
            F.lit(x.column).alias("column_name"), F.lit(x.category).alias("category"), a.alias("survey_value"), b.alias("backcheck_value"),
            match_status(a, b, options).alias("status"), numeric_difference(a, b).alias("difference"), within_ok_range(a, b, x.ok_range).alias("within_range"),
        )
        rows.append(cell)
    keys = list(dict.fromkeys([survey_id, survey_key, survey_key + SUFFIX]))
    keys = [k for k in keys if k in merged.columns]
    return merged.select(*keys, F.explode(F.array(*rows)).alias("c")).select(*keys, "c.*")


def staff_attach(analysis: DataFrame, source: DataFrame, key: str, staff: str, join_key: str | None = None) -> DataFrame:
    """The staff member of each row, from the first row of its key in the source."""
    staff_of = source.groupBy(key).agg(F.min(staff).alias(staff)).withColumnRenamed(key, join_key or key)
    return analysis.join(staff_of, join_key or key, "left")


def visit_dates_attach(analysis: DataFrame, survey: DataFrame, visits: DataFrame, key: str, survey_date: str, backcheck_date: str, visit_key: str | None = None) -> DataFrame:
    """survey_date and backcheck_date of each row; the latter by the visit's own key."""
    first = survey.groupBy(key).agg(F.min(F.to_date(survey_date)).alias("survey_date"))
    second = visits.groupBy(key).agg(F.min(F.to_date(backcheck_date)).alias("backcheck_date")).withColumnRenamed(key, visit_key or key)
    return analysis.join(first, key, "left").join(second, visit_key or key, "left")


def comparison_context(details: DataFrame, survey: DataFrame, visits: DataFrame, key: str, survey_columns: Sequence[str] = (), visit_columns: Sequence[str] = (), visit_key: str | None = None) -> DataFrame:
    """More columns of both sides, named "column (Survey)" and "column (Backcheck)"."""
    first = survey.dropDuplicates([key]).select(key, *[F.col(c).alias(f"{c} (Survey)") for c in survey_columns])
    second = visits.dropDuplicates([key]).select(F.col(key).alias(visit_key or key), *[F.col(c).alias(f"{c} (Backcheck)") for c in visit_columns])
    return details.join(first, key, "left").join(second, visit_key or key, "left")


def _pairs(analysis: DataFrame) -> DataFrame:
    """column_name, s, b of pairs that are numbers on both sides."""
    return analysis.select("column_name", F.col("survey_value").try_cast("double").alias("s"), F.col("backcheck_value").try_cast("double").alias("b")).where("s IS NOT NULL AND b IS NOT NULL")


def paired_ttest(analysis: DataFrame) -> DataFrame:
    """column_name, n, mean_difference, t, p. The statistics are one aggregate; p is found from a row a column."""
    d = F.col("s") - F.col("b")
    rows = _pairs(analysis).groupBy("column_name").agg(F.count("*").alias("n"), F.avg(d).alias("m"), F.stddev_samp(d).alias("sd")).collect()  # a row a column
    made = []
    for r in rows:
        t = r["m"] / (r["sd"] / math.sqrt(r["n"])) if r["sd"] else None
        made.append((r["column_name"], r["n"], r["m"], t, student_two_sided(t, r["n"] - 1)))
    return analysis.sparkSession.createDataFrame(made, "column_name string, n long, mean_difference double, t double, p double")


def proportion_test(analysis: DataFrame) -> DataFrame:
    """column_name, n, z, p of two shares of 0/1 values; null without variance."""
    rows = _pairs(analysis).groupBy("column_name").agg(F.count("*").alias("n"), F.avg("s").alias("p1"), F.avg("b").alias("p2")).collect()  # a row a column
    made = []
    for r in rows:
        v = (r["p1"] * (1 - r["p1"]) + r["p2"] * (1 - r["p2"])) / r["n"]
        z = (r["p1"] - r["p2"]) / math.sqrt(v) if v > 0 else None
        made.append((r["column_name"], r["n"], z, normal_two_sided(z)))
    return analysis.sparkSession.createDataFrame(made, "column_name string, n long, z double, p double")


#: Differences up to which p is exact: without and with ties.
EXACT, EXACT_TIED = 50, 13


def signed_rank_test(analysis: DataFrame) -> DataFrame:
    """column_name, n (non-zero differences), w, z, p, note where the test is skipped.

    Differences are counted by size first; average ranks come from running counts of those, by column. p is exact for up to EXACT
    differences, with ties for up to EXACT_TIED; for more it is the normal approximation with tie correction.
    """
    d = F.col("s") - F.col("b")
    sizes = _pairs(analysis).where(d != 0).groupBy("column_name", F.abs(d).alias("size")).agg(F.count("*").alias("n"), F.count_if(d > 0).alias("up"))
    before = F.sum("n").over(Window.partitionBy("column_name").orderBy("size")) - F.col("n")
    ranked = sizes.withColumn("rank", before + (F.col("n") + 1) / 2)
    few = F.when(F.col("rank") + (F.col("n") - 1) / 2 <= EXACT, F.struct("rank", "n"))  # of a column with more differences only some, which go unused
    sums = ranked.groupBy("column_name").agg(F.sum("n").alias("n"), F.sum(F.col("rank") * F.col("up")).alias("up"), F.sum(F.col("rank") * (F.col("n") - F.col("up"))).alias("down"), F.sum(F.pow(F.col("n").cast("double"), 3) - F.col("n")).alias("ties"), F.collect_list(few).alias("few"))
    made = []
    for r in sums.collect():  # a row a column
        n, w = r["n"], min(r["up"], r["down"])
        v = n * (n + 1) * (2 * n + 1) / 24 - r["ties"] / 48
        z = (w - n * (n + 1) / 4) / math.sqrt(v) if v > 0 else None
        exact = n <= (EXACT_TIED if r["ties"] else EXACT)
        p = signed_rank_two_sided([round(2 * x["rank"]) for x in r["few"] for _ in range(x["n"])], w) if exact else normal_two_sided(z)
        made.append((r["column_name"], n, float(w), z, p if v > 0 else None, None if v > 0 else "differences do not vary"))
    return analysis.sparkSession.createDataFrame(made, "column_name string, n long, w double, z double, p double, note string")


def reliability(analysis: DataFrame) -> DataFrame:
    """Simple response variance (half the variance of the difference) and 1 less its share of the survey's variance."""
    found = _pairs(analysis).groupBy("column_name").agg((F.var_samp(F.col("s") - F.col("b")) / 2).alias("srv"), F.var_samp("s").alias("v_"))
    return found.select("column_name", "srv", (1 - F.try_divide("srv", "v_")).alias("reliability"))


def backcheck_summary(survey: DataFrame, visits: DataFrame, survey_id: str, enumerator: str, backchecker: str) -> DataFrame:
    first = survey.agg(F.count("*").alias("surveys"), F.count_distinct(enumerator).alias("enumerators"))
    second = visits.agg(F.count("*").alias("backchecks"), F.count_distinct(backchecker).alias("backcheckers"))
    return first.crossJoin(second).withColumn("coverage_pct", percent(F.col("backchecks"), F.col("surveys")))  # one row each


_COMPARED = "status NOT IN ('missing', 'excluded')"


def _rates(where: str = "true") -> dict[str, Column]:
    compared, wrong = F.count_if(F.expr(f"{where} AND {_COMPARED}")), F.count_if(F.expr(f"{where} AND status = 'mismatch'"))
    return {"survey_values": F.count_if(F.expr(f"{where} AND survey_value IS NOT NULL")), "backcheck_values": F.count_if(F.expr(f"{where} AND backcheck_value IS NOT NULL")), "compared": compared, "mismatches": wrong, "error_rate": F.round(percent(wrong, compared), 2)}


def staff_backcheck_stats(analysis: DataFrame, staff: str, survey_id: str, categories: Sequence[int] = (1, 2, 3)) -> DataFrame:
    """analysis with staff, survey_date and backcheck_date: checked surveys, mean days between the visits, values and error rates in all and by category."""
    days = F.date_diff("backcheck_date", "survey_date")
    once = F.first(F.struct(days.alias("d")))
    pairs = analysis.groupBy(staff, survey_id).agg(once.getField("d").alias("d")).groupBy(staff).agg(F.count("*").alias("backchecks"), F.round(F.avg("d"), 1).alias("mean_days"))
    aggs = [c.alias(k) for k, c in _rates().items()] + [c.alias(f"{k}_{n}") for n in categories for k, c in _rates(f"category = {n}").items()]
    return pairs.join(analysis.groupBy(staff).agg(*aggs), staff)


def column_backcheck_stats(analysis: DataFrame, tests: DataFrame | None = None) -> DataFrame:
    """column_name, category, values, compared, mismatches, error rate; beside the columns of tests, a row a column."""
    found = analysis.groupBy("column_name", "category").agg(*[c.alias(k) for k, c in _rates().items()])
    return found if tests is None else found.join(F.broadcast(tests), "column_name", "left")


def comparison_details(analysis: DataFrame, columns: Sequence[str] | None = None, only_mismatches: bool = True) -> DataFrame:
    rows = analysis.where("survey_value IS NOT NULL OR backcheck_value IS NOT NULL")
    rows = rows.where(F.col("column_name").isin(*columns)) if columns else rows
    return rows.where("status = 'mismatch'") if only_mismatches else rows


def compare_by_prefix(df: DataFrame, by: str, survey_prefix: str = "svy_", visit_prefix: str = "back_") -> DataFrame:
    """Columns svy_x against back_x, as trimmed text: % mismatches and % back-checked by variable and enumerator."""
    names = [c.removeprefix(survey_prefix) for c in df.columns if c.startswith(survey_prefix) and visit_prefix + c.removeprefix(survey_prefix) in df.columns]
    text = lambda c: F.trim(F.col(c).cast("string"))
    cells = df.select(by, F.explode(F.array(*[F.struct(F.lit(n).alias("variable"), text(survey_prefix + n).alias("a"), text(visit_prefix + n).alias("b")) for n in names])).alias("c")).select(by, "c.*")
    checked = F.col("b").isNotNull()
    return cells.groupBy("variable", by).agg(percent(F.count_if(checked & ~F.col("a").eqNullSafe(F.col("b"))), F.count_if(checked)).alias("mismatch_pct"), percent(F.count_if(checked), F.count("*")).alias("checked_pct"))


