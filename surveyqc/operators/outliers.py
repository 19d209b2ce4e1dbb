"""Outliers by IQR or SD bounds, hard and soft constraints."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from surveyqc.functions.columns import long_form, match_columns
from surveyqc.functions.quantiles import with_quantiles
from surveyqc.functions.shared import written

MULTIPLIER = {"iqr": 1.5, "sd": 3.0}
LEAST_VALUES = {"iqr": 20, "sd": 30}


def _stats(cells: DataFrame, by: str, method: str, multiplier: float | None, rule: str) -> DataFrame:
    m, v = MULTIPLIER[method] if multiplier is None else multiplier, F.col("value")
    plain = cells.groupBy(by).agg(F.count(v).alias("n"), F.min(v).alias("min"), F.max(v).alias("max"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("sd"))
    found = with_quantiles(plain, cells, [by], "value", {"q1_": 0.25, "median": 0.5, "q3_": 0.75}, rule)
    q1, q3, mean, sd = map(F.col, ("q1_", "q3_", "mean", "sd"))
    low, high = (q1 - m * (q3 - q1), q3 + m * (q3 - q1)) if method == "iqr" else (mean - m * sd, mean + m * sd)
    return found.select(by, "n", "min", "max", "mean", "median", "sd", (q3 - q1).alias("iqr"), low.alias("lower"), high.alias("upper"))


def outlier_stats(df: DataFrame, names: Sequence[str], method: str = "iqr", multiplier: float | None = None, rule: str = "linear") -> DataFrame:
    """column_name, n, min, max, mean, median, sd, iqr, lower, upper; all null for columns without values. rule: see `quantiles`."""
    return _stats(long_form(df, [], names), "column_name", method, multiplier, rule)


@F.udf(StringType(), useArrow=False)
def _two_places(x: float | None) -> str | None:
    """As C's printf: by the double's exact value, where format_string rounds its shortest decimal form (753026.315 lies below its half)."""
    return None if x is None else f"{x:.2f}"


def _flagged(cells: DataFrame, stats: DataFrame, by: str, least: int) -> DataFrame:
    # stats has a row for each checked column, so that its bounds are written out once.
    told = {f"{side}_told_": F.concat(F.lit(f"{'below lower' if side == 'lower' else 'above upper'} bound "), _two_places(side)) for side in ("lower", "upper")}
    reason = F.when(F.col("n") < least, "no outlier").when(F.col("value") < F.col("lower"), F.col("lower_told_")).when(F.col("value") > F.col("upper"), F.col("upper_told_")).otherwise("no outlier")
    return cells.where("value IS NOT NULL").join(F.broadcast(stats.withColumns(told)), by).withColumn("reason", reason).drop(*told)


def outlier_flags(df: DataFrame, ids: Sequence[str], names: Sequence[str], method: str = "iqr", multiplier: float | None = None, least: int | None = None, rule: str = "linear") -> DataFrame:
    """ids, column_name, value, the column's statistics and the reason; no flags with fewer than `least` values."""
    stats = outlier_stats(df, names, method, multiplier, rule)
    return _flagged(long_form(df, ids, names), stats, "column_name", LEAST_VALUES[method] if least is None else least)


def outlier_flags_grouped(df: DataFrame, ids: Sequence[str], groups: Mapping[str, Sequence[str]], method: str = "iqr", multiplier: float | None = None, least: int | None = None, rule: str = "linear") -> DataFrame:
    """As outlier_flags, with statistics pooled over the columns of each group."""
    of = {n: g for g, names in groups.items() for n in names}
    mapped = F.create_map(*[F.lit(x) for pair in of.items() for x in pair])
    cells = long_form(df, ids, list(of)).withColumn("group_name", F.element_at(mapped, F.col("column_name")))
    stats = _stats(cells, "group_name", method, multiplier, rule)
    return _flagged(cells, stats, "group_name", LEAST_VALUES[method] if least is None else least)


def variable_groups(columns: Sequence[str], pattern: str = r"^(.*?)_?\d+$") -> dict[str, list[str]]:
    """Columns whose names differ by a number at the end, by their common prefix."""
    import re

    found: dict[str, list[str]] = {}
    for c in match_columns(columns, pattern, "regex"):
        found.setdefault(re.match(pattern, c)[1], []).append(c)
    return {k: v for k, v in found.items() if len(v) > 1}


@dataclass(frozen=True)
class Bounds:
    hard_min: float | None = None
    soft_min: float | None = None
    soft_max: float | None = None
    hard_max: float | None = None

    def __post_init__(self) -> None:
        given = [x for x in (self.hard_min, self.soft_min, self.soft_max, self.hard_max) if x is not None]
        if given != sorted(given):
            raise ValueError("bounds must not fall from hard_min to hard_max")


_BROKEN = {"hard_min": lambda v, b: v < b, "soft_min": lambda v, b: v < b, "soft_max": lambda v, b: v > b, "hard_max": lambda v, b: v > b}


def breaches(bounds: Mapping[str, Bounds]) -> Column:
    """A row's array of (column_name, value, breached), one for each checked column."""
    rows = []
    for n, b in bounds.items():
        v = F.col(n).try_cast("double")
        broken = [F.when(test(v, F.lit(getattr(b, k))), F.lit(k)) for k, test in _BROKEN.items() if getattr(b, k) is not None]
        rows.append(F.struct(F.lit(n).alias("column_name"), v.alias("value"), F.array_compact(F.array(*broken)).cast("array<string>").alias("breached")))
    return F.array(*rows)


def constraint_violations(df: DataFrame, ids: Sequence[str], bounds: Mapping[str, Bounds]) -> DataFrame:
    """ids, column_name, value, reason (the first bound broken of hard_min, soft_min, soft_max, hard_max), breached (all of them)."""
    cells = df.select(*ids, F.explode(breaches(bounds)).alias("c")).select(*ids, "c.*")
    return cells.where(F.size("breached") > 0).withColumn("reason", F.get("breached", 0))


def violation_type(reason: str | Column) -> Column:
    c = F.col(reason) if isinstance(reason, str) else reason
    return F.when(c == "hard_min", "Hard Min").when(c == "soft_min", "Soft Min").when(c == "soft_max", "Soft Max").when(c == "hard_max", "Hard Max")


def constraint_metrics(violations: DataFrame, columns_checked: int) -> DataFrame:
    return violations.agg(F.lit(columns_checked).alias("columns_checked"), F.count("*").alias("total"), *[F.count_if(F.col("reason") == k).alias(k) for k in _BROKEN])


def outlier_metrics(flags: DataFrame, enumerator: str) -> DataFrame:
    out = F.col("reason") != "no outlier"
    return flags.agg(
        F.count_distinct("column_name").alias("columns_checked"), F.count_distinct(F.when(out, F.col("column_name"))).alias("columns_with"),
        F.count_if(out).alias("total"), F.count_distinct(F.when(out, F.col(enumerator))).alias("enumerators_with"),
    )


def outlier_metrics_of(df: DataFrame, names: Sequence[str], enumerator: str, multiplier: float | None = None, least: int | None = None) -> DataFrame:
    """outlier_metrics of a table's columns by the IQR rule, in one pass: values are counted by enumerator, and all else comes from the counts."""
    m, few = MULTIPLIER["iqr"] if multiplier is None else multiplier, LEAST_VALUES["iqr"] if least is None else least
    cells = long_form(df, [enumerator], names).where("value IS NOT NULL")
    counted = written(cells.groupBy(enumerator, "column_name", "value").agg(F.count("*").alias("rows_")), "value-counts")
    fences = with_quantiles(counted.groupBy("column_name").agg(F.sum("rows_").alias("n_")), counted, ["column_name"], "value", {"q1_": 0.25, "q3_": 0.75}, weight="rows_")
    spread = m * (F.col("q3_") - F.col("q1_"))
    fences = fences.select("column_name", "n_", (F.col("q1_") - spread).alias("low_"), (F.col("q3_") + spread).alias("high_"))
    out = (F.col("n_") >= few) & ((F.col("value") < F.col("low_")) | (F.col("value") > F.col("high_")))
    judged = counted.join(F.broadcast(fences), "column_name").groupBy("column_name", enumerator).agg(F.sum(F.when(out, F.col("rows_")).otherwise(0)).alias("out_"))
    some = F.col("out_") > 0
    return judged.agg(
        F.count_distinct("column_name").alias("columns_checked"), F.count_distinct(F.when(some, F.col("column_name"))).alias("columns_with"),
        F.coalesce(F.sum("out_"), F.lit(0)).alias("total"), F.count_distinct(F.when(some, F.col(enumerator))).alias("enumerators_with"),
    )


def column_outlier_summary(flags: DataFrame, key: str) -> DataFrame:
    """column_name, values, outliers and the column's statistics; a key counts once for a column."""
    once = flags.dropDuplicates(["column_name", key])
    stats = ["min", "max", "mean", "median", "sd", "iqr", "lower", "upper"]
    return once.groupBy("column_name").agg(F.count("*").alias("n_values"), F.count_if(F.col("reason") != "no outlier").alias("n_outliers"), *[F.max(s).alias(s) for s in stats])


def inspect_column(df: DataFrame, column: str, rule: str = "linear") -> DataFrame:
    cells = df.select(F.col(column).try_cast("double").alias("value"))
    v = F.col("value")
    plain = cells.agg(F.count(v).alias("n"), F.count_if(v.isNull()).alias("nulls"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("sd"), F.min(v).alias("min"), F.max(v).alias("max"))
    return with_quantiles(plain, cells, [], "value", {"q1": 0.25, "median": 0.5, "q3": 0.75}, rule).select("n", "nulls", "mean", "sd", "min", "q1", "median", "q3", "max")


def outlier_admin_join(flags: DataFrame, df: DataFrame, key: str, roles: Sequence[str]) -> DataFrame:
    """Each row's role columns beside all outlier results of its key, also where keys repeat; without repeats, cheaper is to give roles as ids to outlier_flags."""
    return df.select(key, *roles).join(flags, key, "left")
