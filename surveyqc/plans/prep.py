"""Replayable preparation: a list of steps folded over a table."""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from surveyqc.functions import transforms as T
from surveyqc.operators import filters as R


@dataclass(frozen=True)
class Step:
    """An action by name with its arguments."""

    action: str
    arguments: dict[str, Any] = field(default_factory=dict)


def transform_column(df: DataFrame, column: str, function: str, value: Sequence[Any] = ()) -> DataFrame:
    """Replaces a column by a function of it."""
    if function in ("to date", "to datetime"):
        return T.parse_dates(df, column)
    if function == "dummies":
        return T.dummies(df, column)
    if function in T.DATE_PARTS:
        made = T.DATE_PARTS[function](F.col(column))
    elif function in T.ROUNDING:
        made = T.ROUNDING[function](F.col(column))
    elif function in T.TEXT:
        made = T.TEXT[function](F.col(column))
    elif function in ("add", "subtract", "multiply", "divide"):
        made = T.arithmetic(column, function, value[0])
    else:
        made = {"replace": T.replace_first, "substring": T.substring, "extract": T.extract, "strip": T.strip}[function](column, *value)
    return df.withColumn(column, made)


ACTIONS: dict[str, Callable[..., DataFrame]] = {
    "transform column": transform_column,
    "add computed": lambda df, name, method, columns: df.withColumn(name, T.across(method, columns)),
    "add constant": R.add_constant, "add index": R.add_index, "add uuid": R.add_uuid, "add random": R.add_random, "remove columns": R.remove_columns,
    "remove by index": R.remove_rows_by_index, "remove if missing": R.remove_if_missing, "remove if not missing": R.remove_if_not_missing,
    "keep equal": R.keep_equal, "keep not equal": R.keep_not_equal, "remove compared": R.remove_compared, "remove between": R.remove_between,
    "remove not between": R.remove_not_between, "remove like": R.remove_like, "remove not like": R.remove_not_like,
}


def register(name: str, action: Callable[..., DataFrame]) -> None:
    """Users' own actions: functions from a table (and arguments) to a table."""
    ACTIONS[name] = action


def apply_prep(df: DataFrame, steps: Sequence[Step]) -> DataFrame:
    for step in steps:
        df = ACTIONS[step.action](df, **step.arguments)
    return df


def apply_step(df: DataFrame, step: Step) -> tuple[DataFrame, DataFrame]:
    """The table after one step and a row of rows affected and remaining."""
    after = apply_prep(df, [step])
    counts = df.agg(F.count("*").alias("before_")).crossJoin(after.agg(F.count("*").alias("remaining")))  # one row each
    return after, counts.select((F.col("before_") - F.col("remaining")).alias("affected"), "remaining")


def apply_prep_observed(df: DataFrame, steps: Sequence[Step]) -> tuple[DataFrame, Callable[[], DataFrame]]:
    """The table after all steps, and a function that tells, once an action has run on it, what each step did: step, action, affected, remaining.

    Rows are counted as they pass, so all counts come from the pass that uses the table, whatever the number of steps.
    """
    counts = [Observation() for _ in range(len(steps) + 1)]
    df = df.observe(counts[0], F.count(F.lit(1)).alias("n"))
    for step, count in zip(steps, counts[1:], strict=True):
        df = apply_prep(df, [step]).observe(count, F.count(F.lit(1)).alias("n"))
    spark = df.sparkSession

    def told() -> DataFrame:
        n = [c.get["n"] for c in counts]
        rows = [(i, s.action, a - b, b) for i, (s, a, b) in enumerate(zip(steps, n[:-1], n[1:], strict=True))]
        return spark.createDataFrame(rows, "step int, action string, affected long, remaining long")

    return df, told


def remove_prep_step(steps: Sequence[Step], position: int) -> list[Step]:
    return [s for i, s in enumerate(steps) if i != position]


def to_json(steps: Sequence[Step]) -> str:
    return json.dumps([{"action": s.action, "arguments": s.arguments} for s in steps])


def from_json(text: str) -> list[Step]:
    return [Step(**s) for s in json.loads(text)]
