"""Exact quantiles of groups of any size, without a group in one task."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from surveyqc.functions.shared import written

RULES = ("linear", "midpoint", "nearest", "lower", "higher")


def _fused(a: Column, b: Column, c: Column) -> Column:
    """a * b + c of doubles that are not null, rounded once."""
    return F.java_method(F.lit("java.lang.Math"), F.lit("fma"), a, b, c).cast("double")


def quantiles(df: DataFrame, by: Sequence[str], value: str, at: Mapping[str, float], rule: str = "linear", weight: str | None = None) -> DataFrame:
    """`by` and a column for each quantile in `at` of the double column `value`; without `by` one row, null if there are no values.

    The rank q * (n - 1) lies between two values: `linear` weighs them (as SQL's quantile_cont to the last bit: the lower value's
    product is fused with the sum), `midpoint` takes their mean, `nearest` the closer one (of two as close the higher), `lower`
    and `higher` one of them. Nulls don't count; groups without values have no row; a null group
    is a group. Equal values are counted first and the counts are dealt by ranges of group and value, so that a group of any size
    lies in many parts. Sums over the parts' groups give each value its rank, and a group's task sees but the values asked for.
    weight: a column with the rows that each row stands for, where df has been counted already.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {', '.join(RULES)}")
    group = F.struct(*[F.col(b) for b in by]) if by else F.struct(F.lit(0).alias("all_"))
    rows = F.lit(1).cast("long") if weight is None else F.col(weight)
    counted = df.where(F.col(value).isNotNull()).select(group.alias("g_"), F.col(value).cast("double").alias("v_"), rows.alias("w_")).groupBy("g_", "v_").agg(F.sum("w_").alias("c_"))
    dealt = written(counted.repartitionByRange("g_", "v_").withColumn("part_", F.spark_partition_id()), "value-counts")
    sizes = dealt.groupBy("g_", "part_").agg(F.sum("c_").alias("s_"))
    whole = Window.partitionBy("g_")  # a row a part of the group
    offsets = sizes.select("g_", "part_", (F.sum("s_").over(whole.orderBy("part_")) - F.col("s_")).alias("before_"), (F.sum("s_").over(whole) - 1).alias("last_"))
    # The ranks that a value holds are over first_ to upto_.
    upto = F.sum("c_").over(Window.partitionBy("g_", "part_").orderBy("v_"))
    ranked = dealt.withColumn("own_", upto).join(offsets, ["g_", "part_"]).withColumn("upto_", F.col("before_") + F.col("own_") - 1).withColumn("first_", F.col("before_") + F.col("own_") - F.col("c_"))
    position = {name: F.col("last_") * F.lit(float(q)) for name, q in at.items()}

    def holds(rank: Column) -> Column:
        return rank.between(F.col("first_"), F.col("upto_"))

    asked = F.exists(F.array(*[f(p) for p in position.values() for f in (F.floor, F.ceil)]), holds)
    ends = [F.max(F.when(holds(f(p)), F.col("v_"))).alias(f"{end}_{name}") for name, p in position.items() for end, f in (("low", F.floor), ("high", F.ceil))]
    rows = ranked.where(asked)
    found = (rows.groupBy("g_") if by else rows.groupBy()).agg(F.max("last_").alias("last_"), *ends)

    def told(name: str) -> Column:
        low, high, p = F.col(f"low_{name}"), F.col(f"high_{name}"), position[name]
        share = p - F.floor(p)
        told_by = {
            "linear": F.when(low == high, low).when(low.isNotNull(), _fused(low, F.ceil(p) - p, share * high)), "midpoint": (low + high) / 2,
            "nearest": F.when(share < 0.5, low).otherwise(high), "lower": low, "higher": high,
        }
        return told_by[rule].alias(name)

    return found.select(*[F.col(f"g_.{b}").alias(b) for b in by], *[told(name) for name in at])


def with_quantiles(stats: DataFrame, df: DataFrame, by: Sequence[str], value: str, at: Mapping[str, float], rule: str = "linear", weight: str | None = None) -> DataFrame:
    """stats (a row a group) and the quantiles of df's values by the same groups."""
    found = quantiles(df, by, value, at, rule, weight)
    if not by:
        return stats.crossJoin(found)  # one row each
    renamed = found.select(*[F.col(b).alias(f"{b}__") for b in by], *at)
    same = [stats[b].eqNullSafe(F.col(f"{b}__")) for b in by]
    return stats.join(renamed, same, "left").drop(*[f"{b}__" for b in by])
