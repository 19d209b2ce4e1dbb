"""Running results within groups of any size: a segmented scan over range-sorted parts, instead of a window over a whole group."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from surveyqc.functions.shared import written


def segmented_scan(
    df: DataFrame,
    by: Sequence[str],
    order: Sequence[str],
    carries: Mapping[str, Callable[[Column], Column]],
    over_parts: Mapping[str, Callable[[WindowSpec, WindowSpec], Column]],
    results: Mapping[str, Callable[[WindowSpec, WindowSpec], Column]],
    parts: int | None = None,
) -> DataFrame:
    """df with `results`, computed along `order` within `by`.

    Rows are dealt by ranges of (by, order), so that a group of any size lies in many parts. A part's carry is an aggregate of its
    rows (`carries`, given the rows' order as a struct); `over_parts` are windows over the parts of a group before and after a part, a row
    a part; only groups that lie in several parts have them, at most two for each part, so they are broadcast. `results` are windows
    over the rows of a part up to the row and from the row on, beside the carries, which are null where a group lies in one part.
    Nulls come first; a null group is a group; equal rows are in any order. Null results need no carry.
    """
    n = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = written(df.repartitionByRange(n, *[F.asc_nulls_first(c) for c in (*by, *order)]).withColumn("part_", F.spark_partition_id()), "scan-parts")
    key = F.struct(*by)
    at = F.struct(*order)
    ends = dealt.groupBy(key.alias("by_"), "part_").agg(*[make(at).alias(name) for name, make in carries.items()])
    whole = Window.partitionBy("by_")
    before = whole.orderBy("part_").rowsBetween(Window.unboundedPreceding, -1)
    after = whole.orderBy("part_").rowsBetween(1, Window.unboundedFollowing)
    several = ends.withColumn("parts_", F.count("*").over(whole)).where("parts_ > 1")
    told = several.select("by_", F.col("part_").alias("of_"), *[make(before, after).alias(name) for name, make in over_parts.items()])
    rows = dealt.join(F.broadcast(told), (F.col("part_") == F.col("of_")) & key.eqNullSafe(F.col("by_")), "left")
    own = Window.partitionBy("part_", *by).orderBy(*[F.asc_nulls_first(c) for c in order])
    upto = own.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    on = own.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    return rows.withColumns({name: make(upto, on) for name, make in results.items()}).select(*dict.fromkeys([*df.columns, *results]))


def fill_both_ways(df: DataFrame, by: Sequence[str], order: Sequence[str], names: Sequence[str], parts: int | None = None) -> DataFrame:
    """df with columns filled forward, then backward, within a group."""
    when = lambda n, at: F.when(F.col(n).isNotNull(), at)
    carries = {f"last_{n}": lambda at, n=n: F.max_by(n, when(n, at)) for n in names} | {f"first_{n}": lambda at, n=n: F.min_by(n, when(n, at)) for n in names}
    over = {f"before_{n}": lambda b, a, n=n: F.last(f"last_{n}", True).over(b) for n in names} | {f"after_{n}": lambda b, a, n=n: F.first(f"first_{n}", True).over(a) for n in names}
    filled = {n: lambda u, o, n=n: F.coalesce(F.last(n, True).over(u), F.col(f"before_{n}"), F.first(n, True).over(o), F.col(f"after_{n}")) for n in names}
    return segmented_scan(df, by, order, carries, over, filled, parts)


def running_sum(df: DataFrame, by: Sequence[str], order: Sequence[str], value: str, name: str, parts: int | None = None) -> DataFrame:
    """df with the sum of the value over the rows of a group so far; null until the first value."""
    so_far = lambda u, o: F.when(F.col("before_").isNull(), F.sum(value).over(u)).otherwise(F.col("before_") + F.coalesce(F.sum(value).over(u), F.lit(0)))
    return segmented_scan(df, by, order, {"sum_": lambda at: F.sum(value)}, {"before_": lambda b, a: F.sum("sum_").over(b)}, {name: so_far}, parts)
