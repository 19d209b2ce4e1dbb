"""Missing values: cells coded as present (0), null (1) or one of the user's missing codes (2 ...)."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from surveyqc.functions.columns import percent


def missing_encode(df: DataFrame, codes: Mapping[str, Sequence[str]], names: Sequence[str] | None = None) -> DataFrame:
    """Cells to 0, 1 or the place of their label + 2; later labels win. Codes are read in the column's type, dates only have nulls."""
    coded = []
    for f in df.schema.fields:
        if names is not None and f.name not in names:
            coded.append(F.col(f.name))
            continue
        c, value = F.col(f.name), F.when(F.col(f.name).isNull(), 1)
        if not isinstance(f.dataType, (T.DateType, T.TimestampType, T.TimestampNTZType, T.BooleanType)):
            for i, (_, texts) in reversed(list(enumerate(codes.items()))):
                typed = [F.lit(t).try_cast(f.dataType) for t in texts]
                value = value.when(F.coalesce(c.isin(*typed), F.lit(False)), i + 2)
        coded.append(value.otherwise(0).cast("int").alias(f.name))
    return df.select(*coded)


def _shares(coded: DataFrame, names: Sequence[str]) -> list:
    return [F.avg((F.col(n) > 0).cast("double")).alias(n) for n in names]


def missing_summary(coded: DataFrame, names: Sequence[str]) -> DataFrame:
    """Mean % missing of columns; % of columns that are all, partly and never missing."""
    one = coded.agg(*_shares(coded, names))
    shares = F.array(*names)
    part = lambda test: percent(F.size(F.filter(shares, test)), F.lit(len(names)))
    mean = F.aggregate(shares, F.lit(0.0), lambda a, x: a + F.coalesce(x, F.lit(0.0))) * 100 / len(names)
    return one.select(mean.alias("mean_missing_pct"), part(lambda x: x == 1).alias("all_missing_pct"), part(lambda x: x > 0).alias("any_missing_pct"), part(lambda x: x == 0).alias("none_missing_pct"))


def missing_by_column(coded: DataFrame, names: Sequence[str], labels: Sequence[str]) -> DataFrame:
    """column_name; counts and % of nulls, of each label and of all missing."""
    kinds = {"null": 1} | {label: i + 2 for i, label in enumerate(labels)}
    # One row a column: counts are made before the cells are turned.
    wide = coded.agg(F.count("*").alias("rows_"), *[F.count_if(F.col(n) == k).alias(f"{n}|{k}") for n in names for k in kinds.values()])
    parts = [F.struct(F.lit(n).alias("column_name"), *[F.col(f"`{n}|{k}`").alias(f"n_{label}") for label, k in kinds.items()]) for n in names]
    rows = wide.select("rows_", F.explode(F.array(*parts)).alias("p")).select("rows_", "p.*")
    total = sum((F.col(f"n_{k}") for k in kinds), F.lit(0))
    counted = rows.withColumn("n_missing", total.cast("long"))
    return counted.select("column_name", *[c for k in [*kinds, "missing"] for c in (F.col(f"n_{k}"), percent(F.col(f"n_{k}"), F.col("rows_")).alias(f"pct_{k}"))])


def missing_by_column_filtered(by_column: DataFrame, threshold: float) -> DataFrame:
    """Columns with at least that % missing, and the least and the highest % among them."""
    some = by_column.where(F.col("pct_missing") >= threshold)
    return some.crossJoin(some.agg(F.min("pct_missing").alias("least_pct"), F.max("pct_missing").alias("highest_pct")))  # one row


def missing_over_time(coded: DataFrame, names: Sequence[str], date: str) -> DataFrame:
    """coded keeps its date column: missing cells of a day's cells, in %."""
    cells = sum(((F.col(n) > 0).cast("int") for n in names), F.lit(0))
    return coded.groupBy(F.to_date(date).alias("date")).agg(percent(F.sum(cells), F.count("*") * len(names)).alias("missing_pct")).orderBy("date")


def missing_compare(coded: DataFrame, names: Sequence[str], group: str) -> DataFrame:
    """coded keeps its group column: rows of the group, their % of all, % missing of each column."""
    by = coded.groupBy(group).agg(F.count("*").alias("n"), *[(F.avg((F.col(n) > 0).cast("double")) * 100).alias(f"pct_{n}") for n in names])
    return by.crossJoin(by.agg(F.sum("n").alias("all_"))).select(group, "n", percent(F.col("n"), F.col("all_")).alias("pct_rows"), *[f"pct_{n}" for n in names])


def nullity_patterns(coded: DataFrame, names: Sequence[str]) -> DataFrame:
    """bits (which of the columns are missing, 63 to a number), n: rows of each pattern."""
    words = [names[i : i + 63] for i in range(0, len(names), 63)]
    packed = [reduce(lambda a, b: a.bitwiseOR(b), [F.when(F.col(c) > 0, F.lit(1 << i)).otherwise(F.lit(0)).cast("long") for i, c in enumerate(own)]) for own in words]
    return coded.select(F.array(*packed).alias("bits")).groupBy("bits").agg(F.count("*").alias("n"))


def nullity_correlation(coded: DataFrame, names: Sequence[str]) -> DataFrame:
    """column_1, column_2, correlation of the 0/1 indicators, for each pair once; null where an indicator never varies.

    Rows are packed to patterns of missing columns and counted by pattern. How many rows lack both of two columns comes from the bit
    planes of the distinct patterns: one product of matrices a task, whose cells Spark sums.
    """
    k = len(names)

    def both(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        exact = np.zeros((k, k), np.int64)
        for batch in batches:
            for low in range(0, batch.num_rows, 4096):
                part = batch.slice(low, 4096)
                words = np.asarray(part.column("bits").flatten()).reshape(part.num_rows, -1)
                planes = np.concatenate([words[:, i // 63] >> (i % 63) & 1 for i in range(k)]).reshape(k, -1).astype(np.float64)
                n = np.asarray(part.column("n"))
                for shift in (0, 24, 48):  # sums of products stay below 2 ** 53
                    exact += (planes @ (planes * (n >> shift & 0xFFFFFF)).T).astype(np.int64) << shift
        a, b = np.triu_indices(k)
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(exact[a, b])], ["a", "b", "n"])

    pairs = nullity_patterns(coded, names).mapInArrow(both, "a long, b long, n long").groupBy("a", "b").agg(F.sum("n").alias("n"))
    single = pairs.where("a = b")  # a row a column
    rows = coded.agg(F.count("*").cast("double").alias("rows_"))
    one = lambda end: F.broadcast(single.select(F.col("a").alias(end), F.col("n").cast("double").alias(f"n_{end}")))
    told = pairs.where("a < b").join(one("a"), "a").join(one("b"), "b").crossJoin(rows)
    spread = F.sqrt(F.col("n_a") * (F.col("rows_") - F.col("n_a"))) * F.sqrt(F.col("n_b") * (F.col("rows_") - F.col("n_b")))
    name = lambda c: F.element_at(F.array(*map(F.lit, names)), F.col(c).cast("int") + 1)
    return told.select(name("b").alias("column_1"), name("a").alias("column_2"), F.when(spread > 0, (F.col("rows_") * F.col("n") - F.col("n_a") * F.col("n_b")) / spread).alias("correlation"))


def partially_missing_columns(coded: DataFrame, names: Sequence[str]) -> DataFrame:
    one = coded.agg(*_shares(coded, names))
    parts = [F.struct(F.lit(n).alias("column_name"), F.col(n).alias("share")) for n in names]
    return one.select(F.explode(F.array(*parts)).alias("p")).select("p.*").where("share > 0 AND share < 1").select("column_name")


def nullity_matrix(coded: DataFrame, names: Sequence[str], ids: Sequence[str] = ()) -> DataFrame:
    return coded.select(*ids, *[(F.col(n) > 0).cast("int").alias(n) for n in names])
