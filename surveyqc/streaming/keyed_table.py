"""A table with one row a key that batches are merged into: buckets of keys, rewritten only where a batch touches them.

Under the folder, data/v=<batch>/bucket=<b> holds the buckets that a batch has rewritten, and manifest/v=<batch> says for each bucket
which batch holds its newest rows. A batch reads the manifest before its own, so merging it again writes the same again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

_MANIFEST = "bucket int, written long, v long"


def _newest(df: DataFrame, key: str, time: str | None) -> DataFrame:
    """The row of each key with the latest time, ties by all columns: the same however rows are dealt over batches."""
    row = F.struct(*[time] if time else [], *[c for c in df.columns if c != time])
    return df.groupBy(F.col(key).alias("key_")).agg(F.max(row).alias("row_")).select("row_.*").select(*df.columns)


def _bucket(key: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def _manifest(spark: SparkSession, folder: str, version: int) -> dict[int, int]:
    """The batch that wrote each bucket last: a row a bucket."""
    rows = spark.read.schema(_MANIFEST).parquet(f"{folder}/manifest").where(F.col("v") == version)
    return {r["bucket"]: r["written"] for r in rows.collect()}


def _rows(spark: SparkSession, folder: str, schema: StructType, written: dict[int, int]) -> DataFrame:
    if not written:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*[f"{folder}/data/v={v}/bucket={b}" for b, v in sorted(written.items())])


def merge(batch: DataFrame, folder: str, number: int, key: str, time: str | None = None, buckets: int = 64) -> None:
    """Merges the number-th batch (from 0): of a key's rows, stored and new, the latest stays. Only buckets with a new row are read and written.

    A null time is before all others; a null key is a key; an empty batch changes nothing. All batches have one schema, one number of buckets.
    """
    spark = batch.sparkSession
    fresh = _newest(batch, key, time).withColumn("bucket", _bucket(key, buckets))
    touched = {r["bucket"] for r in fresh.select("bucket").distinct().collect()}  # at most `buckets`
    written = _manifest(spark, folder, number - 1) if number else {}
    old = _rows(spark, folder, batch.schema, {b: v for b, v in written.items() if b in touched}).withColumn("bucket", _bucket(key, buckets))
    if touched:
        both = _newest(old.unionByName(fresh), key, time)
        both.repartition(min(len(touched), buckets), "bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{folder}/data/v={number}")
    rows = sorted((written | dict.fromkeys(touched, number)).items())
    spark.createDataFrame(rows, "bucket int, written long").coalesce(1).write.mode("overwrite").parquet(f"{folder}/manifest/v={number}")


def read(spark: SparkSession, folder: str, schema: StructType | str) -> DataFrame:
    """The rows of all keys as of the last batch."""
    last = spark.read.schema(_MANIFEST).parquet(f"{folder}/manifest").agg(F.max("v")).first()[0]
    kind = schema if isinstance(schema, StructType) else StructType.fromDDL(schema)
    return _rows(spark, folder, kind, _manifest(spark, folder, last) if last is not None else {})
