"""Files in, stages out."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

STAGES = ("raw", "prep", "corrected")


def scan_csv(spark: SparkSession, path: str, schema: StructType | str | None = None) -> DataFrame:
    """Header, inferred types unless a schema is given (inference reads the file once more). With a schema, rows that don't fit are kept in _corrupt_record."""
    reader = spark.read.option("header", True).option("mode", "PERMISSIVE").option("multiLine", True).option("escape", '"')
    if schema is None:
        return reader.option("inferSchema", True).csv(path)
    base = schema if isinstance(schema, StructType) else StructType.fromDDL(schema)
    return reader.option("columnNameOfCorruptRecord", "_corrupt_record").csv(path, schema=StructType([*base.fields, *StructType.fromDDL("_corrupt_record string").fields]))


def scan_json(spark: SparkSession, path: str, schema: StructType | str | None = None) -> DataFrame:
    """A JSON array of records, or one record a line where the file has no array."""
    return spark.read.option("multiLine", True).json(path, schema=schema)


def scan_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def scan_stata_many(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Many .dta files, one to a row of work; each is read by pandas in a task, columns cast to the schema."""
    fields = StructType.fromDDL(schema).fieldNames()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import io

        for batch in batches:
            for content in batch["content"]:
                yield pd.read_stata(io.BytesIO(content), convert_categoricals=False).reindex(columns=fields)

    return spark.read.format("binaryFile").load(path).select("content").repartition("content").mapInPandas(run, schema)


def stage_path(root: str, project: str, stage: str, alias: str) -> str:
    safe = re.sub(r"[^A-Za-z0-9_]+", "_", alias).strip("_")
    if not safe:
        raise ValueError(f"no usable alias: {alias!r}")
    return f"{root}/{project}/{stage}/{safe}"


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def save_stage(df: DataFrame, root: str, project: str, stage: str, alias: str) -> None:
    df.write.mode("overwrite").parquet(stage_path(root, project, stage, alias))


def load_stage(spark: SparkSession, root: str, project: str, stage: str, alias: str) -> DataFrame:
    return spark.read.parquet(stage_path(root, project, stage, alias))


def stage_exists(spark: SparkSession, root: str, project: str, stage: str, alias: str) -> bool:
    return _exists(spark, stage_path(root, project, stage, alias))


def drop_stage(spark: SparkSession, root: str, project: str, stage: str, alias: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(stage_path(root, project, stage, alias))
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def resolve_stage(spark: SparkSession, root: str, project: str, alias: str) -> DataFrame:
    """The latest stage that has rows: corrected, else prep, else raw."""
    for stage in reversed(STAGES):
        if stage_exists(spark, root, project, stage, alias) and not (found := load_stage(spark, root, project, stage, alias)).isEmpty():
            return found
    raise ValueError(f"{alias} has no stage with rows")


def delete_rows(df: DataFrame, column: str, value: object) -> DataFrame:
    """Rows whose column differs from the value (null matches a null value alone)."""
    if column not in df.columns:
        raise ValueError(f"unknown column: {column}")
    return df.where(~F.col(column).eqNullSafe(F.lit(value)))


def export_bundle(parts: dict[str, DataFrame], folder: str) -> None:
    """Each part as Parquet under the folder, one write after another."""
    for name, df in parts.items():
        df.write.mode("overwrite").parquet(f"{folder}/{name}")


def dataset_preview_metrics(df: DataFrame) -> DataFrame:
    """Rows, columns and % null cells (2 dp)."""
    nulls = sum((F.count_if(F.col(c).isNull()) for c in df.columns), F.lit(0))
    return df.agg(F.count("*").alias("rows"), F.lit(len(df.columns)).alias("columns"), F.round(F.try_divide(nulls * 100.0, F.count("*") * len(df.columns)), 2).alias("missing_pct"))


def union_all(parts: Sequence[DataFrame]) -> DataFrame:
    """Diagonal union: columns that a part lacks are null."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out
