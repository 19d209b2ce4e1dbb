"""Survey-shaped tables derived from the given ones, by expressions that Spark and DuckDB read alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

AS_OF = "2001-08-01"
SURVEY = {
    "survey_key": "o_orderkey", "survey_id": "o_custkey", "survey_date": "CAST(o_orderdate AS DATE)", "enumerator": "o_custkey % 23", "team": "o_custkey % 5",
    "age": "CASE WHEN o_orderkey % 13 = 0 THEN NULL WHEN o_orderkey % 17 = 0 THEN -999 WHEN o_orderkey % 19 = 0 THEN -888 ELSE o_orderkey % 90 END",
    "income": "CASE WHEN o_orderkey % 11 = 0 THEN NULL WHEN o_orderkey % 211 = 0 THEN o_totalprice * 20 ELSE o_totalprice END",
    "children": "CASE WHEN o_orderkey % 29 = 0 THEN NULL ELSE o_orderkey % 7 END",
    "duration": "600 + o_orderkey % 3000", "formversion": "1 + o_orderkey % 3", "consent": "CASE WHEN o_orderstatus = 'F' THEN 'no' ELSE 'yes' END",
    "outcome": "CASE WHEN o_orderkey % 7 = 0 THEN 'partial' ELSE 'complete' END", "region": "o_orderpriority",
    "note": "CASE WHEN o_orderkey % 31 = 0 THEN '' WHEN o_orderkey % 37 = 0 THEN ' N/A ' WHEN o_orderkey % 41 = 0 THEN '12.5' ELSE o_orderpriority END",
}
VISITS = {
    "survey_key": "o_orderkey", "survey_id": "o_orderkey", "backchecker": "o_orderkey % 4", "backcheck_date": "CAST(o_orderdate AS DATE) + CAST(o_orderkey % 14 AS INT)",
    "income": "CASE WHEN o_orderkey % 70 = 0 THEN NULL WHEN o_orderkey % 30 = 0 THEN o_totalprice + 5 ELSE o_totalprice END",
    "children": "CASE WHEN o_orderkey % 40 = 0 THEN o_orderkey % 7 + 1 ELSE o_orderkey % 7 END",
    "region": "CASE WHEN o_orderkey % 50 = 0 THEN concat(' ', lower(o_orderpriority), '!') ELSE o_orderpriority END",
}
GPS = {
    "survey_key": "c_custkey", "cluster": "c_nationkey", "latitude": "CASE WHEN c_custkey % 101 = 0 THEN NULL ELSE 6.6e0 + (c_custkey % 100) * 5e-4 + CASE WHEN c_custkey % 97 = 0 THEN 1e0 ELSE 0e0 END END",
    "longitude": "-0.18e0 + (c_custkey % 89) * 5e-4", "gps_accuracy": "3e0 + c_custkey % 11",
}


def _sql(columns: dict[str, str], source: str) -> str:
    return f"SELECT {', '.join(f'{e} AS {c}' for c, e in columns.items())} FROM {source}"


#: For DuckDB: the same tables as common table expressions.
WITH = f"survey AS ({_sql(SURVEY, 'orders')}), visits AS ({_sql(VISITS, 'orders WHERE o_orderkey % 10 = 0')}), gps AS ({_sql(GPS, 'customer')})"


class Tables:
    """Lazy tables of a folder."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir = spark, sf_dir

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def _of(self, columns: dict[str, str], source: DataFrame) -> DataFrame:
        return source.selectExpr(*[f"{e} AS {c}" for c, e in columns.items()])

    @property
    def survey(self) -> DataFrame:
        return self._of(SURVEY, self.read("orders"))

    @property
    def visits(self) -> DataFrame:
        shifted = VISITS | {"backcheck_date": "date_add(CAST(o_orderdate AS DATE), CAST(o_orderkey % 14 AS INT))"}
        return self._of(shifted, self.read("orders").where("o_orderkey % 10 = 0"))

    @property
    def gps(self) -> DataFrame:
        return self._of(GPS, self.read("customer"))
