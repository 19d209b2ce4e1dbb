"""A training corpus from raw documents, in five stages.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; all but the last return the columns of
documents. run() writes each stage as Parquet in the shared folder and reads it again, so a lost executor repeats one stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from surveyqc.llm import decontamination, packing, rules, secrets, simhash
from surveyqc.llm.common import table, written
from surveyqc.llm.queries import tokenizer_path

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rule or a risk-controlled cutoff rejects go."""
    return rules.keep(docs, table(spark, sf_dir, "labels")).select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest doc_id stays."""
    return simhash.deduplicate(docs).select(*COLUMNS)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of the benchmark go."""
    return decontamination.decontaminate(docs, table(spark, sf_dir, "benchmark")).select(*COLUMNS)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Values of live-looking secrets are replaced, also where a few sources or copies of one text hold them; every document stays."""
    return secrets.redact(docs, max_owners=secrets.SEVERAL_OWNERS, by_text=True).select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each token piece of each document lies in which sequence."""
    return packing.pack(docs, tokenizer_path())


STAGES = [("quality_rules", quality_rules), ("simhash_near_dedup", near_dedup), ("benchmark_decontamination", decontaminate), ("secret_scans", redact_secrets), ("best_fit_packing", pack)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
