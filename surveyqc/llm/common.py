"""What several of the operators share: the cluster's shared folder, words of a text, Arrow batches."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import suppress
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space between words, as Java's and RE2's patterns write it.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
#: Bytes of text that a task in Python works on at once.
SLICE_BYTES = 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors see: spark.checkpoint.dir; where that is unset, one of our own in local mode and an error on a cluster."""
    sc = spark.sparkContext
    if (found := spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()) is None:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(found)
    return found.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder, read back: lineage is cut and a lost executor costs nothing."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def give_back() -> None:
    """Returns freed memory to the system: a Python worker lives on after its task, beside others and the executor's heap."""
    pa.default_memory_pool().release_unused()
    with suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def slices(batch: pa.RecordBatch, column: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with about `most` bytes of text each (a longer text stands alone)."""
    size = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0), dtype=np.int64)
    if not len(size):
        return
    cuts = np.flatnonzero(np.diff(np.cumsum(size) // most)) + 1
    for a, b in pairwise([0, *cuts.tolist(), len(size)]):
        yield batch.slice(a, b - a)
        give_back()


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words of the texts one after another, and where each text's words begin (one entry more at the end)."""
    lists = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
    flat, edges = lists.flatten(), np.asarray(lists.offsets, dtype=np.int64)
    edges = edges - edges[0]
    full = np.asarray(pc.greater(pc.binary_length(flat), 0))
    if full.all():
        return flat, edges
    return flat.filter(pa.array(full)), np.concatenate([[0], np.cumsum(full)])[edges]


def text_table(df: DataFrame, key: str = "doc_id") -> DataFrame:
    """Only the key and the text: columns with clashing names go no further."""
    return df.select(F.col(key), text_or_empty().alias("text"))


#: Rows, and bytes of their texts, lists and maps, that are sent to every executor at most; more are shuffled.
BROADCAST_ROWS, BROADCAST_BYTES = 200_000, 32 << 20


def small_or_shuffled(rows: DataFrame) -> DataFrame:
    """rows (a written table) marked for broadcast if its counted rows and bytes allow it, else as it is."""
    if rows.count() > BROADCAST_ROWS:
        return rows
    wide = [c for c, kind in rows.dtypes if kind in ("string", "binary") or kind.startswith(("array", "map", "struct"))]
    if wide and (rows.agg(F.sum(F.octet_length(F.to_json(F.struct(*wide))))).first()[0] or 0) > BROADCAST_BYTES:
        return rows
    return F.broadcast(rows)
